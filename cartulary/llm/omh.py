"""Near-duplicate documents by Order MinHash.

A document's k-mers of words are labelled with their occurrence number. Under
each of SKETCHES hash functions its two smallest labelled k-mers are kept in
text order; documents that agree in one such sequence are candidates, which
takes similar content in a similar order. Documents of equal words are one
before anything is compared. In a bucket of candidates every document meets the
bucket's hub only, the document that shares buckets with the most others. Where
that leaves a bucket's documents in more than one class, documents that agree in
two sketches are compared across classes, if they are at most GROUP. The
documents of larger groups meet the group's hub and are then joined exactly, by
prefix filtering of their k-mers: in rounds the documents of a k-mer meet in random
parts and are labelled anew, until few pairs of different classes are left, and
these are all compared. So a link is missed only if its documents agree in fewer than two
sketches and are not both in such groups, or if it lies inside a class. Pairs are verified by the Jaccard similarity of their k-mers and by
the distance of a banded alignment of their words; both must reach SIMILARITY.
Classes are the connected components of verified links.

A pair at Jaccard 0.8 agrees in a sketch with probability of about 0.64, so in
one of 8 with 0.9997 and in two with 0.99.

Defined cases: documents without words (null and empty texts too) are classes of
their own; documents of fewer than K words have no k-mers and match only equal
words; repeated rows share a class; of rows of one doc_id with different texts each
is in the class of its own text; a null doc_id is no document, other ids must be
integers; no documents give no rows; a class is named by its smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.batches import as_lists, bound_batches, free, numbered, pieces, texts_of
from cartulary.llm.components import components
from cartulary.llm.words import hash_words, mix, shingles
from cartulary.session import cut, forget, settle, ship

K, SKETCHES, SIMILARITY = 5, 8, 0.8
#: Documents of a group that are compared with each other; those of larger groups are joined by their k-mers.
GROUP = 32
SLICE_BYTES = 1 << 20
#: Rows of a crowded k-mer that meet in a round, about.
PART = 128
#: Pairs of different classes for each row of crowded k-mers that are listed without more rounds, and the share of them
#: that a round may leave for another one to follow. No class depends on either.
FEW, SLOW = 4, 0.75
#: Slots in which k-mers of crowded groups are counted, to tell rare ones from common ones.
SLOTS = 1 << 15
#: Cells of alignment bands that are filled at once.
CELLS = 1 << 17
#: Words of one side that alignments hold at once.
WORDS = 1 << 20
#: Identifiers of candidates that may be broadcast to fetch their texts; beyond it the texts are shuffled.
BROADCAST_IDS = 1_000_000
#: Pairs that are verified together, so that alignments of like size share their steps.
PAIRS = 2048
_SEEDS = mix(np.arange(1, 2 * SKETCHES + 1, dtype=np.uint64))


def occurrence(kmers: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How many equal k-mers stand before each in its document."""
    key = mix(kmers + mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.append(True, ranked[1:] != ranked[:-1]) if len(ranked) else np.zeros(0, bool)
    place = np.arange(len(ranked))
    out = np.empty(len(ranked), np.uint64)
    out[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return out


def sketch(kmers: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Documents x SKETCHES: the hash of each function's two smallest labelled k-mers in text order; rows of counts < 2 are 0."""
    out = np.zeros((len(counts), SKETCHES), np.uint64)
    doc = np.repeat(np.arange(len(counts)), counts)
    fit = counts >= 2
    kmers, doc = kmers[fit[doc]], doc[fit[doc]]
    if not len(kmers):
        return out
    own = np.flatnonzero(fit)
    doc = np.searchsorted(own, doc)
    starts = np.append(0, np.cumsum(counts[own]))[:-1]
    labelled = mix(kmers + occurrence(kmers, doc) * np.uint64(0x9E3779B97F4A7C15))
    for i in range(SKETCHES):
        value = (labelled ^ _SEEDS[2 * i]) * (_SEEDS[2 * i + 1] | np.uint64(1))
        value ^= value >> np.uint64(32)
        spots = []
        for _ in range(2):
            least = np.minimum.reduceat(value, starts)
            at = np.flatnonzero(value == least[doc])
            at = at[np.append(True, doc[at][1:] != doc[at][:-1])]
            spots.append(at)
            value[at] = np.iinfo(np.uint64).max
        first, last = np.minimum(*spots), np.maximum(*spots)
        out[own, i] = mix(kmers[first] * np.uint64(0xD1B54A32D192ED03) + mix(kmers[last]) + np.uint64(i))
    return out


def fingerprints(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of all words of each text in their order; 0 where there are none."""
    n = np.diff(starts)
    place = np.arange(len(hashes)) - np.repeat(starts[:-1], n)
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(mix(hashes + mix(place.astype(np.uint64))), dtype=np.uint64))
    return np.where(n > 0, mix(sums[starts[1:]] - sums[starts[:-1]]) | np.uint64(1), np.uint64(0))


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, t (hash of the row's text), same (hash of all words; 0 if none) and sketch (array of bucket values), as a table."""
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", SLICE_BYTES):
                hashes, starts = hash_words(texts_of(batch, "text"))
                n = np.diff(starts)
                doc = np.repeat(np.arange(len(n)), n)
                inside = np.arange(len(hashes)) <= (starts[1:] - K)[doc]
                found = shingles(hashes, K)
                kmers = np.append(found, np.zeros(len(hashes) - len(found), np.uint64))[inside]
                values = sketch(kmers, np.maximum(n - K + 1, 0))
                has = n - K + 1 >= 2
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("t"),
                        pa.array(fingerprints(hashes, starts).view(np.int64)),
                        as_lists(values[has].view(np.int64).ravel(), np.where(has, SKETCHES, 0), pa.int64()),
                    ],
                    ["doc_id", "t", "same", "sketch"],
                )

    own = docs.select(numbered(docs, doc_id).alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("t"), F.col(f"`{text}`").alias("text")).where("doc_id IS NOT NULL")
    return cut(own.mapInArrow(run, "doc_id long, t long, same long, sketch array<long>"), "sketches")


def words_of(docs: DataFrame, known: DataFrame, ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id (the hash of a text's words) and words (packed 32-bit hashes) of the rows of docs that ids names, as a table.

    known: doc_id and t of all rows; ids: doc_id and t, each once. Texts are hashed again rather than kept with their
    sketches: most documents are in no pair.
    """
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    count = ids.count()
    twice = known.join(ids, ["doc_id", "t"], "left_semi").count() > count  # equal rows of one doc_id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", SLICE_BYTES):
                hashes, starts = hash_words(texts_of(batch, "text"))
                short = hashes.astype(np.uint32)
                words = [short[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(fingerprints(hashes, starts).view(np.int64)), pa.array(words, pa.binary())], ["doc_id", "words"])

    own = docs.select(numbered(docs, doc_id).alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("t"), F.col(f"`{text}`").alias("text"))
    own = own.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, ["doc_id", "t"], "left_semi").select("text")
    found = own.mapInArrow(run, "doc_id long, words binary")
    return cut(found.dropDuplicates(["doc_id"]) if twice else found, "words")


def distances(left: list[np.ndarray], right: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Edit distances of word sequences where they are at most `most`, else more than that.

    Bands are tried from narrow to wide: a distance that fits its band is exact,
    only pairs beyond go on, so a pair costs its length times its own distance.
    """
    most = np.asarray(most, np.int64)
    out = most + 1
    n, m = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
    pending = np.flatnonzero(np.abs(n - m) <= most)
    limit = np.maximum(np.abs(n - m), np.maximum(4, np.maximum(n, m) // 64))
    while len(pending):
        limit[pending] = np.minimum(limit[pending], most[pending])
        band = (limit + np.abs(m - n)) // 2 + 1
        order = pending[np.lexsort((n[pending], band[pending]))]
        at = 0
        while at < len(order):
            end = at + 1
            longest = max(n[order[at]], m[order[at]])
            while end < len(order) and n[order[end]] <= 2 * n[order[at]] + 64 and (end - at + 1) * (2 * band[order[end]] + 1) <= CELLS:
                longest = max(longest, n[order[end]], m[order[end]])
                if (end - at + 1) * longest > WORDS:
                    break
                end += 1
            group = order[at:end]
            out[group] = _band([left[i] for i in group], [right[i] for i in group], int(band[group].max()))
            at = end
        pending = pending[(out[pending] > limit[pending]) & (limit[pending] < most[pending])]
        limit[pending] *= 2
    return np.where(out <= most, out, most + 1)


def _band(left: list[np.ndarray], right: list[np.ndarray], width: int) -> np.ndarray:
    """Distances along alignments that stay within so many diagonals of the main one; cells past an end never reach a result."""
    n, m = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    rows, size = int(n.max(initial=0)), 2 * width + 1
    a = np.zeros((len(left), rows), np.uint32)
    b = np.zeros((len(left), max(rows, int(m.max(initial=0))) + size + 1), np.uint32)  # column j of b is place j - width
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        a[i, : len(x)] = x
        b[i, width : width + len(y)] = y
    offset = np.arange(-width, width + 1)
    big = np.int32(1 << 28)
    cost = np.where(offset >= 0, offset, big).astype(np.int32)[None, :].repeat(len(left), 0)
    out = np.full(len(left), big, np.int64)
    shift = np.arange(size, dtype=np.int32)

    def take(i: int) -> None:
        done = np.flatnonzero(n == i)
        k = m[done] - i + width
        fits = (k >= 0) & (k < size)
        out[done[fits]] = cost[done[fits], k[fits]]

    take(0)
    for i in range(1, rows + 1):
        j = i + offset  # places after i words of left
        match = cost + (b[:, i - 1 : i - 1 + size] != a[:, i - 1 : i])
        drop = np.empty_like(cost)
        drop[:, :-1] = cost[:, 1:] + 1
        drop[:, -1] = big
        step = np.minimum(match, drop)
        step[:, j < 0] = big
        if -width <= -i:
            step[:, width - i] = i
        cost = (np.minimum.accumulate(step - shift, axis=1) + shift).astype(np.int32)
        take(i)
    return out


def similar(left: list[np.ndarray], right: list[np.ndarray], least: float = SIMILARITY) -> np.ndarray:
    """Whether each pair of word sequences reaches the similarity in shared k-mers and in the alignment."""
    out = np.zeros(len(left), bool)
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        p, q = np.unique(shingles(x.astype(np.uint64), K)), np.unique(shingles(y.astype(np.uint64), K))
        if min(len(p), len(q)) < least * max(len(p), len(q)) or not len(p):
            out[i] = len(x) == len(y) and bool((x == y).all())
            continue
        shared = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
        out[i] = shared >= least * (len(p) + len(q) - shared)
    some = np.flatnonzero(out)
    if len(some):
        x, y = [left[i] for i in some], [right[i] for i in some]
        longest = np.array([max(len(p), len(q)) for p, q in zip(x, y, strict=True)])
        most = ((1 - least) * longest + 1e-9).astype(np.int64)
        out[some] = distances(x, y, most) <= most
    return out


def verify(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """The pairs (a, b) whose documents are similar. table: doc_id, words; one row per doc_id."""
    ship(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS):
                part = batch.slice(at, PAIRS)
                left, right = ([np.frombuffer(x.as_buffer(), np.uint32) for x in part.column(c)] for c in ("wa", "wb"))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(similar(left, right)))

    a = table.select(F.col("doc_id").alias("a"), F.col("words").alias("wa"))
    b = table.select(F.col("doc_id").alias("b"), F.col("words").alias("wb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, words: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """verify() as a table; the words are fetched for it and removed."""
    texts = words(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct())
    found = cut(verify(pairs, texts), "found")
    forget(texts)
    return found


def links(reps: DataFrame, words: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Verified links (a, b) between documents of different words. reps: doc_id, sketch; one row per doc_id. words: a table of doc_id and words of a table of doc_id."""
    known = reps.select("doc_id", "sketch").where(F.size("sketch") > 0)
    buckets = known.select("doc_id", F.explode("sketch").alias("key"))
    live = settle(lambda: sized(buckets), "buckets")
    degree = cut(live.groupBy("doc_id").agg(F.sum("n").alias("degree")), "degrees")
    first = cut(hub_pairs(live, degree), "pairs")
    found = verified(first, words)
    named = settle(lambda: labelled(live.select("doc_id", "key"), found), "labels")
    open_ = known.join(mixed(named).select("doc_id", "label").distinct(), "doc_id")
    open_ = cut(open_, "open")
    keys = cut(mixed(sized(cut(open_.select("doc_id", "label", F.explode(combined(2)).alias("key")), "twos"))), "keys")
    few, crowd = keys.where(F.col("n") <= GROUP), keys.where(F.col("n") > GROUP)
    a, b = few.select("key", F.col("doc_id").alias("a"), F.col("label").alias("la")), few.select("key", F.col("doc_id").alias("b"), F.col("label").alias("lb"))
    pairs = a.join(b, "key").where("a < b AND la <> lb").select("a", "b")
    pairs = pairs.unionAll(hub_pairs(crowd, degree)).distinct()
    new = cut(pairs.join(first, ["a", "b"], "left_anti"), "pairs")
    found = found.unionAll(verified(new, words))
    met = settle(lambda: labelled(crowd.select("doc_id", "key"), found), "labels")
    crowd = settle(lambda: mixed(met).select("doc_id").distinct(), "crowd")
    if crowd.isEmpty():
        return found
    return prefix_links(words(crowd), found, first.unionAll(new))


def grams_of(words: pa.Array) -> list[np.ndarray]:
    """The different k-mers of each text."""
    return [np.unique(shingles(np.frombuffer(w.as_buffer(), np.uint32).astype(np.uint64), K)) for w in words]


def slot_counts(docs: DataFrame) -> np.ndarray:
    """How many k-mers of the texts fall into each of SLOTS slots of their hashes: sums per task, then of few tasks, so that little comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for g in grams_of(batch.column("words")):
                sums += np.bincount((g % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for x in batch.column("n"):
                sums += np.frombuffer(x.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["n"])

    rows = docs.select("words").mapInArrow(count, "n binary").repartition(8).mapInArrow(add, "n binary").collect()
    return sum((np.frombuffer(r.n, np.int64) for r in rows), np.zeros(SLOTS, np.int64))


def prefixes(docs: DataFrame) -> DataFrame:
    """doc_id, size (number of k-mers), g (a k-mer) and left (k-mers from g on), for the first k-mers of each text, as a table. docs: doc_id, words.

    With k-mers in one order, those of rare slots first, two documents whose k-mers reach SIMILARITY share one of the first
    size - ceil(SIMILARITY * size) + 1 of both, and where they first meet enough must be left to both.
    """
    ship(docs.sparkSession)
    often = slot_counts(docs)  # any order gives the same pairs; this one lets few documents meet

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, left, flat = [], [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
            for g in grams_of(batch.column("words")):
                n = len(g)
                head = n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1 if n else 0
                flat.append(g[np.lexsort((g, often[(g % np.uint64(SLOTS)).astype(np.int64)]))][:head])
                left.append(n - np.arange(head, dtype=np.int32))
                counts.append((n, head))
            n, head = np.array(counts, np.int64).reshape(-1, 2).T
            own = np.repeat(np.arange(len(n)), head)
            doc = batch.column("doc_id").to_numpy()[own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.array(n[own].astype(np.int32)), pa.array(np.concatenate(left)), pa.array(np.concatenate(flat).view(np.int64))],
                ["doc_id", "size", "left", "g"],
            )

    return cut(docs.mapInArrow(run, "doc_id long, size int, left int, g long"), "prefixes")


def labelled(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with label, the component of each document under the links found."""
    named = components(found).select(F.col("node").alias("doc_id"), "component")
    return docs.join(named, "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")


def meetings(left: DataFrame, right: DataFrame, by: list[str], tried: DataFrame) -> DataFrame:
    """New pairs (a, b) of rows of equal `by` that differ in label and can be similar, as a table. Both: doc_id, label, size, left and by."""
    x, y = (d.select(*by, *[F.col(c).alias(f"{c}{i}") for c in ("doc_id", "label", "size", "left")]) for i, d in enumerate((left, right)))
    near = F.least("size0", "size1") >= SIMILARITY * F.greatest("size0", "size1") - 1e-9
    # the first k-mer that two documents share leaves enough to both, so places that leave less need not meet
    enough = F.least("left0", "left1") >= SIMILARITY / (1 + SIMILARITY) * (F.col("size0") + F.col("size1")) - 1e-6
    met = x.join(y, by).where("label0 <> label1").where(near & enough)
    pairs = met.select(F.least("doc_id0", "doc_id1").alias("a"), F.greatest("doc_id0", "doc_id1").alias("b")).distinct()
    return cut(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")


def prefix_links(docs: DataFrame, found: DataFrame, tried: DataFrame) -> DataFrame:
    """found and links that join all classes whose documents are similar. docs: doc_id, words; tried: pairs (a, b) already verified.

    Rows of one k-mer are dealt to parts of about PART at random, which only meet inside; what they link is one class in the next
    round, with other parts. Once few pairs of different classes are left, or rounds no longer lower their number, all that are left are
    listed: rows outside their k-mer's largest class meet all of the k-mer's rows. So rounds save pairs but decide no class.
    """
    rows, before, turn = prefixes(docs), None, 0
    while True:
        old, rows = rows, settle(lambda: labelled(rows.select("doc_id", "size", "left", "g"), found), "rows")
        forget(old)
        per = rows.groupBy("g", "label").agg(F.count("*").alias("n"))
        square = F.sum(F.col("n").cast("double") * F.col("n")).alias("q")
        main = F.max_by("label", F.struct("n", "label")).alias("main")
        keys = per.groupBy("g").agg(F.sum("n").alias("t"), square, F.count("*").alias("labels"), main).where("labels > 1")
        keys = cut(keys.select("g", "t", ((F.col("t").cast("double") * F.col("t") - F.col("q")) / 2).alias("pairs"), "main"), "keys")
        sums = keys.agg(F.sum("t").alias("rows"), F.sum("pairs").alias("pairs")).head()
        if not sums.rows:
            return found
        old, rows = rows, cut(rows.join(keys.select("g", "t", "main"), "g"), "rows")
        forget(old, keys)
        last = sums.pairs <= FEW * sums.rows or before is not None and sums.pairs > SLOW * before
        if last:
            new = meetings(rows.where("label <> main"), rows, ["g"], tried)
        else:
            dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "g", F.lit(turn)), F.ceil(F.col("t") / PART)))
            new = meetings(dealt, dealt.where("label <> main"), ["g", "part"], tried)
        found = found.unionAll(cut(verify(new, docs), "found"))
        if last:
            return found
        tried, before, turn = tried.unionAll(new), sums.pairs, turn + 1


def sized(keys: DataFrame) -> DataFrame:
    """keys with the number n of their key's rows, where there are two or more."""
    counts = cut(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "counts")  # read plainly, so that Spark may split a very common key
    return keys.join(counts, "key")


def mixed(keys: DataFrame) -> DataFrame:
    """Rows whose key has documents of more than one label."""
    several = cut(keys.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("key"), "several")
    return keys.join(several, "key", "left_semi")


def combined(width: int):
    """A key for every choice of so many sketches."""
    return F.array(*[F.xxhash64(*[x for i in chosen for x in (F.lit(i), F.col("sketch")[i])]) for chosen in combinations(range(SKETCHES), width)])


def hub_pairs(keys: DataFrame, degree: DataFrame) -> DataFrame:
    """Each document with its key's hub, the one of largest degree (of those the smallest id), as a < b."""
    ranked = keys.select("doc_id", "key").join(degree, "doc_id")
    hubs = cut(ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("doc_id")).alias("m"))).alias("hub")).select("key", (-F.col("hub.m")).alias("hub")), "hubs")
    met = keys.select("doc_id", "key").join(hubs, "key").where("doc_id <> hub")
    return met.select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()


def text_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, t (hash of the row's text), class_id and n_links of every row whose doc_id is not null."""
    table = sketches(docs, doc_id, text)
    first = table.where("same <> 0").groupBy("same").agg(F.min(F.struct("doc_id", "t")).alias("r"))
    first = cut(first.select("same", F.col("r.doc_id").alias("rep"), F.col("r.t").alias("rep_t")), "first")  # read plainly, so that Spark may split the rows of a text with very many copies
    reps = table.where("same <> 0").dropDuplicates(["same"]).select(F.col("same").alias("doc_id"), "sketch")
    reps = cut(reps, "reps")  # from here on a text's words are its id
    known = table.select("doc_id", "t")

    def words(ids: DataFrame) -> DataFrame:
        named = first.join(ids.select(F.col("doc_id").alias("same")), "same").select(F.col("rep").alias("doc_id"), F.col("rep_t").alias("t"))
        return words_of(docs, known, cut(named, "ids"), doc_id, text)

    found = settle(lambda: links(reps, words), "links")
    groups = components(found).select(F.col("node").alias("same"), "component")
    named = groups.join(first, "same").groupBy("component").agg(F.min("rep").alias("class_id"))
    ends = found.select(F.col("a").alias("same")).unionAll(found.select(F.col("b").alias("same"))).groupBy("same").agg(F.count("*").alias("n_links"))
    near = cut(groups.join(named, "component").join(ends, "same").select("same", "class_id", "n_links"), "near")
    classed = cut(first.join(near, "same", "left").select("same", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "known")
    rows = table.select("doc_id", "t", "same").join(classed, "same", "left")
    return rows.select("doc_id", "t", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class) and n_links (verified links of its words to other words)."""
    return text_classes(docs, doc_id, text).drop("t")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, without those whose class has a smaller doc_id; rows of null doc_id stay."""
    own_id, own_t = free(docs, "own_id"), free(docs, "own_t")

    def later() -> DataFrame:
        return text_classes(docs, doc_id, text).where("class_id < doc_id").select(F.col("doc_id").alias(own_id), F.col("t").alias(own_t)).distinct()

    dropped = settle(later, "dropped")
    gone = (numbered(docs, doc_id) == F.col(own_id)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(own_t))
    return docs.join(dropped, gone, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
