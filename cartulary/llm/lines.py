"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Two lines within EDITS edits share one of EDITS + 1 equal segments. Every line
of MIN_CHARS or more code points is indexed by its own segments and probes the
index with those of its substrings that could be a segment of a line as long or
up to EDITS shorter, at the few offsets that the edits left and right of the
segment allow. Keys are hashes of segment, line length and segment number, so
the join is an equi-join. Under a key with a crowd of lines, as families of edited
copies make, every line meets a few hubs of the key; then only lines of different
components are compared, with letter counts that drop pairs too far from each other
inside the join, and very large crowds are first told apart by segments of what
stands beside the shared one. So classes are those of all pairs, but no crowd's
pairs are listed; the report, which counts the links of every line, compares all
lines of a crowd instead, as many pairs as it has to count. What remains is verified by a bit-parallel edit distance over a
band of 2 * EDITS + 1 rows.

Lines are known by 64-bit hashes; a false match needs equal hashes and lengths.
Lines that come so often that they would crowd a partition are at most HOT_LINES
different ones; they are indexed from one document each. Other copies meet in
the partition of their key and are dropped there before the join.

A class is a connected component of lines under equality and verified links; the
class's first occurrence, by doc_id and place, is kept and the others repeat it.

Defined cases: null and empty texts have one empty line; lines without a
non-space character never repeat; lines shorter than MIN_CHARS match only equal
lines, as two edits make another line of so few letters; equal rows of one doc_id
count as one, rows of one doc_id with different texts come one after the other
(in order of their texts' hashes) and keep their own places; a null doc_id is no
document, other ids must be integers; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from cartulary.llm.batches import free, numbered
from cartulary.llm.components import components
from cartulary.session import cut, settle, sweep

EDITS, MIN_CHARS = 2, 32
#: At most so many different lines are too common to be indexed from all their documents.
HOT_LINES = 100_000
#: Identifiers of candidate lines that may be broadcast to fetch their texts; beyond it the texts are shuffled.
BROADCAST_IDS = 1_000_000
#: Places of repeated lines that may be broadcast to the texts; beyond it the texts are shuffled.
BROADCAST_PLACES = 1_000_000
#: Lines under one key up to which all that probe it are candidates as they are.
CROWD = 16
#: Lines under a crowded key up to which lines of different components are compared; beyond it the key is cut finer, so often at most.
DENSE, DEPTH = 1024, 6
#: Hubs of a crowded key that all its lines meet, one after the other, before lines of different components are compared.
HUBS = 2
_LETTERS = "entairoshldcumgb"


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, t (hash of the row's text), pos, line, its hash h and length n, of lines that hold more than spaces."""
    own = docs.select(numbered(docs, doc_id).alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id IS NOT NULL")
    lines = own.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.length(F.trim("line")) > 0)
    return lines.select("doc_id", "t", "pos", "line", F.xxhash64("line").alias("h"), F.length("line").alias("n"))


def letter_counts(line: Column, letters: str) -> Column:
    """The counts of up to eight letters modulo 256, side by side in a long."""
    counts = [F.shiftleft((F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).cast("long").bitwiseAND(F.lit(255).cast("long")), 8 * i) for i, c in enumerate(letters)]
    return reduce(Column.bitwiseOR, counts)


def counts_apart(a: Column, b: Column) -> Column:
    """A lower bound of the sum of differences of letter counts."""
    parts = []
    for i in range(8):
        x, y = (F.shiftrightunsigned(c, 8 * i).bitwiseAND(F.lit(255).cast("long")) for c in (a, b))
        parts.append(F.least(F.abs(x - y), 256 - F.abs(x - y)))
    return reduce(Column.__add__, parts)


def segment(length: Column, i: Column, edits: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i of EDITS + 1 in a line: sizes differ by one at most, the longer come last."""
    parts = edits + 1
    longer = length % parts
    base = ((length - longer) / parts).cast("int")
    return i * base + F.greatest(F.lit(0), i - (parts - longer)), base + (i >= parts - longer).cast("int")


def keys(lines: DataFrame, edits: int, min_chars: int, probe: bool, rest: bool = False, segments: Sequence[int] | None = None) -> DataFrame:
    """key and h: hashes of a line's own segments, or of its substrings that may be a segment of a line up to EDITS shorter.

    What to cut out is exploded first, so that the expression for a key is there once. Where lines have a column up, the
    keys hold it too; with rest, line and n are what stands beside the segment. segments: those asked for, else all.
    """
    cuts = []
    for shorter in range(edits + 1 if probe else 1):
        for i in range(edits + 1) if segments is None else segments:
            # edits to the left of segment i are at most i, to the right at most EDITS - i
            reach = range(max(-i, shorter - (edits - i)), min(i, shorter + edits - i) + 1) if probe else (0,)
            cuts += [F.struct(F.lit(shorter).alias("shorter"), F.lit(i).alias("i"), F.lit(o).alias("offset")) for o in reach]
    above = ["up"] if "up" in lines.columns else []
    rows = lines.select(*above, "h", "line", "n", F.explode(F.array(*cuts)).alias("cut"))
    length = F.col("n") - F.col("cut.shorter")
    start, size = segment(length, F.col("cut.i"), edits)
    at = start + F.col("cut.offset")
    fits = (at >= 0) & (at + size <= F.col("n")) & (length >= min_chars)
    beside = [F.concat(F.substr("line", F.lit(1), at), F.substr("line", at + size + 1)).alias("line"), (F.col("n") - size).alias("n")] if rest else []
    return rows.where(fits).select(F.xxhash64(F.substr("line", at + 1, size), length, F.col("cut.i"), *above).alias("key"), "h", *beside)


def spread(keys: DataFrame) -> DataFrame:
    """Deal keys out for the join."""
    return keys.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")


def texts_by_hash(docs_lines: DataFrame, ids: DataFrame) -> DataFrame:
    """h and line of the given hashes (a table with h), as a table."""
    ids = cut(ids.select("h").distinct(), "ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return cut(docs_lines.join(ids, "h", "left_semi").groupBy("h").agg(F.min("line").alias("line")), "texts")


def met(docs_lines: DataFrame, places: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """What the index and the probes have in common, as a table of key, a, b and crowded: line b probes a key that a is indexed under.

    Of a key with more than CROWD lines a is one only, its hub, and crowded says so. Keys hold their segment's number, so
    the first and last segments meet in one round and those between, which are probed at more places, in another: only
    one round's keys are on disk at a time.
    """
    seen = Observation()
    often = places.where(F.col("n") >= min_chars).groupBy("h").agg(F.count("*").alias("copies"), F.min("doc_id").alias("home")).observe(seen, F.sum("copies").alias("total"))
    often = cut(often.where("copies > 8"), "often")
    hot = often.where(F.col("copies") > (seen.get["total"] or 0) / HOT_LINES).select("h", "home")  # at most HOT_LINES rows
    own = docs_lines.where(F.col("n") >= min_chars).join(F.broadcast(hot), "h", "left").where("home IS NULL OR home = doc_id")
    found = []
    for segments in filter(None, ([0, edits] if edits else [0], range(1, edits))):
        found.append(cut(_met(own, edits, min_chars, segments), "met"))
        sweep(docs_lines.sparkSession)
    return reduce(DataFrame.unionAll, found)


def _met(own: DataFrame, edits: int, min_chars: int, segments: Sequence[int]) -> DataFrame:
    """What met() returns, by keys of some segments."""
    same = Window.partitionBy("key")
    index = spread(keys(own, edits, min_chars, probe=False, segments=segments)).dropDuplicates(["key", "h"])
    index = index.withColumn("m", F.count("*").over(same)).withColumn("first", F.min("h").over(same))
    crowded = F.col("m") > CROWD
    # up to CROWD rows of a key, or its hub: to hash these in memory is even over partitions
    ends = index.where(~crowded | (F.col("h") == F.col("first"))).select("key", F.col("h").alias("a"), crowded.alias("crowded"))
    probe = spread(keys(own, edits, min_chars, probe=True, segments=segments))
    return probe.join(ends.hint("shuffle_hash"), "key").where("a <> h").select("key", "a", F.col("h").alias("b"), "crowded")


def marked(texts: DataFrame, *more: str) -> DataFrame:
    """h, more columns, the line's length and the counts of sixteen letters."""
    return texts.select("h", *more, F.char_length("line").alias("n"), letter_counts(F.col("line"), _LETTERS[:8]).alias("x"), letter_counts(F.col("line"), _LETTERS[8:]).alias("y"))


def close(edits: int) -> Column:
    """Whether lengths (na, nb) and letter counts (xa, ya, xb, yb) allow so few edits."""
    apart = counts_apart(F.col("xa"), F.col("xb")) + counts_apart(F.col("ya"), F.col("yb"))
    return (F.abs(F.col("na") - F.col("nb")) <= edits) & (apart <= 2 * edits)


def edit_distance(longer: Column, shorter: Column, edits: int = EDITS) -> Column:
    """The edit distance of two texts if it is within edits, else something larger. longer has at least as many code points, and more than edits.

    Bits are the rows of a band around the diagonal: the top bit is edits rows
    below it. Of a column the vertical differences are kept (up, down); the
    distance is followed along the band's lower edge and then along the last row.
    """
    width = 2 * edits + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    state = "struct<up:int,down:int,d:int,last:int,i:int>"
    start = F.struct(F.lit((full << (width - edits - 1)) & full).alias("up"), F.lit(0).alias("down"), F.lit(edits).alias("d"), F.lit(1 << (width - 2)).alias("last"), F.lit(0).alias("i"))

    def diagonal(v: Column) -> Column:
        d0 = (v.eq.bitwiseAND(v.up) + v.up).bitwiseXOR(v.up).bitwiseOR(v.eq).bitwiseOR(v.down).bitwiseAND(full)
        return F.struct(v.up.alias("up"), v.d.alias("d"), v["last"].alias("last"), v.i.alias("i"), v.down.alias("down"), d0.alias("d0"))

    def horizontal(v: Column) -> Column:
        hp = v.down.bitwiseOR(F.bitwise_not(v.d0.bitwiseOR(v.up)).bitwiseAND(full))
        return F.struct(v.d.alias("d"), v["last"].alias("last"), v.i.alias("i"), v.d0.alias("d0"), hp.alias("hp"), v.d0.bitwiseAND(v.up).alias("hn"))

    def of(text: Column) -> Column:
        """The distance of text.rows and text.chars; both are split once."""
        edge = F.size(text.rows) - edits

        def vertical(v: Column) -> Column:
            side = v.i < edge
            along = F.when(v.hp.bitwiseAND(v["last"]) != 0, 1).otherwise(0) - F.when(v.hn.bitwiseAND(v["last"]) != 0, 1).otherwise(0)
            d = v.d + F.when(side, F.when(v.d0.bitwiseAND(top) != 0, 0).otherwise(1)).otherwise(along)
            half = F.shiftright(v.d0, 1)
            up = v.hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(v.hp)).bitwiseAND(full))
            last = F.when(side, v["last"]).otherwise(F.shiftright(v["last"], 1))
            return F.struct(up.alias("up"), half.bitwiseAND(v.hp).alias("down"), d.alias("d"), last.alias("last"), (v.i + 1).alias("i"))

        def step(s: Column, c: Column) -> Column:
            bits = [F.when(F.get(text.rows, s.i + (edits - width + 1 + k)) == c, F.lit(1 << k)).otherwise(F.lit(0)) for k in range(width)]
            eq = reduce(Column.bitwiseOR, bits)
            first = F.struct(s.up.alias("up"), s.down.alias("down"), s.d.alias("d"), s["last"].alias("last"), s.i.alias("i"), eq.alias("eq"))
            return _let(_let(_let(first, diagonal), horizontal), vertical).cast(state)

        return F.aggregate(text.chars, start.cast(state), step, lambda s: s.d)

    def trimmed(both: Column) -> Column:
        """What lies between the common beginning and the common end, of which edits + 1 letters stay."""
        head = _common(both.rows, both.chars)
        left = F.least(F.size(both.rows), F.size(both.chars)) - head
        tail = F.greatest(F.least(_common(F.reverse(both.rows), F.reverse(both.chars)), left) - (edits + 1), F.lit(0))
        # a longer text keeps more letters than edits, as its last row must lie below the band's upper edge
        head = F.least(head, F.greatest(F.size(both.rows) - tail - (edits + 1), F.lit(0)))
        return _let(F.struct(*[F.slice(both[c], head + 1, F.size(both[c]) - head - tail).alias(c) for c in ("rows", "chars")]), of)

    letters = [F.filter(F.split(t, ""), lambda c: c != "") for t in (longer, shorter)]
    return _let(F.struct(letters[0].alias("rows"), letters[1].alias("chars")), trimmed)


def _common(a: Column, b: Column) -> Column:
    """How many elements two arrays begin with alike."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(differ > 0, differ - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def _let(value: Column, body) -> Column:
    """body of value, which is computed once: a lambda over an array of one."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ordered(pairs: DataFrame) -> DataFrame:
    """The pairs as a < b, each once."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """The pairs whose lines are within the edits, as a table. texts: marked() with the line."""
    whole = pairs.join(texts.toDF("a", "ta", "na", "xa", "ya"), "a").join(texts.toDF("b", "tb", "nb", "xb", "yb"), "b").where((F.col("ta") != F.col("tb")) & close(edits))
    swap = F.col("na") < F.col("nb")
    whole = whole.select("a", "b", F.when(swap, F.col("tb")).otherwise(F.col("ta")).alias("x"), F.when(swap, F.col("ta")).otherwise(F.col("tb")).alias("y"))
    return cut(whole.where(_within(pairs.sparkSession.sparkContext.applicationId, edits)).select("a", "b"), "line_links")


@cache
def _within(app: str, edits: int) -> Column:
    """Whether x and y are within the edits; the expression is large, so it is built once in an application."""
    return edit_distance(F.col("x"), F.col("y"), edits) <= edits


def labels(links: DataFrame) -> DataFrame:
    """h and label (component) of the lines that have links, as a table."""
    return settle(lambda: components(links).select(F.col("node").alias("h"), F.col("component").alias("label")), "labels")


def labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    return rows.join(label, "h", "left").withColumn("label", F.coalesce("label", "h"))


def several(members: DataFrame, label: DataFrame) -> DataFrame:
    """The keys whose lines are of more than one component, as a table. members: key and h."""
    return cut(labelled(members, label).groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l < m").select("key"), "open")


def line_links(docs_lines: DataFrame, places: DataFrame | None = None, edits: int = EDITS, min_chars: int = MIN_CHARS, every: bool = False) -> DataFrame:
    """Verified links a, b between hashes of different lines within the edits, as a table. places: doc_id, h, n of docs_lines, if at hand.

    All links of lines that share a key of at most CROWD lines, and of larger crowds so many that lines are connected as all links would connect them.
    every: all links of crowds too, each once.
    """
    found = met(docs_lines, docs_lines.select("doc_id", "h", "n") if places is None else places, edits, min_chars)
    ids = found.select(F.col("a").alias("h")).unionAll(found.select(F.col("b").alias("h")))
    texts = cut(marked(texts_by_hash(docs_lines, ids), "line"), "counted")
    links = verified(ordered(found), texts, edits)
    crowds = found.where("crowded")
    members = crowds.select("key", F.col("b").alias("h")).unionAll(crowds.select("key", F.col("a").alias("h"))).distinct()
    label = labels(links.limit(0) if every else links)  # without labels each line is a component of its own
    open_ = several(members, label)
    if open_.isEmpty():
        return links
    rows = texts.join(cut(members.join(open_, "key", "left_semi").select("h").distinct(), "ids"), "h", "left_semi").select("h", "line", "n")
    own, probes = (cut(keys(rows, edits, min_chars, probe, rest=True).join(open_, "key", "left_semi").distinct(), "rests") for probe in (False, True))
    if not every:
        links, label = hub_links(own, probes, texts, links, label, edits)
    return crowd_links(own, probes, texts, links, label, edits)


def degrees(links: DataFrame) -> DataFrame:
    """h and links of every line that has some."""
    return links.select(F.col("a").alias("h")).unionAll(links.select(F.col("b").alias("h"))).groupBy("h").agg(F.count("*").alias("links"))


def hub_links(own: DataFrame, probes: DataFrame, texts: DataFrame, links: DataFrame, label: DataFrame, edits: int) -> tuple[DataFrame, DataFrame]:
    """links and those that the lines which probe a crowded key have to hubs of it, and the components that they make.

    A hub is the line of most links so far, the middle of a family, outside the components of the key's hubs before it.
    """
    rows, used = own.select("key", "h"), None
    for _ in range(HUBS):
        ranked = labelled(rows.join(degrees(links), "h", "left"), label)
        if used is not None:
            ranked = ranked.join(labelled(used, label).select("key", "label"), ["key", "label"], "left_anti")
        best = ranked.groupBy("key").agg(F.max(F.struct(F.coalesce("links", F.lit(0)), (-F.col("h")).alias("m"))).alias("hub"))
        hubs = cut(best.select("key", (-F.col("hub.m")).alias("h")), "hubs")
        to = labelled(hubs, label).toDF("h", "key", "la").select("key", F.col("h").alias("a"), "la")
        pairs = labelled(probes.select("key", "h").distinct(), label).join(to, "key").where("label <> la").select("a", F.col("h").alias("b"))
        new = verified(ordered(pairs), texts, edits)
        if new.isEmpty():
            break
        links, used = links.unionAll(new), hubs if used is None else used.unionAll(hubs)
        label = labels(links)
    return links, label


def crowd_links(own: DataFrame, probes: DataFrame, texts: DataFrame, links: DataFrame, label: DataFrame, edits: int) -> DataFrame:
    """links and more, each once, between lines of different components under crowded keys, until no two components have a pair within the edits.

    own and probes: key, h and what stands beside the key's segment (line, n). Of keys with at most DENSE lines each line that
    probes is compared with those of other components. Under larger ones what stands beside the segment is cut into
    segments again, as it is within the edits too; that may go on until nearly all of the line is in the key.
    """
    for depth in range(DEPTH + 1):
        sizes = cut(own.groupBy("key").agg(F.count("*").alias("m")), "sizes")  # a line is under a key once
        small = F.col("m") <= (DENSE if depth < DEPTH else 1 << 62)
        marks = texts.select("h", "n", "x", "y")
        left = labelled(own.join(sizes.where(small).select("key"), "key").select("key", "h"), label).join(marks, "h").toDF("a", "key", "la", "na", "xa", "ya")
        right = labelled(probes.join(sizes.where(small).select("key"), "key").select("key", "h").distinct(), label).join(marks, "h").toDF("b", "key", "lb", "nb", "xb", "yb")
        pairs = left.join(right, (left["key"] == right["key"]) & (F.col("la") != F.col("lb")) & close(edits)).select("a", "b")
        links = links.unionAll(verified(ordered(pairs).join(links, ["a", "b"], "left_anti"), texts, edits))
        large = sizes.where(~small).select("key")
        if large.isEmpty():
            break
        deeper = [rows.join(large, "key", "left_semi").withColumnRenamed("key", "up") for rows in (own, probes)]
        own, probes = (cut(keys(rows, edits, 0, probe, rest=True).distinct(), "rests") for rows, probe in zip(deeper, (False, True), strict=True))
    return links


def line_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, copies_are_one: bool = False, every: bool = False) -> DataFrame:
    """doc_id, t (hash of the row's text), pos, class, links and repeats (whether the class comes before) of every line that holds more than spaces.

    copies_are_one: documents of equal text are the first of them. every: links counts all links of a line, else those that hold its class together.
    """
    lines = occurrences(docs, doc_id, text)
    places = cut(lines.select("doc_id", "t", "pos", "h", "n"), "places")
    if copies_are_one:
        first = places.groupBy("t").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("t", "first")
        places = places.join(cut(first, "copied"), "t", "left").select(F.coalesce("first", "doc_id").alias("doc_id"), "t", "pos", "h", "n")
    links = settle(lambda: line_links(lines, places, edits, min_chars, every), "links")
    groups = components(links).select(F.col("node").alias("h"), "component")
    near = cut(groups.join(degrees(links), "h"), "near")
    rows = places.select("doc_id", "t", "pos", "h").join(near, "h", "left")
    rows = rows.select("doc_id", "t", "pos", F.coalesce("component", "h").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
    homes = rows.groupBy("class").agg(F.min("doc_id").alias("home"), F.count("*").alias("n")).where("n > 1").select("class", "home")
    homes = cut(homes, "homes")  # read plainly, so that Spark may split the rows of a class that is in very many documents
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.join(homes, "class", "left").repartition(n, "doc_id")
    order = Window.partitionBy("doc_id", "class").orderBy("t", "pos")
    again = F.col("home").isNotNull() & ((F.col("home") != F.col("doc_id")) | (F.rank().over(order) > 1))  # equal places, of equal rows, are one
    return found.select("doc_id", "t", "pos", "class", "links", again.alias("repeats"))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_links (for each of its lines, the different lines within the edits), classes and repeated places, in order of place."""
    found = line_classes(docs, doc_id, text, edits, min_chars, every=True)
    # dealt by doc_id already, so this gathers without another shuffle
    grouped = found.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set(F.struct("pos", "class", "repeats", "links"))).alias("l"))
    ids = docs.select(numbered(docs, doc_id).alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("t")).where("doc_id IS NOT NULL")
    whole = ids.join(grouped, ["doc_id", "t"], "left")
    rows = F.coalesce("l", F.array().cast("array<struct<pos:int,class:bigint,repeats:boolean,links:bigint>>"))
    whole = whole.select("doc_id", rows.alias("l"))
    return whole.select(
        "doc_id",
        F.size("l").cast("long").alias("n_lines"),
        F.aggregate("l", F.lit(0).cast("long"), lambda n, x: n + x.links).alias("n_links"),
        F.col("l.class").alias("classes"),
        F.filter("l", lambda x: x.repeats)["pos"].alias("repeated"),
    )


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns, with every line taken out of the texts that repeats an earlier one; what is left may be an empty text.

    Of documents of equal text each keeps what the first one keeps, so that they stay copies, which a document stage takes out.
    """
    gone, own_t = free(docs, "gone"), free(docs, "gone_t")
    whole = F.col(f"`{text}`")

    def repeated() -> DataFrame:
        found = line_classes(docs, doc_id, text, copies_are_one=True).where("repeats")
        return found.groupBy(F.col("t").alias(own_t)).agg(F.collect_set("pos").alias(gone))

    first = settle(repeated, "repeated")
    sweep(docs.sparkSession)
    places = first.agg(F.sum(F.size(gone))).head()[0] or 0
    first = F.broadcast(first) if places <= BROADCAST_PLACES else first
    joined = docs.join(first, numbered(docs, doc_id).isNotNull() & (F.xxhash64(whole) == F.col(own_t)), "left")
    kept = F.array_join(F.filter(F.split(whole, "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    columns = [F.when(F.col(gone).isNotNull(), kept).otherwise(whole).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns)
