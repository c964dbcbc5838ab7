"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lowers case, strips accents, maps homoglyphs of other scripts to Latin
letters and digits to the letters they stand for. The lexicon holds words and
word stems; an entry counts where a word starts with it, unless an exception
phrase covers the place. A text's evidence is the sum of the weights of its
matches, divided by the logarithm of its length in words, and a logistic curve
turns evidence into a score.

Entries, weights and the curve are learned from labelled rows only: from at most
SAMPLE_ROWS rows of each label, those of the smallest hashes of doc_id, less
copies of each other. Labels,
language, source and doc_id are no inputs of a score.

Defined cases: null and empty texts have no evidence and get the curve's lowest
score; without labelled rows of both kinds nothing matches and every score is
the prior, below one half; repeated rows get equal scores; rows of one doc_id
in the labels count as toxic if any says so.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.llm.batches import bound_batches, pieces, texts_of
from cartulary.llm.words import hash_words, mix, shingles
from cartulary.session import cut, ship

#: Labelled rows of each kind that the lexicon is learned from, at most.
SAMPLE_ROWS = 4000
STEM_CHARS = range(3, 13)
#: Evidence that an entry needs (log-likelihood ratio) and the share of toxic among its rows at equal priors.
LEAST_G2, LEAST_SHARE = 18.0, 0.95

# Digits and signs that stand for letters. 1 and | stand for i and for l, so l folds to i as well.
DIGITS = {"l": "i", "L": "i", "|": "i", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ø": "o", "ł": "l", "ß": "ss",
}
# Phrases in which an entry is meant otherwise.
EXCEPTIONS = ("clown fish", "clown car", "trash can", "trash bin", "pond scum", "sore loser", "recycling trash")


def fold_table() -> dict[int, str | None]:
    """Letters up to U+024F and full-width forms to their base letters by decomposition; marks and zero-width signs to nothing."""
    table: dict[int, str | None] = {c: None for c in [*range(0x300, 0x370), 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD]}
    for c in [*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)).lower()
        if base != chr(c) and base.isalnum():
            table[c] = base
    table |= {ord(a): b for a, b in HOMOGLYPHS.items()} | {ord(a.upper()): b for a, b in HOMOGLYPHS.items() if len(a.upper()) == 1 and not a.upper().isascii()}
    table = {c: b and "".join(DIGITS.get(x, x) for x in b) for c, b in table.items()}
    return table | {c: chr(c + 32) for c in range(65, 91)} | {ord(a): b for a, b in DIGITS.items()}


_FOLD = fold_table()


def fold(text: str) -> str:
    return text.translate(_FOLD)


@dataclass
class Lexicon:
    entries: dict[str, float]  # stems with their weights
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 1.0
    prior: float = -4.0
    _matcher: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_matcher": None}

    def matcher(self):
        if self._matcher is None:
            import ahocorasick

            self._matcher = ahocorasick.Automaton()
            for e in self.entries:
                self._matcher.add_word(e, (e, None))
            for p in map(fold, self.exceptions):
                self._matcher.add_word(p, (None, p))
            self._matcher.make_automaton()
        return self._matcher

    def matches(self, folded: str) -> list[tuple[int, str]]:
        """Where words start with an entry, outside exception phrases; of entries at one place the longest."""
        if not self.entries:
            return []
        found, spared = {}, []
        for end, (entry, phrase) in self.matcher().iter(folded):
            n = len(entry or phrase)
            start = end - n + 1
            if start and folded[start - 1].isalnum():
                continue
            if entry is not None:
                found[start] = entry  # matches of one start come by ascending end
            elif not folded[end + 1 : end + 2].isalnum():
                spared.append((start, end))
        return [(s, e) for s, e in sorted(found.items()) if not any(a <= s <= b for a, b in spared)]

    def evidence(self, text: str) -> float:
        folded = fold(text)
        weight = sum(self.entries[e] for _, e in self.matches(folded))
        return weight / math.log2(2 + folded.count(" ") + folded.count("\n")) if weight else 0.0

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.prior + self.slope * self.evidence(text)))))


def stems(text: str) -> set[str]:
    """The beginnings of a text's folded words."""
    words = set("".join(c if c.isalnum() else " " for c in fold(text)).split())
    return {w[:n] for w in words for n in STEM_CHARS if n <= len(w)}


def train_fold(doc_id):
    """Rows to learn from: the remainder of crc32 of the id as text by 5 is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Lexicon:
    """Learn a lexicon from the labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    ship(spark)
    bound_batches(spark)
    known = labels.select(F.col(f"`{doc_id}`").cast("long").alias("k"), F.col(f"`{label}`").cast("int").alias("toxic")).where("k IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(train_fold(F.col("k"))).groupBy("k").agg(F.max("toxic").alias("toxic"))
    rows = [known.where(c).orderBy(F.xxhash64("k"), "k").limit(SAMPLE_ROWS) for c in ("toxic = 1", "toxic <> 1")]
    ids = rows[0].unionAll(rows[1])  # at most 2 * SAMPLE_ROWS rows, so it may be broadcast
    sample = docs.select(F.col(f"`{doc_id}`").cast("long").alias("k"), F.col(f"`{text}`").alias("text")).join(F.broadcast(ids), "k").select("k", "toxic", "text")
    sample = cut(one_of_each_family(cut(sample, "labelled")), "families")
    share = known.agg(F.avg("toxic").alias("p")).head().p
    sizes = {bool(r.toxic == 1): r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return Lexicon({})

    def count(chosen: frozenset[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter[str] = Counter()
            for batch in batches:
                for t in texts_of(batch, "text"):
                    seen.update(stems(t) if chosen is None else stems(t) & chosen)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["stem", "n"])

        return run

    def counted(part: DataFrame, chosen: frozenset[str] | None, least: int) -> dict[str, int]:
        sums = part.select("text").mapInArrow(count(chosen), "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        return {r.stem: r.n for r in sums.collect()}  # bounded by the sample

    # an entry can reach LEAST_G2 only with so many toxic rows
    least = math.ceil(LEAST_G2 / (2 * math.log((n_toxic + n_clean) / n_toxic)))
    toxic = counted(sample.where("toxic = 1"), None, least)
    clean = counted(sample.where("toxic <> 1"), frozenset(toxic), 1)
    entries = choose(toxic, clean, n_toxic, n_clean)
    lexicon = Lexicon(entries)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.evidence(t) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.float64())], ["toxic", "x"])

    rows = sample.mapInArrow(evidence, "toxic int, x double").collect()  # bounded by the sample
    lexicon.slope, lexicon.prior = curve(np.array([r.x for r in rows]), np.array([r.toxic == 1 for r in rows], float), share)
    return lexicon


def one_of_each_family(sample: DataFrame) -> DataFrame:
    """The sample without copies: of rows that agree in a MinHash value of their 3-word shingles only the one of smallest k stays.

    Edited copies of one document would else make its rare words look like evidence.
    """
    ship(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for t in texts_of(batch, "text"):
                hashes, _ = hash_words([t])
                parts = shingles(hashes, 3) if len(hashes) > 2 else mix(np.append(hashes, np.uint64(len(hashes))))
                values.append([int(mix(parts ^ np.uint64(seed)).min().view(np.int64)) for seed in (1, 2, 3)])
            columns = [pa.array([v[i] for v in values], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("k", "toxic", "text")], *columns], ["k", "toxic", "text", "f0", "f1", "f2"])

    rows = sample.mapInArrow(run, "k long, toxic int, text string, f0 long, f1 long, f2 long")
    rows = cut(rows, "shingled")
    ids = rows.select("k", "f0", "f1", "f2")
    for f in ("f0", "f1", "f2"):
        ids = ids.join(ids.groupBy(f).agg(F.min("k").alias("m")), f).where("k = m").drop("m")
    return rows.join(ids.select("k").distinct(), "k", "left_semi").dropDuplicates(["k"]).select("toxic", "text")


def choose(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Stems with evidence enough that are nearly only in toxic rows, without those that a chosen stem begins."""
    out: dict[str, float] = {}
    total = n_toxic + n_clean
    for stem, t in sorted(toxic.items(), key=lambda x: (len(x[0]), x[0])):
        c = clean.get(stem, 0)
        if any(stem[:n] in out for n in STEM_CHARS if n < len(stem)):
            continue
        rate_t, rate_c = t / n_toxic, c / n_clean
        expected = ((t + c) * n_toxic / total, (t + c) * n_clean / total)
        g2 = 2 * sum(o * math.log(o / e) for o, e in zip((t, c), expected, strict=True) if o)
        if g2 >= LEAST_G2 and rate_t / (rate_t + rate_c) >= LEAST_SHARE:
            out[stem] = math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
    return out


def curve(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and intercept of a logistic regression with a small ridge, rows weighted to the share of toxic rows."""
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    a, b = 1.0, -1.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        grad = np.array([(weight * (p - y) * x).sum() + 0.01 * a, (weight * (p - y)).sum() + 0.01 * b])
        h = weight * p * (1 - p)
        hess = np.array([[(h * x * x).sum() + 0.01, (h * x).sum()], [(h * x).sum(), h.sum() + 0.01]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
    return float(max(a, 0.0)), float(min(b, -0.1))


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1."""
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    keep = [f for f in docs.schema.fields if f.name != out]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text):
                found = pa.array([lexicon.score(t) for t in texts_of(batch, text)], pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [found], [*names, out])

    return docs.mapInArrow(run, T.StructType([*keep, T.StructField(out, T.DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return score(docs, fit(docs, labels, text=text), text, name).where(F.col(name) < threshold).drop(name)
