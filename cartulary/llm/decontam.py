"""Benchmark decontamination with an FM-index per shard of the training text.

A shard is a slice of documents of bounded size. Words that no benchmark phrase
holds cannot be part of an occurrence, so they become separators, and runs
between separators that are shorter than the shortest phrase are left out; what
stays is indexed: suffix array, Burrows-Wheeler transform in a wavelet matrix,
suffix positions sampled every SAMPLE places. All phrases are searched backward
at once; occurrences are located by walking to a sampled position, and the words
they cover are merged into removal spans.

Words are the runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lowered.
A phrase is a window of WINDOW consecutive words of an item; an item of fewer
words, but not none, is one phrase.

Defined cases: null and empty texts have no words and are clean; items without
words or without an id match nothing; rows of one item_id count as one item;
repeated documents are judged row by row; an empty benchmark leaves all clean.
Extra columns pass through where the caller asks for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.llm.batches import as_lists, bound_batches, pieces, texts_of
from cartulary.session import ship

WINDOW = 13
SAMPLE = 8
#: Bytes of text in a shard, and of benchmark text that is broadcast at once; a larger benchmark takes more passes.
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 8 << 20
#: A document is contaminated if one word in so many is hit.
SHARE = 20

_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(b if b in _KEEP else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


class Phrases:
    """The distinct windows of benchmark items, as symbols from 1 on, and each window's items."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        rows, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for item, text in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text or "")], np.int32)
            if len(ids):
                short = np.pad(ids, (0, max(0, window - len(ids))))  # 0 is no word
                rows.append(np.lib.stride_tricks.sliding_window_view(short, window))
                owners.append(np.full(len(rows[-1]), item))
        self.symbols, own = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.lens = (self.symbols > 0).sum(1)
        pairs = np.unique(np.stack([own.ravel(), np.concatenate(owners)], 1), axis=0)
        self.item_ids = pairs[:, 1]
        self.item_starts = np.searchsorted(pairs[:, 0], np.arange(len(self.symbols) + 1))
        self.shortest = int(self.lens.min()) if len(self.lens) else 0

    def items(self, window: int) -> list[int]:
        """The items that hold a window."""
        return self.item_ids[self.item_starts[window] : self.item_starts[window + 1]].tolist()


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """By prefix doubling, until all suffixes differ."""
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    ranks, step = ranks.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = ranks[step:] + 1
        key = ranks * (int(ranks.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.append(0, np.diff(key[order]) != 0))
        ranks = np.empty(n, np.int64)
        ranks[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2
        if step >= n:
            return order


class WaveletMatrix:
    """Rank and access over a sequence of small integers, all arguments arrays."""

    def __init__(self, seq: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.levels = []
        for bit in range(self.bits - 1, -1, -1):
            ones = (seq >> bit & 1).astype(bool)
            raw = np.zeros((len(seq) // 64 + 1) * 8, np.uint8)
            packed = np.packbits(ones, bitorder="little")
            raw[: len(packed)] = packed
            words = raw.view("<u8")
            counts = np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))
            self.levels.append((bit, words, counts, len(seq) - int(ones.sum())))
            seq = np.concatenate([seq[~ones], seq[ones]])

    @staticmethod
    def ones(words: np.ndarray, counts: np.ndarray, i: np.ndarray) -> np.ndarray:
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return counts[i >> 6] + np.bitwise_count(words[i >> 6] & mask)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place i."""
        start = np.zeros(len(i), np.int64)
        for bit, words, counts, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            a, b = self.ones(words, counts, start), self.ones(words, counts, i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for bit, words, counts, zeros in self.levels:
            one = (words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            out |= one.astype(np.int64) << bit
            before = self.ones(words, counts, i)
            i = np.where(one, zeros + before, i - before)
        return out


class FmIndex:
    """Over runs of symbols from 1 on, each run followed by a 0."""

    def __init__(self, seq: np.ndarray, top: int):
        gaps = np.flatnonzero(seq == 0)
        ranks = seq + len(gaps)
        ranks[gaps] = np.arange(len(gaps))  # all separators differ, so suffixes differ by the end of their run
        self.order = suffix_array(ranks)
        before = seq[self.order - 1]
        self.first = np.append(0, np.cumsum(np.bincount(seq, minlength=top + 1)))
        self.matrix = WaveletMatrix(before, top)
        self.known = (self.order % SAMPLE == 0) | (before == 0)  # a walk never leaves its run
        self.sampled = self.order[self.known]
        self.known_before = np.append(0, np.cumsum(self.known))
        del self.order

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """The row range of each phrase, by backward search of all at once."""
        last = phrases.symbols[np.arange(len(phrases.lens)), phrases.lens - 1]
        lo, hi = self.first[last], self.first[last + 1]
        for j in range(2, phrases.symbols.shape[1] + 1):
            live = np.flatnonzero((phrases.lens >= j) & (lo < hi))
            if not len(live):
                break
            c = phrases.symbols[live, phrases.lens[live] - j]
            lo[live] = self.first[c] + self.matrix.rank(c, lo[live])
            hi[live] = self.first[c] + self.matrix.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place of each row's suffix: steps back until a sampled row, whose place is stored."""
        out, walked = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        rows = rows.copy()
        while len(left):
            known = self.known[rows[left]]
            hit = left[known]
            out[hit] = self.sampled[self.known_before[rows[hit]]] + walked[hit]
            left = left[~known]
            if len(left):
                c = self.matrix.access(rows[left])
                rows[left] = self.first[c] + self.matrix.rank(c, rows[left])
                walked[left] += 1
        return out


def find(texts: list[str], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the words; and of all occurrences the text, its first word and the phrase."""
    get, none = phrases.vocab.get, np.zeros(0, np.int64)
    coded = [[get(w, 0) for w in words_of(t)] for t in texts]
    n_words = np.array([len(c) for c in coded], np.int64)
    starts = np.append(0, np.cumsum(n_words))
    flat = np.fromiter((x for c in coded for x in c), np.int32, int(starts[-1]))
    if not len(phrases.lens) or not len(flat):
        return n_words, none, none, none
    inside = np.zeros(len(flat) + 2, bool)
    inside[1:-1] = flat > 0
    cut = np.zeros(len(flat) + 1, bool)
    cut[starts] = True
    begins = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    long = ends - begins >= phrases.shortest
    begins, ends = begins[long], ends[long]
    if not len(begins):
        return n_words, none, none, none
    size = ends - begins
    at = np.append(0, np.cumsum(size + 1))  # where each run starts in the index
    seq = np.zeros(at[-1], np.int64)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    seq[np.repeat(at[:-1], size) + place] = flat[np.repeat(begins, size) + place]
    index = FmIndex(seq, len(phrases.vocab))
    lo, hi = index.search(phrases)
    counts = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(lo)), counts)
    if not len(which):
        return n_words, none, none, none
    spots = index.locate(np.repeat(lo, counts) + np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts))
    run = np.searchsorted(at, spots, side="right") - 1
    word = begins[run] + spots - at[run]
    doc = np.searchsorted(starts, word, side="right") - 1
    return n_words, doc, word - starts[doc], which


def judge(texts: list[str], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[int]]]:
    """Of each text its words, merged spans of hit words (first, one past the last) and the items that occur."""
    n_words, doc, first, which = find(texts, phrases)
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[int]] = {}
    order = np.lexsort((first, doc))
    for d, a, p in zip(doc[order].tolist(), first[order].tolist(), which[order].tolist(), strict=True):
        b = a + int(phrases.lens[p])
        own = spans.setdefault(d, [])
        if own and a <= own[-1][1]:
            own[-1] = (own[-1][0], max(b, own[-1][1]))
        else:
            own.append((a, b))
        items.setdefault(d, set()).update(phrases.items(p))
    return [(n, spans.get(i, []), sorted(items.get(i, ()))) for i, n in enumerate(n_words.tolist())]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


REPORT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("items", T.ArrayType(T.LongType())),
])


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", report: str = "report") -> DataFrame:
    """docs with a struct of n_words, n_hit, merged spans of hit words and the ids of items that occur."""
    spark = docs.sparkSession
    ship(spark)
    bound_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    blocks = -(-int(items.agg(F.sum(F.octet_length("t")).alias("n")).head().n or 1) // BLOCK_BYTES)
    out = docs
    for b in range(blocks):  # one, unless the benchmark is larger than a block
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b) if blocks > 1 else items
        out = _pass(out, spark.sparkContext.broadcast(Phrases([(r.i, r.t) for r in own.collect()])), text, report, b > 0)
    return out


def _pass(docs: DataFrame, phrases, text: str, report: str, again: bool) -> DataFrame:
    keep = [f for f in docs.schema.fields if f.name != report]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text, SHARD_BYTES):
                found = judge(texts_of(batch, text), phrases.value)
                if again:
                    old = batch.column(report).to_pylist()
                    found = [(n, merge_spans([*s, *map(tuple, o["spans"])]), sorted({*i, *o["items"]})) for (n, s, i), o in zip(found, old, strict=True)]
                n_spans = np.array([len(s) for _, s, _ in found], np.int64)
                flat = np.array([x for _, s, _ in found for ab in s for x in ab], np.int64)
                pairs = as_lists_of(as_lists(flat, np.full(int(n_spans.sum()), 2), pa.int64()), n_spans)
                ids = as_lists(np.array([x for _, _, i in found for x in i], np.int64), np.array([len(i) for _, _, i in found], np.int64), pa.int64())
                hit = pa.array([sum(b - a for a, b in s) for _, s, _ in found], pa.int64())
                struct = pa.StructArray.from_arrays([pa.array([n for n, _, _ in found], pa.int64()), hit, pairs, ids], ["n_words", "n_hit", "spans", "items"])
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [struct], [*names, report])

    return docs.mapInArrow(run, T.StructType([*keep, T.StructField(report, REPORT)]))


def as_lists_of(inner: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), inner)


def contaminated(report: str = "report"):
    """Whether a twentieth of the words or more is hit."""
    return (F.col(f"{report}.n_hit") > 0) & (SHARE * F.col(f"{report}.n_hit") >= F.col(f"{report}.n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that are not contaminated."""
    name = "report"
    while name in docs.columns:
        name += "_"
    return scan(docs, benchmark, text, name).where(~contaminated(name)).drop(name)
