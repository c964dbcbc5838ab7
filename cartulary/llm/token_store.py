"""Token ids on disk as directly addressable codes.

An id is split into chunks of CHUNK_BITS bits, the lowest first. Level 0 holds
the first chunk of every id, level 1 the second chunk of those ids that have one,
and so on. A bitmap beside each level says which ids go on, and a rank directory
counts its ones before each 64-bit word; so the place of an id's next chunk is a
rank, and any token is read by one look per level without decoding a block.

A file part (one row of the stored table, written and read by Spark so that any
store works) covers consecutive documents in ascending doc_id order:

    8 bytes magic, u32 documents, u32 levels, u64 tokens,
    per document u64 key position and u64 first token (one more at the end),
    per level u64 chunks, the chunks (u8), u64 bitmap words, u64 ranks.

All numbers are little endian. Parts are cut at PART_TOKENS, so memory stays
bounded whatever a document range holds; a longer document is a part of its own.

Defined cases: null texts count as empty and hold the end id only; rows of equal
doc_id keep all their tokens, in the order of their ids; a null doc_id comes first; an
empty table gives no parts.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartulary.llm.batches import bound_batches, pieces, texts_of
from cartulary.session import scratch, ship

MAGIC = b"DACTOK1\0"
CHUNK_BITS = 8
PART_TOKENS = 1 << 20
#: Bytes of text that are encoded at once: new words are gathered over a slice, so larger ones cost less.
SLICE_BYTES = 4 << 20
#: Words whose ids a worker remembers before it starts anew.
CACHE_WORDS = 1_000_000
#: Texts of these characters only are split here and their words encoded once; the library gets all others whole.
PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")


class Encoder:
    """The tokenizers library with a memory: a word that comes again is not encoded again."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        gc.disable()  # millions of small objects without cycles
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.kind, self.code = (np.uint16, "H") if self.library.get_vocab_size() <= 1 << 16 else (np.uint32, "I")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed integers of self.kind."""
        split = [SPLIT.findall(t) if PLAIN.fullmatch(t) and not any(x in t for x in self.special) else None for t in texts]
        whole = iter(self.ids([t for t, s in zip(texts, split, strict=True) if s is None]))
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        new = list(set().union(*[s for s in split if s]) - self.cache.keys())
        self.cache.update(zip(new, self.ids(new), strict=True))
        get = self.cache.__getitem__
        return [next(whole) if s is None else b"".join(map(get, s)) for s in split]


@lru_cache(maxsize=4)
def load(path: str) -> Encoder:
    return Encoder(path)


def pack(ids: np.ndarray, keys: list[int], starts: list[int]) -> bytes:
    """A file part: ids of documents whose sort keys and first tokens are given."""
    levels, rest = [], ids.astype(np.uint64)
    while True:
        more = rest >> CHUNK_BITS > 0
        words = np.zeros(-(-len(rest) // 64) * 8, np.uint8)
        bits = np.packbits(more, bitorder="little")
        words[: len(bits)] = bits
        words = words.view("<u8")
        ranks = np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.uint64)).astype("<u8")
        levels.append((rest.astype(np.uint8), words, ranks))
        rest = rest[more] >> np.uint64(CHUNK_BITS)
        if not len(rest):
            break
    head = np.array([len(keys), len(levels)], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes()
    docs = np.array(keys, "<i8").tobytes() + np.array([*starts, len(ids)], "<u8").tobytes()
    body = b"".join(np.array([len(c)], "<u8").tobytes() + c.tobytes() + w.tobytes() + r.tobytes() for c, w, r in levels)
    return MAGIC + head + docs + body


class Part:
    """A file part opened for reading: token(i) is random access, tokens(a, b) a range, all() everything."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        n_docs, n_levels = np.frombuffer(data, "<u4", 2, 8).tolist()
        self.n = int(np.frombuffer(data, "<u8", 1, 16)[0])
        self.keys = np.frombuffer(data, "<i8", n_docs, 24)
        self.starts = np.frombuffer(data, "<u8", n_docs + 1, at := 24 + 8 * n_docs).astype(np.int64)
        at += 8 * (n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            size = int(np.frombuffer(data, "<u8", 1, at)[0])
            chunks = np.frombuffer(data, np.uint8, size, at := at + 8)
            words = np.frombuffer(data, "<u8", n := -(-size // 64), at := at + size)
            ranks = np.frombuffer(data, "<u8", n + 1, at := at + 8 * n)
            at += 8 * (n + 1)
            self.levels.append((chunks, words, ranks))

    def token(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level, (chunks, words, ranks) in enumerate(self.levels):
            out |= int(chunks[i]) << CHUNK_BITS * level
            word, bit = int(words[i >> 6]), i & 63
            if not word >> bit & 1:
                break
            i = int(ranks[i >> 6]) + (word & (1 << bit) - 1).bit_count()
        return out

    def all(self) -> np.ndarray:
        out, at = np.zeros(self.n, np.uint32), np.arange(self.n)
        for level, (chunks, words, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            at = at[np.unpackbits(words.view(np.uint8), count=len(chunks), bitorder="little").astype(bool)]
        return out

    def tokens(self, start: int, end: int) -> np.ndarray:
        return np.array([self.token(i) for i in range(start, end)], np.uint32)


def write(df: DataFrame, tokenizer_path: str, end_id: int | None = 0, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> str:
    """Encode every text of df and write the file parts; returns the table's path.

    Documents go to as many ranges of doc_id as there are shuffle partitions.
    The range borders are quantiles of doc_id alone, so texts are read once.
    """
    spark = df.sparkSession
    ship(spark)
    bound_batches(spark)
    path = path or scratch(spark, "tokens")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(-(1 << 63)))
    borders = df.select(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 100 * n).alias("q")).head().q or []
    bounds = np.unique(np.array(borders, np.int64))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(tokenizer_path)
        end = b"" if end_id is None else encoder.kind(end_id).tobytes()
        for whole in batches:
            for batch in pieces(whole, "text", SLICE_BYTES):
                packed = [p + end for p in encoder.encode(texts_of(batch, "text"))]
                seg = np.searchsorted(bounds, batch.column("key").to_numpy(), side="left").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(seg), batch.column("key"), pa.array(packed, pa.binary())], ["seg", "key", "ids"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = load(tokenizer_path).kind
        seg, part, before, keys, starts, held, size = None, 0, 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            data = pack(np.frombuffer(b"".join(held), kind), keys, starts)
            numbers = [pa.array([seg], pa.int32()), pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64())]
            return pa.RecordBatch.from_arrays([*numbers, pa.array([data], pa.binary())], ["seg", "part", "part_start", "n_tokens", "data"])

        for batch in batches:
            for s, k, x in zip(batch.column("seg").to_pylist(), batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                n_own = len(x) // np.dtype(kind).itemsize
                if keys and (s != seg or size + n_own > PART_TOKENS):
                    yield flush()
                    part, before, keys, starts, held, size = part + 1, before + size, [], [], [], 0
                if s != seg:
                    seg, part, before = s, 0, 0
                keys.append(k)
                starts.append(size)
                held.append(x)
                size += n_own
        if keys:
            yield flush()

    encoded = df.select(key.alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(ids, "seg int, key long, ids binary")
    stored = encoded.repartition(n, "seg").sortWithinPartitions("seg", "key", "ids").mapInArrow(parts, "seg int, part int, part_start long, n_tokens long, data binary")
    stored.write.option("compression", "zstd").parquet(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of stored parts: doc_id, start (tokens of all documents before), n_tokens, ids_crc32.

    A part knows its start in its range; the sums of whole ranges, at most one row
    for each shuffle partition of the writer, are broadcast.
    """
    ship(spark)
    files = spark.read.parquet(path)
    sizes = files.groupBy("seg").agg(F.sum("n_tokens").alias("n"))
    before = sizes.select("seg", (F.sum("n").over(Window.orderBy("seg")) - F.col("n")).alias("seg_start"))

    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column("base").to_pylist(), batch.column("data"), strict=True):
                part = Part(data.as_py())
                ids = part.all().astype("<u4")
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(part.starts[:-1], part.starts[1:], strict=True)]
                key = pa.array(part.keys, pa.int64(), mask=part.keys == -(1 << 63))
                yield pa.RecordBatch.from_arrays([key, pa.array(base + part.starts[:-1]), pa.array(np.diff(part.starts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    based = files.join(F.broadcast(before), "seg").select((F.col("seg_start") + F.col("part_start")).alias("base"), "data")
    return based.mapInArrow(docs, "doc_id long, start long, n_tokens long, ids_crc32 long")
