"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of full-dimensional codewords, one of each
codebook. Codebooks are fitted one after the other by k-means to the residuals
of a bounded sample, and every vector is encoded by beam search over the
codebooks. Beside its codes a vector keeps the squared norm of its approximation,
from which distances follow (distances()); inner products need the lookup table
alone: a query's products with all codewords, summed over a vector's codes. The best SHORTLIST by that
score are then ranked by exact inner products in double precision.

Queries are taken in blocks of bounded size; each block meets the rows' codes
where they lie, every batch of rows gives its k best of a shortlist, and a window
over a query's few rows merges them, so no task holds more than a block of
queries and a batch of rows. As a shortlist is taken of each batch, which rows
are ranked exactly depends on how rows lie in batches, and a table of few rows is
ranked exactly as a whole. Ties go to the smaller id throughout, and the rank that a shortlist ends
with is widened to all its ties.

Defined cases: vectors that are null, of the wrong length, all zero or hold a
null or non-finite component take no part; repeated ids keep one row each (the
smallest vector, compared by components); fewer candidates than k give all; no
vectors give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.llm.batches import as_lists, bound_batches
from cartulary.session import cut, ship

#: Vectors that codebooks are fitted on, those of the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
BOOKS, WORDS, BEAM, ROUNDS = 8, 256, 8, 8
#: Candidates of each query that exact inner products rank, for each neighbour asked for.
WIDEN = 20
QUERY_BLOCK = 4096


@dataclass
class Codebooks:
    """words: books x codewords x dimensions."""

    words: np.ndarray

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes by beam search, and the squared norm of each approximation."""
        n, (books, size, dim) = len(vectors), self.words.shape
        codes, made = np.zeros((n, 1, 0), np.uint8), np.zeros((n, 1, dim), np.float32)
        for m in range(books):
            left = vectors[:, None, :] - made  # rows x beam x dim
            gain = (self.words[m] ** 2).sum(1) - 2 * left @ self.words[m].T
            loss = (left**2).sum(2)[:, :, None] + gain  # rows x beam x words
            flat = loss.reshape(n, -1)
            keep = min(BEAM, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
            beam, word = best // size, best % size
            codes = np.concatenate([np.take_along_axis(codes, beam[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
            made = np.take_along_axis(made, beam[:, :, None], 1) + self.words[m][word]
        return codes[:, 0], (made[:, 0] ** 2).sum(1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """books x codewords x queries: the products a score sums up."""
        return np.einsum("mkd,qd->mkq", self.words, queries, optimize=True).astype(np.float32)

    def distances(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Approximate squared distances, rows x queries, from lookup tables and stored norms."""
        tables = self.tables(queries)
        products = sum(tables[m][codes[:, m]] for m in range(len(tables)))
        return norms[:, None] - 2 * products + (queries**2).sum(1)[None, :]

    def approximate(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(self.words.shape[0]))


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 7) -> Codebooks:
    """Residual codebooks by k-means, then refitted once each to what the other books leave."""
    rng = np.random.default_rng(seed)
    size = min(words, len(sample))
    found = np.zeros((books, size, sample.shape[1]), np.float32)
    rest = sample.astype(np.float32).copy()
    for m in range(books):
        centres = rest[rng.choice(len(rest), size, replace=False)]
        for _ in range(ROUNDS):
            near = ((centres**2).sum(1) - 2 * rest @ centres.T).argmin(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, rest)
            counts = np.bincount(near, minlength=size)
            centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], rest[rng.choice(len(rest), size)])
        near = ((centres**2).sum(1) - 2 * rest @ centres.T).argmin(1)
        found[m] = centres
        rest -= centres[near]
    out = Codebooks(found)
    codes = np.concatenate([out.encode(sample[i : i + 512].astype(np.float32))[0] for i in range(0, len(sample), 512)])
    for m in range(books):
        own = sample - (out.approximate(codes) - out.words[m][codes[:, m]])
        sums = np.zeros_like(out.words[m])
        np.add.at(sums, codes[:, m], own.astype(np.float32))
        counts = np.bincount(codes[:, m], minlength=size)
        out.words[m] = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], out.words[m])
    return out


def usable(vector: Column, dim: int) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & fine & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array, dim: int, kind=np.float64) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(-1, dim)


def index(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, Codebooks | None, int]:
    """All usable rows with codes and norms (vec_id, v, codes, norm), as a table; the codebooks and the dimension."""
    spark = df.sparkSession
    ship(spark)
    bound_batches(spark)
    own = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("v")).where("vec_id IS NOT NULL")
    top = own.where("v IS NOT NULL").groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").head()
    dim = top.dim if top else 0
    rows = own.where(usable(F.col("v"), dim)).groupBy("vec_id").agg(F.min("v").alias("v"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toArrow()
    if not len(sample):
        return rows.select("vec_id", "v", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).cast("float").alias("norm")), None, dim
    books = fit(matrix(sample["v"].combine_chunks(), dim, np.float32))
    shared = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                codes, norm = shared.value.encode(matrix(batch.column("v"), dim, np.float32))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm, pa.float32())], ["vec_id", "v", "codes", "norm"])

    return cut(rows.mapInArrow(run, "vec_id long, v array<double>, codes binary, norm float"), "codes"), books, dim


def search(rows: DataFrame, books: Codebooks | None, dim: int, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k nearest rows of each query (vec_id, v) by inner product: query_id, rank, vec_id, score."""
    spark, wide = rows.sparkSession, k * WIDEN
    if books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total = queries.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    found = None
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b) if blocks > 1 else queries
        block = own.select("vec_id", "v").toArrow()  # about QUERY_BLOCK rows
        if not block.num_rows:
            continue
        vectors = matrix(block["v"].combine_chunks(), dim)
        shared = spark.sparkContext.broadcast((block["vec_id"].to_numpy(), vectors, books.tables(vectors.astype(np.float32))))
        part = _block(rows, shared, dim, k, wide)
        if blocks > 1:  # one after the other, so that one block is held at a time
            part = cut(part, "block")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block(rows: DataFrame, shared, dim: int, k: int, wide: int) -> DataFrame:
    """Of each batch of rows every query's k best: a shortlist by lookup tables, then exact products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, tables = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own, vectors = batch.column("vec_id").to_numpy(), matrix(batch.column("v"), dim)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(own), -1)
            out_q, out_i, out_s = [], [], []
            for a in range(0, len(ids), 64):
                scores = np.zeros((len(own), min(64, len(ids) - a)), np.float32)
                for m in range(codes.shape[1]):
                    scores += tables[m, :, a : a + 64][codes[:, m]]
                for j in range(scores.shape[1]):
                    s = scores[:, j]
                    if len(s) > wide:
                        edge = np.partition(s, len(s) - wide)[len(s) - wide]
                        short = np.flatnonzero(s >= edge)  # all that tie with the last
                    else:
                        short = np.arange(len(s))
                    short = short[own[short] != ids[a + j]]
                    exact = (vectors[short] * queries[a + j]).sum(1)
                    best = np.lexsort((own[short], -exact))[:k]
                    out_q.append(np.full(len(best), ids[a + j]))
                    out_i.append(own[short[best]])
                    out_s.append(exact[best])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_i)), pa.array(np.concatenate(out_s))], ["query_id", "vec_id", "score"])

    return rows.select("vec_id", "v", "codes").mapInArrow(run, "query_id long, vec_id long, score double")
