"""Statistics over benchmark results."""

from __future__ import annotations

import math
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.schema import BENCH_SCHEMA

# Workload presets (repetitions, sizes), the size that charts compare at, limits of significance and of effect sizes.
SIZES = (100, 500, 1000, 5000, 10000)
PRESETS = {"quick": (3, (100, 1000)), "basic": (5, SIZES), "detailed": (10, SIZES)}
COMPARED_SIZE = 10_000
SIGNIFICANCE = ((0.001, "highly significant"), (0.01, "very significant"), (0.05, "significant"))
EFFECTS = ((0.2, "negligible"), (0.5, "small"), (0.8, "medium"))


def sample_stats(results: DataFrame, *by: str, value: str = "time_ms") -> DataFrame:
    """Count, mean, median, sample deviation (0 of one value), least and largest; values of 0 and below are dropped."""
    v = F.col(value)
    kept = results.where(v > 0)
    return kept.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("least"), F.max(v).alias("largest")
    )


def population_stats(results: DataFrame, *by: str, value: str = "time_ms", counts: str | None = None) -> DataFrame:
    """Mean, least, largest, population deviation and, with a counts column, its whole mean."""
    v = F.col(value)
    aggs = [F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("largest"), F.stddev_pop(v).alias("std")]
    if counts:
        aggs.append(F.expr(f"sum(`{counts}`) div count(*)").alias("mean_count"))
    return results.groupBy(*by).agg(*aggs)


def rate(n: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, n / seconds).otherwise(0.0)


def by_size(results: DataFrame, value: str = "time_ms") -> DataFrame:
    """Mean times of both index types per data size: data_size, s2, ogr."""
    return results.groupBy("data_size").pivot("index_type", ["s2", "ogr"]).agg(F.avg(value))


def improvement(results: DataFrame, value: str = "time_ms") -> DataFrame:
    """How much faster s2 is than ogr, in per cent of ogr's time, and the change relative to ogr."""
    both = by_size(results, value).where("s2 IS NOT NULL AND ogr IS NOT NULL")
    return both.select("data_size", F.when(F.col("ogr") > 0, (F.col("ogr") - F.col("s2")) / F.col("ogr") * 100).alias("time_gain"), F.when(F.col("ogr") > 0, (F.col("s2") - F.col("ogr")) / F.col("ogr") * 100).alias("change"))


def speedups(results: DataFrame, value: str = "time_ms") -> DataFrame:
    return by_size(results, value).where("s2 IS NOT NULL AND ogr IS NOT NULL").select("data_size", F.when(F.col("s2") > 0, F.col("ogr") / F.col("s2")).alias("speedup"))


def mean_speedup(results: DataFrame, value: str = "time_ms") -> DataFrame:
    return speedups(results, value).agg(F.avg(F.when(F.col("speedup") > 0, F.col("speedup"))).alias("mean_speedup"))


def regression(results: DataFrame, *by: str, x: str = "data_size", y: str = "time_ms") -> DataFrame:
    """Slope, intercept, correlation and determination of the logarithms."""
    kept = results.where((F.col(x) > 0) & (F.col(y) > 0)).withColumn("lx", F.ln(x)).withColumn("ly", F.ln(y))
    return kept.groupBy(*by).agg(F.regr_slope("ly", "lx").alias("slope"), F.regr_intercept("ly", "lx").alias("intercept"), F.corr("ly", "lx").alias("r"), F.regr_r2("ly", "lx").alias("r2"))


def spread(results: DataFrame, *by: str, value: str = "time_ms") -> DataFrame:
    """Mean, population deviation, median, least and largest."""
    v = F.col(value)
    return results.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.median(v).alias("median"), F.min(v).alias("least"), F.max(v).alias("largest"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, evaluated by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), (c if abs(c) > tiny else tiny)
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def t_p_value(t: float | None, freedom: float | None) -> float | None:
    """Two-sided p of Student's t."""
    if t is None or freedom is None or freedom <= 0 or math.isnan(t):
        return None
    if math.isinf(t):
        return 0.0
    x = freedom / (freedom + t * t)
    if x >= 1:
        return 1.0
    a, b = freedom / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(T.DoubleType())
def p_value(t: pd.Series, freedom: pd.Series) -> pd.Series:
    return pd.Series([t_p_value(a, b) for a, b in zip(t, freedom, strict=True)], dtype=float)


def _moments(results: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    def of(kind: str, f) -> Column:
        return f(F.when(F.col("index_type") == kind, F.col(value)))

    aggs = [of(k, f).alias(f"{n}_{k}") for k in ("s2", "ogr") for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    rows = results.groupBy(*by).agg(*aggs).where("n_s2 > 1 AND n_ogr > 1")
    pooled = ((F.col("n_s2") - 1) * F.col("v_s2") + (F.col("n_ogr") - 1) * F.col("v_ogr")) / (F.col("n_s2") + F.col("n_ogr") - 2)
    return rows.withColumn("pooled", F.sqrt(pooled))


def t_test(results: DataFrame, *by: str, value: str = "time_ms") -> DataFrame:
    """Student's t of s2 against ogr with pooled variance, degrees of freedom, p and its class."""
    rows = _moments(results, by, value)
    t = F.when(F.col("pooled") > 0, (F.col("m_s2") - F.col("m_ogr")) / (F.col("pooled") * F.sqrt(1 / F.col("n_s2") + 1 / F.col("n_ogr"))))
    rows = rows.select(*by, t.alias("t"), (F.col("n_s2") + F.col("n_ogr") - 2).cast("double").alias("freedom"))
    rows = rows.withColumn("p", p_value("t", "freedom"))
    label = F.lit("not significant")
    for limit, name in reversed(SIGNIFICANCE):
        label = F.when(F.col("p") < limit, name).otherwise(label)
    return rows.withColumn("significance", label)


def cohens_d(results: DataFrame, *by: str, value: str = "time_ms") -> DataFrame:
    """The distance of the means in pooled deviations and its class."""
    d = F.when(F.col("pooled") > 0, F.abs(F.col("m_s2") - F.col("m_ogr")) / F.col("pooled")).otherwise(0.0)
    rows = _moments(results, by, value).select(*by, d.alias("d"))
    label = F.lit("large")
    for limit, name in reversed(EFFECTS):
        label = F.when(F.col("d") < limit, name).otherwise(label)
    return rows.withColumn("effect", label)


def nearest_size(results: DataFrame, to: int = COMPARED_SIZE) -> DataFrame:
    """The data size nearest to one, of two equally near the smaller."""
    sizes = results.select("data_size").distinct()
    return sizes.agg(F.min(F.struct(F.abs(F.col("data_size") - to).alias("d"), "data_size")).alias("b")).select(F.col("b.data_size").alias("data_size"))


def memory_per_feature(results: DataFrame) -> DataFrame:
    """Mean KB of memory per feature by data size."""
    return results.groupBy("data_size").agg((F.avg("memory_usage_mb") * 1024 / F.col("data_size")).alias("kb_per_feature"))


def summary(results: DataFrame, value: str = "avg_time_ms") -> DataFrame:
    return results.groupBy("index_type").agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("largest"))


def series(results: DataFrame, operation: str | None = None, index_type: str | None = None) -> DataFrame:
    """Results of an operation and index type in the order of data size."""
    out = results
    if operation is not None:
        out = out.where(F.col("operation") == operation)
    if index_type is not None:
        out = out.where(F.col("index_type") == index_type)
    return out.orderBy("data_size")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a result document: an object with a results array."""
    doc = spark.read.schema(f"results ARRAY<{BENCH_SCHEMA.simpleString()}>").json(path, multiLine=True)
    return doc.select(F.inline("results"))


def write_results(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One document with a results array: the rows are a benchmark's few."""
    rows.agg(F.collect_list(F.struct(*BENCH_SCHEMA.names)).alias("results")).coalesce(1).write.mode(mode).json(path)


def measure(spark: SparkSession, work: dict[tuple[str, str, int], Callable[[], int]], iterations: int = 5) -> DataFrame:
    """Run each (index type, operation, size) so often and report its times; runs that fail are left out."""
    rows = []
    for (kind, operation, size), run in work.items():
        times, counts = [], []
        for _ in range(iterations):
            start = time.perf_counter()
            try:
                n = run()
            except Exception as e:
                print(f"{kind} {operation} {size}: {type(e).__name__}: {e}")
                continue
            times.append((time.perf_counter() - start) * 1000)
            counts.append(n)
        if times:
            mean = sum(times) / len(times)
            std = math.sqrt(max(0.0, sum(t * t for t in times) / len(times) - mean * mean))
            rows.append((kind, operation, size, mean, min(times), max(times), std, sum(counts) // len(counts), 0.0, len(times)))
    return spark.createDataFrame(rows, BENCH_SCHEMA)
