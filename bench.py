"""Headline queries, timed. Prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from cartulary.functions import codec  # noqa: E402
from cartulary.operators import store  # noqa: E402
from cartulary.operators.index import INDEXES  # noqa: E402
from cartulary.operators.query import bbox_query  # noqa: E402
from cartulary.operators.stats import SIZES  # noqa: E402
from cartulary.plans import registry  # noqa: E402
from cartulary.schema import BOXES  # noqa: E402
from cartulary.session import get_spark, scratch  # noqa: E402
from cartulary.sources import derived  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

HEADLINE = ("bbox_scan_medium", "geohash_hybrid", "s2_hybrid", "hex_hybrid", "multi_bbox_join", "pool_dictionary", "delta_quantised", "offset_index", "layer_totals", "bench_stats_sample")


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 4)


def best(run, times: int = 3) -> float:
    return min(timed(run) for _ in range(times))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    drain(derived.features(spark, sf))  # start-up and compilation are not the queries'
    out: dict[str, float] = {}
    for name in HEADLINE:
        out[name] = best(lambda name=name: drain(registry.QUERIES[name](spark, sf)), 2)

    # the workload of the layer benchmark: indexes built and saved once, then asked for each box
    layer = store.FeatureStore.write(derived.layer(spark, sf), scratch(spark, "layer"))
    features = layer.features
    rows = features.count()
    made = {}
    for kind, cls in INDEXES.items():
        index = cls() if kind != "hex" else cls(8)
        path = scratch(spark, kind)
        out[f"build_{kind}"] = timed(lambda index=index, path=path: index.build(features).save(path))
        out[f"build_{kind}_per_million"] = round(out[f"build_{kind}"] / rows * 1e6, 2)
        made[kind] = index.load(spark, path)
    bounds = made["bounds"]
    for size in ("small", "medium", "large"):
        for kind, index in made.items():
            out[f"query_{kind}_{size}"] = best(lambda index=index, size=size: bbox_query(features, index, BOXES[size], bounds).count())
    for n in SIZES:
        out[f"sequential_{n}"] = best(lambda n=n: drain(layer.sequential(n)), 2)
    out["random_1000"] = best(lambda: drain(layer.random(1000)), 2)
    out["codec_round_trip"] = best(lambda: drain(features.select(codec.decode(codec.encode(F.col("coords"))).alias("c"))), 2)
    total = round(sum(v for k, v in out.items() if not k.endswith("_per_million")), 3)
    print(json.dumps({"metric": "layer queries, index builds and reads", "value": total, "unit": "sec", "queries": out, "sf": os.path.basename(sf).removeprefix("sf"), "features": rows}))
    spark.stop()


if __name__ == "__main__":
    main()
