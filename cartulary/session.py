"""Session settings, the shared scratch folder and shipping of the package to executors."""

from __future__ import annotations

import atexit
import gc
import itertools
import os
import tempfile
import time
import uuid
import weakref
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.python.filterPushdown.enabled": "true",
}

_shipped: set[str] = set()
_own_dir: list[str] = []
_scratch: dict[str, str] = {}
#: Tables after which the driver's JVM is told to collect what nothing refers to any more: only then does Spark delete their shuffle files.
CLEAN_EVERY = 12
_tables = itertools.count(1)
#: Paths of the tables that cut() wrote and nothing removed so far, in order, and those that cut() gave out as DataFrames.
_live: list[str] = []
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def get_spark(app: str = "cartulary", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators rely on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="cartulary-"), "cartulary.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.join("cartulary", os.path.relpath(p, root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="cartulary-shared-"))
    return _own_dir[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; everything there is removed when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = f"{shared_dir(spark)}/cartulary-{app}-{uuid.uuid4().hex[:8]}"
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(_scratch[app])
        atexit.register(_remove, path, conf)
    return f"{_scratch[app]}/{name}-{uuid.uuid4().hex[:12]}"


def _remove(path, conf) -> None:
    try:
        path.getFileSystem(conf).delete(path, True)
    except Exception:  # the JVM may have gone first; the folder is scratch space
        pass


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends here, and losing executors loses nothing."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    if next(_tables) % CLEAN_EVERY == 0:
        df.sparkSession.sparkContext._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _live.append(path)
    _path_of[out] = path
    return out


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what is finished; worth its time after large shuffles."""
    gc.collect()  # tables that only Python's cycles hold
    for _ in range(2):  # one collection alone was followed by as much disk as none
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)  # Spark deletes in the background


def forget(*tables: DataFrame) -> None:
    """Remove tables that cut() returned. Nothing that is still to be computed may read them."""
    for df in tables:
        _delete(df.sparkSession, [_path_of.pop(df)])


def settle(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """cut() what make returns, then remove the tables that were cut while make ran: only its result may read them."""
    before = set(_live)
    out = cut(make(), name)
    _delete(out.sparkSession, [p for p in _live if p not in before and p != _path_of[out]])
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        _live.remove(p)
