"""Where staged and iterated tables are settled: the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Bytes of stored rows for a task that keeps its rows' groups in memory; below SMALL, the planner deals them out.
SHARE, SMALL = 6 << 20, 32 << 20
#: An estimate from here on is Spark's stand-in for a size that it doesn't know.
UNKNOWN = 1 << 50


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where that is unset (tests) a folder of this machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="corvane-")
        atexit.register(shutil.rmtree, _LOCAL[app], True)
    return "file://" + _LOCAL[app]


def settle(df: DataFrame) -> DataFrame:
    """df written and read again: its lineage ends here, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shares(df: DataFrame) -> int | None:
    """Tasks to deal df's rows to, by the planner's estimate of its size; None where it is small or not known."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return -(-size // SHARE) if SMALL <= size < UNKNOWN else None


def spread(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """df by its keys in n tasks, so that grouping and sorting there take memory by n and not by the cluster's settings."""
    return df if n is None else df.repartition(n, *keys)
