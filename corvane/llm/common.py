"""What the operators share: the shared folder, tables written to it, hashing, and connected components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import shutil
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
_MADE: list[tuple[SparkSession, str]] = []
_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or where that is unset (tests) one of this machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="corvane-")
        atexit.register(shutil.rmtree, _LOCAL[app], True)
    return "file://" + _LOCAL[app]


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the executors' Python workers; once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    here = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(here)
    at = os.path.join(tempfile.mkdtemp(prefix="corvane-code-"), "corvane_llm.zip")
    with zipfile.ZipFile(at, "w") as z:
        z.writestr("corvane/__init__.py", "")
        for name in sorted(os.listdir(here)):
            if name.endswith(".py"):
                z.write(os.path.join(here, name), os.path.relpath(os.path.join(here, name), os.path.dirname(top)))
    spark.sparkContext.addPyFile(at)


def spill(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and returns what was written: cuts the lineage, and a lost executor loses nothing.

    batch_rows bounds the rows of an Arrow batch that Python operators of df get.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane/{label}-{uuid.uuid4().hex}"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    if batch_rows:
        spark.conf.set(key, batch_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, old)
    _MADE.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes tables that spill() wrote, when no later step reads them."""
    for df in frames:
        for f in df.inputFiles()[:1]:
            _delete(df.sparkSession, f.rpartition("/")[0])


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that have been written: it does when its driver drops their plans."""
    gc.collect()
    spark._jvm.System.gc()


def spilled() -> list[tuple[SparkSession, str]]:
    """The tables that spill() has written so far."""
    return list(_MADE)


def delete(tables: list[tuple[SparkSession, str]]) -> None:
    """Deletes tables of spilled()."""
    for spark, path in tables:
        _delete(spark, path)
        if (spark, path) in _MADE:
            _MADE.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # an application that has ended has no JVM left to delete with
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- text and hashes


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then what stands between ASCII white space: [^\\x20\\x09-\\x0D]+, as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hash_all(items) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, items), dtype=np.uint64, count=len(items))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit words."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word windows over word hashes h; with fewer words, of the whole sequence."""
    n = len(h)
    if n == 0:
        return h
    width = min(k, n)
    out = np.full(n - width + 1, U(width))
    for i in range(width):
        out = mix(out * U(0x9E3779B97F4A7C15) + h[i : n - width + 1 + i])
    return np.unique(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def arrow(spark_schema, **cols) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=to_arrow_type(f.dataType)) for f in spark_schema], names=[f.name for f in spark_schema])


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): comp is the smallest node reachable by the edges; nodes without edges are not listed.

    Alternating large-star and small-star steps (Kiveris et al. 2014), each an aggregation and an equi-join, so that
    neither a hub nor a large component meets in one task as a collected list.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = spill(e, "edges")
    state = _digest(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        new = spill(small, "edges")
        discard(e)
        e, old, state = new, state, _digest(new)
        if state == old:
            break
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _digest(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return int(r[0]), r[1]
