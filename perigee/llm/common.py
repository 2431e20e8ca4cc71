"""What the operators of this subpackage share: durable intermediate tables and connected components."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee import on_path

_roots: dict[str, str] = {}
#: Size of the Arrow batches that Python workers are handed, about. Spark's own bound is 64 MB: a worker holds a batch and
#: what it makes of it, the executor the buffers that it fills.
BATCH = "8m"
#: Whether Spark removes an execution's shuffle files as it ends. Only a plan that is executed again would miss them.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
#: By session: the writes under way, and the setting before them.
_writing: dict[int, tuple[int, str | None]] = {}


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches of long texts. Sessions that have another bound than Spark's own keep it."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m") == "64m":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, which driver and executors share.

    Where that setting is missing, a local master gets a temporary folder; a cluster is refused, as a
    machine-local folder would lose its rows with the executor.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="perigee-")
        _roots[app] = f"{root.rstrip('/')}/{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_delete, spark, _roots[app])
    return _roots[app]


def _delete(spark: SparkSession, path: str) -> None:
    """At exit: removes the application's intermediate tables if the session is still there."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may be gone, and then nothing can be done
        pass


@contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    """While it holds, an execution's shuffle files go as it ends, not when the driver next collects its garbage.

    Threads on one session may overlap: the last one out restores the setting.
    """
    session = spark._jsparkSession.hashCode()
    with _lock:
        if session not in _writing:
            _writing[session] = (0, spark.conf.get(FREE, None))
            spark.conf.set(FREE, "true")
        _writing[session] = (_writing[session][0] + 1, _writing[session][1])
    try:
        yield
    finally:
        with _lock:
            n, before = _writing.pop(session)
            if n > 1:
                _writing[session] = (n - 1, before)
            elif before is None:
                spark.conf.unset(FREE)
            else:
                spark.conf.set(FREE, before)


def materialize(df: DataFrame) -> DataFrame:
    """Writes the rows once to the shared folder and reads them back: lineage ends there, a lost executor costs a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    with _freeing(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_path()
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); root is the component's smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until a round changes nothing. Each step is a
    partially aggregated minimum by node and an equi-join. The minima are written before they are joined: a join of rows
    with an aggregate that has just been shuffled by the same key is never split, one with a table that is read is. No
    edge or node reaches the driver but two sums.
    """
    e = edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x > y").distinct()
    e = materialize(e)
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = e.select(F.col("x").alias("u"), F.col("y").alias("v")).union(e.select("y", "x"))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("x"), F.col("m").alias("y"))
        # The smallest neighbour of a large-star edge's upper end, then both ends hang from it.
        large = materialize(large.where("x > y").distinct())
        low = materialize(large.groupBy("x").agg(F.min("y").alias("m")))
        small = large.join(low, "x").where("y > m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        e = materialize(small.union(low.select("x", F.col("m").alias("y"))).distinct())
    roots = e.groupBy("x").agg(F.min("y").alias("root"))
    return materialize(roots.select(F.col("x").alias("node"), "root").union(roots.select(F.col("root").alias("node"), "root").distinct()))


def held_out(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(mod))
