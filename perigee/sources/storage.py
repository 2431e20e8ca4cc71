"""Shared intermediate tables: written once to the folder that the cluster names, read from there by every query."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from perigee import on_path, tuned

_roots: dict[str, str] = {}
_made: dict[tuple, str] = {}


def root(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir; a temporary one only where a local master has none set."""
    on_path()
    tuned(spark)
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="perigee-")
        _roots[app] = f"{base.rstrip('/')}/{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_delete, spark, _roots[app])
    return _roots[app]


def _delete(spark: SparkSession, path: str) -> None:
    """At exit: removes the application's tables if the session is still there."""
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may be gone, and then nothing can be done
        pass


def saved(df: DataFrame) -> DataFrame:
    """The rows, written once and read from there."""
    return df.sparkSession.read.schema(df.schema).parquet(write(df))


def over(df: DataFrame, sql: Callable[..., str], *more: DataFrame) -> DataFrame:
    """A SQL operator over DataFrames: `sql` takes a SELECT for each. The views live only until the plan is made, under
    names of their own, so threads on one session don't meet."""
    spark = df.sparkSession
    names = [f"__perigee_{uuid.uuid4().hex}" for _ in (df, *more)]
    for name, rows in zip(names, (df, *more), strict=True):
        rows.createOrReplaceTempView(name)
    try:
        return spark.sql(sql(*(f"SELECT * FROM {name}" for name in names)))
    finally:
        for name in names:
            spark.catalog.dropTempView(name)


def stamp(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of the files at a path: what tells a changed input from the one before."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return tuple((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found)


def write(df: DataFrame) -> str:
    path = f"{root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def kept(spark: SparkSession, source: str, name: str, make: Callable[[], str]) -> str:
    """The path that `make` gives for `name`, made if this application has none of the source as it is now."""
    key = (spark.sparkContext.applicationId, source, stamp(spark, source), name)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def once(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame]) -> str:
    """Where the table `name` made from `source` is; it is made if this application has none of the source as it is now."""
    return kept(spark, source, name, lambda: write(make()))
