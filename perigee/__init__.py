"""A PySpark engine for archives of two-line element sets, and for training-data corpora."""

from __future__ import annotations

import os
from pathlib import Path

VERSION = "0.2.0"
_HOME = str(Path(__file__).resolve().parent.parent)


def tuned(spark) -> None:
    """Validation makes long methods, which the JVM never compiles; below this limit Spark splits them instead. Sessions
    that have another limit than Spark's own keep it."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit", "65535") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def on_path() -> None:
    """Lets Python workers on this machine import the package wherever the driver was started. On a cluster it is
    installed on the executors or sent with --py-files."""
    from pyspark import SparkContext

    places = [os.environ]
    if SparkContext._active_spark_context is not None:
        places.append(SparkContext._active_spark_context.environment)
    for env in places:
        have = env.get("PYTHONPATH", "")
        if _HOME not in have.split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(filter(None, [have, _HOME]))


on_path()
