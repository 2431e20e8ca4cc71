"""Exports: numbered text files of a fixed number of units each, JSON lines, whole documents.

A unit (a record, a finding) is a text that ends with a line feed; its number in its stem decides its file, so files are exact and their contents do
not depend on partitions. Each file is written by one task beside the folder and renamed into place by the driver, once
all are there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_UNITS = 1_000_000
MOST_FILES = 99_999


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.Path, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_numbered(units: DataFrame, folder: str, suffix: str, per_file: int = DEFAULT_UNITS, stems: list[str] | None = None) -> list[str]:
    """Writes units (stem, n from 0 in its stem, text) as `<stem>.<number><suffix>`, `per_file` units each (0: one file);
    stems without units get an empty file 1. Earlier files of these stems go. Returns the names."""
    spark = units.sparkSession
    number = F.lit(1).cast("long") if per_file == 0 else F.floor(F.col("n") / per_file) + 1
    rows = units.select("stem", number.alias("number"), "n", F.expr("substring(text, 1, length(text) - 1)").alias("text"))
    most = rows.agg(F.max("number")).first()[0] or 1
    if most > MOST_FILES:
        raise ValueError(f"{most} files for a stem; at most {MOST_FILES}")
    Path, fs = _fs(spark, folder)
    part = f"{folder.rstrip('/')}/.part-{uuid.uuid4().hex}"
    # A number for each file: its stem's place in order, then its own. Rows of a file meet in one task in their order.
    names = [r[0] for r in rows.select("stem").distinct().orderBy("stem").collect()]  # one a source file
    place = F.array_position(F.array(*map(F.lit, names)), F.col("stem")) if names else F.lit(0).cast("long")
    files = rows.select((place * (MOST_FILES + 1) + F.col("number")).alias("file"), "n", "text")
    files.repartition("file").sortWithinPartitions("file", "n").select("file", "text").write.partitionBy("file").text(part, lineSep="\n")
    made: list[tuple[str, str]] = []
    for c in fs.listStatus(Path(part)):
        if not c.isDirectory():
            continue
        found = [f.getPath() for f in fs.listStatus(c.getPath()) if f.getPath().getName().startswith("part-")]
        if len(found) != 1:
            raise RuntimeError(f"{c.getPath()}: {len(found)} parts for one file")
        stem, own = divmod(int(c.getPath().getName().removeprefix("file=")), MOST_FILES + 1)
        made.append((found[0].toString(), f"{names[stem - 1]}.{own:05d}{suffix}"))
    have = {name.removesuffix(suffix)[:-6] for _, name in made}
    for old in fs.listStatus(Path(folder)):
        name = old.getPath().getName()
        if name.endswith(suffix) and name.removesuffix(suffix)[:-6] in {*have, *(stems or [])}:
            fs.delete(old.getPath(), False)
    for full, name in made:
        if not fs.rename(Path(full), Path(f"{folder.rstrip('/')}/{name}")):
            raise OSError(f"can't put {name} into {folder}")
    for stem in set(stems or []) - have:
        name = f"{stem}.00001{suffix}"
        fs.create(Path(f"{folder.rstrip('/')}/{name}"), True).close()
        made.append(("", name))
    fs.delete(Path(part), True)
    return sorted(name for _, name in made)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Puts a file in another's place. Where the file system can, in one step: no moment has neither."""
    Path, fs = _fs(spark, old)
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(Path(old)), fs.makeQualified(Path(new)), options)


def write_document(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, written beside its place and renamed."""
    Path, fs = _fs(spark, path)
    part = Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename(spark, part.toString(), path)


def read_document(spark: SparkSession, path: str) -> str | None:
    """A small text file's content, null where there is none."""
    Path, fs = _fs(spark, path)
    if not fs.exists(Path(path)):
        return None
    stream = fs.open(Path(path))
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
    finally:
        stream.close()


def made(spark: SparkSession, folder: str) -> str:
    Path, fs = _fs(spark, folder)
    fs.mkdirs(Path(folder))
    return folder


def write_json(spark: SparkSession, path: str, value: object, sort: bool = False) -> None:
    write_document(spark, path, json.dumps(value, indent=2, sort_keys=sort) + "\n")


def json_lines(rows: DataFrame, columns: list[str]) -> F.Column:
    """A compact JSON line of the columns in their order, nulls written."""
    return F.concat(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), F.lit("\n"))
