"""Text archives in and out: source files of lines, exported sets of numbered files, findings.

A source folder holds `tle*.txt`, a file a stem; an exported set is `<stem>.<number><suffix>`, numbers from 1 without gaps.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perigee.functions.tle import SPARK
from perigee.operators import records
from perigee.sources import exports
from perigee.sources.storage import over, saved

FINDING = (
    "schema_version string, outcome string, file string, norad_id long, rule_id string, source_lines array<long>, tier_attempted string, column_range array<int>, observed string, expected string, note string, "
    "related array<struct<rule_id: string, source_lines: array<long>, tier_attempted: string, column_range: array<int>, observed: string, expected: string, note: string>>"
)


class ArchiveError(ValueError):
    """The files at a path are not what they should be."""


def listed(spark: SparkSession, path: str) -> list[tuple[str, str, int]]:
    """(name, path, bytes) of the regular files in a folder, or of a file, in the order of their names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise ArchiveError(f"no such file or folder: {path}")
    return sorted((f.getPath().getName(), f.getPath().toString(), f.getLen()) for f in fs.listStatus(p) if f.isFile())


def stem(name: str) -> str:
    """A source file's name without its ending."""
    return re.sub(r"\.txt$", "", name)


def sources(spark: SparkSession, path: str) -> list[tuple[str, str, int]]:
    """(name, path, bytes) of the source files of a folder (not of folders in it), without exports; a file stands for
    itself whatever its name."""
    found = listed(spark, path)
    if len(found) == 1 and path.rstrip("/").endswith(found[0][0]):
        return found
    return [f for f in found if re.fullmatch(r"tle.*\.txt", f[0]) and not re.search(r"\.(cleaned|broken)\.txt$", f[0])]


def discover(spark: SparkSession, path: str) -> list[str]:
    return [full for _, full, _ in sources(spark, path)]


def _numbered(rows: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    """Text rows (keys, start, id, raw) with `at`, their number from 0 in (`within`): the scan numbers its rows in the order of
    its splits, and a row a split gives where each begins, so no file is brought together."""
    splits = rows.groupBy(*keys, "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    order = [k for k in (*keys, "start") if k not in within]
    names = {k: f"s_{k}" for k in (*keys, "start")}
    ahead = F.sum("n").over(Window.partitionBy(*within).orderBy(*order)) - F.col("n")
    splits = saved(splits.select(*(F.col(k).alias(v) for k, v in names.items()), "first", ahead.alias("ahead")))
    same = [F.col(k) == F.col(v) for k, v in names.items()]
    joined = rows.join(splits, reduce(lambda a, b: a & b, same))
    return joined.withColumn("at", F.col("id") - F.col("first") + F.col("ahead")).drop(*names.values(), "first", "ahead")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(src_file, line_no, raw) of the source files: lines end at line feeds alone; blank lines count."""
    files = discover(spark, path)
    if not files:
        raise ArchiveError(f"no tle*.txt files in {path}")
    rows = spark.read.option("lineSep", "\n").text(files)
    rows = rows.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("src_file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("raw"))
    return _numbered(rows, ["src_file"], ["src_file"]).select("src_file", (F.col("at") + 1).alias("line_no"), "raw")


def chunk_files(spark: SparkSession, folder: str, suffix: str) -> dict[str, list[str]]:
    """By stem: the files of its exported set in order. A gap in the numbers is an error."""
    return {stem: [full for full, _ in own] for stem, own in chunk_sizes(spark, folder, suffix).items()}


def chunk_sizes(spark: SparkSession, folder: str, suffix: str) -> dict[str, list[tuple[str, int]]]:
    """By stem: (path, bytes) of the files of its exported set in order. A gap in the numbers is an error."""
    sets: dict[str, dict[int, tuple[str, int]]] = {}
    for name, full, size in listed(spark, folder):
        m = re.fullmatch(rf"(.+)\.(\d{{5}}){re.escape(suffix)}", name)
        if m:
            sets.setdefault(m[1], {})[int(m[2])] = (full, size)
    for own_stem, own in sets.items():
        if sorted(own) != list(range(1, len(own) + 1)):
            raise ArchiveError(f"{folder}: the files of {own_stem} are not numbered 1 to {len(own)}")
    return {own_stem: [own[k] for k in sorted(own)] for own_stem, own in sorted(sets.items())}


def _pairs(spark: SparkSession, files: list[str], suffix: str) -> DataFrame:
    """(src_file, idx, line1, line2) of exported files: pairs by position, an odd last line ignored. A byte that is not
    ASCII becomes a replacement character."""
    rows = spark.read.option("lineSep", "\n").text(files)
    name = F.col("_metadata.file_name")
    raw = F.regexp_replace(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), r"[^\x00-\x7F]", "\ufffd")
    rows = rows.select(F.regexp_extract(name, r"^(.+)\.\d{5}\.", 1).alias("src_file"), F.regexp_extract(name, rf"\.(\d{{5}}){re.escape(suffix)}$", 1).cast("int").alias("chunk"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), raw.alias("raw"))
    joined = _numbered(rows, ["src_file", "chunk"], ["src_file"])
    halves = joined.select("src_file", F.floor(F.col("at") / 2).alias("idx"), (F.col("at") % 2).alias("half"), "raw")
    halves = halves.groupBy("src_file", "idx").agg(F.max(F.when(F.col("half") == 0, F.col("raw"))).alias("line1"), F.max(F.when(F.col("half") == 1, F.col("raw"))).alias("line2"))
    return halves.where("line2 is not null")


def read_cleaned(spark: SparkSession, folder: str, suffix: str = ".cleaned.txt") -> DataFrame:
    """The fact table (catalog, epoch_key, epoch_us, elset, line1, line2, src_file, idx) of an exported set."""
    sets = chunk_files(spark, folder, suffix)
    if not sets:
        raise ArchiveError(f"no *.NNNNN{suffix} files in {folder}")
    return over(_pairs(spark, [f for own in sets.values() for f in own], suffix), lambda t: records.facts(SPARK, t))


RECORD_BYTES = 140


def read_import(spark: SparkSession, folder: str) -> DataFrame:
    """The import set of a finished run as a fact table in its order. Files whose size is no multiple of a record, a gap in
    their numbers or catalog numbers that fall from one file to the next are errors."""
    own = chunk_sizes(spark, folder, ".txt").get("import", [])
    if not own:
        raise ArchiveError(f"no import.NNNNN.txt files in {folder}")
    for path, size in own:
        if size % RECORD_BYTES:
            raise ArchiveError(f"{path}: {size} bytes are no whole records of {RECORD_BYTES}")
    rows = over(_pairs(spark, [path for path, _ in own], ".txt"), lambda t: records.facts(SPARK, t))
    ends = rows.groupBy(F.floor(F.col("idx") / F.lit(max(1, own[0][1] // RECORD_BYTES))).alias("chunk")).agg(F.min("catalog").alias("low"), F.max("catalog").alias("high")).orderBy("chunk").collect()  # a row a file
    for a, b in zip(ends, ends[1:], strict=False):
        if a["high"] > b["low"]:
            raise ArchiveError(f"{folder}: catalog numbers fall from {a['high']} to {b['low']}; the import set is not sorted")
    return rows


def read_findings(spark: SparkSession, folder: str) -> DataFrame:
    """The findings of a run, report.NNNNN.jsonl; a line of another schema or without rule or file is an error."""
    files = chunk_files(spark, folder, ".jsonl").get("report", [])
    if not files:
        raise ArchiveError(f"no report.NNNNN.jsonl files in {folder}")
    found = spark.read.schema(FINDING).json(files, mode="FAILFAST")
    bad = found.where("schema_version is distinct from '1' or rule_id is null or file is null").limit(1).collect()
    if bad:
        raise ArchiveError(f"{folder}: a finding lacks schema version 1, rule_id or file: {bad[0].asDict()}")
    return found


def read_suspects(spark: SparkSession, folder: str) -> DataFrame | None:
    """The suspects of a verified run (rule, severity, catalog, epoch_key, src_file, idx, detail), None without one."""
    try:
        files = chunk_files(spark, folder, ".jsonl").get("suspects", [])
    except ArchiveError:
        return None
    schema = "schema_version string, rule string, severity string, catalog long, epoch_key double, src_file string, index long, detail string"
    return spark.read.schema(schema).json(files, mode="FAILFAST").drop("schema_version").withColumnRenamed("index", "idx") if files else None


def read_broken_ids(spark: SparkSession, path: str) -> DataFrame:
    """(norad_id): catalog numbers that a run quarantined."""
    return spark.read.schema("noradId long").json(path).select(F.col("noradId").alias("norad_id"))


def read_json(spark: SparkSession, path: str) -> dict:
    """A JSON object from a small file; anything else is an error that names it."""
    text = exports.read_document(spark, path)
    if text is None:
        raise ArchiveError(f"no such file: {path}")
    try:
        value = json.loads(text)
    except ValueError as why:
        raise ArchiveError(f"{path}: not JSON ({why})") from why
    if not isinstance(value, dict):
        raise ArchiveError(f"{path}: not a JSON object")
    return value


def read_json_or_none(spark: SparkSession, path: str) -> dict | None:
    try:
        return read_json(spark, path)
    except ArchiveError:
        return None
