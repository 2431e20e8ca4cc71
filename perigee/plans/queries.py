"""The engine's operators as queries over the test tables: one SQL text each, for Spark and for the engine that checks it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee import archive, on_path
from perigee.functions import tle
from perigee.functions.tle import DUCK, SPARK, Dialect
from perigee.operators import align, dedup, orbit, records, verify
from perigee.plans import feed
from perigee.sources import exports, storage, tle_text

Text = Callable[[Dialect], str]


#: Tables that queries share, each a SELECT over the ones before. Spark writes each once; the checking engine has them
#: as common table expressions.
BASES: dict[str, Text] = {
    "feed_records": feed.records,
    "feed_lines": lambda d: feed.lines(d, "SELECT * FROM feed_records"),
    "routed_plain": lambda d: records.routed(d, "SELECT * FROM feed_lines"),
    "routed": lambda d: records.routed(d, "SELECT * FROM feed_lines", True),
    "cleaned": lambda d: records.cleaned(d, "SELECT * FROM routed"),
    # The fact table of the feed itself, without defects in between.
    "good": lambda d: records.cleaned(d, "SELECT src_file, event_id * 10 + rank AS src1, line1, line2, true AS clean FROM feed_records"),
    "suspects": lambda d: verify.suspects(d, "SELECT * FROM cleaned"),
    "good_suspects": lambda d: verify.suspects(d, "SELECT * FROM good"),
    "import_set": lambda d: dedup.import_set(d, "SELECT * FROM good"),
}


def _routed(d: Dialect, rebuild: bool = True) -> str:
    return f"SELECT * FROM {'routed' if rebuild else 'routed_plain'}"


def _cleaned(d: Dialect) -> str:
    return "SELECT * FROM cleaned"


def _good(d: Dialect) -> str:
    return "SELECT * FROM good"


def _suspects(d: Dialect) -> str:
    return "SELECT * FROM suspects"


def _used(d: Dialect) -> str:
    return dedup.excluding(_cleaned(d), _suspects(d))


def _imported(d: Dialect) -> str:
    return "SELECT * FROM import_set"


def _findings(d: Dialect, rebuild: bool = True) -> str:
    return f"SELECT src_file, src1, rule_id, norad_id FROM ({_routed(d, rebuild)}) r WHERE NOT clean"


def _residuals(_: Dialect) -> str:
    """A residual per event and user, some missing, a few far out."""
    return "SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 57 = 0 THEN round(value * 40, 1) ELSE round(value, 1) END AS r FROM events"


def _text_lines(d: Dialect) -> str:
    if d.spark:
        return "SELECT doc_id, CAST(n AS BIGINT) + 1 AS line_no, raw FROM (SELECT doc_id, posexplode(split(text, '[\\n]')) AS (n, raw) FROM documents) x"
    return "SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS raw FROM documents"


def _counts(d: Dialect, rebuild: bool, by_file: bool) -> str:
    file = "src_file, " if by_file else ""
    return f"SELECT {file}rule_id, count(*) AS n FROM ({_findings(d, rebuild)}) f GROUP BY {file}rule_id"


def _stats(d: Dialect) -> str:
    return records.file_stats(d, "SELECT * FROM feed_lines", _routed(d))


def _edges(d: Dialect) -> str:
    fixes = tle.edge_fixes(d, "raw")
    flags = ", ".join(f"CASE WHEN {t} THEN 1 ELSE 0 END AS {f.replace('-', '_')}" for f, t in fixes.items())
    return f"SELECT src_file, line_no, {tle.core(d, 'raw')} AS core, {flags} FROM (SELECT * FROM feed_lines) l WHERE NOT {tle.content_free(d, 'raw')}"


def _changed(_: Dialect) -> str:
    """Records of the feed with their places in it, some changed afterwards: the line itself, or where it is said to stand."""
    line2 = "CASE WHEN src1 % 13 = 0 THEN concat(substr(line2, 1, 67), '##') ELSE line2 END"
    return f"SELECT src_file, src1 AS idx, src1, CASE WHEN src1 % 17 = 0 THEN src2 + 10000000 ELSE src2 END AS src2, CASE WHEN src1 % 37 = 0 THEN concat(substr(line1, 1, 20), '999', substr(line1, 24)) ELSE line1 END AS line1, {line2} AS line2 FROM (SELECT * FROM routed) c WHERE clean"


def _population(d: Dialect) -> str:
    return f"SELECT DISTINCT catalog FROM ({_good(d)}) g WHERE catalog <> -1"


#: name: SQL text. Operators by group: lines and records; repair and routing; checks; latest and history; comparison.
TEXTS: dict[str, Text] = {
    "tle_checksum": lambda d: f"SELECT event_id, rank, CAST({tle.checksum('line1')} AS INT) AS sum1, CAST({tle.checksum('line2')} AS INT) AS sum2 FROM (SELECT * FROM feed_records) r",
    "tle_layout_valid": lambda d: f"SELECT src_file, line_no, {tle.layout_ok(d, 'raw', 1)} AS as_line1, {tle.layout_ok(d, 'raw', 2)} AS as_line2 FROM (SELECT * FROM feed_lines) l",
    "tle_semantic_valid": lambda d: f"SELECT src_file, line_no, {tle.body_ok(d, 'raw', 1)} AS as_line1, {tle.body_ok(d, 'raw', 2)} AS as_line2 FROM (SELECT * FROM feed_lines) l",
    "tle_line_valid": lambda d: f"SELECT src_file, line_no, {tle.line_ok(d, 'raw', 1)} AS as_line1, {tle.line_ok(d, 'raw', 2)} AS as_line2 FROM (SELECT * FROM feed_lines) l",
    "tle_content_free_drop": lambda d: f"SELECT doc_id, count(*) AS lines, CAST(sum(CASE WHEN {tle.content_free(d, 'raw')} THEN 1 ELSE 0 END) AS BIGINT) AS dropped FROM ({_text_lines(d)}) l GROUP BY doc_id",
    "tle_line_kinds": lambda d: f"SELECT src_file, kind, count(*) AS n FROM ({records.kept(d, "SELECT * FROM feed_lines")}) k GROUP BY src_file, kind",
    "tle_edge_fixes": _edges,
    "tle_pair_records": lambda d: f"SELECT src_file, src1, src2 FROM ({records.paired(d, "SELECT * FROM feed_lines")}) p WHERE rule_id IS NULL",
    "tle_orphans": lambda d: f"SELECT src_file, src1, rule_id, note FROM ({records.paired(d, "SELECT * FROM feed_lines")}) p WHERE rule_id IS NOT NULL",
    "tle_validate_rule_counts": lambda d: f"SELECT rule_id, tier, count(*) AS n FROM ({_routed(d, False)}) r WHERE NOT clean GROUP BY rule_id, tier",
    "tle_routed_rebuild": lambda d: f"SELECT src_file, src1, src2, line1, line2, rule_id, related_rule, tier, norad_id FROM ({_routed(d)}) r",
    "tle_repair_fixes": lambda d: records.fix_counts(_routed(d)),
    "tle_reconstruct_checksum": lambda d: f"SELECT src_file, src1, line1, line2 FROM ({_routed(d)}) r WHERE reconstructed_checksum1 + reconstructed_checksum2 > 0",
    "tle_catalog_mismatch": lambda d: f"SELECT src_file, src1, tier FROM ({_routed(d)}) r WHERE rule_id = 'TLE-PAIR-003'",
    "tle_decode_catalog": lambda d: f"SELECT event_id, rank, {tle.decode_catalog(d, tle.catalog_field('line1'))} AS catalog FROM (SELECT * FROM feed_records) r",
    "tle_epoch": lambda d: f"SELECT event_id, rank, epoch_year, epoch_day, epoch_key, epoch_us, {tle.iso_of('epoch_us', d)} AS iso FROM ({tle.with_epoch(d, "SELECT * FROM feed_records")}) e",
    "tle_element_set": lambda d: f"SELECT event_id, rank, {tle.element_set(d, 'line1')} AS elset FROM (SELECT * FROM feed_records) r",
    "tle_orbital_state": lambda d: "SELECT event_id, rank, " + ", ".join(f"{x} AS s{k}" for k, x in enumerate(tle.orbital_state("line1", "line2"))) + f" FROM (SELECT * FROM feed_records) r",
    "tle_cleaned": lambda d: f"SELECT catalog, epoch_key, epoch_us, elset, line1, line2, src_file, idx FROM ({_cleaned(d)}) c",
    "tle_file_stats": _stats,
    "tle_run_totals": lambda d: "SELECT count(*) AS files, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("lines", "paired", "orphan", "clean", "quarantined")) + f" FROM ({_stats(d)}) s",
    "tle_quarantine_sample": lambda d: f"SELECT src_file, rule_id, src1, nth FROM (SELECT src_file, rule_id, src1, row_number() OVER (PARTITION BY src_file, rule_id ORDER BY src1) AS nth FROM ({_findings(d)}) f) s WHERE nth <= 5",
    "tle_quarantine_dropped": lambda d: f"SELECT src_file, rule_id, count(*) - 5 AS dropped FROM ({_findings(d)}) f GROUP BY src_file, rule_id HAVING count(*) > 5",
    "tle_per_norad_breakdown": lambda d: f"SELECT norad_id, rule_id, count(*) AS n, count(DISTINCT src_file) AS files FROM ({_findings(d)}) f WHERE norad_id IS NOT NULL GROUP BY norad_id, rule_id",
    "tle_broken_norads": lambda d: f"SELECT DISTINCT norad_id FROM ({_findings(d)}) f WHERE norad_id IS NOT NULL",
    "tle_epoch_histogram": lambda d: verify.histogram(d, _cleaned(d)),
    "tle_epoch_conflicts": lambda d: f"SELECT catalog, epoch_key, src_file, idx FROM ({verify.conflicts(_good(d))}) c WHERE clash",
    "tle_reissue_census": lambda d: f"SELECT catalog, count(*) AS n FROM ({verify.conflicts(_good(d))}) c WHERE reissue GROUP BY catalog",
    "tle_duplicate_epochs": lambda d: verify.duplicate_epoch_catalogs(_good(d)),
    "tle_suspects": _suspects,
    "tle_suspect_summary": lambda d: verify.suspect_summary(_suspects(d)),
    "tle_suspects_by_file": lambda d: verify.suspect_summary(_suspects(d), True),
    "align_source": lambda d: align.by_provenance(d, _changed(d), "SELECT * FROM feed_lines"),
    "align_order": lambda d: align.by_order(d, _changed(d), "SELECT * FROM feed_lines"),
    "align_missing_sources": lambda d: align.missing_sources(_changed(d), "SELECT * FROM feed_lines WHERE src_file <> 'tle03'"),
    "tle_dedup_unusable_notes": lambda d: dedup.unusable_notes(d, f"SELECT CASE WHEN idx % 7 = 0 THEN -1 ELSE catalog END AS catalog, epoch_key, CASE WHEN idx % 11 = 0 THEN NULL ELSE epoch_us END AS epoch_us, elset, line1, line2, src_file, idx FROM ({_good(d)}) g"),
    "tle_dedup_latest": _imported,
    "tle_dedup_notes": lambda d: dedup.notes(d, _good(d)),
    "tle_dedup_excluding_hard": lambda d: f"SELECT catalog, epoch_key, src_file, idx FROM ({dedup.import_set(d, _used(d))}) i",
    "tle_dedup_unusable": lambda d: dedup.unusable_groups(d, f"SELECT CASE WHEN idx % 7 = 0 THEN -1 ELSE catalog END AS catalog, epoch_key, CASE WHEN idx % 11 = 0 THEN NULL ELSE epoch_us END AS epoch_us, elset, line1, line2, src_file, idx FROM ({_good(d)}) g"),
    "tle_dedup_summary": lambda d: dedup.summary(d, _good(d), dedup.excluding(_good(d), 'SELECT * FROM good_suspects')),
    "tle_manifest": lambda d: dedup.history(d, _imported(d)),
    "tle_gap_list": lambda d: dedup.gaps(d, _imported(d)),
    "tle_gap_silent": lambda d: f"SELECT catalog, count(*) AS records FROM ({_imported(d)}) i GROUP BY catalog HAVING count(*) < 3",
    "tle_extract_history": lambda d: dedup.extract(_imported(d), [2, 9, 14]),
    "tle_chunks": lambda d: dedup.chunked(_imported(d), 1000),
    "events_gap_manifest": lambda d: dedup.history(d, f"SELECT DISTINCT user_id, {d.micros('ts')} AS us FROM events", "user_id", "us", 3.0),
    "events_gap_list": lambda d: dedup.gaps(d, f"SELECT DISTINCT user_id, {d.micros('ts')} AS us FROM events", "user_id", "us", 3.0),
    "orders_latest": lambda d: "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM orders) o WHERE nth = 1",
    "run_diff_by_rule": lambda d: dedup.run_diff(_counts(d, False, False), _counts(d, True, False), ("rule_id",)),
    "run_diff_by_file": lambda d: dedup.run_diff(_counts(d, False, True), _counts(d, True, True), ("src_file", "rule_id"), "src_file"),
    "lineitem_run_diff": lambda d: dedup.run_diff("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_discount < 0.05 GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_discount > 0.02 AND l_returnflag <> 'R' GROUP BY l_returnflag, l_linestatus", ("l_returnflag", "l_linestatus")),
    "quality_gate": lambda d: dedup.gate(_stats(d), Fraction("1.5")),
    "sample_even": lambda d: verify.even_sample(_population(d), 20),
    "sample_stratified": lambda d: verify.stratified_sample(_population(d), verify.duplicate_epoch_catalogs(_good(d)), 25),
    "sample_stratified_few": lambda d: verify.stratified_sample(_population(d), f"SELECT catalog FROM ({_suspects(d)}) s WHERE rule = 'VRFY-EPOCH-CONFLICT'", 40),
    "outlier_global_mad": lambda d: verify.global_threshold(d, _residuals(d)),
    "outlier_local_median": lambda d: verify.local_thresholds(d, _residuals(d)),
    "outlier_hot": lambda d: verify.hot(d, _residuals(d)),
}


TABLES = ("events", "documents", "orders", "lineitem")


def path_of(spark: SparkSession, sf_dir: str, base: str) -> str:
    """Where the shared table `base` of a folder's events is; it is made where it is missing."""
    return storage.once(spark, f"{sf_dir}/events.parquet", base, lambda: spark.sql(_scanned(BASES[base](SPARK), spark, sf_dir)))


def _scanned(text: str, spark: SparkSession, sf_dir: str) -> str:
    """The text over the Parquet files of a folder, and over the shared tables that it names."""

    def path(m: re.Match) -> str:
        if m[1] in TABLES:
            return f"FROM parquet.`{sf_dir}/{m[1]}.parquet`"
        return f"FROM parquet.`{path_of(spark, sf_dir, m[1])}`"

    return re.sub(rf"\bFROM ({'|'.join([*TABLES, *BASES])})\b", path, text)


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.sql(_scanned(TEXTS[name](SPARK), spark, sf_dir))


def _oracle(text: str) -> str:
    """The text behind the shared tables that it needs, as common table expressions in their order."""
    need, todo = set(), [text]
    while todo:
        for b in re.findall(rf"\bFROM ({'|'.join(BASES)})\b", todo.pop()):
            if b not in need:
                need.add(b)
                todo.append(BASES[b](DUCK))
    tables = ", ".join(f"{b} AS ({BASES[b](DUCK)})" for b in BASES if b in need)
    return f"WITH {tables} {text}" if tables else text


def _base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_path()
    return spark.sql(_scanned(f"SELECT * FROM {name}", spark, sf_dir))


def orbit_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orbit.track_residuals(_base(spark, sf_dir, "good"))


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """The feed as an archive of text files, cleaned, verified against them and reduced by the commands on folders; made
    once. Gives the folder: in/ and out/."""

    def make() -> str:
        folder = f"{storage.root(spark)}/tree-{uuid.uuid4().hex}"
        lines = _base(spark, sf_dir, "feed_lines")
        units = lines.select(F.col("src_file").alias("stem"), (F.col("line_no") - 1).alias("n"), F.concat("raw", F.lit("\n")).alias("text"))
        for name in exports.write_numbered(units, exports.made(spark, f"{folder}/in"), ".txt", 0):
            exports.rename(spark, f"{folder}/in/{name}", f"{folder}/in/{name.split('.')[0]}.txt")
        archive.clean(spark, f"{folder}/in", f"{folder}/out", reconstruct_checksum=True, chunk_records=1000)
        archive.verify(spark, f"{folder}/out", f"{folder}/in", chunk_records=1000)
        archive.dedup(spark, f"{folder}/out", chunk_records=1000)
        return folder

    return storage.kept(spark, f"{sf_dir}/events.parquet", "tree", make)


def _of_tree(read: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: read(spark, _tree(spark, sf_dir))


def _document(spark: SparkSession, path: str, columns: str, pick: str | None = None) -> DataFrame:
    """Numbers of a small JSON document as one row."""
    doc = tle_text.read_json(spark, path)
    doc = doc[pick] if pick else doc
    names = columns.split()
    return spark.createDataFrame([tuple(int(doc[n]) for n in names)], ", ".join(f"{n} bigint" for n in names))


KEPT = "SELECT catalog, epoch_key, epoch_us, elset, line1, line2, src_file, idx"
#: What the commands on folders leave, read back: (query, the SQL that makes the same of the tables).
TREE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], Text]] = {
    "archive_lines": (lambda s, t: tle_text.read_lines(s, f"{t}/in"), lambda d: "SELECT src_file, line_no, raw FROM (SELECT * FROM feed_lines) l"),
    "archive_cleaned": (lambda s, t: tle_text.read_cleaned(s, f"{t}/out/01-cleaned"), lambda d: f"{KEPT} FROM ({_cleaned(d)}) c"),
    "archive_findings": (
        lambda s, t: tle_text.read_findings(s, f"{t}/out/03-report").select("file", "rule_id", "norad_id", "tier_attempted", F.get("related", F.lit(0))["rule_id"].alias("related_rule"), F.get("source_lines", F.lit(0)).isNotNull().alias("placed")),
        lambda d: f"SELECT concat(src_file, '.txt') AS file, rule_id, norad_id, tier AS tier_attempted, related_rule, true AS placed FROM ({_routed(d)}) r WHERE NOT clean",
    ),
    "archive_broken_ids": (lambda s, t: tle_text.read_broken_ids(s, f"{t}/out/03-report/broken-noradids.ndjson"), lambda d: f"SELECT DISTINCT norad_id FROM ({_findings(d)}) f WHERE norad_id IS NOT NULL"),
    "archive_report_totals": (
        lambda s, t: _document(s, f"{t}/out/03-report/report.json", "files_processed paired_records orphan_entries input_lines_seen clean_count quarantined_count failed_count", "summary"),
        lambda d: "SELECT count(*) AS files_processed, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {n}" for c, n in (("paired", "paired_records"), ("orphan", "orphan_entries"), ("lines", "input_lines_seen"), ("clean", "clean_count"), ("quarantined", "quarantined_count"))) + f", CAST(0 AS BIGINT) AS failed_count FROM ({_stats(d)}) s",
    ),
    # Every record of the tree has its origin, so the audit against the source adds nothing.
    "archive_suspects": (lambda s, t: tle_text.read_suspects(s, f"{t}/out/04-verify"), lambda d: f"SELECT rule, severity, catalog, epoch_key, src_file, idx, detail FROM ({_suspects(d)}) s"),
    "archive_import_set": (
        lambda s, t: tle_text.read_import(s, f"{t}/out/05-dedup").drop("src_file"),
        lambda d: f"SELECT catalog, epoch_key, epoch_us, elset, line1, line2, CAST(row_number() OVER (ORDER BY catalog, epoch_key) - 1 AS BIGINT) AS idx FROM ({dedup.import_set(d, _used(d))}) i",
    ),
    "archive_notes": (
        lambda s, t: s.read.schema("catalog long, epoch_key double, conflict boolean, kept struct<src_file: string, index: long, element_set: int>, dropped array<struct<index: long>>").json(f"{t}/out/05-dedup/notes.*.jsonl").where("kept is not null").select("catalog", "epoch_key", F.col("conflict").cast("int").alias("conflict"), F.concat("kept.src_file", F.lit(":"), "kept.index", F.lit(":"), F.coalesce(F.col("kept.element_set").cast("string"), F.lit(""))).alias("kept"), F.size("dropped").cast("long").alias("n")),
        lambda d: f"SELECT n.catalog AS catalog, n.epoch_key AS epoch_key, n.conflict AS conflict, n.kept AS kept, CAST(length(n.dropped) - length(replace(n.dropped, ',', '')) + 1 AS BIGINT) AS n FROM ({dedup.notes(d, _used(d))}) n",
    ),
    "archive_manifest": (
        lambda s, t: s.read.schema("norad_id long, records long, first_epoch string, last_epoch string, span_days double, median_spacing_days double, largest_gap_days double, gap_count long").json(f"{t}/out/05-dedup/manifest.jsonl"),
        lambda d: f"SELECT key AS norad_id, records, first_epoch, last_epoch, span_days, median_spacing_days, largest_gap_days, gap_count FROM ({dedup.history(d, dedup.import_set(d, _used(d)))}) h",
    ),
    "archive_dedup_summary": (
        lambda s, t: _document(s, f"{t}/out/05-dedup/summary.json", "records_read excluded_hard_suspects records_written records_dropped groups_collapsed conflicts_flagged unusable_records gap_silent_satellites"),
        lambda d: dedup.summary(d, _cleaned(d), _used(d)),
    ),
}


#: These have no SQL text of their own: orbits are checked by published positions.
FRAMES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"orbit_residuals": orbit_residuals}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(name) for name in TEXTS} | {name: _of_tree(read) for name, (read, _) in TREE.items()} | FRAMES
ORACLE_SQL: dict[str, str] = {name: _oracle(text(DUCK)) for name, text in [*TEXTS.items(), *((n, t) for n, (_, t) in TREE.items())]}
