"""The commands on an output folder: 01-cleaned, 02-broken, 03-report, 04-verify, 05-dedup, 06-extract, each step reading
what the ones before it left there, and the texts and documents that they write."""

from __future__ import annotations

import hashlib
import json
import platform
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee import VERSION, api
from perigee.functions import diagnostics, registry, tle
from perigee.functions.tle import SPARK
from perigee.operators import dedup as latest, records, verify as checks
from perigee.sources import exports, tle_text
from perigee.sources.exports import made
from perigee.sources.storage import over, saved
from perigee.sources.tle_text import ArchiveError

CLEANED, BROKEN, REPORT, VERIFY, DEDUP, EXTRACT = "01-cleaned", "02-broken", "03-report", "04-verify", "05-dedup", "06-extract"
READMES = {
    CLEANED: "Accepted records: <source>.NNNNN.cleaned.txt, two lines of 69 columns a record, in the order of the source.",
    BROKEN: "Quarantined records: <source>.NNNNN.broken.txt, the lines as they were, each behind what is wrong with it.",
    REPORT: "The cleaning run: report.json and report.md (totals), report.NNNNN.jsonl (a finding a line), broken-noradids.ndjson.",
    VERIFY: "The audit of 01-cleaned: suspects.NNNNN.jsonl, summary.json, summary.md.",
    DEDUP: "One record a satellite and epoch: import.NNNNN.txt, sorted; notes.NNNNN.jsonl, manifest.jsonl, summary.json.",
    EXTRACT: "Histories of satellites: <number>.txt, <number>.json.",
}
SAMPLE = 5


def _step(spark: SparkSession, out_dir: str, name: str) -> str:
    folder = made(spark, f"{out_dir}/{name}")
    exports.write_document(spark, f"{folder}/README.md", READMES[name] + "\n")
    return folder


# --- clean


def _diagnosed(findings: DataFrame) -> DataFrame:
    """The findings with `first` and `related`, their diagnostics with all fields."""
    none = F.lit(None)
    tier2 = F.when(F.col("related_rule") == "TLE-COL-003", "none").otherwise("tier-1")
    on_line = ~F.col("orphan") & (F.col("rule_id") != "TLE-PAIR-003")
    mate = F.col("rule_id") == "TLE-PAIR-003"
    # Which line of the record is at fault: the second only where the first is fine, which the router left in no column.
    # Written step by step: a diagnosis names its line's errors, and its readers name it, many times.
    rows = findings.withColumns({f"core{n}": F.expr(tle.core(SPARK, f"raw{n}")) for n in (1, 2)})
    rows = saved(rows.withColumns({f"errors{n}": diagnostics.body_errors(F.col(f"core{n}"), n) for n in (1, 2)} | {"fine1": F.expr(f"{tle.line_ok(SPARK, 'core1', 1)} AND raw1 RLIKE R'^[\\x00-\\x7F]*\\z'")}))
    second = on_line & F.col("related_rule").isNull() & F.col("fine1")
    one, two = (diagnostics.diagnosis(F.col("rule_id"), f"core{n}", f"errors{n}", F.col("tier"), F.col(f"src{n}")) for n in (1, 2))
    rows = rows.withColumn("d", F.when(second, two).otherwise(one)).withColumn("d3", diagnostics.diagnosis(F.col("related_rule"), "core2", "errors2", tier2, F.col("src2")))
    rows = saved(rows.drop("errors1", "errors2", "fine1"))
    field = lambda core: F.substring(core, 3, 5)
    first = F.struct(
        F.when(mate, F.array(F.lit(3), F.lit(7))).when(on_line, F.col("d.column_range")).alias("column_range"), F.when(mate, field("core2")).when(on_line, F.col("d.expected")).alias("expected"),
        F.when(F.col("orphan"), F.col("note")).when(on_line, F.col("d.note")).otherwise(none).alias("note"), F.when(mate, field("core1")).when(on_line, F.col("d.observed")).alias("observed"), F.col("rule_id"),
        F.when(F.col("orphan"), F.array("src1")).when(mate, F.array("src1", "src2")).otherwise(F.col("d.source_lines")).alias("source_lines"), F.col("tier").alias("tier_attempted"),
    )
    return saved(rows.withColumn("first", first).withColumn("related", F.when(F.col("related_rule").isNull(), F.array()).otherwise(F.array("d3"))).drop("d", "d3", "core1", "core2"))


def findings_json(diagnosed: DataFrame) -> DataFrame:
    """(src_file, src1, text): a JSON line of sorted keys for each finding."""
    f = lambda c: F.col(f"first.{c}").alias(c)
    row = F.struct(
        f("column_range"), f("expected"), F.concat("src_file", F.lit(".txt")).alias("file"), F.col("norad_id"), f("note"), f("observed"), F.lit("quarantined").alias("outcome"), F.col("related"), f("rule_id"),
        F.lit("1").alias("schema_version"), f("source_lines"), f("tier_attempted"),
    )
    return diagnosed.select("src_file", "src1", F.concat(F.to_json(row, {"ignoreNullFields": "false"}), F.lit("\n")).alias("text"))


def diagnostic_text(d: Column) -> Column:
    """A diagnostic as one line: rule (tier), columns, observed and expected values, note; what is absent is left out."""
    said = lambda name: F.when(d[name].isNull(), "").otherwise(F.concat(F.lit(f" {name}='"), d[name], F.lit("'")))
    low, high = d["column_range"][0].cast("string"), d["column_range"][1].cast("string")
    columns = F.when(d["column_range"].isNull(), "").when(low == high, F.concat(F.lit(" col "), low)).otherwise(F.concat(F.lit(" cols "), low, F.lit("-"), high))
    tier = F.when(d["tier_attempted"] == "none", "").otherwise(F.concat(F.lit(" ("), d["tier_attempted"], F.lit(")")))
    return F.concat(F.lit("rule: "), d["rule_id"], tier, columns, said("observed"), said("expected"), F.when(d["note"].isNull(), "").otherwise(F.concat(F.lit(" - "), d["note"])))


def broken_text(numbered: DataFrame, stamp: str) -> Column:
    """What a finding (numbered n in its file) takes in 02-broken: a file's first one brings two lines of heading."""
    place = F.when(F.col("src2").isNull(), F.concat(F.lit("source line "), "src1")).otherwise(F.concat(F.lit("source lines "), "src1", F.lit("-"), "src2"))
    head = F.concat(F.lit("["), F.col("n") + 1, F.lit("] "), place, F.lit(" - "), diagnostic_text(F.col("first")), F.lit("\n"))
    also = F.array_join(F.transform("related", lambda d: F.concat(F.lit("    and: "), diagnostic_text(d), F.lit("\n"))), "")
    title = F.when(F.col("n") == 0, F.concat(F.lit("# "), "src_file", F.lit(".broken.txt - quarantined records\n# source: "), "src_file", F.lit(f".txt | generated: {stamp} | perigee {VERSION}\n\n"))).otherwise("")
    return F.concat(title, head, also, F.col("raw1"), F.lit("\n"), F.when(F.col("raw2").isNull(), "").otherwise(F.concat("raw2", F.lit("\n"))), F.lit("\n"))


def export_clean(result: api.CleanResult, out_dir: str, stems: list[str], chunk_records: int = exports.DEFAULT_UNITS, command: str = "clean") -> dict:
    """01-cleaned, 02-broken and 03-report; the run's envelope."""
    spark = result.cleaned.sparkSession
    units = result.cleaned.select(F.col("src_file").alias("stem"), F.col("idx").alias("n"), F.concat("line1", F.lit("\n"), "line2", F.lit("\n")).alias("text"))
    exports.write_numbered(units, _step(spark, out_dir, CLEANED), ".cleaned.txt", chunk_records, stems)
    numbered = saved(over(result.findings, lambda t: records.in_file(SPARK, t, "src1", "n")))
    broken = _diagnosed(numbered)
    exports.write_numbered(broken.select(F.col("src_file").alias("stem"), "n", broken_text(broken, result.started_at).alias("text")), _step(spark, out_dir, BROKEN), ".broken.txt", chunk_records)
    # One set of findings for all files, in their order: a file's numbers follow those of the files before it.
    ahead, total = {}, 0
    for r in numbered.groupBy("src_file").count().orderBy("src_file").collect():  # a row a file
        ahead[r["src_file"]], total = total, total + r["count"]
    base = F.element_at(F.create_map(*[F.lit(x) for kv in ahead.items() for x in kv]), F.col("src_file")).cast("long") if ahead else F.lit(0).cast("long")
    lines = findings_json(broken).withColumnRenamed("text", "json").join(numbered.select("src_file", "src1", "n"), ["src_file", "src1"])
    report = _step(spark, out_dir, REPORT)
    exports.write_numbered(lines.select(F.lit("report").alias("stem"), (F.col("n") + base).alias("n"), F.col("json").alias("text")), report, ".jsonl", chunk_records, ["report"])
    ids = [r[0] for r in numbered.where("norad_id is not null").select("norad_id").distinct().orderBy("norad_id").collect()]  # catalog numbers: at most some hundred thousand
    exports.write_document(spark, f"{report}/broken-noradids.ndjson", "".join(json.dumps({"noradId": i}, separators=(",", ":")) + "\n" for i in ids))
    whole = run_report(result, command)
    exports.write_json(spark, f"{report}/report.json", whole)
    exports.write_document(spark, f"{report}/report.md", report_text(whole))
    return whole


def run_report(result: api.CleanResult, command: str = "clean", failed: list[tuple[str, str]] | None = None) -> dict:
    """The run's envelope, schema 3: run, environment, totals, and each file's own counts. Files are cleaned together, so
    a file's seconds are its share of the run's, by lines."""
    t = result.totals()
    fixes: dict[str, dict[str, int]] = {}
    for r in result.fixes.collect():  # five rows a file at most
        fixes.setdefault(r["src_file"], {})[r["fix"]] = r["n"]
    rules: dict[str, dict[str, int]] = {}
    norads: dict[str, dict[str, dict[str, int]]] = {}
    for r in result.findings.groupBy("src_file", "rule_id", "norad_id").count().orderBy("src_file", "rule_id", "norad_id").collect():  # quarantined satellites
        own = rules.setdefault(r["src_file"], {})
        own[r["rule_id"]] = own.get(r["rule_id"], 0) + r["count"]
        if r["norad_id"] is not None:
            norads.setdefault(r["src_file"], {}).setdefault(str(r["norad_id"]), {})[r["rule_id"]] = r["count"]
    files = []
    for r in result.stats.orderBy("src_file").collect():
        f, seconds = r["src_file"], result.seconds * r["lines"] / max(1, t["lines"])
        files.append({
            "src_name": f"{f}.txt", "elapsed_seconds": seconds, "bytes": result.sizes.get(f, 0), "records_per_sec": r["paired"] / max(seconds, 0.001), "paired_records": r["paired"], "orphan_entries": r["orphan"],
            "input_lines_seen": r["lines"], "clean_count": r["clean"], "quarantined_count": r["quarantined"], "fix_counts": dict(sorted(fixes.get(f, {}).items())), "quarantine_counts": rules.get(f, {}),
            "dropped_counts": {k: n - SAMPLE for k, n in rules.get(f, {}).items() if n > SAMPLE}, "quarantined_norad_ids": norads.get(f, {}),
        })
    total = lambda key: {k: sum(x[key].get(k, 0) for x in files) for k in sorted({k for x in files for k in x[key]})}
    failed = sorted(failed or [])
    summary = {
        "files_processed": t["files"], "paired_records": t["paired"], "orphan_entries": t["orphan"], "input_lines_seen": t["lines"], "clean_count": t["clean"], "quarantined_count": t["quarantined"],
        "failed_count": len(failed), "fix_counts": total("fix_counts"), "quarantine_counts": total("quarantine_counts"),
    }
    run = {"command": command, "timestamp": result.started_at, "elapsed_seconds": result.seconds, "failed_files": [{"file": f.rsplit("/", 1)[-1], "error": e} for f, e in failed]}
    return {"schema_version": "3", "run": run, "environment": {"tool_version": VERSION, "python_version": platform.python_version()}, "summary": summary, "files": files}


def percent(part: int, whole: int, digits: int = 4, none: str = "n/a") -> str:
    return f"{100 * part / whole:.{digits}f}%" if whole else none


def short_percent(part: int, whole: int, none: str = "-") -> str:
    """Two digits; a share that they would hide is told as such."""
    if not whole:
        return none
    return "0%" if not part else "<0.01%" if 100 * part / whole < 0.01 else percent(part, whole, 2)


def clock(seconds: float) -> str:
    """M:SS, or H:MM:SS from an hour on."""
    m, s = divmod(int(seconds), 60)
    return f"{m // 60}:{m % 60:02d}:{s:02d}" if m >= 60 else f"{m}:{s:02d}"


def size_text(n: float) -> str:
    """Bytes with one digit and a binary unit."""
    for unit in "BKMGTP":
        if n < 1024 or unit == "P":
            return f"{int(n)}B" if unit == "B" else f"{n:.1f}{unit}"
        n /= 1024
    return ""


def duration(seconds: float) -> str:
    """In words, whole seconds."""
    left, parts = int(seconds), []
    for size, word in ((3600, "hour"), (60, "minute"), (1, "second")):
        n, left = divmod(left, size)
        if n or (word == "second" and not parts):
            parts.append(f"{n} {word}{'' if n == 1 else 's'}")
    return ", ".join(parts[:-1]) + (" and " if parts[1:] else "") + parts[-1]


def by_norad(files: list[dict]) -> list[tuple[int, int, dict[str, int], list[str]]]:
    """(satellite, quarantined records, by rule, files), the most first."""
    found: dict[int, tuple[dict[str, int], set[str]]] = {}
    for f in files:
        for norad, counts in f["quarantined_norad_ids"].items():
            own, names = found.setdefault(int(norad), ({}, set()))
            names.add(f["src_name"])
            for rule, n in counts.items():
                own[rule] = own.get(rule, 0) + n
    rows = [(i, sum(c.values()), dict(sorted(c.items(), key=lambda kv: (-kv[1], kv[0]))), sorted(names)) for i, (c, names) in found.items()]
    return sorted(rows, key=lambda r: (-r[1], r[0]))


def report_text(report: dict, top: int | None = 100, preview: int = 5) -> str:
    """The run's report as Markdown: totals, fixes and rules by number (then name), files by name, satellites."""
    s, run = report["summary"], report["run"]
    whole = s["paired_records"] + s["orphan_entries"]
    order = lambda counts: sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))
    out = ["# Cleaning report", "", f"- Generated: {run['timestamp']}", f"- Tool: perigee {report['environment']['tool_version']}", f"- Files: {s['files_processed']}, in {duration(run['elapsed_seconds'])}", "", "## Totals", ""]
    out += [f"- Records: {s['paired_records']:,}", f"- Orphan lines: {s['orphan_entries']:,}", f"- Input lines: {s['input_lines_seen']:,}"]
    out += [f"- Cleaned: {s['clean_count']:,} ({percent(s['clean_count'], whole)})", f"- Quarantined: {s['quarantined_count']:,} ({percent(s['quarantined_count'], whole)})", ""]
    dropped: dict[str, int] = {}
    for f in report["files"]:
        for k, n in f["dropped_counts"].items():
            dropped[k] = dropped.get(k, 0) + n
    out += ["## Fixes", "", *([f"| {k} | {n:,} | {registry.FIXES[k]} |" for k, n in order(s["fix_counts"])] or ["None."]), ""]
    out += ["## Quarantined by rule", "", "| Rule | Records | Beyond the sample | |", "|-|-:|-:|-|", *(f"| {k} | {n:,} | {dropped.get(k, 0):,} | {registry.RULES[k]} |" for k, n in order(s["quarantine_counts"])), ""]
    out += ["## Files", "", "| File | Records | Orphans | Cleaned | Quarantined |", "|-|-:|-:|-:|-:|", *(f"| {f['src_name']} | {f['paired_records']:,} | {f['orphan_entries']:,} | {f['clean_count']:,} | {f['quarantined_count']:,} |" for f in report["files"]), ""]
    sats = by_norad(report["files"])
    out += ["## Satellites", "", "| Satellite | Quarantined | Rules | Files |", "|-:|-:|-|-|"]
    for i, n, rules, names in sats[:top]:
        more = f", +{len(names) - preview} more" if len(names) > preview else ""
        out.append(f"| {i} | {n:,} | {', '.join(f'{k} ({m})' for k, m in rules.items())} | {', '.join(names[:preview])}{more} |")
    if top is not None and len(sats) > top:
        out += ["", f"{len(sats) - top:,} more are in broken-noradids.ndjson."]
    if run["failed_files"]:
        out += ["", "## Failures", "", "| File | Error |", "|-|-|"]
        out += ["| {} | {} |".format(*(" ".join(x.split()).replace("|", "\\|") for x in (f["file"], f["error"]))) for f in run["failed_files"]]
    return "\n".join([*out, ""])


# --- runs that were begun before


def fingerprint(spark: SparkSession, path: str, size: int) -> dict:
    """What tells a changed input: its size, time, and a hash of its first and last 64 KiB."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    digest = hashlib.sha256()
    stream = fs.open(p)
    try:
        for at, n in ((0, min(size, 65_536)), (max(0, size - 65_536), min(size, 65_536))):
            stream.seek(at)
            digest.update(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n)))
    finally:
        stream.close()
    return {"bytes": size, "modified": fs.getFileStatus(p).getModificationTime(), "sha256": digest.hexdigest()}


def compare_inputs(before: dict[str, dict], now: dict[str, dict]) -> dict[str, list[str]]:
    """Inputs that were added, removed or changed."""
    return {"added": sorted(now.keys() - before.keys()), "removed": sorted(before.keys() - now.keys()), "changed": sorted(k for k in now.keys() & before.keys() if now[k] != before[k])}


def output_sizes(spark: SparkSession, out_dir: str) -> dict[str, int]:
    """Bytes of each file that a cleaning run leaves."""
    found = {}
    for step in (CLEANED, BROKEN, REPORT):
        try:
            found |= {f"{step}/{name}": size for name, _, size in tle_text.listed(spark, f"{out_dir}/{step}") if name != "README.md"}
        except ArchiveError:
            continue
    return found


def _archived(spark: SparkSession, path: str, keep: int = 3) -> None:
    """Moves a checkpoint that no longer counts aside; the last `keep` stay."""
    folder = path.rsplit("/", 1)[0]
    if exports.read_document(spark, path) is None:
        return
    exports.rename(spark, path, f"{path}.stale-{time.time_ns()}")
    old = sorted(full for name, full, _ in tle_text.listed(spark, folder) if ".stale-" in name)
    for full in old[:-keep]:
        Path, fs = exports._fs(spark, full)
        fs.delete(Path(full), False)


def clean(spark: SparkSession, path: str, out_dir: str, reconstruct_checksum: bool = False, chunk_records: int = exports.DEFAULT_UNITS, resume: bool = True) -> dict:
    """Cleans an archive into an output folder; the run's envelope. A run that finished over the same inputs with the same
    options, and whose files are as it left them, is not done again; a checkpoint that differs is set aside."""
    inputs = {name: fingerprint(spark, full, size) for name, full, size in tle_text.sources(spark, path)}
    identity = {"reconstruct_checksum": reconstruct_checksum, "chunk_records": chunk_records, "tool_version": VERSION}
    place = f"{made(spark, out_dir)}/checkpoint.json"
    before = tle_text.read_json_or_none(spark, place)
    if resume and before and before.get("identity") == identity and not any(compare_inputs(before.get("inputs", {}), inputs).values()) and before.get("outputs") == output_sizes(spark, out_dir):
        return tle_text.read_json(spark, f"{out_dir}/{REPORT}/report.json")
    _archived(spark, place)
    result = api.clean(spark, path, reconstruct_checksum)
    whole = export_clean(result, out_dir, sorted(result.sizes), chunk_records)
    exports.write_json(spark, place, {"schema_version": "1", "identity": identity, "inputs": inputs, "outputs": output_sizes(spark, out_dir)}, sort=True)
    return whole


def report(spark: SparkSession, out_dir: str, form: str = "text") -> str:
    """A finished run's report, from its envelope."""
    whole = tle_text.read_json(spark, f"{out_dir}/{REPORT}/report.json")
    lacking = {"schema_version", "run", "environment", "summary", "files"} - whole.keys()
    if lacking or whole["schema_version"] != "3":
        raise ArchiveError(f"{out_dir}/{REPORT}/report.json: not an envelope of schema 3 ({', '.join(sorted(lacking)) or whole['schema_version']})")
    return json.dumps(whole, indent=2) + "\n" if form == "json" else report_text(whole)


# --- verify, dedup, extract


def cleaned(spark: SparkSession, out_dir: str) -> DataFrame:
    """The fact table of 01-cleaned, parsed once."""
    return saved(tle_text.read_cleaned(spark, f"{out_dir}/{CLEANED}"))


def cleaned_fingerprint(spark: SparkSession, out_dir: str) -> dict:
    """Each stem of 01-cleaned with the bytes of its files."""
    try:
        sets = tle_text.chunk_sizes(spark, f"{out_dir}/{CLEANED}", ".cleaned.txt")
    except ArchiveError:
        sets = {}
    return {"stems": [[s, sum(size for _, size in own)] for s, own in sorted(sets.items())]}


def verify(spark: SparkSession, out_dir: str, source: str | None = None, chunk_records: int = exports.DEFAULT_UNITS, **options) -> api.VerifyResult:
    """Audits 01-cleaned into 04-verify; source: the folder that it was cleaned from."""
    lines = None if source is None else tle_text.read_lines(spark, source)
    result = api.verify(cleaned(spark, out_dir), lines, **options)
    export_verify(result, out_dir, chunk_records)
    return result


def _ordered(rows: DataFrame, columns: list[str]) -> DataFrame:
    """`rows` with n, their number from 0 in the order of `columns`: sorted once into ranges; only one count a range
    is summed up on the driver."""
    part = saved(rows.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("id", F.monotonically_increasing_id()))
    ranges = part.groupBy(F.shiftright("id", 33).alias("p")).agg(F.min("id").alias("first"), F.count("*").alias("m")).orderBy("p").collect()
    ahead, total = {}, 0
    for r in ranges:
        ahead[r["p"]], total = total - r["first"], total + r["m"]
    base = F.element_at(F.create_map(*[F.lit(x) for kv in ahead.items() for x in kv]), F.shiftright("id", 33)) if ahead else F.lit(0)
    return part.withColumn("n", (F.col("id") + base).cast("long")).drop("id")


def export_verify(result: api.VerifyResult, out_dir: str, chunk_records: int = exports.DEFAULT_UNITS) -> None:
    """04-verify: suspects.NNNNN.jsonl in the order (rule, catalog, epoch, file, index), summary.json, summary.md."""
    spark = result.suspects.sparkSession
    folder = _step(spark, out_dir, VERIFY)
    rows = _ordered(result.suspects, ["rule", "catalog", "epoch_key", "src_file", "idx"])
    line = exports.json_lines(rows, [F.lit("2").alias("schema_version"), F.col("rule"), F.col("severity"), F.col("catalog"), F.col("epoch_key"), F.col("src_file"), F.col("idx").alias("index"), F.col("detail")])
    exports.write_numbered(rows.select(F.lit("suspects").alias("stem"), "n", line.alias("text")), folder, ".jsonl", chunk_records, ["suspects"])
    counts = {r["rule"]: r["n"] for r in over(result.suspects, checks.suspect_summary).orderBy("rule").collect()}
    months = {r["month"]: r["n"] for r in result.histogram.orderBy("month").collect()}
    hard = sum(n for r, n in counts.items() if r in checks.HARD)
    soft = sum(counts.values()) - hard
    doc = {"schema_version": "2", "checked": result.checked, "epoch_distribution": months, "counts": counts, "hard": hard, "soft": soft, "exit_code": int(hard > 0)}
    exports.write_json(spark, f"{folder}/summary.json", doc, sort=True)
    out = ["# Verification", "", *(f"- {k}: {n}" for k, n in sorted(result.checked.items())), "", "## Records by month", "", *(f"- {m}: {n}" for m, n in months.items()), "", "## Suspects", "", "| Rule | Suspects | Severity |", "|-|-:|-|"]
    out += [*(f"| {r} | {n} | {'hard' if r in checks.HARD else 'soft'} |" for r, n in counts.items()), "", f"{'FAIL' if hard else 'PASS'}: {hard} hard, {soft} soft", ""]
    exports.write_document(spark, f"{folder}/summary.md", "\n".join(out))


def dedup(spark: SparkSession, out_dir: str, chunk_records: int = exports.DEFAULT_UNITS) -> api.DedupResult:
    """Reduces 01-cleaned to 05-dedup, without the hard suspects of 04-verify where that was run."""
    result = api.dedup(cleaned(spark, out_dir), tle_text.read_suspects(spark, f"{out_dir}/{VERIFY}"))
    mark = cleaned_fingerprint(spark, out_dir)
    result.summary |= {"cleaned_files": len(mark["stems"]), "cleaned_fingerprint": mark}
    export_dedup(result, out_dir, chunk_records)
    return result


def export_dedup(result: api.DedupResult, out_dir: str, chunk_records: int = exports.DEFAULT_UNITS) -> None:
    """05-dedup: import.NNNNN.txt (140 bytes a record, by catalog and epoch), notes.NNNNN.jsonl, manifest.jsonl, summary.json."""
    spark = result.import_set.sparkSession
    folder = _step(spark, out_dir, DEDUP)
    numbered = over(result.import_set, latest.numbered)
    units = numbered.select(F.lit("import").alias("stem"), (F.col("n") - 1).alias("n"), F.concat("line1", F.lit("\n"), "line2", F.lit("\n")).alias("text"))
    exports.write_numbered(units, folder, ".txt", chunk_records, ["import"])
    card = lambda c: f"named_struct('src_file', split({c}, ':')[0], 'index', CAST(split({c}, ':')[1] AS BIGINT), 'element_set', try_cast(split({c}, ':')[2] AS INT))"
    cells = [F.lit("2").alias("schema_version"), F.col("catalog"), F.col("epoch_key"), (F.col("conflict") == 1).alias("conflict"), F.expr(card("kept")).alias("kept"), F.expr(f"transform(split(dropped, ','), x -> {card('x')})").alias("dropped")]
    kept = result.notes.select("catalog", "epoch_key", exports.json_lines(result.notes, cells).alias("text"))
    bad = result.unusable
    cells = [F.lit("2").alias("schema_version"), F.lit("DEDUP-UNUSABLE-RECORD").alias("rule"), F.col("catalog"), F.col("src_file"), F.col("idx").alias("index"), F.col("reason").alias("detail")]
    notes = _ordered(kept.unionByName(bad.select("catalog", "epoch_key", exports.json_lines(bad, cells).alias("text"))), ["catalog", "epoch_key", "text"])
    exports.write_numbered(notes.select(F.lit("notes").alias("stem"), "n", "text"), folder, ".jsonl", chunk_records, ["notes"])
    rows = _ordered(result.manifest, ["key"])
    names = [F.col("key").alias("norad_id"), *(F.col(c) for c in ("records", "first_epoch", "last_epoch", "span_days", "median_spacing_days", "largest_gap_days", "gap_count"))]
    (made_,) = exports.write_numbered(rows.select(F.lit("manifest").alias("stem"), "n", exports.json_lines(rows, names).alias("text")), folder, ".jsonl", 0, ["manifest"])
    exports.rename(spark, f"{folder}/{made_}", f"{folder}/manifest.jsonl")
    exports.write_json(spark, f"{folder}/summary.json", {**result.summary, "exit_code": result.exit_code(), "schema_version": "2"}, sort=True)


def extract(spark: SparkSession, out_dir: str, ids: list[str | int], dest: str | None = None) -> tuple[DataFrame, list[dict], list[str]]:
    """Histories of satellites from 05-dedup into 06-extract; (records, documents, warnings)."""
    warnings, summary = [], tle_text.read_json_or_none(spark, f"{out_dir}/{DEDUP}/summary.json") or {}
    if summary.get("cleaned_fingerprint") not in (None, cleaned_fingerprint(spark, out_dir)):
        warnings.append("01-cleaned changed after 05-dedup was made")
    broken = f"{out_dir}/{REPORT}/broken-noradids.ndjson"
    known = tle_text.read_broken_ids(spark, broken) if exports.read_document(spark, broken) is not None else None
    source = {"out_dir": out_dir, "dedup_records_written": summary.get("records_written"), "dedup_schema_version": summary.get("schema_version")}
    rows, docs = api.extract(saved(tle_text.read_import(spark, f"{out_dir}/{DEDUP}")), ids, known, source)
    export_extract(rows, docs, dest or _step(spark, out_dir, EXTRACT))
    return rows, docs, warnings


def export_extract(rows: DataFrame, docs: list[dict], dest: str) -> None:
    """For each satellite its records, <id>.txt, and what is known of its history, <id>.json."""
    spark = rows.sparkSession
    folder = made(spark, dest)
    numbered = over(rows, latest.numbered)
    first = numbered.groupBy("catalog").agg(F.min("n").alias("first"))
    units = numbered.join(first, "catalog").select(F.col("catalog").cast("string").alias("stem"), (F.col("n") - F.col("first")).alias("n"), F.concat("line1", F.lit("\n"), "line2", F.lit("\n")).alias("text"))
    for name in exports.write_numbered(units, folder, ".txt", 0):
        exports.rename(spark, f"{folder}/{name}", f"{folder}/{name.split('.')[0]}.txt")
    for doc in docs:
        exports.write_json(spark, f"{folder}/{doc['norad_id']}.json", doc, sort=True)


# --- diff


def diff(spark: SparkSession, out_a: str, out_b: str) -> str:
    """How two runs' findings differ, as text."""
    a, b = (tle_text.read_findings(spark, f"{o}/{REPORT}") for o in (out_a, out_b))
    by_rule, by_file = api.diff(a, b, "file")
    return diff_text([r.asDict() for r in by_rule.orderBy("rule_id").collect()], [r.asDict() for r in by_file.where("delta <> 0").orderBy("file", "rule_id").collect()], out_a, out_b)


def diff_text(rules: list[dict], files: list[dict], name_a: str, name_b: str) -> str:
    """By rule: new, gone and changed; by file, where a file that only one run has shows that run's number alone."""
    title = lambda r: registry.RULES.get(r["rule_id"], "")
    changed = lambda r: f"{r['a']} -> {r['b']} ({r['delta']:+d})"
    kinds = (
        ("New in the second", [r for r in rules if not r["a"]], lambda r: f"+{r['b']}"), ("Gone in the second", [r for r in rules if not r["b"]], lambda r: f"-{r['a']}"),
        ("Changed", [r for r in rules if r["a"] and r["b"] and r["delta"]], changed),
    )
    out = [f"{name_a} -> {name_b}"]
    for head, rows, cell in kinds:
        out += ["", f"{head} ({len(rows)}):", *([f"  {r['rule_id']}  {cell(r)}  {title(r)}".rstrip() for r in rows] or ["  (none)"])]
    out += ["", f"{len(kinds[0][1])} new, {len(kinds[1][1])} gone, {len(kinds[2][1])} changed, {sum(r['a'] == r['b'] for r in rules)} unchanged.", "", f"Files that differ ({len({r['file'] for r in files})}):"]
    last = None
    for r in files:
        if r["file"] != last:
            out.append(f"  {r['file']}" + {"a-only": " (in the first run only)", "b-only": " (in the second run only)"}.get(r["presence"], "") + ":")
            last = r["file"]
        cell = str(r["a"]) if r["presence"] == "a-only" else str(r["b"]) if r["presence"] == "b-only" else changed(r)
        out.append(f"    {r['rule_id']}  {cell}  {title(r)}".rstrip())
    return "\n".join(out if files else [*out, "  (none)"]) + "\n"


def write_sample(findings: DataFrame, folder: str, per_rule: int = SAMPLE) -> list[str]:
    """A small sidecar for each file: its first findings of each rule, in the order of the file."""
    nth = over(findings, lambda t: f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src_file, rule_id ORDER BY src1) AS turn FROM ({t}) f) s WHERE turn <= {per_rule}").drop("turn")
    rows = _diagnosed(over(nth, lambda t: records.in_file(SPARK, t, "src1", "n")))
    return exports.write_numbered(rows.select(F.col("src_file").alias("stem"), "n", broken_text(rows, api.utc_stamp()).alias("text")), made(findings.sparkSession, folder), ".broken.txt", 0)
