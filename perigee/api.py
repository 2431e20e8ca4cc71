"""The engine's commands on tables: clean, verify, dedup, extract, diff, explain. Each takes and returns DataFrames.

`perigee.archive` has the same commands on an output folder. Tables that several results need are written once to the
cluster's shared folder.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee import tuned
from perigee.functions import diagnostics, registry, tle
from perigee.functions.tle import SPARK
from perigee.operators import align, dedup as latest, records, verify as checks
from perigee.sources import exports, storage, tle_text
from perigee.sources.storage import over, saved

explain = registry.explain


@dataclass
class CleanResult:
    """routed: every record and orphan once; cleaned: the fact table; findings: what was quarantined; stats: by file.
    sizes: bytes by file, where files were read; seconds: what routing took."""

    routed: DataFrame
    cleaned: DataFrame
    findings: DataFrame
    stats: DataFrame
    fixes: DataFrame
    sizes: dict[str, int] = field(default_factory=dict)
    seconds: float = 0.0
    started_at: str = ""

    def totals(self) -> dict[str, int]:
        names = ("lines", "paired", "orphan", "clean", "quarantined")
        row = self.stats.agg(F.count("*").alias("files"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names)).first()
        return row.asDict()

    def exit_code(self, threshold: str | None = None) -> int:
        """0, or 1 if records were quarantined (more than a threshold, "100" or "1.5%", allows)."""
        t = self.totals()
        limit: int | Fraction = 0 if threshold is None else latest.parse_threshold(threshold)
        return int(latest.exceeded(t["clean"], t["quarantined"], limit))


def utc_stamp() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())


def clean_lines(lines: DataFrame, reconstruct_checksum: bool = False) -> CleanResult:
    """Pairs, repairs, validates and routes lines (src_file, line_no, raw)."""
    tuned(lines.sparkSession)
    began, stamp = time.time(), utc_stamp()
    routed = saved(over(lines, lambda t: records.routed(SPARK, t, reconstruct_checksum)))
    cleaned = saved(over(routed, lambda t: records.cleaned(SPARK, t)))
    stats = saved(over(routed, lambda t, u: records.file_stats(SPARK, u, t), lines))
    return CleanResult(routed, cleaned, routed.where("not clean"), stats, over(routed, records.fix_counts), seconds=time.time() - began, started_at=stamp)


def clean(spark: SparkSession, path: str, reconstruct_checksum: bool = False, out_dir: str | None = None, chunk_records: int = exports.DEFAULT_UNITS) -> CleanResult:
    """Cleans a folder of tle*.txt files, or one file; with out_dir, writes 01-cleaned, 02-broken and 03-report."""
    result = clean_lines(tle_text.read_lines(spark, path), reconstruct_checksum)
    result.sizes = {tle_text.stem(name): size for name, _, size in tle_text.sources(spark, path)}
    if out_dir:
        from perigee import archive

        archive.export_clean(result, out_dir, sorted(result.sizes), chunk_records)
    return result


@dataclass
class VerifyResult:
    """suspects: (rule, severity, catalog, epoch_key, src_file, idx, detail); checked: what was looked at."""

    suspects: DataFrame
    histogram: DataFrame
    reissues: DataFrame
    checked: dict[str, int]

    def exit_code(self) -> int:
        return int(bool(self.suspects.where("severity = 'hard'").limit(1).count()))


ALIGNED = {"VRFY-INTERIOR-MUT": "cleaned record differs from its source in a non-edge column", "VRFY-ORIGIN-MISSING": "no source origin found through end of source file"}


def verify(cleaned: DataFrame, source_lines: DataFrame | None = None, orbit: bool = False, sample: int = 3000, all_sats: bool = False, tier: str = "sensitive") -> VerifyResult:
    """Checks a fact table again: validity, contradictions at one epoch, the source (records with src1 and src2 by their
    places, others in order), and the orbits of a sample of satellites."""
    columns = ["rule", "severity", "catalog", "epoch_key", "src_file", "idx", "detail"]
    found = saved(over(cleaned, lambda t: checks.suspects(SPARK, t)).select(columns))
    failed = found.where("rule = 'VRFY-REVALIDATE-FAIL'")
    places = failed.select("src_file", "idx")
    valid = cleaned.join(places, ["src_file", "idx"], "left_anti").select(cleaned.columns)
    said = F.concat(F.lit("cleaned record fails validation: "), diagnostics.record_message("line1", "line2"))
    told = cleaned.join(places, ["src_file", "idx"], "left_semi").select("src_file", "idx", said.alias("why"))
    suspects = found.where("rule <> 'VRFY-REVALIDATE-FAIL'").unionByName(failed.drop("detail").join(told, ["src_file", "idx"]).withColumnRenamed("why", "detail").select(columns))
    sums = cleaned.agg(F.count("*").alias("n"), F.count_distinct("src_file").alias("files")).first()
    reissues = over(valid, lambda t: f"SELECT catalog, count(*) AS n FROM ({checks.conflicts(t)}) c WHERE reissue GROUP BY catalog")
    checked = {"files": sums["files"], "records": sums["n"], "source_diff": int(source_lines is not None), "missing_source_files": 0}
    more = []
    if source_lines is not None:
        if {"src1", "src2"} <= set(cleaned.columns):
            moved = over(valid, lambda t, u: align.by_provenance(SPARK, t, u), source_lines)
        else:
            pairs = saved(over(source_lines, lambda t: align.turns(SPARK, t)))
            claimed = saved(over(valid, lambda t, u: align.matched(SPARK, t, u), pairs))
            moved = over(claimed, lambda t, u: align.judged(SPARK, t, u), pairs)
        more.append(moved.withColumn("detail", F.create_map(*[F.lit(x) for kv in ALIGNED.items() for x in kv])[F.col("rule")]))
        checked["missing_source_files"] = over(cleaned, lambda t, u: align.missing_sources(t, u), source_lines).count()
    if orbit:
        from perigee.operators import orbit as tracks

        population = saved(valid.where("catalog <> -1").select("catalog").distinct())
        chosen = population
        if not all_sats:
            twice = over(valid, lambda t: f"SELECT catalog FROM ({checks.duplicate_epoch_catalogs(t)}) d WHERE catalog <> -1")
            chosen = saved(over(population, lambda t, u: checks.stratified_sample(t, u, sample), twice))
        flown = saved(tracks.suspects(valid.join(chosen, "catalog", "left_semi"), tier))
        seen = flown.where("rule is null").agg(F.count("*").alias("tracks"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")).first()
        checked |= {"orbit_population": population.count(), "orbit_sampled": chosen.count(), "orbit_satellites_checked": seen["tracks"], "orbit_pairs_measured": seen["pairs"]}
        more.append(flown.where("rule is not null").select("rule", "src_file", "idx", "detail"))
    keys = valid.select("src_file", "idx", "catalog", "epoch_key")
    for extra in more:
        named = extra.withColumn("severity", F.expr(checks.severity("rule"))).join(keys, ["src_file", "idx"])
        suspects = suspects.unionByName(named.select(columns))
    checked["epoch_reissues"] = reissues.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return VerifyResult(saved(suspects), over(valid, lambda t: checks.histogram(SPARK, t)), reissues, checked)


@dataclass
class DedupResult:
    import_set: DataFrame
    notes: DataFrame
    unusable: DataFrame
    manifest: DataFrame
    summary: dict

    def exit_code(self) -> int:
        return int(self.summary["conflicts_flagged"] > 0)


def dedup(cleaned: DataFrame, suspects: DataFrame | None = None) -> DedupResult:
    """The latest record of each satellite and epoch, without hard suspects, with what it replaced and a manifest."""
    used = cleaned if suspects is None else over(cleaned, latest.excluding, suspects)
    imported = over(used, lambda t: latest.import_set(SPARK, t))
    imported = saved(imported.repartitionByRange("catalog", "epoch_key").sortWithinPartitions("catalog", "epoch_key"))
    summary = over(cleaned, lambda t, u: latest.summary(SPARK, t, u), used).first().asDict()
    notes, unusable = over(used, lambda t: latest.notes(SPARK, t)), over(used, lambda t: latest.unusable_notes(SPARK, t))
    return DedupResult(imported, notes, unusable, over(imported, lambda t: latest.history(SPARK, t)), summary)


def catalog_number(text: str | int) -> int:
    """A catalog number from decimal digits or a letter and four digits; ValueError for anything else."""
    field_ = str(text).strip()
    if field_.isascii() and field_.isdigit() and int(field_) > 0:
        return int(field_)
    if len(field_) == 5 and field_[0] in tle.ALPHA5 and field_[1:].isascii() and field_[1:].isdigit():
        return (10 + tle.ALPHA5.index(field_[0])) * 10_000 + int(field_[1:])
    raise ValueError(f"not a catalog number: {text}")


def extract(import_set: DataFrame, ids: list[str | int], quarantined_ids: DataFrame | None = None, source: dict | None = None) -> tuple[DataFrame, list[dict]]:
    """(records of the satellites, oldest first; a document a satellite with its gaps). Unknown ids raise KeyError.
    source: what the documents say about where the records come from."""
    wanted = [catalog_number(i) for i in ids]
    rows = import_set.where(F.col("catalog").isin(wanted))
    history = {r["key"]: r for r in over(rows, lambda t: latest.history(SPARK, t)).collect()}  # the asked-for ids
    missing = [i for i in wanted if i not in history]
    if missing:
        raise KeyError(f"not in the import set: {missing}")
    ends = {r["catalog"]: r for r in rows.groupBy("catalog").agg(F.min_by("elset", "epoch_key").alias("first"), F.max_by("elset", "epoch_key").alias("last")).collect()}
    longest = over(rows, lambda t: f"SELECT key, {tle.iso_of('max_by(before, struct(days, -us))', SPARK)} AS at FROM ({latest.deltas(t, 'catalog', 'epoch_us')}) x WHERE days IS NOT NULL GROUP BY key")
    at = {r["key"]: r["at"] for r in longest.collect()}
    found = over(rows, lambda t: f"SELECT *, {tle.iso_of('start_us', SPARK)} AS s, {tle.iso_of('end_us', SPARK)} AS e FROM ({latest.gaps(SPARK, t)}) g").orderBy("key", "start_us").collect()
    gaps: dict[int, list] = {}
    for g in found:
        gaps.setdefault(g["key"], []).append({"start": g["s"], "end": g["e"], "days": round(g["days"], 6)})
    quarantined = None if quarantined_ids is None else {r[0] for r in quarantined_ids.where(F.col("norad_id").isin(wanted)).select("norad_id").distinct().collect()}
    docs = []
    for i in wanted:
        h, span = history[i], history[i]["span_days"]
        docs.append({
            "schema_version": "2", "norad_id": i, "records": h["records"], "first_epoch": h["first_epoch"], "last_epoch": h["last_epoch"], "span_days": span,
            "mean_records_per_day": round(h["records"] / span, 6) if span else None, "largest_gap_days": h["largest_gap_days"], "largest_gap_at": at.get(i), "median_spacing_days": h["median_spacing_days"],
            "gap_count": h["gap_count"], "gaps": gaps.get(i, []), "had_quarantined_records": None if quarantined is None else i in quarantined,
            "element_set_first": ends[i]["first"], "element_set_last": ends[i]["last"], "source": {"out_dir": None, "dedup_records_written": None, "dedup_schema_version": None, **(source or {})},
        })
    return rows.orderBy("catalog", "epoch_key"), docs


def diff(findings_a: DataFrame, findings_b: DataFrame, file_col: str = "src_file") -> tuple[DataFrame, DataFrame]:
    """(by rule, by file and rule): how two runs' findings differ in number. A file is present in a run that has any
    finding of it."""
    out = []
    for keys, by in ((("rule_id",), None), (("file", "rule_id"), "file")):
        counts = [f.withColumn("file", F.col(file_col)).groupBy(*keys).agg(F.count("*").alias("n")) for f in (findings_a, findings_b)]
        out.append(over(counts[0], lambda t, u, k=keys, p=by: latest.run_diff(t, u, k, p), counts[1]))
    return out[0], out[1]


def stored(spark: SparkSession) -> str:
    """Where this application's intermediate tables are."""
    return storage.root(spark)
