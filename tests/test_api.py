import json
import random

import pytest
from pyspark.sql import functions as F

from perigee import __main__ as commands
from perigee import api, archive
from perigee.functions.tle import SPARK
from perigee.operators import align
from perigee.sources import exports, tle_text
from perigee.sources.storage import over

L1 = "1 00005U 58002B   00179.78495062  .00000023  00000-0  28098-4 0  4753"
L2 = "2 00005  34.2682 348.7242 1859667 331.7664  19.3264 10.82419157413667"


def signed(line):
    return line[:68] + str(sum(int(c) if c.isdigit() else c == "-" for c in line[:68]) % 10)


CLASH = signed(L2[:8] + " 35.2682" + L2[16:])
MIXED = [L1, L2, L1[:68] + "\\", L2[:68], L1[:68] + "9", L2, L1, CLASH]


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "tle1.txt").write_bytes("\n".join(MIXED).encode())
    (tmp_path / "in" / "tle2.txt").write_bytes(b"junk \xff\r line\n\n" + f"{L1}\r\n{L2}\n".encode())
    (tmp_path / "in" / "tle3.txt").write_bytes(b"")
    (tmp_path / "in" / "other.txt").write_text("no")
    (tmp_path / "in" / "tle1.00001.cleaned.txt").write_text("no")
    return tmp_path


def test_lines_keep_their_numbers_over_many_splits(spark, tmp_path):
    rng = random.Random(1)
    want = []
    for f in range(3):
        lines = ["".join(rng.choice("ab \r\t") for _ in range(rng.randrange(40))) for _ in range(3000)]
        (tmp_path / f"tle{f}.txt").write_bytes("\n".join(lines).encode() + b"\n")
        want += [(f"tle{f}", n + 1, x) for n, x in enumerate(lines)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7k")
    try:
        df = tle_text.read_lines(spark, str(tmp_path))
        assert sorted((r.src_file, r.line_no, r.raw) for r in df.collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_clean_verify_dedup_extract(spark, tree):
    out = str(tree / "out")
    result = api.clean(spark, str(tree / "in"), reconstruct_checksum=True, out_dir=out, chunk_records=2)
    t = result.totals()
    assert (t["paired"], t["orphan"], t["clean"], t["quarantined"]) == (5, 1, 4, 2) and t["paired"] + t["orphan"] == t["clean"] + t["quarantined"]
    assert result.exit_code() == 1 and result.exit_code("2") == 0 and result.exit_code("10%") == 1
    names = sorted(p.name for p in (tree / "out/01-cleaned").glob("*.txt"))
    assert names == ["tle1.00001.cleaned.txt", "tle1.00002.cleaned.txt", "tle2.00001.cleaned.txt", "tle3.00001.cleaned.txt"]
    assert (tree / "out/01-cleaned/tle1.00001.cleaned.txt").read_text() == f"{L1}\n{L2}\n" * 2
    assert (tree / "out/01-cleaned/tle3.00001.cleaned.txt").read_text() == ""
    found = [json.loads(x) for x in (tree / "out/03-report/report.00001.jsonl").read_text().splitlines()]
    assert [(f["file"], f["rule_id"], f["source_lines"]) for f in found] == [("tle1.txt", "TLE-CHK-001", [5]), ("tle2.txt", "TLE-PAIR-002", [1])]
    assert list(found[0]) == sorted(found[0]) and (tree / "out/03-report/broken-noradids.ndjson").read_text() == '{"noradId":5}\n'
    assert json.loads((tree / "out/03-report/report.json").read_text())["summary"]["fix_counts"] == {"crlf": 1, "reconstructed-checksum": 2, "trailing-backslash": 1}
    back = tle_text.read_cleaned(spark, f"{out}/01-cleaned")
    assert sorted((r.src_file, r.idx, r.line2) for r in back.collect()) == [("tle1", 0, L2), ("tle1", 1, L2), ("tle1", 2, CLASH), ("tle2", 0, L2)]
    assert tle_text.read_findings(spark, f"{out}/03-report").count() == 2

    checked = api.verify(result.cleaned, tle_text.read_lines(spark, str(tree / "in")))
    assert [(r.rule, r.src_file, r.idx) for r in checked.suspects.collect()] == [("VRFY-EPOCH-CONFLICT", "tle1", 2)] and checked.exit_code() == 1
    kept = api.dedup(result.cleaned, checked.suspects)
    assert kept.summary["records_read"] == 4 and kept.summary["excluded_hard_suspects"] == 1 and kept.summary["records_written"] == 1 and kept.summary["records_dropped"] == 2 and kept.exit_code() == 0
    assert api.dedup(result.cleaned).exit_code() == 1
    rows, docs = api.extract(kept.import_set, ["00005"], tle_text.read_broken_ids(spark, f"{out}/03-report/broken-noradids.ndjson"))
    assert [r.line1 for r in rows.collect()] == [L1] and docs[0]["records"] == 1 and docs[0]["had_quarantined_records"] is True and docs[0]["mean_records_per_day"] is None
    with pytest.raises(KeyError):
        api.extract(kept.import_set, [77])
    archive.export_verify(checked, out)
    archive.export_dedup(api.dedup(result.cleaned), out)
    archive.export_extract(rows, docs, f"{out}/06-extract")
    assert json.loads((tree / "out/04-verify/suspects.00001.jsonl").read_text()) == {"schema_version": "2", "rule": "VRFY-EPOCH-CONFLICT", "severity": "hard", "catalog": 5, "epoch_key": 2000179.78495062, "src_file": "tle1", "index": 2, "detail": "catalog 5 shares epoch 2000179.78495062 and element-set 475 with a different orbital state"}
    summary = json.loads((tree / "out/04-verify/summary.json").read_text())
    assert summary["epoch_distribution"] == {"2000-06": 4} and summary["counts"] == {"VRFY-EPOCH-CONFLICT": 1} and (summary["hard"], summary["soft"], summary["exit_code"]) == (1, 0, 1)
    assert summary["checked"] == {"files": 2, "records": 4, "source_diff": 1, "missing_source_files": 0, "epoch_reissues": 0}
    assert (tree / "out/05-dedup/import.00001.txt").read_text() == f"{L1}\n{L2}\n" and len(f"{L1}\n{L2}\n") == 140
    note = json.loads((tree / "out/05-dedup/notes.00001.jsonl").read_text())
    assert note["conflict"] is True and note["kept"] == {"src_file": "tle2", "index": 0, "element_set": 475} and [x["index"] for x in note["dropped"]] == [0, 1, 2]
    assert json.loads((tree / "out/05-dedup/manifest.jsonl").read_text())["norad_id"] == 5
    assert (tree / "out/06-extract/5.txt").read_text() == f"{L1}\n{L2}\n" and json.loads((tree / "out/06-extract/5.json").read_text())["records"] == 1
    assert "| crlf | 1 |" in (tree / "out/03-report/report.md").read_text()
    plain = api.clean(spark, str(tree / "in"))
    by_rule, by_file = api.diff(plain.findings, result.findings)
    assert {(r.rule_id, r.a, r.b, r.presence) for r in by_rule.collect()} == {("TLE-COL-001", 1, 0, "a-only"), ("TLE-CHK-001", 1, 1, "both"), ("TLE-PAIR-002", 1, 1, "both")}
    assert by_file.count() == 3


def test_chunk_gaps_and_bad_findings_are_errors(spark, tmp_path):
    (tmp_path / "a.00001.cleaned.txt").write_text("x\n")
    (tmp_path / "a.00003.cleaned.txt").write_text("x\n")
    with pytest.raises(tle_text.ArchiveError):
        tle_text.read_cleaned(spark, str(tmp_path))
    (tmp_path / "report.00001.jsonl").write_text('{"schema_version":"2","rule_id":"TLE-COL-001","file":"x"}\n')
    with pytest.raises(tle_text.ArchiveError):
        tle_text.read_findings(spark, str(tmp_path))
    with pytest.raises(tle_text.ArchiveError):
        tle_text.read_lines(spark, str(tmp_path / "none"))


def test_numbered_files_hold_exactly_their_units(spark, tmp_path):
    units = spark.range(25).select(F.lit("s").alias("stem"), F.col("id").alias("n"), F.concat("id", F.lit("\n")).alias("text")).repartition(7)
    for size, files in ((10, [10, 10, 5]), (25, [25]), (5, [5] * 5), (0, [25])):
        names = exports.write_numbered(units, str(tmp_path), ".txt", size)
        assert [len((tmp_path / n).read_text().splitlines()) for n in names] == files
        assert sorted(p.name for p in tmp_path.glob("*.txt")) == names
        assert "".join((tmp_path / n).read_text() for n in names) == "".join(f"{k}\n" for k in range(25))


def aligned(spark, ours, source, how):
    return sorted((r.rule, r.src_file, r.idx) for r in over(ours, lambda t, u: how(SPARK, t, u), source).collect())


def test_alignment(spark):
    lines = [("f", n + 1, x) for n, x in enumerate([L1, L2, "", L1[:68] + "9", L2, L1[:68], L2 + "\\"])]
    source = spark.createDataFrame(lines, "src_file string, line_no long, raw string")
    ours = spark.createDataFrame([("f", 0, 1, 2, L1, L2), ("f", 1, 6, 7, L1, L2), ("f", 2, 1, 2, L1, CLASH), ("f", 3, 90, 91, L1, L2), ("g", 0, 1, 2, L1, L2)], "src_file string, idx long, src1 long, src2 long, line1 string, line2 string")
    assert aligned(spark, ours, source, align.by_provenance) == [("VRFY-INTERIOR-MUT", "f", 2), ("VRFY-ORIGIN-MISSING", "f", 3), ("VRFY-ORIGIN-MISSING", "g", 0)]
    two = ours.where("idx < 2 and src_file = 'f'")
    assert aligned(spark, two, source, align.by_order) == []
    assert aligned(spark, ours.where("src_file = 'f'"), source, align.by_order) == [("VRFY-ORIGIN-MISSING", "f", 2), ("VRFY-ORIGIN-MISSING", "f", 3)]
    assert [r.src_file for r in over(ours, lambda t, u: align.missing_sources(t, u), source).collect()] == ["g"]


def test_a_dropped_duplicate_is_no_origin_however_far_the_true_one_is(spark):
    """A copy without checksum, or with a bad column, shares satellite and epoch with the record that was kept."""
    later = [signed(f"1 00005U 58002B   00{200 + n}.78495062  .00000023  00000-0  28098-4 0  4753") for n in range(12)]
    between = [x for a in later for x in (a, L2)]
    plus = L1[:33] + "+" + L1[34:68]
    for shadow in (plus, signed(L1[:24] + "A" + L1[25:])):
        lines = [shadow, L2, *between * 20, L1, L2]
        source = spark.createDataFrame([("f", n + 1, x) for n, x in enumerate(lines)], "src_file string, line_no long, raw string")
        rows = [("f", n, a, L2) for n, a in enumerate(later * 20)] + [("f", 240, L1, L2)]
        ours = spark.createDataFrame(rows, "src_file string, idx long, line1 string, line2 string")
        assert aligned(spark, ours, source, align.by_order) == []
        changed = ours.withColumn("line2", F.when(F.col("idx").isin(240, 7), F.lit(CLASH)).otherwise(F.col("line2")))
        assert aligned(spark, changed, source, align.by_order) == [("VRFY-INTERIOR-MUT", "f", 7), ("VRFY-INTERIOR-MUT", "f", 240)]
        only = ours.where("idx = 240").withColumn("line2", F.lit(CLASH))
        gone = source.where(F.col("line_no") < len(lines) - 1)
        assert aligned(spark, only, gone, align.by_order) == [("VRFY-ORIGIN-MISSING", "f", 240)]


def test_commands_on_an_output_folder(spark, tree, capsys, monkeypatch):
    source, out = str(tree / "in"), str(tree / "out")
    assert commands.main(["clean", source, "--out-dir", out, "--reconstruct-checksum", "--chunk-records", "2"], spark) == 1
    assert commands.main(["clean", source, "--out-dir", out, "--reconstruct-checksum", "--chunk-records", "2", "--max-quarantined", "2"], spark) == 0
    whole = json.loads((tree / "out/03-report/report.json").read_text())
    assert set(whole) == {"schema_version", "run", "environment", "summary", "files"} and whole["run"]["failed_files"] == [] and set(whole["environment"]) == {"tool_version", "python_version"}
    assert set(whole["run"]) == {"command", "timestamp", "elapsed_seconds", "failed_files"}
    one = whole["files"][0]
    assert set(one) == {"src_name", "elapsed_seconds", "bytes", "records_per_sec", "paired_records", "orphan_entries", "input_lines_seen", "clean_count", "quarantined_count", "fix_counts", "quarantine_counts", "dropped_counts", "quarantined_norad_ids"}
    assert one["bytes"] == (tree / "in/tle1.txt").stat().st_size and one["quarantined_norad_ids"] == {"5": {"TLE-CHK-001": 1}}
    broken = (tree / "out/02-broken/tle1.00001.broken.txt").read_text().splitlines()
    assert broken[0] == "# tle1.broken.txt - quarantined records" and broken[3] == "[1] source lines 5-6 - rule: TLE-CHK-001 (tier-1) col 69 observed='9' expected='3'" and broken[4:6] == [L1[:68] + "9", L2]
    # The same again does nothing; another option, or a changed file, does.
    stamp = (tree / "out/01-cleaned/tle1.00001.cleaned.txt").stat().st_mtime_ns
    archive.clean(spark, source, out, True, 2)
    assert (tree / "out/01-cleaned/tle1.00001.cleaned.txt").stat().st_mtime_ns == stamp
    (tree / "out/01-cleaned/tle1.00002.cleaned.txt").write_text("")
    archive.clean(spark, source, out, True, 2)
    assert (tree / "out/01-cleaned/tle1.00002.cleaned.txt").read_text() == f"{L1}\n{CLASH}\n"
    assert archive.compare_inputs({"a": {"x": 1}, "b": {"x": 1}}, {"b": {"x": 2}, "c": {}}) == {"added": ["c"], "removed": ["a"], "changed": ["b"]}

    assert commands.main(["verify", out, "--source", source, "--orbit"], spark) == 1
    summary = json.loads((tree / "out/04-verify/summary.json").read_text())
    assert summary["checked"]["orbit_satellites_checked"] == 1 and summary["counts"] == {"VRFY-EPOCH-CONFLICT": 1}
    assert commands.main(["dedup", out], spark) == 0
    deduped = json.loads((tree / "out/05-dedup/summary.json").read_text())
    assert deduped["cleaned_fingerprint"] == {"stems": [["tle1", 420], ["tle2", 140], ["tle3", 0]]} and deduped["cleaned_files"] == 3 and deduped["excluded_hard_suspects"] == 1
    assert set(deduped) == {"records_read", "excluded_hard_suspects", "records_written", "records_dropped", "groups_collapsed", "conflicts_flagged", "unusable_records", "gap_silent_satellites", "cleaned_files", "cleaned_fingerprint", "exit_code", "schema_version"}
    assert commands.main(["extract", "00005", "--out-dir", out], spark) == 0
    doc = json.loads((tree / "out/06-extract/5.json").read_text())
    assert set(doc) == {"schema_version", "norad_id", "records", "first_epoch", "last_epoch", "span_days", "mean_records_per_day", "largest_gap_days", "largest_gap_at", "median_spacing_days", "gap_count", "gaps", "had_quarantined_records", "element_set_first", "element_set_last", "source"}
    assert doc["element_set_first"] == doc["element_set_last"] == 475 and doc["source"]["dedup_records_written"] == 1 and doc["had_quarantined_records"] is True
    with open(tree / "out/01-cleaned/tle3.00001.cleaned.txt", "w") as f:
        f.write(f"{L1}\n{L2}\n")
    assert archive.extract(spark, out, [5])[2] == ["01-cleaned changed after 05-dedup was made"]

    plain = str(tree / "plain")
    assert commands.main(["clean", source, "--out-dir", plain], spark) == 1
    capsys.readouterr()
    assert commands.main(["diff", plain, out], spark) == 0 and commands.main(["report", out], spark) == 0 and commands.main(["explain", "TLE-COL-004"]) == 0
    said = capsys.readouterr().out
    assert "Gone in the second (1):\n  TLE-COL-001  -1" in said and "| tle1.txt | 4 | 0 | 3 | 1 |" in said and "^  column 25" in said
    assert commands.main(["report", str(tree / "none")], spark) == commands.main(["extract", "x", "--out-dir", out], spark) == commands.main(["explain", "nope"]) == 2
    (tree / "out/05-dedup/import.00001.txt").write_text("short\n")
    assert commands.main(["extract", "5", "--out-dir", out], spark) == 2
    assert commands.signal_exit_code(2) == 130
    monkeypatch.chdir(tree)
    (tree / "perigee.json").write_text('{"source": "a", "output": "b"}')
    assert commands.parser(commands.settings()).parse_args(["clean"]).out_dir == "b"


def test_one_sided_files_and_texts(spark):
    a = spark.createDataFrame([("x.txt", "TLE-COL-001")] * 3 + [("y.txt", "TLE-CHK-001")], "file string, rule_id string")
    b = spark.createDataFrame([("x.txt", "TLE-CHK-001"), ("z.txt", "TLE-COL-001")], "file string, rule_id string")
    _, files = api.diff(a, b, "file")
    assert {(r.file, r.rule_id, r.a, r.b, r.presence) for r in files.collect()} == {("x.txt", "TLE-COL-001", 3, 0, "both"), ("x.txt", "TLE-CHK-001", 0, 1, "both"), ("y.txt", "TLE-CHK-001", 1, 0, "a-only"), ("z.txt", "TLE-COL-001", 0, 1, "b-only")}
    assert (archive.clock(65), archive.clock(3665), archive.size_text(3 * 2**30), archive.short_percent(1, 10**6), archive.short_percent(0, 5), archive.duration(3725)) == ("1:05", "1:01:05", "3.0G", "<0.01%", "0%", "1 hour, 2 minutes and 5 seconds")


def test_failing_records_are_told_why(spark):
    rows = [("f", n, a, b) for n, (a, b) in enumerate([(L1, L2), (L1[:68] + "9", L2), (L1, L2[:60]), (L1, L2[:8] + "999" + L2[11:]), (L1, "2 09999  34.2682 348.7242 1859667 331.7664  19.3264 10.82419157413668"), (L1[:68] + "x", L2)])]
    facts = over(spark.createDataFrame(rows, "src_file string, idx long, line1 string, line2 string"), lambda t: records_facts(t))
    found = {r.idx: r.detail for r in api.verify(facts).suspects.collect()}
    assert found == {
        1: "cleaned record fails validation: line 1: checksum mismatch: column 69 is '9', computed 3", 2: "cleaned record fails validation: line 2: line length 60, expected 69",
        3: "cleaned record fails validation: line 2: inclination 999.2682 outside [0, 180]", 4: "cleaned record fails validation: catalog number mismatch: line 1 '00005' vs line 2 '09999'",
        5: "cleaned record fails validation: line 1: checksum column 69 is 'x', not a digit",
    }


def records_facts(t):
    from perigee.operators import records

    return records.facts(SPARK, t)


def test_explain():
    assert "checksum" in api.explain("tle-chk-001") and "fix" in api.explain("crlf")
    with pytest.raises(KeyError):
        api.explain("nope")
