import json

from pyspark.sql import functions as F

from perigee import api, archive
from perigee.functions import diagnostics

L1 = "1 00005U 58002B   00179.78495062  .00000023  00000-0  28098-4 0  4753"
L2 = "2 00005  34.2682 348.7242 1859667 331.7664  19.3264 10.82419157413667"


def errors(spark, line, which):
    return spark.createDataFrame([(line,)], "x string").select(diagnostics.body_errors(F.col("x"), which).alias("e")).first().e


def test_messages(spark):
    assert errors(spark, L1, 1) == [] and errors(spark, L2, 2) == []
    (e,) = errors(spark, L1[:7] + "X" + L1[8:], 1)
    assert (e.msg, e.lo, e.hi, e.observed, e.expected) == ("column 8 (classification): got 'X', expected one of 'UCS'", 8, 8, "X", "UCS")
    (e,) = errors(spark, L1[:8] + "'" + L1[9:], 1)
    assert e.msg == "column 9 (column 9 separator): got \"'\", expected one of ' '"
    (e,) = errors(spark, L1[:24] + "A" + L1[25:], 1)
    assert e.msg == "columns 25-32 (epoch fraction): contains a character outside '0123456789'" and e.observed == "A8495062" and e.expected is None
    (e,) = errors(spark, L2[:8] + "999" + L2[11:], 2)
    assert (e.msg, e.kind, e.lo, e.hi, e.observed, e.expected) == ("inclination 999.2682 outside [0, 180]", "semantic", 9, 16, "999.2682", "[0, 180]")
    found = [e.msg for e in errors(spark, L2[:8] + "999" + L2[11:17] + "3 4" + L2[20:43] + "999" + L2[46:], 2)]
    assert found == ["inclination 999.2682 outside [0, 180]", "a numeric field could not be parsed for semantic checks"]
    (e,) = errors(spark, L1[:20] + "367" + L1[23:], 1)
    assert e.msg == "epoch day-of-year 367.78495062 outside (0, 367)"


def test_findings_carry_them(spark):
    raws = [L1[:24] + "A" + L1[25:], L2, L1, L2[:68] + "1", L1[:60], L2[:7] + "x" + L2[8:], L1[:68], L2, "zz"]
    lines = spark.createDataFrame([("tle1", n + 1, r) for n, r in enumerate(raws)], "src_file string, line_no long, raw string")
    rows = [json.loads(r.text) for r in archive.findings_json(archive._diagnosed(api.clean_lines(lines).findings)).orderBy("src1").collect()]
    short = [(r["rule_id"], r["source_lines"], r["column_range"], r["observed"], r["expected"]) for r in rows]
    assert short == [
        ("TLE-COL-004", [1], [25, 32], "A8495062", None), ("TLE-CHK-001", [4], [69, 69], "1", "7"), ("TLE-COL-001", [5], None, "60", "68 or 69"), ("TLE-COL-001", [7], None, "68", "69"), ("TLE-PAIR-002", [9], None, None, None),
    ]
    assert rows[2]["related"][0]["rule_id"] == "TLE-COL-004" and rows[2]["related"][0]["source_lines"] == [6] and rows[2]["related"][0]["column_range"] == [8, 8]
    assert rows[3]["note"] == "checksum absent; use --reconstruct-checksum to recompute" and rows[4]["note"] == "line does not start with '1 ' or '2 '"
