import random

import pytest

from perigee.functions import tle
from perigee.functions.tle import SPARK
from perigee.operators import records

L1 = "1 00005U 58002B   00179.78495062  .00000023  00000-0  28098-4 0  4753"
L2 = "2 00005  34.2682 348.7242 1859667 331.7664  19.3264 10.82419157413667"
OTHER = "2 09999  34.2682 348.7242 1859667 331.7664  19.3264 10.82419157413668"


def run(spark, rows, sql):
    spark.createDataFrame(rows, "src_file string, line_no long, raw string").createOrReplaceTempView("test_lines")
    return spark.sql(sql("SELECT * FROM test_lines")).collect()


def routed(spark, raws, rebuild=False):
    rows = run(spark, [("tle1", n + 1, r) for n, r in enumerate(raws)], lambda t: records.routed(SPARK, t, rebuild))
    return sorted(rows, key=lambda r: r.src1)


@pytest.mark.parametrize("block", [1, 3, 8_192])
def test_pairing_matches_a_state_machine_at_any_block_size(spark, monkeypatch, block):
    monkeypatch.setattr(records, "BLOCK", block)
    rng = random.Random(block)
    kinds = {"1": "1 a", "2": "\t2 b", "X": "zz", "-": " \\\r", "O": "1 " + "x" * 5000}
    rows, want = [], set()
    for f in range(12):
        seq = [rng.choice("1122X-O") for _ in range(rng.randrange(1, 25))]
        held = None
        for n, k in enumerate(seq, 1):
            rows.append((f"tle{f}", n, kinds[k]))
            if k == "-":
                continue
            if k == "2" and held:
                want.add((f"tle{f}", held, n, None))
                held = None
                continue
            if held:
                want.add((f"tle{f}", held, None, "TLE-PAIR-001"))
                held = None
            if k == "1":
                held = n
            else:
                want.add((f"tle{f}", n, None, {"2": "TLE-PAIR-001", "X": "TLE-PAIR-002", "O": "TLE-COL-001"}[k]))
        if held:
            want.add((f"tle{f}", held, None, "TLE-PAIR-001"))
    got = run(spark, rows, lambda t: records.paired(SPARK, t))
    assert {(r.src_file, r.src1, r.src2, r.rule_id) for r in got} == want and len(got) == len(want)


def test_one_bad_example_for_each_rule(spark):
    cases = [
        ([L1[:60], L2], "TLE-COL-001"), ([L1[:24] + "A" + L1[25:68], L2], "TLE-COL-002"), ([L1[:68] + "ñ", L2], "TLE-COL-003"), ([L1[:24] + "A" + L1[25:], L2], "TLE-COL-004"),
        ([L1[:68] + "0", L2], "TLE-CHK-001"), ([L1], "TLE-PAIR-001"), (["junk"], "TLE-PAIR-002"), ([L1, OTHER], "TLE-PAIR-003"), ([L1[:68], L2], "TLE-COL-001"),
    ]
    for raws, rule in cases:
        (row,) = routed(spark, raws)
        assert not row.clean and row.rule_id == rule, raws


def test_repairs_and_accounting(spark):
    rows = routed(spark, [L1, L2, L1[:68] + "\\", L2[:68], L1[:68] + "9", L2], rebuild=True)
    assert [r.clean for r in rows] == [True, True, False]
    assert (rows[1].line1, rows[1].line2) == (L1, L2)
    assert rows[1].trailing_backslash1 == 1 and rows[1].reconstructed_checksum1 + rows[1].reconstructed_checksum2 == 2
    fixed = routed(spark, ["  " + L1, L2 + "\r", L1 + "   ", L2 + "\\"])
    assert all(r.clean and (r.line1, r.line2) == (L1, L2) for r in fixed)
    assert fixed[0].leading_trim1 == fixed[0].crlf2 == fixed[1].trailing_ws1 == fixed[1].trailing_backslash2 == 1
    assert [r.norad_id for r in routed(spark, [L1, " " + L1, "x"])] == [5, None, None]


def test_cleaning_twice_changes_nothing(spark):
    first = routed(spark, ["  " + L1, L2 + "\r", L1[:68], L2[:68]], rebuild=True)
    again = routed(spark, [x for r in first for x in (r.line1, r.line2)])
    assert all(r.clean for r in again) and [(r.line1, r.line2) for r in again] == [(r.line1, r.line2) for r in first]


def test_body_by_text_is_layout_and_ranges_by_number(spark):
    """Random lines at and around every bound: comparing texts gives what comparing numbers gives."""
    rng, rows = random.Random(9), []
    for _ in range(4000):
        line1, line2 = list(L1), list(L2)
        for line, spans in ((line1, ((20, 32),)), (line2, ((8, 16), (17, 25), (34, 42), (43, 51), (52, 63)))):
            for a, b in spans:
                if rng.random() < 0.5:
                    point, n = "".join(line[a:b]).index("."), b - a
                    whole = rng.choice((rng.choice(("0", "179", "180", "359", "360", "366", "367", "", "1", "00", "99")), "1 2", "  ", "2 "))[-point:].rjust(point)
                    line[a:b] = whole + "." + rng.choice(("0" * (n - point - 1), "0" * (n - point - 2) + "1", "9" * (n - point - 1)))
            if rng.random() < 0.1:
                line[rng.randrange(68)] = rng.choice(" 0A.-+x")
        rows.append(("".join(line1), "".join(line2)))
    spark.createDataFrame(rows, "a string, b string").createOrReplaceTempView("test_bodies")
    both = lambda c, n: f"(CASE WHEN {tle.layout_ok(SPARK, c, n)} THEN {tle.semantic_ok(c, n)} ELSE false END)"
    found = spark.sql(f"SELECT {tle.body_ok(SPARK, 'a', 1)} AS a1, {both('a', 1)} AS a2, {tle.body_ok(SPARK, 'b', 2)} AS b1, {both('b', 2)} AS b2 FROM test_bodies").collect()
    assert all(r.a1 == r.a2 and r.b1 == r.b2 for r in found)
    assert 400 < sum(r.a1 for r in found) < 3800 and 100 < sum(r.b1 for r in found) < 3000
