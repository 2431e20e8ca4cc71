"""Lines to records: pairing, repair, validation and routing, as SQL over a table of lines.

A table of lines has (src_file, line_no, raw). Each step is a SELECT over the one before; Catalyst sees one plan.
"""

from __future__ import annotations

from perigee.functions import tle
from perigee.functions.tle import Dialect

#: Bytes from which a line counts as oversized.
OVERSIZED = 4096


def kept(d: Dialect, lines: str) -> str:
    """Lines that have content, with their kind: 1 or 2 by their first two characters, O oversized, X anything else."""
    size = "octet_length(raw)" if d.spark else "octet_length(encode(raw))"
    head = f"{d.replace('raw', tle.LEAD)}"
    plain = "WHEN substr(raw, 1, 2) = '1 ' THEN '1' WHEN substr(raw, 1, 2) = '2 ' THEN '2'"
    kind = f"CASE WHEN {size} >= {OVERSIZED} THEN 'O' {plain} WHEN {head} LIKE '1 %' THEN '1' WHEN {head} LIKE '2 %' THEN '2' ELSE 'X' END"
    return f"SELECT src_file, line_no, raw, {kind} AS kind FROM ({lines}) l WHERE NOT ({tle.content_free(d, 'raw')} AND {size} < {OVERSIZED})"


#: Lines of a file that are ordered in one task; a file of any length is many such blocks.
BLOCK = 8_192


def _block(no: str) -> str:
    return f"CAST(floor({no} / {float(BLOCK)}) AS BIGINT)"


def neighbours(d: Dialect, lines: str) -> str:
    """The kept lines with the kind before them and the kind, number and text behind them, in their file.

    Windows span one block of a file; what a block's first and last line see beyond it comes from a table of the
    blocks' edges, a row a block.
    """
    w = "OVER (PARTITION BY src_file, blk ORDER BY line_no)"
    inner = f"SELECT *, lag(kind) {w} AS b0, lead(kind) {w} AS a0, lead(line_no) {w} AS n0, lead(raw) {w} AS r0 FROM (SELECT *, {_block('line_no')} AS blk FROM ({kept(d, lines)}) k) x"
    firsts = f"SELECT src_file, blk, kind, line_no, raw FROM ({inner}) f WHERE b0 IS NULL"
    lasts = f"SELECT src_file, blk, kind FROM ({inner}) l WHERE a0 IS NULL"
    f = "OVER (PARTITION BY f.src_file ORDER BY f.blk)"
    edges = f"SELECT f.src_file AS e_file, f.blk AS e_blk, lead(f.kind) {f} AS a1, lead(f.line_no) {f} AS n1, lead(f.raw) {f} AS r1, lag(l.kind) {f} AS b1 FROM ({firsts}) f JOIN ({lasts}) l ON f.src_file = l.src_file AND f.blk = l.blk"
    return (
        "SELECT src_file, line_no, raw, kind, CASE WHEN b0 IS NULL THEN b1 ELSE b0 END AS before, CASE WHEN a0 IS NULL THEN a1 ELSE a0 END AS after, "
        f"CASE WHEN a0 IS NULL THEN n1 ELSE n0 END AS next_no, CASE WHEN a0 IS NULL THEN r1 ELSE r0 END AS next_raw FROM ({inner}) i JOIN ({edges}) e ON i.src_file = e.e_file AND i.blk = e.e_blk"
    )


def in_file(d: Dialect, rows: str, order: str, name: str) -> str:
    """`rows` numbered from 0 within their file in the order of the number `order`, block by block like `neighbours`."""
    blocked = f"SELECT *, {_block(order)} AS blk FROM ({rows}) r"
    totals = f"SELECT src_file AS t_file, blk AS t_blk, sum(m) OVER (PARTITION BY src_file ORDER BY blk) - m AS ahead FROM (SELECT src_file, blk, count(*) AS m FROM ({blocked}) b GROUP BY src_file, blk) t"
    own = f"SELECT *, row_number() OVER (PARTITION BY src_file, blk ORDER BY {order}) AS nth FROM ({blocked}) b"
    joined = f"SELECT *, CAST(ahead + nth - 1 AS BIGINT) AS {name} FROM ({own}) o JOIN ({totals}) t ON o.src_file = t.t_file AND o.blk = t.t_blk"
    return f"SELECT * {'EXCEPT' if d.spark else 'EXCLUDE'} (blk, t_file, t_blk, ahead, nth) FROM ({joined}) j"


def paired(d: Dialect, lines: str) -> str:
    """(src_file, src1, src2, raw1, raw2, rule_id, note): records, and lines without a partner with their diagnosis.

    A line 1 pairs with the next kept line if that is a line 2; everything else is an orphan.
    """
    record = "kind = '1' AND coalesce(after, '') = '2'"
    rule = f"CASE WHEN {record} THEN NULL WHEN kind IN ('1', '2') THEN 'TLE-PAIR-001' WHEN kind = 'X' THEN 'TLE-PAIR-002' ELSE 'TLE-COL-001' END"
    note = (
        f"CASE WHEN {record} THEN NULL WHEN kind = '2' THEN 'orphan line 2: no preceding line 1' WHEN kind = 'X' THEN 'line does not start with ''1 '' or ''2 ''' WHEN kind = 'O' THEN 'line exceeds 4096 bytes; truncated' "
        "WHEN after IS NULL THEN 'orphan line 1 at end of file' WHEN after = '1' THEN 'orphan line 1: followed by another line 1' WHEN after = 'X' THEN 'orphan line 1: followed by a non-TLE line' ELSE 'orphan line 1: followed by an oversized line' END"
    )
    # The first bytes, not characters; a character that the cut would split goes.
    cut = f"decode(substr(encode(raw, 'UTF-8'), 1, {OVERSIZED}), 'UTF-8')" if d.spark else f"decode(encode(raw)[1:{OVERSIZED}])"
    raw = f"CASE WHEN kind = 'O' THEN {cut} ELSE raw END"
    return (
        f"SELECT src_file, line_no AS src1, CASE WHEN {record} THEN next_no END AS src2, {raw} AS raw1, CASE WHEN {record} THEN next_raw END AS raw2, {rule} AS rule_id, {note} AS note "
        f"FROM ({neighbours(d, lines)}) s WHERE NOT (kind = '2' AND coalesce(before, '') = '1')"
    )


def _judged(d: Dialect, n: int, rebuild: bool) -> str:
    """The rule that line n of a record breaks, null if none. The first that applies counts."""
    absent = "" if rebuild else " ELSE 'TLE-COL-001'"
    return (
        f"CASE WHEN NOT ascii{n} THEN 'TLE-COL-003' WHEN size{n} = 69 THEN (CASE WHEN NOT body{n} THEN 'TLE-COL-004' WHEN said{n} IS NULL OR said{n} <> sum{n} THEN 'TLE-CHK-001' END) "
        f"WHEN size{n} = 68 THEN (CASE WHEN NOT body{n} THEN 'TLE-COL-002'{absent} END) ELSE 'TLE-COL-001' END"
    )


def routed(d: Dialect, lines: str, rebuild: bool = False) -> str:
    """Every record and orphan once: (src_file, src1, src2, raw1, raw2, line1, line2, orphan, clean, rule_id, related_rule,
    note, tier, norad_id, fix columns). `rebuild`: whether absent checksums are computed."""
    step = f"SELECT *, {tle.core(d, 'raw1')} AS core1, {tle.core(d, 'raw2')} AS core2, rule_id IS NOT NULL AS orphan FROM ({paired(d, lines)}) p"
    facts = []
    for n in (1, 2):
        said = f"try_cast(CASE WHEN {d.like(f'substr(core{n}, 69, 1)', '^[0-9]' + chr(92) + 'z')} THEN substr(core{n}, 69, 1) END AS INT)"
        facts += [f"{tle.checksum(f'core{n}')} AS sum{n}", f"{tle.body_ok(d, f'core{n}', n)} AS body{n}", f"length(core{n}) AS size{n}", f"{said} AS said{n}"]
    step = f"SELECT *, {', '.join(facts)} FROM ({step}) c"
    # A line whose layout and checksum column fit, and that had no edges, has ASCII alone.
    ascii_only = lambda n: f"CASE WHEN raw{n} = core{n} AND size{n} = 69 AND body{n} AND said{n} IS NOT NULL THEN true ELSE {d.like(f'raw{n}', '^[' + chr(92) + 'x00-' + chr(92) + 'x7F]*' + chr(92) + 'z')} END AS ascii{n}"
    step = f"SELECT *, {ascii_only(1)}, {ascii_only(2)} FROM ({step}) a"
    step = f"SELECT *, CASE WHEN NOT orphan THEN {_judged(d, 1, rebuild)} END AS rule1, CASE WHEN NOT orphan THEN {_judged(d, 2, rebuild)} END AS rule2 FROM ({step}) j"
    step = f"SELECT *, CASE WHEN NOT orphan AND rule1 IS NULL AND rule2 IS NULL AND substr(core1, 3, 5) <> substr(core2, 3, 5) THEN 'TLE-PAIR-003' END AS rule3 FROM ({step}) m"
    step = f"SELECT *, NOT orphan AND rule1 IS NULL AND rule2 IS NULL AND rule3 IS NULL AS clean FROM ({step}) f"
    whole = lambda n: f"CASE WHEN size{n} = 68 THEN concat(core{n}, CAST(sum{n} AS VARCHAR(2))) ELSE core{n} END"
    fixes = []
    for n in (1, 2):
        for fix, test in tle.edge_fixes(d, f"raw{n}").items():
            fixes.append(f"CASE WHEN clean AND raw{n} <> core{n} AND {test} THEN 1 ELSE 0 END AS {fix.replace('-', '_')}{n}")
        fixes.append(f"CASE WHEN clean AND size{n} = 68 THEN 1 ELSE 0 END AS reconstructed_checksum{n}")
    tier = "CASE WHEN orphan OR coalesce(rule1, rule2) = 'TLE-COL-003' THEN 'none' WHEN rule3 IS NOT NULL AND (size1 = 68 OR size2 = 68) THEN 'tier-2' WHEN NOT clean THEN 'tier-1' END"
    return (
        f"SELECT src_file, src1, src2, raw1, raw2, CASE WHEN clean THEN {whole(1)} END AS line1, CASE WHEN clean THEN {whole(2)} END AS line2, orphan, clean, "
        f"coalesce(rule_id, rule1, rule2, rule3) AS rule_id, CASE WHEN rule1 IS NOT NULL THEN rule2 END AS related_rule, note, {tier} AS tier, "
        f"CASE WHEN NOT clean THEN {tle.norad_id(d, 'raw1')} END AS norad_id, {', '.join(fixes)} FROM ({step}) z"
    )


FIXES = ("crlf", "leading-trim", "trailing-ws", "trailing-backslash", "reconstructed-checksum")


def facts(d: Dialect, rows: str) -> str:
    """(catalog, epoch_key, epoch_us, elset, line1, line2, src_file, idx) of records (src_file, idx, line1, line2). The keys
    of a record whose line 1 can't be read are -1; a blank catalog number alone is -1 with a real epoch."""
    catalog = tle.decode_catalog(d, tle.catalog_field("line1"))
    return (
        f"SELECT CASE WHEN epoch_day IS NULL THEN -1 ELSE coalesce({catalog}, -1) END AS catalog, coalesce(epoch_key, CAST(-1 AS DOUBLE)) AS epoch_key, epoch_us, "
        f"{tle.element_set(d, 'line1')} AS elset, line1, line2, src_file, idx FROM ({tle.with_epoch(d, rows)}) c"
    )


def cleaned(d: Dialect, routed_sql: str) -> str:
    """The fact table of accepted records, numbered in their files."""
    return facts(d, in_file(d, f"SELECT src_file, src1, line1, line2 FROM ({routed_sql}) r WHERE clean", "src1", "idx"))


def fix_counts(routed_sql: str) -> str:
    """(src_file, fix, n): lines fixed, of accepted records."""
    sums = ", ".join(f"sum({f.replace('-', '_')}1 + {f.replace('-', '_')}2) AS {f.replace('-', '_')}" for f in FIXES)
    by_file = f"SELECT src_file, {sums} FROM ({routed_sql}) r GROUP BY src_file"
    pick = "CASE fix " + " ".join(f"WHEN '{f}' THEN {f.replace('-', '_')}" for f in FIXES) + " END"
    names = " UNION ALL ".join(f"SELECT '{f}' AS fix" for f in FIXES)
    return f"SELECT src_file, fix, CAST(n AS BIGINT) AS n FROM (SELECT src_file, fix, {pick} AS n FROM ({by_file}) b CROSS JOIN ({names}) f) u WHERE n > 0"  # five rows


def file_stats(d: Dialect, lines: str, routed_sql: str) -> str:
    """(src_file, lines, paired, orphan, clean, quarantined): paired + orphan = clean + quarantined."""
    r = f"SELECT src_file, sum(CASE WHEN orphan THEN 0 ELSE 1 END) AS paired, sum(CASE WHEN orphan THEN 1 ELSE 0 END) AS orphan, sum(CASE WHEN clean THEN 1 ELSE 0 END) AS clean, sum(CASE WHEN clean THEN 0 ELSE 1 END) AS quarantined FROM ({routed_sql}) r GROUP BY src_file"
    l = f"SELECT src_file, max(line_no) AS lines FROM ({lines}) l GROUP BY src_file"  # noqa: E741
    counts = ", ".join(f"CAST(coalesce(r.{c}, 0) AS BIGINT) AS {c}" for c in ("paired", "orphan", "clean", "quarantined"))
    return f"SELECT l.src_file AS src_file, CAST(l.lines AS BIGINT) AS lines, {counts} FROM ({l}) l LEFT JOIN ({r}) r ON l.src_file = r.src_file"
