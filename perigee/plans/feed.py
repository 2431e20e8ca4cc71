"""A deterministic feed of element sets made from the `events` table, good and bad ones, as SQL text.

The engine's tests and queries run on any archive; this feed gives them one in a database that has none.
"""

from __future__ import annotations

from perigee.functions.tle import Dialect, checksum


def _int(x: str, n: int, pad: str) -> str:
    return f"lpad(CAST(CAST({x} AS BIGINT) AS VARCHAR(20)), {n}, '{pad}')"


def _angle(x: str) -> str:
    return f"concat({_int(f'floor(({x}) / 10000.0)', 3, ' ')}, '.', {_int(f'({x}) % 10000', 4, '0')})"


def _body1(cat: str, elset: str, day: str = "dayofyear(ts)", year: str = "year(ts) % 100") -> str:
    ms = "(CAST(extract(hour FROM ts) AS BIGINT) * 3600000 + CAST(extract(minute FROM ts) AS BIGINT) * 60000 + CAST(floor(extract(second FROM ts)) AS BIGINT) * 1000 + event_id % 1000)"
    parts = [
        "'1 '", cat, "'U 20001A   '", _int(year, 2, "0"), _int(day, 3, "0"), "'.'", _int(f"floor({ms} * 1000 / 864.0)", 8, "0"), "'  .'", _int("(event_id * 7919) % 100000", 8, "0"),
        "'  00000-0  '", _int("(event_id * 31) % 100000", 5, "0"), "'-4 0 '", _int(elset, 4, " "),
    ]
    return f"concat({', '.join(parts)})"


def _body2(cat: str, inc: str = "(event_id * 7919) % 1800001") -> str:
    parts = [
        "'2 '", cat, "' '", _angle(inc), "' '", _angle("(event_id * 104729) % 3600000"), "' '", _int("(event_id * 65537) % 10000000", 7, "0"), "' '", _angle("(event_id * 15485863) % 3600000"), "' '",
        _angle("(event_id * 32452843) % 3600000"), "' '", _int("1 + event_id % 16", 2, " "), "'.'", _int("(event_id * 7919) % 100000000", 8, "0"), _int("event_id % 100000", 5, " "),
    ]
    return f"concat({', '.join(parts)})"


CAT = _int("1 + user_id % 99999", 5, "0")
ALPHA = "concat(substr('ABCDEFGHJKLMNPQRSTUVWXYZ', CAST(1 + event_id % 24 AS INT), 1), " + _int("event_id % 10000", 4, "0") + ")"


def _signed(body: str) -> str:
    return f"concat({body}, CAST({checksum(body)} AS VARCHAR(2)))"


def records(d: Dialect) -> str:
    """(event_id, rank, src_file, line1, line2): valid records in the order of their files, with re-issues of later element
    sets (rank 1), clashes within one element set (rank 2), exact copies (rank 3), alphabetic catalog numbers (rank 4)
    and epochs at a year's end (rank 5)."""
    kinds = [
        (0, "true", _body1(CAT, "event_id % 10000"), _body2(CAT)), (1, "event_id % 10 = 0", _body1(CAT, "(event_id + 1) % 10000"), _body2(CAT, "(event_id * 7919 + 17) % 1800001")),
        (2, "event_id % 101 = 0", _body1(CAT, "event_id % 10000"), _body2(CAT, "(event_id * 7919 + 5) % 1800001")), (3, "event_id % 53 = 0", _body1(CAT, "event_id % 10000"), _body2(CAT)),
        (4, "event_id % 29 = 0", _body1(ALPHA, "event_id % 10000"), _body2(ALPHA)),
        (5, "event_id % 41 = 0", _body1(CAT, "event_id % 10000", "CASE WHEN event_id % 3 = 0 THEN 0 ELSE 366 END", "CASE WHEN event_id % 2 = 0 THEN 19 ELSE 57 END"), _body2(CAT)),
    ]
    arms = [f"SELECT event_id, {rank} AS rank, concat('tle', lpad(CAST(event_id % 7 AS VARCHAR(2)), 2, '0')) AS src_file, {b1} AS b1, {b2} AS b2 FROM events WHERE {when}" for rank, when, b1, b2 in kinds]
    return f"SELECT event_id, rank, src_file, concat(b1, CAST({checksum('b1')} AS VARCHAR(2))) AS line1, concat(b2, CAST({checksum('b2')} AS VARCHAR(2))) AS line2 FROM ({' UNION ALL '.join(arms)}) made"


def lines(d: Dialect, made_records: str) -> str:
    """(src_file, line_no, raw): the records as lines of files, with defects by event_id % 97, junk and blank lines."""
    k, slash, cr, tab = "(event_id % 97)", d.char(92), d.char(13), d.char(9)
    first = (
        f"CASE WHEN {k} = 1 THEN concat(line1, {slash}) WHEN {k} = 2 THEN concat(line1, {cr}) WHEN {k} = 3 THEN concat('  ', line1, ' ', {tab}) WHEN {k} = 4 THEN concat(substr(line1, 1, 68), {slash}) "
        f"WHEN {k} = 5 THEN concat(substr(line1, 1, 68), CAST((CAST(substr(line1, 69, 1) AS INT) + 1) % 10 AS VARCHAR(2))) WHEN {k} = 6 THEN concat(substr(line1, 1, 24), 'A', substr(line1, 26)) "
        f"WHEN {k} = 7 THEN substr(line1, 1, 60) WHEN {k} = 8 THEN concat(substr(line1, 1, 24), 'A', substr(line1, 26, 43)) WHEN {k} = 9 THEN concat(substr(line1, 1, 68), {d.char(241) if d.spark else 'chr(241)'}) "
        f"WHEN {k} = 10 THEN concat(substr(line1, 1, 68), 'x') WHEN {k} = 11 THEN concat(substr(line1, 1, 20), '367', substr(line1, 24)) WHEN {k} = 12 THEN concat('junk ', substr(line1, 3, 20)) "
        f"WHEN {k} = 13 THEN concat({slash}, {cr}) WHEN {k} = 19 THEN '' ELSE line1 END"
    )
    second = (
        f"CASE WHEN {k} = 14 THEN ' ' WHEN {k} = 15 THEN concat('2 99999', substr(line2, 8, 61), CAST({checksum(chr(34) + 'o' + chr(34))} AS VARCHAR(2))) WHEN {k} = 16 THEN concat(substr(line2, 1, 8), '999', substr(line2, 12)) "
        f"WHEN {k} = 17 THEN concat(line2, ' ', {slash}, {cr}) WHEN {k} = 18 THEN substr(line2, 1, 68) WHEN {k} = 20 THEN 'x' ELSE line2 END"
    ).replace('"o"', "other")
    made = f"SELECT *, concat('2 99999', substr(line2, 8, 61)) AS other FROM ({made_records}) good"
    both = f"SELECT src_file, event_id, rank, 1 AS half, {first} AS raw FROM ({made}) a UNION ALL SELECT src_file, event_id, rank, 2, {second} FROM ({made}) b"
    return f"SELECT src_file, row_number() OVER (PARTITION BY src_file ORDER BY event_id, rank, half) AS line_no, raw FROM ({both}) halves"
