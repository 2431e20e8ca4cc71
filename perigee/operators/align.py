"""Cleaned records against the source files they come from, as SQL text.

For records that carry their source line numbers the audit is a join on (file, line): `by_provenance`. An exported tree
has none: `by_order` gives each record the source pair of the same two lines, the n-th occurrence to the n-th, by an
equi-join; only records that find none, or one behind a pair that an earlier record has, are looked up by satellite and
epoch among the pairs that no record claims. No file is brought into one task: what precedes a block of records in its
file comes from a table with a row a block.
"""

from __future__ import annotations

from perigee.functions import tle
from perigee.functions.tle import Dialect
from perigee.operators import records as lines_to_records

BLOCK = lines_to_records.BLOCK


def _becomes(core: str) -> str:
    """A normalised line with its checksum, where that alone is absent."""
    return f"CASE WHEN length({core}) = 68 THEN concat({core}, CAST({tle.checksum(core)} AS VARCHAR(2))) ELSE {core} END"


def by_provenance(d: Dialect, records: str, lines: str) -> str:
    """(rule, src_file, idx): records one of whose lines is not what its source line becomes by the allowed repairs.

    records: (src_file, idx, src1, src2, line1, line2); lines: (src_file, line_no, raw). Both are spread by file and line.
    """
    source = f"SELECT src_file AS f, line_no AS no, {_becomes('core')} AS becomes FROM (SELECT src_file, line_no, {tle.core(d, 'raw')} AS core FROM ({lines}) l) c"
    halves = f"SELECT src_file, idx, src1 AS at, line1 AS line FROM ({records}) a UNION ALL SELECT src_file, idx, src2 AS at, line2 AS line FROM ({records}) b"
    joined = f"SELECT h.src_file AS src_file, h.idx AS idx, s.becomes AS becomes FROM ({halves}) h LEFT JOIN ({source}) s ON h.src_file = s.f AND h.at = s.no WHERE s.becomes IS NULL OR s.becomes <> h.line"
    return f"SELECT CASE WHEN count(becomes) > 0 THEN 'VRFY-INTERIOR-MUT' ELSE 'VRFY-ORIGIN-MISSING' END AS rule, src_file, idx FROM ({joined}) j GROUP BY src_file, idx"


def source_pairs(d: Dialect, lines: str) -> str:
    """(src_file, k, p1, p2, valid, catalog, epoch): each kept line that begins like a line 1, with the kept line behind
    it. valid: whether the pair, normalised but without a checksum made for it, is a record that cleaning accepts; an
    invalid pair is never a record's origin, though it may share its satellite and epoch."""
    both = f"SELECT src_file, line_no AS k, {tle.core(d, 'raw')} AS core1, {tle.core(d, 'next_raw')} AS core2 FROM ({lines_to_records.neighbours(d, lines)}) n WHERE next_raw IS NOT NULL AND kind = '1'"
    valid = f"coalesce({tle.line_ok(d, 'core1', 1)} AND {tle.line_ok(d, 'core2', 2)} AND substr(core1, 3, 5) = substr(core2, 3, 5), false)"
    return f"SELECT src_file, k, {_becomes('core1')} AS p1, {_becomes('core2')} AS p2, {valid} AS valid, {tle.decode_catalog(d, tle.catalog_field('core1'))} AS catalog, substr(core1, 19, 14) AS epoch FROM ({both}) b"


def turns(d: Dialect, lines: str) -> str:
    """The source pairs with `turn`, which of the equal pairs of its file each is."""
    return f"SELECT *, row_number() OVER (PARTITION BY src_file, p1, p2 ORDER BY k) AS turn FROM ({source_pairs(d, lines)}) s"


def matched(d: Dialect, records: str, pairs: str) -> str:
    """(src_file, idx, line1, line2, blk, k): records of files that have a source, with the place k of the pair that they
    claim, null if none."""
    own = f"SELECT src_file, idx, line1, line2, row_number() OVER (PARTITION BY src_file, line1, line2 ORDER BY idx) AS turn, CAST(floor(idx / {float(BLOCK)}) AS BIGINT) AS blk FROM ({records}) r"
    sourced = f"SELECT src_file AS known FROM ({pairs}) l GROUP BY src_file"
    return f"SELECT o.src_file AS src_file, o.idx AS idx, o.line1 AS line1, o.line2 AS line2, o.blk AS blk, p.k AS k FROM ({own}) o JOIN ({sourced}) f ON o.src_file = f.known LEFT JOIN ({pairs}) p ON o.src_file = p.src_file AND o.line1 = p.p1 AND o.line2 = p.p2 AND o.turn = p.turn"


def judged(d: Dialect, matches: str, pairs: str) -> str:
    """(rule, src_file, idx) of the matched records that have no origin, or a changed one."""
    inside = f"SELECT *, max(k) OVER (PARTITION BY src_file, blk ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS near FROM ({matches}) m"
    ahead = f"SELECT src_file AS a_file, blk AS a_blk, max(most) OVER (PARTITION BY src_file ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM (SELECT src_file, blk, max(k) AS most FROM ({matches}) b GROUP BY src_file, blk) e"
    past = "greatest(coalesce(near, 0), coalesce(far, 0))"
    late = f"SELECT src_file, idx, line1, line2, {past} AS past FROM ({inside}) i JOIN ({ahead}) a ON i.src_file = a.a_file AND i.blk = a.a_blk WHERE k IS NULL OR k < {past}"
    # Where a changed record's place in the turn is taken by the next copy of its pair, that copy still has an origin: the
    # last copy of its pair stands behind what the records before it claim.
    last = f"SELECT src_file AS l_file, p1 AS l1, p2 AS l2, max(k) AS last_k FROM ({pairs}) q GROUP BY src_file, p1, p2"
    lost = (
        f"SELECT src_file, idx, {tle.decode_catalog(d, tle.catalog_field('line1'))} AS catalog, substr(line1, 19, 14) AS epoch, past "
        f"FROM ({late}) t LEFT JOIN ({last}) l ON t.src_file = l.l_file AND t.line1 = l.l1 AND t.line2 = l.l2 WHERE last_k IS NULL OR last_k <= past"
    )
    free = f"SELECT p.src_file AS src_file, p.k AS k, p.catalog AS catalog, p.epoch AS epoch FROM ({pairs}) p LEFT JOIN (SELECT src_file AS m_file, k AS m_k FROM ({matches}) c WHERE k IS NOT NULL) m ON p.src_file = m.m_file AND p.k = m.m_k WHERE m.m_k IS NULL AND p.valid"
    return (
        f"SELECT CASE WHEN max(f.k) IS NOT NULL THEN 'VRFY-INTERIOR-MUT' ELSE 'VRFY-ORIGIN-MISSING' END AS rule, l.src_file AS src_file, l.idx AS idx FROM ({lost}) l "
        f"LEFT JOIN ({free}) f ON l.src_file = f.src_file AND l.catalog = f.catalog AND l.epoch = f.epoch AND f.k > l.past GROUP BY l.src_file, l.idx"
    )


def by_order(d: Dialect, records: str, lines: str) -> str:
    """(rule, src_file, idx) for records (src_file, idx, line1, line2) against lines (src_file, line_no, raw): INTERIOR-MUT
    where an unclaimed valid pair of the record's satellite and epoch stands behind what the records before it claim,
    ORIGIN-MISSING where none does. Files that only one side has give nothing: see `missing_sources`. The steps are read
    more than once, so whoever runs them writes them: `turns`, `matched`, `judged`."""
    pairs = turns(d, lines)
    return judged(d, matched(d, records, pairs), pairs)


def missing_sources(records: str, lines: str) -> str:
    """(src_file): files of records without a source."""
    return f"SELECT r.src_file AS src_file FROM (SELECT src_file FROM ({records}) a GROUP BY src_file) r LEFT JOIN (SELECT src_file AS known FROM ({lines}) b GROUP BY src_file) l ON r.src_file = l.known WHERE l.known IS NULL"
