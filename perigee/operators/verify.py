"""Checks of a table of cleaned records: re-validation, contradictions at one epoch, histogram, robust outliers, samples.

Input is the fact table (catalog, epoch_key, epoch_us, elset, line1, line2, src_file, idx), or any table with the named
columns. Everything is a SELECT: windows partition by (catalog, epoch_key), so a satellite with many records is spread.
"""

from __future__ import annotations

from perigee.functions import tle
from perigee.functions.tle import Dialect

# Verification rules and their severities.
HARD = ("VRFY-REVALIDATE-FAIL", "VRFY-EPOCH-CONFLICT", "VRFY-INTERIOR-MUT", "VRFY-ORBIT-ERROR")
SOFT = ("VRFY-ORIGIN-MISSING", "VRFY-ORBIT-OUTLIER")


def severity(rule: str) -> str:
    return f"CASE WHEN {rule} IN ({', '.join(repr(r) for r in HARD)}) THEN 'hard' WHEN {rule} IN ({', '.join(repr(r) for r in SOFT)}) THEN 'soft' END"


def revalidated(d: Dialect, records: str) -> str:
    """The records with `valid`: both lines fine and of one catalog number."""
    return f"SELECT *, {tle.line_ok(d, 'line1', 1)} AND {tle.line_ok(d, 'line2', 2)} AND substr(line1, 3, 5) = substr(line2, 3, 5) AS valid FROM ({records}) v"


def _seen(records: str, more: str = "") -> str:
    """The records with their orbit as text and what stands before them in their (catalog, epoch_key), in the order
    (src_file, idx). `more`: further columns that split groups. One shuffle: all windows are within (catalog, epoch_key)."""
    state = tle.state_text("line1", "line2")
    base = f"SELECT *, {state} AS state FROM ({records}) s"
    group, order = f"catalog, epoch_key{more}", "ORDER BY src_file, idx"
    inner = f"SELECT *, row_number() OVER (PARTITION BY {group} {order}) AS nth, count(*) OVER (PARTITION BY {group}) AS in_group FROM ({base}) b"
    return (
        f"SELECT *, first_value(state) OVER (PARTITION BY {group}, elset {order}) AS first_state, row_number() OVER (PARTITION BY {group}, state {order}) AS nth_state FROM ({inner}) w"
    )


def conflicts(records: str) -> str:
    """The records with `clash` and `reissue`, within one (catalog, epoch_key), in the order (src_file, idx).

    clash: the orbit differs from the first one seen in this element set (none is a set of its own); reissue: no clash,
    not the group's first, and an orbit that has not been seen in the group.
    """
    return f"SELECT catalog, epoch_key, elset, src_file, idx, in_group, state <> first_state AS clash, state = first_state AND nth > 1 AND nth_state = 1 AS reissue FROM ({_seen(records)}) w"


def suspects(d: Dialect, records: str) -> str:
    """(rule, severity, catalog, epoch_key, src_file, idx, detail): records that fail again, and clashes among the
    others. Each record is validated once; those that fail stand in groups of their own. detail: what clashes; what
    fails is told by `functions.diagnostics` for the few that do."""
    rule = "CASE WHEN NOT valid THEN 'VRFY-REVALIDATE-FAIL' WHEN state <> first_state THEN 'VRFY-EPOCH-CONFLICT' END"
    detail = "CASE WHEN valid THEN concat('catalog ', CAST(catalog AS VARCHAR(20)), ' shares epoch ', CAST(epoch_key AS VARCHAR(40)), ' and element-set ', coalesce(CAST(elset AS VARCHAR(20)), 'None'), ' with a different orbital state') END"
    found = f"SELECT {rule} AS rule, catalog, epoch_key, src_file, idx, {detail} AS detail FROM ({_seen(revalidated(d, records), ', valid')}) r"
    return f"SELECT rule, {severity('rule')} AS severity, catalog, epoch_key, src_file, idx, detail FROM ({found}) u WHERE rule IS NOT NULL"


def duplicate_epoch_catalogs(records: str) -> str:
    """Catalog numbers with two or more records at one epoch."""
    return f"SELECT DISTINCT catalog FROM (SELECT catalog, epoch_key FROM ({records}) r GROUP BY catalog, epoch_key HAVING count(*) > 1) g"


def histogram(d: Dialect, records: str) -> str:
    """(month, n): records by the month of their instants."""
    return f"SELECT {tle.month_of('epoch_us', d)} AS month, count(*) AS n FROM ({records}) r WHERE epoch_us IS NOT NULL GROUP BY {tle.month_of('epoch_us', d)}"


def suspect_summary(suspects_sql: str, by_file: bool = False) -> str:
    """(rule, severity, n), or by file as well."""
    keys = "src_file, rule, severity" if by_file else "rule, severity"
    return f"SELECT {keys}, count(*) AS n FROM ({suspects_sql}) s GROUP BY {keys}"


def gap_limit(mean_motion: str) -> str:
    """Days across which two records still compare: seven for slow orbits, else three."""
    return f"CASE WHEN {mean_motion} < 1.5 THEN CAST(7 AS DOUBLE) ELSE CAST(3 AS DOUBLE) END"


def global_threshold(d: Dialect, residuals: str, floor: float = 100.0, factor: float = 10.0) -> str:
    """(track, n, threshold): a track's median residual plus `factor` median absolute deviations, at least `floor`;
    the floor alone for fewer than ten residuals. residuals: (track, i, r)."""
    mid = f"SELECT track, {d.median('r')} AS m, count(r) AS n FROM ({residuals}) r WHERE r IS NOT NULL GROUP BY track"
    dev = f"SELECT a.track AS track, {d.median('abs(a.r - b.m)')} AS mad FROM ({residuals}) a JOIN ({mid}) b ON a.track = b.track WHERE a.r IS NOT NULL GROUP BY a.track"
    f0, k = f"CAST({floor} AS DOUBLE)", f"CAST({factor} AS DOUBLE)"
    return f"SELECT m.track AS track, m.n AS n, CASE WHEN m.n < 10 THEN {f0} ELSE {d.rounded(f"greatest({f0}, m.m + {k} * v.mad)", 1)} END AS threshold FROM ({mid}) m JOIN ({dev}) v ON m.track = v.track"


def local_thresholds(d: Dialect, residuals: str, factor: float = 20.0) -> str:
    """(track, i, r, local): `factor` medians of the five residuals on both sides, within runs without holes; 0 where
    fewer than ten stand there."""
    runs = f"SELECT *, sum(CASE WHEN r IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY i) AS run FROM ({residuals}) r"
    w = "OVER (PARTITION BY track, run ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"
    median = f"percentile(r, 0.5) {w}" if d.spark else f"median(r) {w}"
    return f"SELECT track, i, r, CASE WHEN count(*) {w} < 10 THEN CAST(0 AS DOUBLE) ELSE {d.rounded(f"CAST({factor} AS DOUBLE) * {median}", 1)} END AS local FROM ({runs}) s WHERE r IS NOT NULL"


def hot(d: Dialect, residuals: str, floor: float = 100.0, factor: float = 10.0, local_factor: float = 20.0) -> str:
    """(track, i, r): residuals above both thresholds by more than a tenth."""
    return (
        f"SELECT l.track AS track, l.i AS i, l.r AS r FROM ({local_thresholds(d, residuals, local_factor)}) l JOIN ({global_threshold(d, residuals, floor, factor)}) g ON l.track = g.track "
        "WHERE l.r > greatest(g.threshold, l.local) + CAST(0.1 AS DOUBLE)"
    )


def even_sample(population: str, take: int, order: str = "catalog") -> str:
    """`take` evenly spaced members of a population (a column named `order`), by rank, or all if there are no more."""
    ranked = f"SELECT {order}, row_number() OVER (ORDER BY {order}) - 1 AS j, count(*) OVER () AS m FROM ({population}) p"
    return f"SELECT {order} FROM ({ranked}) r WHERE m <= {take} OR CAST(floor((j * {take} + m - 1) / CAST(m AS DOUBLE)) AS BIGINT) * m < (j + 1) * {take}"


def stratified_sample(population: str, first: str, take: int) -> str:
    """A sample that takes the catalogs of `first` before others: evenly among them if they alone are too many, else
    all of them and evenly of the rest."""
    marked = f"SELECT p.catalog AS catalog, CASE WHEN f.catalog IS NULL THEN 1 ELSE 0 END AS rest FROM ({population}) p LEFT JOIN (SELECT DISTINCT catalog FROM ({first}) f0) f ON p.catalog = f.catalog"
    ranked = f"SELECT catalog, rest, row_number() OVER (PARTITION BY rest ORDER BY catalog) - 1 AS j, count(*) OVER (PARTITION BY rest) AS m, sum(1 - rest) OVER () AS firsts FROM ({marked}) k"
    share = f"SELECT catalog, j, m, CASE WHEN rest = 0 THEN least({take}, firsts) ELSE greatest({take} - firsts, 0) END AS own FROM ({ranked}) r"
    return f"SELECT catalog FROM ({share}) s WHERE m <= own OR CAST(floor((j * own + m - 1) / CAST(m AS DOUBLE)) AS BIGINT) * m < (j + 1) * own"
