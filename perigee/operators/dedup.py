"""Latest record per satellite and epoch, per-satellite manifest, one satellite's history, comparison of runs, gates."""

from __future__ import annotations

from fractions import Fraction

from perigee.functions import tle
from perigee.functions.tle import Dialect
from perigee.operators import verify


def excluding(records: str, suspects: str) -> str:
    """The records without those at the places of hard suspects."""
    return f"SELECT r.* FROM ({records}) r WHERE NOT EXISTS (SELECT 1 FROM ({suspects}) h WHERE h.severity = 'hard' AND h.src_file = r.src_file AND h.idx = r.idx)"


def ranked(records: str) -> str:
    """The records with place 1 for the one that is kept: the latest element set, then the last (src_file, idx)."""
    return f"SELECT *, row_number() OVER (PARTITION BY catalog, epoch_key ORDER BY coalesce(elset, -1) DESC, src_file DESC, idx DESC) AS place, count(*) OVER (PARTITION BY catalog, epoch_key) AS of FROM ({records}) r"


def unusable(d: Dialect, catalog: str = "catalog", epoch: str = "epoch_us") -> str:
    """Why a kept record can't be used, null if it can."""
    ascii_only = d.like("concat(line1, line2)", "^[\\x00-\\x7F]*\\z")
    return f"CASE WHEN {catalog} < 0 THEN 'unparseable catalog or epoch (a corrupt line)' WHEN {epoch} IS NULL THEN 'unparseable epoch' WHEN NOT {ascii_only} THEN 'non-ASCII bytes in a cleaned line' END"


def import_set(d: Dialect, records: str) -> str:
    """(catalog, epoch_key, epoch_us, elset, line1, line2, src_file, idx): one usable record for each (catalog, epoch_key)."""
    return f"SELECT catalog, epoch_key, epoch_us, elset, line1, line2, src_file, idx FROM ({ranked(records)}) k WHERE place = 1 AND {unusable(d)} IS NULL"


def unusable_groups(d: Dialect, records: str) -> str:
    """(reason, n): groups whose kept record can't be used."""
    return f"SELECT reason, count(*) AS n FROM (SELECT {unusable(d)} AS reason FROM ({ranked(records)}) k WHERE place = 1) u WHERE reason IS NOT NULL GROUP BY reason"


def groups(d: Dialect, records: str) -> str:
    """A row for each (catalog, epoch_key): of (its records), fine (1 if the kept one can be used), conflict, kept and
    dropped in text form file:idx:elset. One shuffle: windows and aggregate are all within (catalog, epoch_key)."""
    card = "concat(src_file, ':', CAST(idx AS VARCHAR(20)), ':', coalesce(CAST(elset AS VARCHAR(20)), ''))"
    order = "concat(src_file, lpad(CAST(idx AS VARCHAR(20)), 20, '0'))"
    seen = verify._seen(ranked(records))
    return (
        f"SELECT catalog, epoch_key, max(of) AS of, max(CASE WHEN place = 1 AND {unusable(d)} IS NULL THEN 1 ELSE 0 END) AS fine, max(CASE WHEN state <> first_state THEN 1 ELSE 0 END) AS conflict, "
        f"max(CASE WHEN place = 1 THEN {card} END) AS kept, {d.list(card, order, 'place > 1')} AS dropped FROM ({seen}) s GROUP BY catalog, epoch_key"
    )


def notes(d: Dialect, records: str) -> str:
    """(catalog, epoch_key, conflict, kept, dropped): for each group that lost records, in text form file:idx:elset."""
    return f"SELECT catalog, epoch_key, conflict, kept, dropped FROM ({groups(d, records)}) g WHERE of > 1 AND fine = 1"


def unusable_notes(d: Dialect, records: str) -> str:
    """(catalog, epoch_key, src_file, idx, reason): kept records that can't be used."""
    return f"SELECT catalog, epoch_key, src_file, idx, reason FROM (SELECT *, {unusable(d)} AS reason FROM ({ranked(records)}) k WHERE place = 1) u WHERE reason IS NOT NULL"


def summary(d: Dialect, records: str, used: str) -> str:
    """One row of counts: records read, excluded, written, dropped, groups collapsed, conflicts, unusable groups, silent
    satellites (fewer than three records, which have no gap statistics). `used`: the records without hard suspects. One
    pass over `used`, and a count of `records`."""
    by_catalog = (
        f"SELECT catalog, sum(of) AS left_, sum(fine) AS written, sum(fine * (of - 1)) AS dropped, sum(CASE WHEN of > 1 THEN fine ELSE 0 END) AS collapsed, "
        f"sum(CASE WHEN of > 1 AND conflict = 1 THEN fine ELSE 0 END) AS conflicts, sum(1 - fine) AS unusable FROM ({groups(d, used)}) g GROUP BY catalog"
    )
    total = lambda x, name: f"CAST(coalesce(sum({x}), 0) AS BIGINT) AS {name}"
    sums = ", ".join([total("left_", "left_"), total("written", "records_written"), total("dropped", "records_dropped"), total("collapsed", "groups_collapsed"), total("conflicts", "conflicts_flagged"), total("unusable", "unusable_records"), total("CASE WHEN written BETWEEN 1 AND 2 THEN 1 ELSE 0 END", "gap_silent_satellites")])
    return (
        f"SELECT a.records_read AS records_read, a.records_read - t.left_ AS excluded_hard_suspects, t.records_written AS records_written, t.records_dropped AS records_dropped, t.groups_collapsed AS groups_collapsed, "
        f"t.conflicts_flagged AS conflicts_flagged, t.unusable_records AS unusable_records, t.gap_silent_satellites AS gap_silent_satellites FROM (SELECT {sums} FROM ({by_catalog}) c) t CROSS JOIN (SELECT count(*) AS records_read FROM ({records}) r) a"  # one row each
    )


def deltas(series: str, key: str, us: str) -> str:
    """(key, us, before, days): each row of a series with the days since the one before."""
    w = f"OVER (PARTITION BY {key} ORDER BY {us})"
    return f"SELECT {key} AS key, {us} AS us, lag({us}) {w} AS before, ({us} - lag({us}) {w}) / CAST(86400000000 AS DOUBLE) AS days FROM ({series}) s"


def gaps(d: Dialect, series: str, key: str = "catalog", us: str = "epoch_us", factor: float = 10.0, most: int = 10) -> str:
    """(key, start_us, end_us, days): gaps longer than `factor` lower medians of a series of three or more, its `most`
    longest (the report's length), earlier ones first among equals."""
    step = deltas(series, key, us)
    bar = f"SELECT key, {d.lower_median('days')} AS bar, count(*) AS n FROM ({step}) t WHERE days IS NOT NULL GROUP BY key"
    found = f"SELECT t.key AS key, t.before AS start_us, t.us AS end_us, t.days AS days, row_number() OVER (PARTITION BY t.key ORDER BY t.days DESC, t.before) AS place FROM ({step}) t JOIN ({bar}) b ON t.key = b.key WHERE b.bar > 0 AND b.n >= 2 AND t.days > CAST({factor} AS DOUBLE) * b.bar"
    return f"SELECT key, start_us, end_us, days FROM ({found}) f WHERE place <= {most}"


def history(d: Dialect, series: str, key: str = "catalog", us: str = "epoch_us", factor: float = 10.0) -> str:
    """(key, records, first_epoch, last_epoch, span_days, median_spacing_days, largest_gap_days, gap_count): the manifest.
    One window and one aggregate by the same key; a series' spacings are gathered to be held against their own median."""
    step = deltas(series, key, us)
    gathered, above = d.above("days", f"CAST({factor} AS DOUBLE) * bar")
    own = f"SELECT key, count(*) AS records, min(us) AS first_us, max(us) AS last_us, {d.median('days')} AS mid, {d.lower_median('days')} AS bar, max(days) AS longest, {gathered} AS gathered FROM ({step}) t GROUP BY key"
    return (
        f"SELECT key, records, {tle.iso_of('first_us', d)} AS first_epoch, {tle.iso_of('last_us', d)} AS last_epoch, {d.rounded('((last_us - first_us) / CAST(86400000000 AS DOUBLE))', 6)} AS span_days, "
        f"CASE WHEN records >= 3 THEN {d.rounded('mid', 6)} END AS median_spacing_days, coalesce({d.rounded('longest', 6)}, CAST(0 AS DOUBLE)) AS largest_gap_days, "
        f"CAST(CASE WHEN records >= 3 AND bar > 0 THEN {above} ELSE 0 END AS BIGINT) AS gap_count FROM ({own}) o"
    )


def extract(imported: str, ids: list[int]) -> str:
    """The records of some satellites, oldest first; the filter reaches the scan of a table sorted by catalog."""
    return f"SELECT catalog, epoch_key, line1, line2 FROM ({imported}) i WHERE catalog IN ({', '.join(str(int(i)) for i in ids) or 'NULL'})"


def run_diff(counts_a: str, counts_b: str, keys: tuple[str, ...], presence_by: str | None = None) -> str:
    """(keys, a, b, delta, presence) of two runs' counts (keys, n): both, a-only or b-only. presence_by: the key by which
    a side counts as present, any row of it sufficing (a file, whatever its rules); each key by itself else."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    names = ", ".join(f"coalesce(a.{k}, b.{k}) AS {k}" for k in keys)
    n = "CAST(coalesce(a.n, 0) AS BIGINT)", "CAST(coalesce(b.n, 0) AS BIGINT)"
    here = "a.n IS NOT NULL AS in_a, b.n IS NOT NULL AS in_b"
    rows = f"SELECT {names}, {n[0]} AS a, {n[1]} AS b, {n[1]} - {n[0]} AS delta, {here} FROM ({counts_a}) a FULL OUTER JOIN ({counts_b}) b ON {on}"
    if presence_by:
        any_ = lambda c: f"max(CASE WHEN {c} THEN 1 ELSE 0 END) OVER (PARTITION BY {presence_by}) = 1"
        rows = f"SELECT {', '.join(keys)}, a, b, delta, {any_('in_a')} AS in_a, {any_('in_b')} AS in_b FROM ({rows}) p"
    return f"SELECT {', '.join(keys)}, a, b, delta, CASE WHEN NOT in_a THEN 'b-only' WHEN NOT in_b THEN 'a-only' ELSE 'both' END AS presence FROM ({rows}) d"


def parse_threshold(text: str) -> int | Fraction:
    """"100" is a count, "1.5%" a share from 0 to 100 percent, exactly."""
    text = text.strip()
    if text.endswith("%"):
        share = Fraction(text[:-1].strip())
        if not 0 <= share <= 100:
            raise ValueError(f"percentage outside 0-100: {text}")
        return share
    if not text.isascii() or not text.isdigit():
        raise ValueError(f"neither a count nor a percentage: {text}")
    return int(text)


def exceeded(clean: int, quarantined: int, threshold: int | Fraction) -> bool:
    """Whether a run quarantined more than it may."""
    if isinstance(threshold, Fraction):
        return 100 * quarantined > threshold * (clean + quarantined)
    return quarantined > threshold


def gate(stats: str, percent: Fraction) -> str:
    """(clean, quarantined, over): the gate as SQL, by whole numbers only."""
    return f"SELECT clean, quarantined, 100 * quarantined * {percent.denominator} > {percent.numerator} * (clean + quarantined) AS over FROM (SELECT CAST(sum(clean) AS BIGINT) AS clean, CAST(sum(quarantined) AS BIGINT) AS quarantined FROM ({stats}) f) t"


def numbered(records: str) -> str:
    """(catalog, epoch_key, line1, line2, n): the import set's rows with their number from 1 in the order (catalog,
    epoch_key). Rows are numbered inside their catalog; only one total a catalog is summed up in one place."""
    totals = f"SELECT catalog, sum(m) OVER (ORDER BY catalog) - m AS before FROM (SELECT catalog, count(*) AS m FROM ({records}) r GROUP BY catalog) t"
    own = f"SELECT catalog, epoch_key, line1, line2, row_number() OVER (PARTITION BY catalog ORDER BY epoch_key) AS nth FROM ({records}) r"
    return f"SELECT o.catalog AS catalog, o.epoch_key AS epoch_key, o.line1 AS line1, o.line2 AS line2, CAST(o.nth + t.before AS BIGINT) AS n FROM ({own}) o JOIN ({totals}) t ON o.catalog = t.catalog"


def chunked(records: str, size: int) -> str:
    """(chunk, records, bytes, first_catalog, last_catalog): export files of `size` rows; size 0: one file."""
    chunk = "CAST(1 AS BIGINT)" if size == 0 else f"CAST(floor((n - 1) / {float(size)}) AS BIGINT) + 1"
    rows = f"SELECT {chunk} AS chunk, catalog FROM ({numbered(records)}) q"
    return f"SELECT chunk, count(*) AS records, count(*) * 140 AS bytes, min(catalog) AS first_catalog, max(catalog) AS last_catalog FROM ({rows}) c GROUP BY chunk"
