"""What exactly is wrong with a line: columns, observed and expected values, messages. For the few lines that fail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from perigee.functions import tle

ERROR = "struct<kind:string,msg:string,lo:int,hi:int,observed:string,expected:string>"
#: Characters that are not shown as themselves between single quotes.
_SHOWN = {chr(c): repr(chr(c)) for c in [*range(32), 39, 92, 127]}


def shown(char: Column) -> Column:
    """A character as it is quoted in messages."""
    special = F.create_map(*[F.lit(x) for kv in _SHOWN.items() for x in kv])
    return F.coalesce(F.element_at(special, char), F.concat(F.lit("'"), char, F.lit("'")))


def _error(kind: str, msg: Column, lo: int | None = None, hi: int | None = None, observed: Column | None = None, expected: str | None = None) -> Column:
    none = F.lit(None)
    fields = (F.lit(kind), msg, F.lit(lo), F.lit(hi), none if observed is None else observed, F.lit(expected))
    return F.struct(*fields).cast(ERROR)


def layout_errors(line: Column, which: int) -> Column:
    """The errors of the first 68 columns: single characters in their order, then fields."""
    chars, fields = (tle.LINE1_CHARS, tle.LINE1_FIELDS) if which == 1 else (tle.LINE2_CHARS, tle.LINE2_FIELDS)
    found = []
    for c, allowed, name in chars:
        own = F.substring(line, c, 1)
        bad = ~own.isin(*allowed)
        found.append(F.when(bad, _error("column", F.concat(F.lit(f"column {c} ({name}): got "), shown(own), F.lit(f", expected one of {allowed!r}")), c, c, own, allowed)))
    for a, b, kind, name in fields:
        own = F.substring(line, a, b - a + 1)
        span = {"A": "[A-Z0-9 ]", "D": "[0-9]", "B": "[0-9 ]"}[kind]
        bad = ~own.rlike(f"^{span}*\\z")
        found.append(F.when(bad, _error("column", F.lit(f"columns {a}-{b} ({name}): contains a character outside {tle.CLASSES[kind]!r}"), a, b, own)))
    return F.array_compact(F.array(*found))


def range_errors(line: Column, which: int) -> Column:
    """The errors of a line of good layout whose numbers lie outside their ranges; what follows a field that can't be
    read is not looked at."""
    found, fine = [], F.lit(True)
    for a, b, what, valid, written in tle.RANGES1 if which == 1 else tle.RANGES2:
        x = F.substring(line, a, b - a + 1).try_cast("double")
        good = {"x > 0 AND x < 367": (x > 0) & (x < 367), "x >= 0 AND x <= 180": (x >= 0) & (x <= 180), "x >= 0 AND x < 360": (x >= 0) & (x < 360), "x > 0": x > 0}[valid]
        said = f" outside {written}" if what != "mean motion" else " is not strictly positive"
        text = x.cast("string")
        found.append(F.when(fine & x.isNotNull() & ~good, _error("semantic", F.concat(F.lit(f"{what} "), text, F.lit(said)), a, b, text, written)))
        found.append(F.when(fine & x.isNull(), _error("semantic", F.lit("a numeric field could not be parsed for semantic checks"))))
        fine = fine & x.isNotNull()
    return F.array_compact(F.array(*found))


def body_errors(line: Column, which: int) -> Column:
    """The errors of the layout, or, where it is fine, those of the ranges. A long expression: whoever names its result
    more than once writes it first."""
    fine = F.substring(line, 1, 68).rlike(tle.LAYOUT[which])
    return F.concat(layout_errors(line, which), F.when(fine, range_errors(line, which)).otherwise(F.array().cast(f"array<{ERROR}>")))


def line_message(line: Column, which: int) -> Column:
    """What is wrong first with a line of a record, null if nothing."""
    size, own = F.length(line), F.substring(line, 69, 1)
    return F.when(size != 69, F.concat(F.lit("line length "), size.cast("string"), F.lit(", expected 69"))).otherwise(F.coalesce(F.get(body_errors(line, which), F.lit(0))["msg"], F.when(~own.rlike(r"^[0-9]\z"), F.concat(F.lit("checksum column 69 is "), shown(own), F.lit(", not a digit")))))


def record_message(line1: str, line2: str) -> Column:
    """What is wrong first with a record (columns line1, line2), null if nothing."""
    found = []
    for n, name in ((1, line1), (2, line2)):
        own, total = F.substring(name, 69, 1), F.expr(f"CAST({tle.checksum(name)} AS STRING)")
        sum_ = F.when(own != total, F.concat(F.lit("checksum mismatch: column 69 is "), shown(own), F.lit(", computed "), total))
        found.append(F.concat(F.lit(f"line {n}: "), F.coalesce(line_message(F.col(name), n), sum_)))
    cat = F.when(F.substring(line1, 3, 5) != F.substring(line2, 3, 5), F.concat(F.lit("catalog number mismatch: line 1 '"), F.substring(line1, 3, 5), F.lit("' vs line 2 '"), F.substring(line2, 3, 5), F.lit("'")))
    return F.coalesce(*found, cat)


def bounded(value: Column) -> Column:
    """At most 16 characters."""
    return F.when(F.length(value) > 16, F.concat(F.substring(value, 1, 13), F.lit("..."))).otherwise(value)


def noted(text: Column) -> Column:
    """Printable and at most 80 characters; null if empty."""
    clean = F.regexp_replace(text, r"[^\x20-\x7E]", "?")
    short = F.when(F.length(clean) > 80, F.concat(F.substring(clean, 1, 77), F.lit("..."))).otherwise(clean)
    return F.when(short != "", short)


def diagnosis(rule: Column, core: str, errors: str, tier: Column, line_no: Column) -> Column:
    """The diagnostic of one line of a record that breaks `rule`, its fields in the order of their names. core, errors:
    columns with the normalised line and what `body_errors` says of it."""
    first, joined = F.get(errors, F.lit(0)), F.array_join(F.transform(errors, lambda e: e["msg"]), "; ")
    total = F.expr(f"CAST({tle.checksum(core)} AS STRING)")
    core = F.col(core)
    size = F.length(core)
    layout, check = rule == "TLE-COL-004", rule == "TLE-CHK-001"
    columns = F.when(layout & first["lo"].isNotNull(), F.array(first["lo"], first["hi"])).when(check, F.array(F.lit(69), F.lit(69)))
    absent = (rule == "TLE-COL-001") & (size == 68)
    observed = F.when(layout, first["observed"]).when(check, F.substring(core, 69, 1)).when(rule == "TLE-COL-001", size.cast("string"))
    expected = F.when(layout, first["expected"]).when(check, total).when(absent, "69").when(rule == "TLE-COL-001", "68 or 69")
    note = F.when(layout | (rule == "TLE-COL-002"), joined).when(rule == "TLE-COL-003", "line contains a non-ASCII byte").when(absent, "checksum absent; use --reconstruct-checksum to recompute")
    return F.struct(
        columns.alias("column_range"), bounded(expected).alias("expected"), noted(note).alias("note"), bounded(observed).alias("observed"), rule.alias("rule_id"),
        F.array(line_no).alias("source_lines"), tier.alias("tier_attempted"),
    )
