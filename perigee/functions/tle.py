"""Scalar functions on two-line element sets, as SQL text.

Every function returns an expression over expressions: Catalyst compiles it like any built-in, and the same text (but
for the few spellings that `Dialect` holds) runs in another SQL engine, which is how results are checked.
"""

from __future__ import annotations

from dataclasses import dataclass

# The record layout. (column from 1, allowed characters, name) and (first, last column, class, name).
LINE1_CHARS = [
    (1, "1", "line number"), (2, " ", "column 2 separator"), (8, "UCS", "classification"), (9, " ", "column 9 separator"), (18, " ", "column 18 separator"),
    (24, ".", "epoch decimal point"), (33, " ", "column 33 separator"), (34, " +-", "first-derivative sign"), (35, ".", "first-derivative decimal point"),
    (44, " ", "column 44 separator"), (45, " +-", "second-derivative mantissa sign"), (51, "+-", "second-derivative exponent sign"), (53, " ", "column 53 separator"),
    (54, " +-", "B* mantissa sign"), (60, "+-", "B* exponent sign"), (62, " ", "column 62 separator"), (64, " ", "column 64 separator"),
]
LINE1_FIELDS = [
    (3, 7, "A", "satellite catalog number"), (10, 17, "A", "international designator"), (19, 20, "D", "epoch year"), (21, 23, "B", "epoch day-of-year"), (25, 32, "D", "epoch fraction"),
    (36, 43, "D", "first-derivative digits"), (46, 50, "D", "second-derivative mantissa"), (52, 52, "D", "second-derivative exponent"), (55, 59, "D", "B* mantissa"), (61, 61, "D", "B* exponent"),
    (63, 63, "D", "ephemeris type"), (65, 68, "B", "element set number"),
]
LINE2_CHARS = [
    (1, "2", "line number"), (2, " ", "column 2 separator"), (8, " ", "column 8 separator"), (12, ".", "inclination decimal point"), (17, " ", "column 17 separator"), (21, ".", "RAAN decimal point"),
    (26, " ", "column 26 separator"), (34, " ", "column 34 separator"), (38, ".", "argument-of-perigee decimal point"), (43, " ", "column 43 separator"), (47, ".", "mean-anomaly decimal point"),
    (52, " ", "column 52 separator"), (55, ".", "mean-motion decimal point"),
]
LINE2_FIELDS = [
    (3, 7, "A", "satellite catalog number"), (9, 11, "B", "inclination integer part"), (13, 16, "D", "inclination fraction"), (18, 20, "B", "RAAN integer part"), (22, 25, "D", "RAAN fraction"),
    (27, 33, "D", "eccentricity"), (35, 37, "B", "argument-of-perigee integer part"), (39, 42, "D", "argument-of-perigee fraction"), (44, 46, "B", "mean-anomaly integer part"),
    (48, 51, "D", "mean-anomaly fraction"), (53, 54, "B", "mean-motion integer part"), (56, 63, "D", "mean-motion fraction"), (64, 68, "B", "revolution number"),
]
CLASSES = {"A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 ", "D": "0123456789", "B": "0123456789 "}
#: (first, last column, name, what is valid, how the range is written), line 2; line 1 has the day of year alone.
RANGES1 = [(21, 32, "epoch day-of-year", "x > 0 AND x < 367", "(0, 367)")]
RANGES2 = [
    (9, 16, "inclination", "x >= 0 AND x <= 180", "[0, 180]"), (18, 25, "RAAN", "x >= 0 AND x < 360", "[0, 360)"), (35, 42, "argument of perigee", "x >= 0 AND x < 360", "[0, 360)"),
    (44, 51, "mean anomaly", "x >= 0 AND x < 360", "[0, 360)"), (53, 63, "mean motion", "x > 0", "> 0"),
]
#: Letters of five-character catalog numbers; I and O are left out.
ALPHA5 = "ABCDEFGHJKLMNPQRSTUVWXYZ"


@dataclass(frozen=True)
class Dialect:
    """The spellings in which the engines differ."""

    name: str = "spark"

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def like(self, text: str, pattern: str) -> str:
        return f"({text} RLIKE R'{pattern}')" if self.spark else f"regexp_matches({text}, '{pattern}')"

    def replace(self, text: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({text}, R'{pattern}', '{by}')" if self.spark else f"regexp_replace({text}, '{pattern}', '{by}', 'g')"

    def extract(self, text: str, pattern: str) -> str:
        return f"regexp_extract({text}, R'{pattern}', 0)" if self.spark else f"regexp_extract({text}, '{pattern}', 0)"

    def micros(self, stamp: str) -> str:
        return f"unix_micros(CAST({stamp} AS TIMESTAMP))" if self.spark else f"epoch_us({stamp})"

    def median(self, x: str) -> str:
        """The mean of the two middle values."""
        return f"percentile({x}, 0.5)" if self.spark else f"median({x})"

    def lower_median(self, x: str) -> str:
        return f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {x})" if self.spark else f"quantile_disc({x}, 0.5)"

    def char(self, code: int) -> str:
        return f"char({code})" if self.spark else f"chr({code})"

    def list(self, x: str, order: str, where: str = "true") -> str:
        """The texts x of the rows where `where` holds, joined by commas in an order; null where there are none."""
        if self.spark:
            rows = f"collect_list(CASE WHEN {where} THEN struct({order} AS o, {x} AS x) END)"
            return f"nullif(array_join(transform(array_sort({rows}), s -> s.x), ','), '')"
        return f"string_agg({x}, ',' ORDER BY {order}) FILTER (WHERE {where})"

    def above(self, x: str, bar: str) -> tuple[str, str]:
        """An aggregate that gathers the numbers x of a group, and how many of what it gathered exceed a bar."""
        if self.spark:
            return f"collect_list({x})", f"size(filter(gathered, g -> g > {bar}))"
        return f"list({x}) FILTER (WHERE {x} IS NOT NULL)", f"coalesce(len(list_filter(gathered, lambda g: g > {bar})), 0)"

    def rounded(self, x: str, digits: int) -> str:
        """Half to even on the scaled double: what ties of binary fractions (675 s are 1/128 day) need."""
        scale = f"CAST({10**digits} AS DOUBLE)"
        return f"({'rint' if self.spark else 'round_even'}({x} * {scale}{'' if self.spark else ', 0'}) / {scale})"


SPARK, DUCK = Dialect("spark"), Dialect("duckdb")


def checksum(line: str) -> str:
    """Sum of the digits of the first 68 columns, a minus counting one, modulo ten: by what is left without each of them
    (a search for one byte is much cheaper than a translation of all)."""
    body = f"substr({line}, 1, 68)"
    left = lambda mark: f"bit_length(replace({body}, '{mark}', ''))"  # noqa: E731  in bits: no character is counted
    return f"CAST(((46 * bit_length({body}) - {left('-')} - {left('1')} - {' - '.join(f'{n} * {left(n)}' for n in range(2, 10))}) % 80) / 8 AS INT)"


def _pattern(chars: list, fields: list, numbers: tuple[tuple[int, int], ...] = ()) -> str:
    """numbers: spans whose blanks may only lead."""
    at: dict[int, str] = {c: f"[{allowed if '-' not in allowed else allowed.replace('-', '') + '-'}]" if len(allowed) > 1 or allowed == "." else allowed for c, allowed, _ in chars}
    span = {"A": "[A-Z0-9 ]", "D": "[0-9]", "B": "[0-9 ]"}
    at |= {c: span[kind] for a, b, kind, _ in fields for c in range(a, b + 1)}
    out, c = "", 1
    while c <= 68:
        if own := next((b for a, b in numbers if a == c), None):
            n = own - c + 1
            out += "(?:" + "|".join(" " * k + "[0-9]" * (n - k) for k in range(n + 1)) + ")"
            c += n
            continue
        n = 1
        while at.get(c + n) == at[c] and c + n <= 68:
            n += 1
        out += at[c] if n == 1 else f"{at[c]}{{{n}}}"
        c += n
    return f"^{out}\\z"


LAYOUT = {1: _pattern(LINE1_CHARS, LINE1_FIELDS), 2: _pattern(LINE2_CHARS, LINE2_FIELDS)}


#: Layouts of lines whose numbers can be read.
READABLE = {1: _pattern(LINE1_CHARS, LINE1_FIELDS, ((21, 23),)), 2: _pattern(LINE2_CHARS, LINE2_FIELDS, ((9, 11), (18, 20), (35, 37), (44, 46), (53, 54)))}


def layout_ok(d: Dialect, line: str, number: int) -> str:
    """Whether the first 68 columns have the layout of line 1 or 2."""
    return d.like(f"substr({line}, 1, 68)", LAYOUT[number])


def number(line: str, first: int, last: int) -> str:
    return f"try_cast(substr({line}, {first}, {last - first + 1}) AS DOUBLE)"


def semantic_ok(line: str, which: int) -> str:
    """Whether the numbers of a line of good layout lie in their ranges; false where one can't be read."""
    tests = []
    for a, b, _, valid, _ in RANGES1 if which == 1 else RANGES2:
        tests.append(f"coalesce({valid.replace('x', number(line, a, b))}, false)")
    return "(" + " AND ".join(tests) + ")"


def body_ok(d: Dialect, line: str, which: int) -> str:
    """Whether a line has the layout, and its numbers are in their ranges. The same as `layout_ok` and `semantic_ok`
    without a cast: numbers of one width with leading blanks are in the order of their texts."""
    text = lambda a, b: f"substr({line}, {a}, {b - a + 1})"
    tests = [f"{text(a, b)} {test}" for a, b, test in (((21, 32, "< '367'"),) if which == 1 else ((9, 16, "<= '180.0000'"), (18, 25, "< '360'"), (35, 42, "< '360'"), (44, 51, "< '360'")))]
    tests.append(d.like(text(21, 32) if which == 1 else text(53, 63), "[1-9]"))
    return f"(CASE WHEN {d.like(f'substr({line}, 1, 68)', READABLE[which])} THEN {' AND '.join(tests)} ELSE false END)"


def checksum_ok(d: Dialect, line: str) -> str:
    return f"(CASE WHEN {d.like(f'substr({line}, 69, 1)', '^[0-9]\\z')} THEN CAST(substr({line}, 69, 1) AS INT) = {checksum(line)} ELSE false END)"


def line_ok(d: Dialect, line: str, which: int) -> str:
    return f"(length({line}) = 69 AND {body_ok(d, line, which)} AND {checksum_ok(d, line)})"


def catalog_field(line: str) -> str:
    return f"substr({line}, 3, 5)"


def decode_catalog(d: Dialect, field: str) -> str:
    """The catalog number of a field: decimal, or a letter and four digits; null else."""
    text = f"trim({field})"
    return (
        f"(CASE WHEN {d.like(text, '^[0-9]+\\z')} THEN try_cast({text} AS BIGINT) "
        f"WHEN {d.like(text, f'^[{ALPHA5}][0-9]{{4}}\\z')} THEN (9 + {'instr' if d.spark else 'strpos'}('{ALPHA5}', substr({text}, 1, 1))) * 10000 + CAST(substr({text}, 2, 4) AS BIGINT) END)"
    )


def norad_id(d: Dialect, raw: str) -> str:
    """The catalog number of a raw line 1, null where the line does not start with it untrimmed, or is not ASCII."""
    fine = f"{d.like(raw, '^[\\x00-\\x7F]*\\z')} AND length({raw}) >= 7 AND substr({raw}, 1, 2) = '1 '"
    return f"(CASE WHEN {fine} THEN {decode_catalog(d, catalog_field(raw))} END)"


def element_set(d: Dialect, line1: str) -> str:
    text = f"substr({line1}, 65, 4)"
    return f"(CASE WHEN {d.like(text, '^ *[0-9]+\\z')} THEN try_cast(trim({text}) AS INT) END)"


def with_epoch(d: Dialect, sql: str, line1: str = "line1") -> str:
    """The rows of `sql` with epoch_year, epoch_day, epoch_key and epoch_us, null where the epoch can't be read.

    Two-digit years below 57 are of this century. A day of year before 1 or behind the year's end rolls over one year's
    end; its fraction is carried over as text, so equal instants get equal doubles. The key, year * 1000 + day, is in the
    order of the instants; epoch_us, microseconds since 1970, is rounded half to even.
    """
    leap = lambda y: f"({y} % 4 = 0 AND ({y} % 100 <> 0 OR {y} % 400 = 0))"
    read = f"SELECT *, try_cast(substr({line1}, 19, 2) AS INT) AS e_yy, try_cast(trim(substr({line1}, 21, 3)) AS INT) AS e_dd FROM ({sql}) e0"
    year = f"SELECT *, CASE WHEN e_yy < 57 THEN 2000 + e_yy ELSE 1900 + e_yy END AS e_y FROM ({read}) e1"
    size = f"SELECT *, CASE WHEN {leap('e_y')} THEN 366 ELSE 365 END AS e_len, CASE WHEN {leap('(e_y - 1)')} THEN 366 ELSE 365 END AS e_before FROM ({year}) e2"
    roll = (
        f"SELECT *, CASE WHEN e_dd < 1 THEN e_y - 1 WHEN e_dd > e_len THEN e_y + 1 ELSE e_y END AS epoch_year, "
        f"try_cast(concat(CAST(CASE WHEN e_dd < 1 THEN e_dd + e_before WHEN e_dd > e_len THEN e_dd - e_len ELSE e_dd END AS VARCHAR(12)), '.', substr({line1}, 25, 8)) AS DOUBLE) AS epoch_day FROM ({size}) e3"
    )
    key = f"SELECT *, epoch_year * CAST(1000 AS DOUBLE) + epoch_day AS epoch_key, epoch_day - CAST(1 AS DOUBLE) AS e_past, floor(epoch_day - CAST(1 AS DOUBLE)) AS e_days FROM ({roll}) e4"
    part = "(e_past - e_days) * CAST(86400000000 AS DOUBLE)"
    rounded = f"rint({part})" if d.spark else f"round_even({part}, 0)"
    micros = f"{d.micros('CAST(make_date(epoch_year, 1, 1) AS TIMESTAMP)')} + CAST(e_days AS BIGINT) * 86400000000 + CAST({rounded} AS BIGINT)"
    drop = "e_yy, e_dd, e_y, e_len, e_before, e_past, e_days"
    return f"SELECT * {'EXCEPT' if d.spark else 'EXCLUDE'} ({drop}), CASE WHEN epoch_day IS NOT NULL THEN {micros} END AS epoch_us FROM ({key}) e5"


def month_of(micros: str, d: Dialect) -> str:
    return f"date_format(timestamp_micros({micros}), 'yyyy-MM')" if d.spark else f"strftime(make_timestamp({micros}), '%Y-%m')"


def iso_of(micros: str, d: Dialect) -> str:
    """Seconds precision, truncated."""
    return f"date_format(timestamp_micros({micros}), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")" if d.spark else f"strftime(make_timestamp({micros}), '%Y-%m-%dT%H:%M:%SZ')"


def decimal_exponent(field: str) -> str:
    """SNNNNN+E with an implied leading point; powers of ten as literals, so that each is the nearest double."""
    mantissa, power = f"try_cast(replace(substr({field}, 1, 6), ' ', '') AS DOUBLE)", f"substr({field}, 7, 2)"
    cases = " ".join(f"WHEN {power} IN ({signs}) THEN CAST('1E{e - 5}' AS DOUBLE)" for e, signs in [*((e, f"'{e:+d}'") for e in range(-9, 10) if e), (0, "'+0', '-0'")])
    return f"({mantissa} * (CASE {cases} END) + CAST(0 AS DOUBLE))"


def orbital_state(line1: str, line2: str) -> list[str]:
    """The nine values that make an orbit: two records with the same state differ in nothing physical."""
    ndot = f"(try_cast(replace(substr({line1}, 34, 10), ' ', '') AS DOUBLE) + CAST(0 AS DOUBLE))"
    return [
        ndot, decimal_exponent(f"substr({line1}, 45, 8)"), decimal_exponent(f"substr({line1}, 54, 8)"), number(line2, 9, 16), number(line2, 18, 25),
        f"try_cast(substr({line2}, 27, 7) AS DOUBLE)", number(line2, 35, 42), number(line2, 44, 51), number(line2, 53, 63),
    ]


def state_text(line1: str, line2: str) -> str:
    """The state as one comparable text; where a value can't be read, the columns themselves."""
    values = orbital_state(line1, line2)
    fine = " AND ".join(f"{v} IS NOT NULL" for v in values)
    joined = "concat_ws('|', " + ", ".join(f"CAST({v} AS VARCHAR(40))" for v in values) + ")"
    return f"(CASE WHEN {fine} THEN {joined} ELSE concat(substr({line1}, 1, 64), substr({line2}, 1, 63)) END)"


# Edge normalisation in closed form: what stands before the first and behind the last mark that is neither blank, tab,
# carriage return (behind only) nor backslash (behind only).
LEAD, TAIL, EMPTY = "^[ \\t]+", "[ \\t\\r\\\\]+\\z", "^[ \\t\\r\\\\]*\\z"


def content_free(d: Dialect, raw: str) -> str:
    """Whether a line has nothing but edge marks; a line that begins with a line number has more, without a pattern."""
    return f"(substr({raw}, 1, 1) NOT IN ('1', '2') AND {d.like(raw, EMPTY)})"


def core(d: Dialect, raw: str) -> str:
    """The line without its edges; one that begins with a line number and ends with a digit has none."""
    bare = f"substr({raw}, 1, 1) IN ('1', '2') AND substr({raw}, length({raw}), 1) BETWEEN '0' AND '9'"
    return f"(CASE WHEN {bare} THEN {raw} ELSE {d.replace(d.replace(raw, TAIL), LEAD)} END)"


def edge_fixes(d: Dialect, raw: str) -> dict[str, str]:
    """By fix: whether normalising the edges of a line that has content needs it."""
    tail = d.extract(raw, TAIL)
    return {
        "crlf": d.like(tail, "\\r"), "leading-trim": d.like(raw, LEAD), "trailing-ws": d.like(tail, "[ \\t]"), "trailing-backslash": d.like(tail, "\\\\"),
    }
