"""Rules, fixes and severities as dimension tables, and what explains them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The public vocabulary of rules and fixes.
RULES = {
    "TLE-COL-001": "line length after normalization is not 69 columns",
    "TLE-COL-002": "68-char line where columns 1-68 fail layout — interior character missing",
    "TLE-COL-003": "line contains a non-ASCII byte",
    "TLE-COL-004": "column layout or format check failed",
    "TLE-CHK-001": "mod-10 checksum digit at column 69 does not match",
    "TLE-PAIR-001": "line with no matching partner — orphan line 1 or line 2",
    "TLE-PAIR-002": "line does not start with '1 ' or '2 '",
    "TLE-PAIR-003": "paired line 1 and line 2 disagree on NORAD catalog ID",
    "TLE-INT-001": "cleaner itself raised an exception on this record",
}
FIXES = {
    "crlf": "stripped a trailing carriage return (CRLF line ending)",
    "leading-trim": "stripped leading spaces or tabs before column 1",
    "trailing-ws": "stripped trailing spaces or tabs after column 69",
    "trailing-backslash": "stripped a stray trailing backslash",
    "reconstructed-checksum": "recomputed a missing column-69 checksum digit",
}
TIERS = ("none", "tier-1", "tier-2")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, k.split("-")[1], v) for k, v in RULES.items()], "rule_id string, family string, title string")


def fixes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FIXES.items()), "fix string, title string")


# A public record (satellite 00005), on which each rule and fix is shown.
L1 = "1 00005U 58002B   00179.78495062  .00000023  00000-0  28098-4 0  4753"
L2 = "2 00005  34.2682 348.7242 1859667 331.7664  19.3264 10.82419157413667"
OTHER = "2 09999  34.2682 348.7242 1859667 331.7664  19.3264 10.82419157413668"
#: By rule: (lines that break it, lines that don't, columns at fault).
EXAMPLES: dict[str, tuple[list[str], list[str], tuple[int, int] | None]] = {
    "TLE-COL-001": ([L1[:60]], [L1], None),
    "TLE-COL-002": ([L1[:24] + "A" + L1[25:68]], [L1], (25, 25)),
    "TLE-COL-003": ([L1[:68] + "\xf1"], [L1], (69, 69)),
    "TLE-COL-004": ([L1[:24] + "A" + L1[25:]], [L1], (25, 25)),
    "TLE-CHK-001": ([L1[:68] + "0"], [L1], (69, 69)),
    "TLE-PAIR-001": ([L1], [L1, L2], None),
    "TLE-PAIR-002": (["junk line"], [L1, L2], (1, 2)),
    "TLE-PAIR-003": ([L1, OTHER], [L1, L2], (3, 7)),
}
#: By fix: the line before; after it, each reads L1.
FIXED = {"crlf": L1 + "\r", "leading-trim": "  " + L1, "trailing-ws": L1 + "   ", "trailing-backslash": L1 + "\\", "reconstructed-checksum": L1[:68]}


def known_tags() -> list[str]:
    return sorted([*RULES, *FIXES])


def guard() -> None:
    """Every rule but the one for faults of the engine has an example, every fix too, and no name means two things."""
    if set(EXAMPLES) != set(RULES) - {"TLE-INT-001"} or set(FIXED) != set(FIXES) or set(RULES) & set(FIXES):
        raise RuntimeError("rules, fixes and their examples don't agree")


guard()


def _shown(text: str) -> str:
    return text.replace("\r", "\\r").replace("\t", "\\t")


def explain(tag: str) -> str:
    """A rule's or fix's documentation with an example; the tag's case doesn't matter. KeyError with the known tags."""
    known = {k.lower(): k for k in known_tags()}
    name = known.get(tag.strip().lower())
    if name is None:
        raise KeyError(f"unknown tag {tag!r}; known: {', '.join(known_tags())}")
    if name in FIXES:
        return f"{name}\n{FIXES[name]}\n(fix: the line is kept)\n\n  before:  {_shown(FIXED[name])}\n  after:   {L1}"
    out = [name, RULES[name], "(rule: the record is quarantined)"]
    if name in EXAMPLES:
        bad, good, columns = EXAMPLES[name]
        at = 1 if name == "TLE-PAIR-003" else 0
        for n, line in enumerate(bad):
            out.append(("\n  bad:     " if not n else "           ") + _shown(line))
            if columns and n == at:
                out.append(" " * (10 + columns[0]) + "^" * (columns[1] - columns[0] + 1) + f"  column{'' if columns[0] == columns[1] else 's'} {'-'.join(map(str, sorted(set(columns))))}")
        out += [("  good:    " if not n else "           ") + line for n, line in enumerate(good)]
    return "\n".join(out)
