"""Orbit checks: does each record lead to the next one of its satellite?

A satellite's records, one group, are its history: some ten thousand rows at most, whatever the archive holds besides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from perigee.functions import sgp4

# Fixed values: (floor in km, median deviations) by tier.
TIERS = {"sensitive": (100.0, 10.0), "strict": (200.0, 20.0)}
HARD_ERRORS = (1, 2, 3, 4, 5)
LOCAL_FACTOR, QUANTUM = 20.0, 0.1


def read(line1: list[str], line2: list[str], epoch_us: np.ndarray) -> sgp4.Orbits:
    return sgp4.parse(line1, line2, epoch_us / 86400e6 + 7306.0)


def residuals(line1: list[str], line2: list[str], epoch_us: np.ndarray) -> tuple[np.ndarray, np.ndarray, sgp4.Orbits]:
    """(error codes, residuals, orbits): residual i is the distance in km between where record i - 1 and record i put the
    satellite at the epoch of i; nan where they don't compare (an error, no time between them, or too much)."""
    orbits = read(line1, line2, epoch_us)
    n = len(line1)
    out = np.full(n, np.nan)
    if n > 1:
        out[1:] = between(orbits, epoch_us, np.arange(n - 1), np.arange(1, n))
    return orbits.error, out, orbits


def gap_days(orbits: sgp4.Orbits, i: np.ndarray) -> np.ndarray:
    """Days across which two records still compare: seven for orbits slower than 1.5 turns a day, else three."""
    return np.where(orbits.kozai[i] * 1440 / sgp4.TWO_PI < 1.5, 7.0, 3.0)


def between(orbits: sgp4.Orbits, epoch_us: np.ndarray, i: np.ndarray, j: np.ndarray, stretch: float = 1.0) -> np.ndarray:
    """Residuals from records i to records j."""
    minutes = (epoch_us[j] - epoch_us[i]) / 60e6
    able = (orbits.error[i] == 0) & (orbits.error[j] == 0) & (minutes > 0) & (minutes <= stretch * gap_days(orbits, i) * 1440)
    wrong_a, from_a = orbits.take(i).at(np.where(able, minutes, 0.0))  # none is led further than it is asked for
    wrong_b, from_b = orbits.take(j).at(np.zeros(len(j)))
    r = np.round(np.sqrt(((from_a - from_b) ** 2).sum(axis=1)), 1)
    return np.where(able & (wrong_a == 0) & (wrong_b == 0), r, np.nan)


def threshold(r: np.ndarray, floor: float, factor: float) -> float:
    known = r[~np.isnan(r)]
    if len(known) < 10:
        return floor
    middle = np.median(known)
    return round(max(floor, middle + factor * np.median(np.abs(known - middle))), 1)


def local_thresholds(r: np.ndarray) -> np.ndarray:
    """Twenty medians of the five residuals on both sides in the run without holes; 0 for fewer than ten."""
    out, known = np.zeros(len(r)), ~np.isnan(r)
    start = 0
    while start < len(r):
        if not known[start]:
            start += 1
            continue
        end = start
        while end < len(r) and known[end]:
            end += 1
        for k in range(start, end):
            near = r[max(start, k - 5) : min(end, k + 6)]
            if len(near) >= 10:
                out[k] = round(LOCAL_FACTOR * float(np.median(near)), 1)
        start = end
    return out


def outliers(r: np.ndarray, orbits: sgp4.Orbits, epoch_us: np.ndarray, floor: float, factor: float) -> list[tuple[int, float, bool]]:
    """(record, the bar that it exceeds, whether it alone is at fault) of records that don't fit their track. Where both
    pairs of a record are hot and its neighbours fit each other, it alone is; any other hot pair is laid on its second
    record."""
    top = threshold(r, floor, factor)
    bars = np.maximum(top, local_thresholds(r))
    with np.errstate(invalid="ignore"):
        hot = r > bars + QUANTUM
    found, used, i = [], set(), 1
    while i + 1 < len(r):
        if hot[i] and hot[i + 1] and i not in used:
            probe = between(orbits, epoch_us, np.array([i - 1]), np.array([i + 1]), 2.0)[0]
            if probe <= top + QUANTUM:
                found.append((i, float(bars[i]), True))
                used |= {i, i + 1}
        i += 1
    return sorted(found + [(k, float(bars[k]), False) for k in range(1, len(r)) if hot[k] and k not in used])


FOUND = "rule string, src_file string, idx long, residual double, detail string, pairs long"


def suspects(records: DataFrame, tier: str = "sensitive") -> DataFrame:
    """(rule, src_file, idx, residual, detail, pairs): records whose elements are no orbit, and outliers of their tracks;
    and, with a null rule, a row for each track with the pairs measured in it.
    records: (catalog, epoch_key, epoch_us, line1, line2, src_file, idx), valid."""
    floor, factor = TIERS[tier]

    def track(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["epoch_key", "src_file", "idx"])
        us = pdf["epoch_us"].to_numpy(dtype=np.int64)
        error, r, orbits = residuals(pdf["line1"].tolist(), pdf["line2"].tolist(), us)
        files, places = pdf["src_file"].tolist(), pdf["idx"].tolist()
        rows: list[tuple] = [(None, None, None, None, None, int((~np.isnan(r)).sum()))]
        for k in range(len(pdf)):
            if orbits.unread[k]:
                rows.append(("VRFY-ORBIT-ERROR", files[k], places[k], None, "sgp4 cannot parse these elements", None))
            elif error[k] in HARD_ERRORS:
                rows.append(("VRFY-ORBIT-ERROR", files[k], places[k], None, f"sgp4 rejects these elements (error {error[k]}: {sgp4.ERRORS[int(error[k])]})", None))
        for k, bar, alone in outliers(r, orbits, us, floor, factor):
            why = "isolated by leave-one-out: neighbours agree without it" if alone else "inconclusive"
            rows.append(("VRFY-ORBIT-OUTLIER", files[k], places[k], float(r[k]), f"orbit residual {float(r[k])} km vs its neighbour exceeds the {bar} km threshold ({why})", None))
        out = pd.DataFrame(rows, columns=["rule", "src_file", "idx", "residual", "detail", "pairs"])
        return out.astype({"idx": "Int64", "pairs": "Int64"})

    own = records.where("epoch_us is not null").select("catalog", "epoch_key", "epoch_us", "line1", "line2", "src_file", "idx")
    return own.groupBy("catalog").applyInPandas(track, FOUND)


def track_residuals(records: DataFrame) -> DataFrame:
    """(catalog, src_file, idx, residual): each record's distance from where the one before it leads, null where they
    don't compare."""

    def track(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["epoch_key", "src_file", "idx"])
        _, r, _ = residuals(pdf["line1"].tolist(), pdf["line2"].tolist(), pdf["epoch_us"].to_numpy(dtype=np.int64))
        return pd.DataFrame({"catalog": pdf["catalog"].tolist(), "src_file": pdf["src_file"].tolist(), "idx": pdf["idx"].tolist(), "residual": [None if np.isnan(x) else float(x) for x in r]})

    own = records.where("epoch_us is not null").select("catalog", "epoch_key", "epoch_us", "line1", "line2", "src_file", "idx")
    return own.groupBy("catalog").applyInPandas(track, "catalog long, src_file string, idx long, residual double")
