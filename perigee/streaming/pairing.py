"""Pairing of lines as they arrive: an extension, nothing that archives need.

A stream of lines (src_file, line_no, raw), in order within each file, becomes a stream of records and orphans. For each
file the state is one held line 1; a file that stays silent longer than `patience` gives its held line up as an orphan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "src_file string, src1 long, src2 long, raw1 string, raw2 string, rule_id string"
HELD = "line_no long, raw string"


def kind_of(raw: str) -> str:
    if not raw.strip(" \t\r\\"):
        return "-"
    if len(raw.encode("utf-8", "replace")) >= 4096:
        return "O"
    head = raw.lstrip(" \t")[:2]
    return {"1 ": "1", "2 ": "2"}.get(head, "X")


def pair(file: str, rows: list[tuple[int, str]], held: tuple[int, str] | None) -> tuple[list[tuple], tuple[int, str] | None]:
    """Records and orphans of some lines in order, and the line 1 that still waits."""
    out: list[tuple] = []
    for no, raw in rows:
        kind = kind_of(raw)
        if kind == "-":
            continue
        if kind == "2" and held:
            out.append((file, held[0], no, held[1], raw, None))
            held = None
            continue
        if held:
            out.append((file, held[0], None, held[1], None, "TLE-PAIR-001"))
            held = None
        if kind == "1":
            held = (no, raw)
        else:
            out.append((file, no, None, raw[:4096], None, {"2": "TLE-PAIR-001", "X": "TLE-PAIR-002", "O": "TLE-COL-001"}[kind]))
    return out, held


def paired_stream(lines: DataFrame, patience: str | None = "10 minutes") -> DataFrame:
    """patience None: a held line waits for ever, and the query ends where its source ends."""

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], held[0], None, held[1], None, "TLE-PAIR-001")] if held else [], columns=[c.split()[0] for c in OUT.split(", ")])
            return
        rows = sorted((int(n), r) for pdf in frames for n, r in zip(pdf["line_no"], pdf["raw"], strict=True))
        out, held = pair(key[0], rows, held)
        if held:
            state.update(held)
            if patience:
                state.setTimeoutDuration(int(pd.Timedelta(patience).total_seconds() * 1000))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if patience else GroupStateTimeout.NoTimeout
    return lines.groupBy("src_file").applyInPandasWithState(step, OUT, HELD, "append", timeout)
