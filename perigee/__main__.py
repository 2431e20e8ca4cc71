"""The command line: python -m perigee clean | verify | dedup | extract | diff | report | explain.

Exit codes: 0 fine; 1 records were quarantined, hard suspects or conflicts found; 2 it can't be done; 128 and the signal's
number if stopped by one. Options that are not given come from perigee.json in the working folder (source, output).
"""

from __future__ import annotations

import argparse
import json
import os
import signal
import sys


def settings() -> dict:
    """The project's settings: {source, output}."""
    if not os.path.exists("perigee.json"):
        return {}
    with open("perigee.json") as f:
        found = json.load(f)
    if not isinstance(found, dict) or not all(isinstance(found.get(k, ""), str) for k in ("source", "output")):
        raise ValueError("perigee.json: an object with the texts source and output is needed")
    return found


def signal_exit_code(number: int) -> int:
    return 128 + int(number)


def parser(own: dict) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="perigee")
    subs = p.add_subparsers(dest="command", required=True)
    out = {"default": own.get("output", "out"), "nargs": "?"}
    c = subs.add_parser("clean")
    c.add_argument("path", nargs="?", default=own.get("source", "."))
    c.add_argument("--out-dir", default=own.get("output", "out"))
    c.add_argument("--reconstruct-checksum", action="store_true")
    c.add_argument("--max-quarantined")
    c.add_argument("--chunk-records", type=int, default=1_000_000)
    c.add_argument("--no-resume", action="store_true")
    v = subs.add_parser("verify")
    v.add_argument("out", **out)
    v.add_argument("--source", default=own.get("source"))
    v.add_argument("--no-source-diff", action="store_true")
    v.add_argument("--orbit", action="store_true")
    v.add_argument("--sample", type=int, default=3000)
    v.add_argument("--all", action="store_true")
    v.add_argument("--sensitivity", choices=("sensitive", "strict"), default="sensitive")
    subs.add_parser("dedup").add_argument("out", **out)
    e = subs.add_parser("extract")
    e.add_argument("ids", nargs="+")
    e.add_argument("--out-dir", default=own.get("output", "out"))
    e.add_argument("--dest")
    d = subs.add_parser("diff")
    d.add_argument("a")
    d.add_argument("b")
    r = subs.add_parser("report")
    r.add_argument("out", **out)
    r.add_argument("--report", choices=("text", "json"), default="text")
    subs.add_parser("explain").add_argument("tag")
    return p


def run(spark, a: argparse.Namespace) -> int:
    from perigee import api, archive
    from perigee.operators import dedup as latest

    if a.command == "clean":
        limit = 0 if a.max_quarantined is None else latest.parse_threshold(a.max_quarantined)
        s = archive.clean(spark, a.path, a.out_dir, a.reconstruct_checksum, a.chunk_records, not a.no_resume)["summary"]
        print(f"{s['clean_count']} cleaned, {s['quarantined_count']} quarantined")
        return int(latest.exceeded(s["clean_count"], s["quarantined_count"], limit))
    if a.command == "verify":
        return archive.verify(spark, a.out, None if a.no_source_diff else a.source, orbit=a.orbit, sample=a.sample, all_sats=a.all, tier=a.sensitivity).exit_code()
    if a.command == "dedup":
        return archive.dedup(spark, a.out).exit_code()
    if a.command == "extract":
        for warning in archive.extract(spark, a.out_dir, a.ids, a.dest)[2]:
            print(warning, file=sys.stderr)
    elif a.command == "diff":
        print(archive.diff(spark, a.a, a.b), end="")
    elif a.command == "report":
        print(archive.report(spark, a.out, a.report), end="")
    else:
        print(api.explain(a.tag))
    return 0


def main(args: list[str] | None = None, spark=None) -> int:
    def stopped(number, _):
        raise SystemExit(signal_exit_code(number))

    try:
        a = parser(settings()).parse_args(args)
        if a.command != "explain" and spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
            for number in (signal.SIGINT, signal.SIGTERM, signal.SIGHUP):
                signal.signal(number, stopped)
        return run(spark, a)
    except (ValueError, KeyError, OSError) as why:
        print(f"perigee: {why}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
