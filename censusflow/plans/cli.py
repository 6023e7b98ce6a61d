"""Command line: python -m censusflow -f a.csv b.csv [options]. Exit codes: 0 done, 1 bad input, 2 bad options."""

from __future__ import annotations

import argparse
import logging
import sys
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from censusflow import functions as fn
from censusflow.operators.order import SORT_KEYS
from censusflow.plans.pipeline import Options, run
from censusflow.plans.render import report_text
from censusflow.sources.csv_export import ExportError, read_exports


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="censusflow", description="Clean, deduplicate, filter and count client-activity exports.", allow_abbrev=False, add_help=False)
    p.add_argument("-f", "--f", action="append", default=[], metavar="FILE", help="input file; may be repeated, more files may follow")
    p.add_argument("files", nargs="*", help="more input files")
    p.add_argument("-sort", "--sort", default="namespace_path", help=f"one of: {', '.join(SORT_KEYS)}")
    p.add_argument("-namespace", "--namespace", default="", help="keep namespaces that hold this text")
    p.add_argument("-type", "--type", default="", help="keep one client type")
    p.add_argument("-since", "--since", default="", help="keep clients created at or after this time")
    p.add_argument("-since-file", "--since-file", action="append", default=[], metavar="NAME=DATE", help="the same for one file")
    for short, text in {"p": "count certificate clients apart", "d": "one row per client id", "dedup-alias": "one row per alias and identity group", "dedup-jwt": "drop token logins seen through another method", "debug": "show records", "per-file": "one summary per file too"}.items():
        p.add_argument(f"-{short}", f"--{short}", action="store_true", help=text)
    p.add_argument("-single-line", "--single-line", action="store_true", help="no field holds a line break: large files are read in parts")
    p.add_argument("-help", "--help", "-h", action="store_true", help="show this text")
    return p


# Spellings of true and false after an option that is on or off.
TRUE, FALSE = ("1", "t", "T", "true", "TRUE", "True"), ("0", "f", "F", "false", "FALSE", "False")


def switched(argv: list[str], switches: set[str]) -> list[str]:
    """Arguments with -x=true as -x, and without -x=false."""
    out = []
    for a in argv:
        name, eq, value = a.partition("=")
        if eq and name.startswith("-") and name.lstrip("-") in switches and value in (*TRUE, *FALSE):
            out += [name] if value in TRUE else []
        else:
            out.append(a)
    return out


def time_of(spark: SparkSession, text: str) -> datetime | None:
    return spark.range(1).select(fn.parse_time(F.lit(text)).alias("t")).first()["t"]


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    options = parser()
    on_off = {s.lstrip("-") for a in options._actions if a.nargs == 0 for s in a.option_strings}
    args = options.parse_intermixed_args(switched(sys.argv[1:] if argv is None else argv, on_off))
    paths = [*args.f, *args.files]
    if args.help or not paths:
        parser().print_help(out)
        return 0
    logging.basicConfig(format="warning: %(message)s")
    spark = spark or SparkSession.builder.appName("censusflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        cutoffs = {}
        for x in args.since_file:
            name, eq, date = x.rpartition("=")
            if not eq or not name.strip():
                print(f"--since-file {x!r} must be name=date", file=sys.stderr)
                return 2
            if not (t := time_of(spark, date)):
                raise ExportError(f'error: --since-file "{name}"="{date}" is not a recognized date/time format')
            cutoffs[name.strip()] = t
        since = time_of(spark, args.since) if args.since else None
        if args.since and not since:
            raise ExportError(f'error: --since "{args.since}" is not a recognized date/time format')
        options = Options(args.sort, args.namespace, args.type, since, cutoffs, args.p, args.d, args.dedup_alias, args.dedup_jwt, args.debug, args.per_file)
        raw = read_exports(spark, paths, multi_line=not args.single_line, warn=True)
        if raw.isEmpty():
            raise ExportError("no records found across the provided CSV files")
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    stages = run(raw, options)
    stages.final.persist()
    try:
        for line in report_text(stages, options, paths):
            print(line, file=out)
    finally:
        stages.final.unpersist()
    return 0
