"""python -m sourcelode.cli [scan|architecture|duplicates|dead-code] [ROOT] [--details] [--format F] [--profile P] [--scope DIR]..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import report
from .model import VIEWS, InputError
from .plans.scan import exit_code, scan


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sourcelode", allow_abbrev=False)
    parser.add_argument("query", choices=list(VIEWS))
    parser.add_argument("root", nargs="?", default=".")
    parser.add_argument("--details", action="store_true")
    parser.add_argument("--format", choices=("terminal", "json", "html"), default="terminal")
    parser.add_argument("--profile", choices=("standard", "large"))
    parser.add_argument("--scope", action="append", default=[])
    try:
        args = parser.parse_args(argv)
    except SystemExit as end:
        return 2 if end.code else 0
    session = spark or SparkSession.builder.appName("sourcelode").config("spark.ui.enabled", "false").getOrCreate()
    try:
        result = scan(session, args.root, args.profile, args.scope).select(args.query)
    except InputError as error:
        print(f"{error.code}: {error.message}", file=sys.stderr)
        return 2
    shown = {"json": report.to_json, "html": report.to_html, "terminal": lambda r: report.to_terminal(r, args.details)}[args.format](result)
    sys.stdout.write(shown)
    return exit_code(result)


if __name__ == "__main__":
    sys.exit(main())
