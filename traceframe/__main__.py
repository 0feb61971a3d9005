"""Entry points for ``spark-submit`` or ``python -m traceframe``: build, search, show, tables (E14).

    python -m traceframe build /data/checkout /data/snapshots
    python -m traceframe search /data/snapshots "which equation balances p_z" --kind equation
    python -m traceframe show /data/snapshots symbol p_a --scenario S1
    python -m traceframe tables /data/snapshots

Rows are printed as JSON, one a line.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from traceframe.api import Engine, NotFound, build_snapshot
from traceframe.sources import snapshot

VIEWS = ("symbol", "switch", "module", "scenario", "links")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="traceframe", description=__doc__.split("\n")[0])
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="read a source tree, derive all tables and publish them")
    build.add_argument("root")
    build.add_argument("out")
    search = commands.add_parser("search", help="the best chunks for a query")
    search.add_argument("out")
    search.add_argument("query")
    search.add_argument("-k", type=int, default=5)
    for name in ("module", "realization", "kind", "phase", "scenario"):
        search.add_argument(f"--{name}")
    show = commands.add_parser("show", help="what is known of a name")
    show.add_argument("out")
    show.add_argument("view", choices=VIEWS)
    show.add_argument("name")
    show.add_argument("--scenario")
    show.add_argument("--rows", type=int, default=20, help="rows of each table")
    commands.add_parser("tables", help="tables and columns of the published snapshot").add_argument("out")
    return parser


def _print(df: DataFrame, rows: int, title: str = "") -> None:
    if title:
        print(f"# {title}")
    for line in df.limit(rows).toJSON().collect():
        print(line)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one command; the exit code is 1 if a name was not found."""
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("traceframe").getOrCreate()
    if args.command == "build":
        print(build_snapshot(spark, args.root, args.out))
        return 0
    engine = Engine(spark, snapshot.current(spark, args.out))
    if args.command == "tables":
        _print(snapshot.tables(spark, engine.path), 1_000)
        return 0
    try:
        if args.command == "search":
            _print(engine.search(args.query, args.k, **{n: getattr(args, n) for n in ("module", "realization", "kind", "phase", "scenario")}), args.k)
            return 0
        found = getattr(engine, args.view)(args.name, **({"scenario": args.scenario} if args.view in ("symbol", "switch") else {}))
    except NotFound as e:
        print(e, file=sys.stderr)
        return 1
    for title, df in (found.items() if isinstance(found, dict) else [(args.view, found)]):
        _print(df, args.rows, title)
    return 0


if __name__ == "__main__":
    sys.exit(main())
