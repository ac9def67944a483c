"""Command line for the reference's everyday flows.

    python -m shopfloor build    --tables DIR | --csv PATH [PATH ...]
    python -m shopfloor ask      star|nested|graph QUESTION (--tables DIR | --csv PATH ...)
    python -m shopfloor compare  QUESTION --tables DIR
    python -m shopfloor refresh  (--tables DIR | --csv PATH ...)
    python -m shopfloor query    NAME --tables DIR      # any catalogue entry
    python -m shopfloor list

Works under spark-submit (the cluster's session and its spark.checkpoint.dir)
or plain python (a local session).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    from .session import apply_defaults
    spark = SparkSession.builder.appName("shopfloor").getOrCreate()
    apply_defaults(spark)
    return spark


def _warehouse(spark: SparkSession, args):
    from .plans.warehouse import CsvWarehouse, Warehouse
    if args.csv:
        return CsvWarehouse.open_csv(spark, args.csv)
    return Warehouse.open(spark, args.tables)


def _source_args(p: argparse.ArgumentParser) -> None:
    g = p.add_mutually_exclusive_group(required=True)
    g.add_argument("--tables", help="folder with the driver's parquet tables")
    g.add_argument("--csv", nargs="+", help="order-line CSV files or folders")


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="shopfloor")
    sub = ap.add_subparsers(dest="cmd", required=True)
    _source_args(sub.add_parser("build", help="load the three layouts"))
    ask = sub.add_parser("ask", help="one of the ten questions on one layout")
    ask.add_argument("layout", choices=["star", "nested", "graph"])
    ask.add_argument("question")
    _source_args(ask)
    cmp_ = sub.add_parser("compare", help="one question on all layouts, reconciled")
    cmp_.add_argument("question")
    cmp_.add_argument("--tables", required=True)
    _source_args(sub.add_parser("refresh", help="rebuild and publish the star summaries"))
    q = sub.add_parser("query", help="run a catalogue entry")
    q.add_argument("name")
    q.add_argument("--tables", required=True)
    q.add_argument("--rows", type=int, default=50)
    sub.add_parser("list", help="catalogue entries")
    args = ap.parse_args(argv)

    if args.cmd == "list":
        from .plans.catalog import queries
        print("\n".join(sorted(queries())))
        return 0
    spark = _session()
    if args.cmd == "build":
        wh = _warehouse(spark, args)
        star, nested, graph = wh.star(), wh.nested(), wh.graph()
        for name, df in star.tables().items():
            print(f"star.{name}: {df.count()} rows")
        print(f"nested.sales: {nested.count()} records")
        for label, df in graph.nodes.items():
            print(f"graph.{label}: {df.count()} nodes")
        if args.csv:
            print(f"skipped rows: {wh.skipped().count()}")
    elif args.cmd == "ask":
        from .operators import graph as g_ops, nested as n_ops, star as s_ops
        wh = _warehouse(spark, args)
        ops = {"star": (s_ops, wh.star), "nested": (n_ops, wh.nested),
               "graph": (g_ops, wh.graph)}[args.layout]
        ops[0].QUESTIONS[args.question](ops[1]()).show(100, truncate=False)
    elif args.cmd == "compare":
        from .plans.catalog_access import reconcile_question
        from .plans.warehouse import Warehouse
        reconcile_question(Warehouse.open(spark, args.tables), args.question) \
            .show(100, truncate=False)
    elif args.cmd == "refresh":
        from .operators.summaries import refresh_star_summaries
        wh = _warehouse(spark, args)
        for name, df in refresh_star_summaries(wh.star(), wh.storage).items():
            print(f"{name}: {df.count()} rows")
    elif args.cmd == "query":
        from .plans.catalog import queries
        queries()[args.name](spark, args.tables).show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
