"""Command line: ``python -m factmill etl | train | publish``."""

from __future__ import annotations

import argparse

from factmill import fixed_values as fixed
from factmill.operators.runlog import summary_lines
from factmill.plans.etl import publish_run, run_etl
from factmill.plans.training import train_and_evaluate
from factmill.session import build_session
from factmill.sources import readers


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="factmill", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    etl = commands.add_parser("etl", help="clean a raw table into totals")
    etl.add_argument("--out", required=True, help="folder for all outputs")
    source = etl.add_mutually_exclusive_group(required=True)
    source.add_argument("--input", help="raw table")
    source.add_argument("--demo", action="store_true", help="use the sample table")
    etl.add_argument("--format", default="parquet", help="format of the raw table")
    etl.add_argument("--row-cap", type=int, default=None)
    etl.add_argument("--cap-order", nargs="+", help="columns that say which rows come first")
    etl.add_argument("--db-url", default=None)
    etl.add_argument("--db-table", default="facts_aggregated")
    etl.add_argument("--load-demo", action="store_true", help="load a demo run too")

    train = commands.add_parser("train", help="fit and measure both models")
    train.add_argument("--totals", required=True, help="aggregated table")
    train.add_argument("--out", required=True, help="folder for models and metrics")
    train.add_argument("--train-until", type=int, default=fixed.TRAIN_UNTIL)

    publish = commands.add_parser("publish", help="write runs as dashboard entries")
    publish.add_argument("--out", required=True, help="folder of the etl command")
    publish.add_argument("--dry-run", action="store_true", help="show, do not write")

    args = parser.parse_args(argv)
    spark = build_session()
    if args.command == "etl":
        raw = None
        if args.input:
            raw = readers.scan(spark, args.input, args.format, row_cap=args.row_cap, cap_order=args.cap_order)
        result = run_etl(
            spark,
            args.out,
            raw,
            db_url=args.db_url,
            db_table=args.db_table,
            load_demo=args.load_demo,
        )
        lines = summary_lines(result.run).orderBy("position").select("line")
        print("\n".join(row["line"] for row in lines.collect()))
        publish_run(spark, args.out)
    elif args.command == "train":
        totals = readers.read_totals(spark, args.totals)
        result = train_and_evaluate(totals, args.train_until, folder=args.out)
        result.metrics.show(truncate=False, vertical=True)
    elif args.dry_run:
        from factmill.operators import runlog

        runs = runlog.read_runs(spark, f"{args.out}/metrics/runs")
        runlog.dashboard_entries(runlog.recent_runs(runs)).show(truncate=False)
    else:
        publish_run(spark, args.out).show(truncate=False)


if __name__ == "__main__":
    main()
