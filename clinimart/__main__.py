"""The jobs of the system.

    spark-submit --py-files clinimart.zip run_job.py refresh OPERATIONAL WAREHOUSE FROM TO
    spark-submit --py-files clinimart.zip run_job.py update BEFORE OPERATIONAL WAREHOUSE FROM TO
    spark-submit --py-files clinimart.zip run_job.py expire WAREHOUSE [--keep N] [--grace-days D]
    spark-submit --py-files clinimart.zip run_job.py report WAREHOUSE NAME OUTPUT [--from D] [--to D]
    spark-submit --py-files clinimart.zip run_job.py alerts CHANGES LOG CHECKPOINT

or ``python -m clinimart`` with the same arguments on one machine.
"""

from __future__ import annotations

import argparse
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession

from .plans import reports
from .plans.changes import changes_between, refresh_changed
from .plans.warehouse import expire, latest, refresh
from .sources.storage import read_operational, written_once
from .streaming.alerts import start_alert_stream

REPORTS = {
    **reports.STORED,
    "disease_trend": reports.disease_trend,
    "cost_trend": reports.cost_trend,
    "monthly_trend": reports.monthly_trend,
    "overview": reports.overview,
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="clinimart")
    jobs = parser.add_subparsers(dest="job", required=True)
    load = jobs.add_parser("refresh", help="load dimensions, fact and stored reports")
    for name in ("operational", "warehouse", "calendar_from", "calendar_to"):
        load.add_argument(name)
    update = jobs.add_parser("update", help="load only what differs from an earlier state")
    for name in ("before", "operational", "warehouse", "calendar_from", "calendar_to"):
        update.add_argument(name)
    old = jobs.add_parser("expire", help="remove old loads after a grace period")
    old.add_argument("warehouse")
    old.add_argument("--keep", type=int, default=2)
    old.add_argument("--grace-days", type=float, default=1)
    show = jobs.add_parser("report", help="write one report of the last load as parquet")
    show.add_argument("warehouse")
    show.add_argument("name", choices=sorted(REPORTS))
    show.add_argument("output")
    show.add_argument("--from", dest="date_from")
    show.add_argument("--to", dest="date_to")
    watch = jobs.add_parser("alerts", help="append long-stay alerts for new changes")
    for name in ("changes", "log", "checkpoint"):
        watch.add_argument(name)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"clinimart {args.job}").getOrCreate()
    if args.job == "refresh":
        refresh(
            spark,
            args.warehouse,
            lambda table: read_operational(spark, args.operational, table),
            args.calendar_from,
            args.calendar_to,
            stored_reports=reports.STORED,
        )
    elif args.job == "update":

        def now(table: str) -> DataFrame:
            return read_operational(spark, args.operational, table)

        def changed(table: str) -> DataFrame:
            found = changes_between(read_operational(spark, args.before, table), now(table))
            return written_once(found, "changes")

        days = (args.calendar_from, args.calendar_to)
        refresh_changed(spark, args.warehouse, now, changed, *days, stored_reports=reports.STORED)
    elif args.job == "expire":
        for load in expire(spark, args.warehouse, args.keep, timedelta(days=args.grace_days)):
            print(load)
    elif args.job == "report":
        wh = latest(spark, args.warehouse)
        if wh is None:
            raise SystemExit(f"no finished load in {args.warehouse}")
        REPORTS[args.name](wh, args.date_from, args.date_to).write.parquet(args.output)
    else:
        start_alert_stream(spark, args.changes, args.log, args.checkpoint).awaitTermination()


if __name__ == "__main__":
    main()
