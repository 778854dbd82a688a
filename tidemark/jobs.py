"""Command line of the jobs, for spark-submit.

    jobs.py land        --topic T --servers H:P --path P --checkpoint C [--available-now]
    jobs.py publish     --dataset D --landing L --compacted C --ledger G [--date YYYY-MM-DD ...]
    jobs.py consolidate --dataset D --landing L --compacted C --ledger G --root R [--date ...]
    jobs.py preview     (as publish) shows the newest state within the published dates
    jobs.py maintain    (as consolidate, without dates) [--rebuild | --compact] [--sweep]; shows what each audit found

Without --date a job takes the day before today in UTC. Most values can come from the
environment instead.
"""

from __future__ import annotations

import argparse
import os
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import business_date
from tidemark.operators import current as state
from tidemark.operators import quality
from tidemark.operators.events import events
from tidemark.plans import sweep
from tidemark.plans.consolidate import Consolidation
from tidemark.plans.publish import Publisher
from tidemark.schemas import ENTITIES
from tidemark.session import builder, object_store
from tidemark.sources.streams import kafka_stream
from tidemark.streaming.landing import start_landing

# --- fixed values: environment variables that stand in for options ---
ENVIRONMENT = {
    "topic": "KAFKA_TOPIC",
    "path": "RAW_PATH",
    "checkpoint": "CHECKPOINT_PATH",
    "dataset": "DATASET",
    "landing": "LANDING_PATH",
    "compacted": "COMPACTED_PATH",
    "ledger": "CONTROL_PATH",
    "date": "PARTITION_DATE",
    "stale_minutes": "RUNNING_STALE_AFTER_MINUTES",
}
PREVIEW_ROWS = 10
# --- end of fixed values ---


def _option(parser: argparse.ArgumentParser, name: str, **more) -> None:
    default = os.environ.get(ENVIRONMENT.get(name, ""))
    if default is not None:
        more = more | {"default": [default] if more.get("nargs") else default, "required": False}
    parser.add_argument("--" + name.replace("_", "-"), **more)


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tidemark")
    jobs = parser.add_subparsers(dest="job", required=True)

    land = jobs.add_parser("land")
    for name in ("topic", "servers", "path", "checkpoint"):
        _option(land, name, required=True)
    land.add_argument("--available-now", action="store_true")
    land.add_argument("--interval")
    land.add_argument("--min-partitions", type=int)
    land.add_argument("--max-offsets-per-trigger", type=int)
    land.add_argument("--starting-offsets", default="earliest")

    for job in ("publish", "consolidate", "preview", "maintain"):
        sub = jobs.add_parser(job)
        for name in ("dataset", "landing", "compacted", "ledger"):
            _option(sub, name, required=True)
        _option(sub, "date", nargs="+")
        _option(sub, "stale_minutes", type=int, default=30)
        if job == "publish":
            sub.add_argument("--materialize", action="store_true")
            sub.add_argument("--payload", action="store_true")
            sub.add_argument("--republish-grown", action="store_true")
        if job == "maintain":
            sub.add_argument("--sweep", action="store_true", help="remove runs that no state ever published")
            base = sub.add_mutually_exclusive_group()
            base.add_argument("--rebuild", action="store_true", help="write the current state anew from history")
            base.add_argument("--compact", action="store_true", help="merge the current state's parts into one")
        if job in ("consolidate", "maintain"):
            sub.add_argument("--root", required=True)
            sub.add_argument("--buckets", type=int, default=200)
        sub.add_argument("--backfill", nargs="*", default=[])
    for sub in jobs.choices.values():
        sub.add_argument("--store", help="endpoint of an S3-compatible store; keys from "
                         "STORE_ACCESS_KEY and STORE_SECRET_KEY")
    return parser.parse_args(argv)


def land(spark: SparkSession, args: argparse.Namespace) -> None:
    records = kafka_stream(spark, args.servers, args.topic, min_partitions=args.min_partitions,
                           max_offsets_per_trigger=args.max_offsets_per_trigger,
                           starting_offsets=args.starting_offsets)
    start_landing(records, args.path, args.checkpoint, available_now=args.available_now,
                  interval=args.interval).awaitTermination()


def _publisher(spark: SparkSession, args: argparse.Namespace) -> Publisher:
    flags = {name: getattr(args, name, False)
             for name in ("materialize", "payload", "republish_grown")}
    return Publisher(spark, args.dataset, args.landing, args.compacted, args.ledger,
                     stale_after=timedelta(minutes=int(args.stale_minutes)),
                     backfills=tuple(args.backfill), **flags)


def _dates(args: argparse.Namespace) -> list:
    return [business_date(d) for d in args.date or [None]]


def publish(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return _publisher(spark, args).publish(_dates(args))


def _consolidation(spark: SparkSession, args: argparse.Namespace) -> Consolidation:
    return Consolidation(spark, ENTITIES[args.dataset], _publisher(spark, args), args.root, args.buckets)


def consolidate(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Write history of the dates and fold them into current state."""
    job = _consolidation(spark, args)
    job.reprocess(_dates(args))
    job.apply(_dates(args))
    return job.current()


def preview(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Newest state per key within the published dates; nothing is written."""
    entity = ENTITIES[args.dataset]
    published = _publisher(spark, args).published(_dates(args))
    return state.latest(events(published, entity), entity)


def maintain(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Rebuild or compact the current state, remove what crashed publications left, then audit: one row per check
    (``runs_left``, ``columns``, ``values``, ``current``), what it found and how often."""
    job = _consolidation(spark, args)
    if args.rebuild:
        job.rebuild()
    elif args.compact:
        job.compact()
    left = sweep.orphan_runs(job.publisher)
    if args.sweep:
        sweep.remove(job.publisher, left.collect())
        left = sweep.orphan_runs(job.publisher)

    def counted(check: str, found: DataFrame, what: str) -> DataFrame:
        return found.groupBy(F.col(what).alias("found")).agg(F.count("*").alias("times")).select(
            F.lit(check).alias("check"), "found", "times")

    broken = job.domain_audit().where("violations > 0")
    checks = [
        counted("runs_left", left, "run_id"),
        counted("columns", job.type_audit().where("verdict <> 'ok'"), "verdict"),
        broken.select(F.lit("values").alias("check"), F.col("rule").alias("found"), F.col("violations").alias("times")),
        counted("current", quality.current_audit(job.current(), job.history(), job.entity), "verdict"),
    ]
    return reduce(DataFrame.unionByName, checks)


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    store = [object_store(args.store, os.environ["STORE_ACCESS_KEY"], os.environ["STORE_SECRET_KEY"],
                          tls=args.store.startswith("https"))] if args.store else []
    spark = builder(f"tidemark-{args.job}", *store).getOrCreate()
    if args.job == "land":
        land(spark, args)
        return
    result = {"publish": publish, "consolidate": consolidate, "preview": preview,
              "maintain": maintain}[args.job](spark, args)
    if args.job == "preview":
        result.printSchema()
    if args.job in ("preview", "maintain"):
        result.show(PREVIEW_ROWS, truncate=False)


if __name__ == "__main__":
    main()
