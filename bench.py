"""Headline workloads, timed; prints one JSON line.

The change records are derived from the supplied tables once and are not timed. Every
workload then runs over all of them: landing, publication, history, current state, checks.
The whole list runs twice, each time with outputs of its own: the first pass, on a cold JVM,
is reported as ``cold``, the second as ``queries``.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tidemark.operators import current as state  # noqa: E402
from tidemark.operators import events as ev  # noqa: E402
from tidemark.operators import fingerprint as prints  # noqa: E402
from tidemark.operators import history as past  # noqa: E402
from tidemark.operators import quality  # noqa: E402
from tidemark.plans.consolidate import Consolidation  # noqa: E402
from tidemark.schemas import ORDERS  # noqa: E402
from tidemark.session import builder, configure, scratch  # noqa: E402
from tidemark.sources.layers import landing_scan  # noqa: E402
from tidemark.sources.streams import file_stream  # noqa: E402
from tidemark.streaming.landing import catch_up  # noqa: E402
from workload import stages  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def consume(df: DataFrame) -> None:
    """Compute every row and column, keep none."""
    df.write.format("noop").mode("overwrite").save()


def measure(spark: SparkSession, topic: str, root: str) -> dict[str, float]:
    """Seconds per workload over the staged inputs, with fresh outputs."""
    landed = landing_scan(spark, root)
    days = stages.landing_dates(spark, root)
    stream_out = scratch(spark, "bench-stream")
    source = stages.publisher(spark, ORDERS, root)
    job = Consolidation(spark, ORDERS, source, scratch(spark, "bench-out"), buckets=int(CPUS))
    other = Consolidation(spark, ORDERS, source, scratch(spark, "bench-out"), buckets=int(CPUS))

    def events() -> DataFrame:
        return ev.events(landed, ORDERS)

    def reconciled() -> DataFrame:
        changes = landed.where(F.col("value_raw").isNotNull())
        return quality.reconcile(changes, job.history())

    workloads = {
        "ingest_stream": lambda: catch_up(
            file_stream(spark, topic), f"{stream_out}/data", f"{stream_out}/checkpoint"),
        "fingerprint": lambda: consume(prints.fingerprint(landed)),
        "raw_uniqueness": lambda: consume(prints.duplicates(landed)),
        "publish_run": lambda: source.publish(days),
        "published_read": lambda: consume(source.published()),
        "cdc_normalize": lambda: consume(events()),
        "op_profile": lambda: consume(ev.operation_profile(events())),
        "domain_audit": lambda: consume(quality.domain_audit(events(), ORDERS)),
        "orders_current": lambda: consume(state.latest(events(), ORDERS)),
        "orders_history": lambda: consume(past.distinct_events(events())),
        "history_write": lambda: job.reprocess(days[:-1]),
        "history_append_one_date": lambda: job.reprocess(days[-1:]),
        "current_rebuild": job.rebuild,
        "current_fold_one_date": lambda: other.apply(days[-1:]),  # a date the state has not seen
        "current_read": lambda: consume(other.current()),
        "layer_reconcile": lambda: consume(reconciled()),
    }
    seconds = {}
    for name, run in workloads.items():
        if name == "current_fold_one_date":
            other.apply(days[:-1])  # not timed
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)
    return seconds


def main() -> None:
    spark = configure(
        builder("bench").master(f"local[{CPUS}]")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_FOLDER") or tempfile.mkdtemp(prefix="bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    topic = stages.topic_files(spark, SF_DIR, ORDERS, files=16)
    root = stages.landing(spark, SF_DIR, ORDERS, scattered=True)
    records = landing_scan(spark, root).count()
    cold = measure(spark, topic, root)
    seconds = measure(spark, topic, root)

    print(json.dumps({
        "metric": "cdc_pipeline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(SF_DIR).name.removeprefix("sf"),
        "cpus": int(CPUS),
        "records": records,
        "records_per_sec": {
            name: round(records / seconds[name])
            for name in ("ingest_stream", "publish_run", "cdc_normalize", "orders_current")},
        "cold": cold | {"total": round(sum(cold.values()), 3)},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
