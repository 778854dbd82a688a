"""One query per operator. Each takes (spark, folder of the supplied tables)."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import run_id_column
from tidemark.functions.decimals import connect_decimal
from tidemark.operators import blocks
from tidemark.operators import current as state
from tidemark.operators import drift
from tidemark.operators import events as ev
from tidemark.operators import fingerprint as prints
from tidemark.operators import history as past
from tidemark.operators import ledger, offsets, quality, versions
from tidemark.operators.compaction import Thresholds, policy
from tidemark.plans import sweep
from tidemark.plans.consolidate import Consolidation
from tidemark.plans.publish import PublicationRejected, Publisher
from tidemark.schemas import IDENTITY, LANDING_DATE, LEDGER, ORDERS, PAYMENTS, REFUNDS, Entity
from tidemark.session import configure, scratch, written
from tidemark.sources import tables
from tidemark.sources import layers
from tidemark.sources.layers import files_of, landing_scan, run_scan
from tidemark.sources.streams import file_stream
from tidemark.streaming.landing import catch_up, land_batch, project
from workload import stages
from workload.changes import ALL, encoded, kafka_records, raw_records, spread, table

QUERIES = {}


def query(fn):
    """Register ``fn`` under its own name, on a session with the jobs' settings."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


# --- presentation: types that compare alike in other engines -------------------------------

def text(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


def shown(df: DataFrame) -> DataFrame:
    """Zone-free timestamps, floating-point amounts, text for bytes."""
    plain = {"timestamp": "timestamp_ntz", "binary": "string", "decimal(10,2)": "double"}
    return df.select(*[
        F.col(name).cast(plain[kind]).alias(name) if kind in plain else F.col(name)
        for name, kind in df.dtypes
    ])


def _identity(df: DataFrame) -> DataFrame:
    return shown(df.select("topic", "kafka_partition", "offset", "kafka_timestamp_utc",
                           text("key_raw")))


def _events(spark: SparkSession, sf_dir: str, entity: Entity = ORDERS, dealt=None) -> DataFrame:
    return ev.events(raw_records(spark, sf_dir, entity, dealt), entity)


# --- landing --------------------------------------------------------------------------------

@query
def raw_landing_projection(spark, sf_dir):
    projected = project(kafka_records(spark, sf_dir, ORDERS))
    present = F.col("value_raw").isNotNull().alias("has_value")
    return shown(projected.select("*", present).drop("value_raw"))


@query
def raw_landing_stream(spark, sf_dir):
    source, out = stages.topic_files(spark, sf_dir, ORDERS), scratch(spark, "landing")
    catch_up(file_stream(spark, source), f"{out}/data", f"{out}/checkpoint")
    return _identity(landing_scan(spark, f"{out}/data"))


@query
def stream_available_now(spark, sf_dir):
    """Several bounded micro-batches, then a stop."""
    source, out = stages.topic_files(spark, sf_dir, PAYMENTS), scratch(spark, "landing")
    catch_up(file_stream(spark, source, max_files_per_trigger=3),
             f"{out}/data", f"{out}/checkpoint")
    return _identity(landing_scan(spark, f"{out}/data"))


@query
def stream_restart_no_dup(spark, sf_dir):
    """Three starts over a growing topic: each record is landed once."""
    records = kafka_records(spark, sf_dir, ORDERS)
    source, out = scratch(spark, "topic"), scratch(spark, "landing")
    early = F.col("partition") < 3
    for arrived in (records.where(early), records.where(~early), None):
        if arrived is not None:
            arrived.write.mode("append").parquet(source)
        catch_up(file_stream(spark, source), f"{out}/data", f"{out}/checkpoint")
    landed = landing_scan(spark, f"{out}/data")
    return landed.groupBy("topic", "kafka_partition", "offset").agg(F.count("*").alias("copies"))


@query
def stream_killed_before_commit(spark, sf_dir):
    """Micro-batches of which the last was written but not committed, as when a job is killed between the two;
    the next start repeats it, and each record is landed once."""
    source, out = stages.topic_files(spark, sf_dir, ORDERS), scratch(spark, "landing")
    for _ in range(2):
        catch_up(file_stream(spark, source, max_files_per_trigger=3), f"{out}/data", f"{out}/checkpoint")
        stages.forget_last_commit(spark, f"{out}/checkpoint")
    catch_up(file_stream(spark, source), f"{out}/data", f"{out}/checkpoint")
    landed = landing_scan(spark, f"{out}/data")
    return landed.groupBy("topic", "kafka_partition", "offset").agg(F.count("*").alias("copies"))


@query
def landing_root_scan(spark, sf_dir):
    root = stages.landing(spark, sf_dir, ORDERS, scattered=True)
    return shown(landing_scan(spark, root).select(
        "topic", "kafka_partition", "offset", "kafka_timestamp_utc", "ingested_at_utc",
        LANDING_DATE))


@query
def landing_partition_scan(spark, sf_dir):
    """Records of the dates asked for, by one pruned scan."""
    root = stages.landing(spark, sf_dir, PAYMENTS, scattered=False)
    days = stages.landing_dates(spark, root)
    return landing_scan(spark, root, days).groupBy(LANDING_DATE).agg(
        F.count("*").alias("records"), F.count("value_raw").alias("changes"))


# --- records to events ----------------------------------------------------------------------

@query
def cdc_decode(spark, sf_dir):
    decoded = ev.decode(raw_records(spark, sf_dir, ORDERS))
    def found(path: str) -> Column:
        wrapped = F.get_json_object("value_json", f"$.payload.{path}")
        return F.coalesce(wrapped, F.get_json_object("value_json", f"$.{path}"))

    return shown(decoded.select(
        "topic", "kafka_partition", "offset", "kafka_timestamp_utc", "key_json",
        F.col("value_json").startswith('{"payload":').alias("wrapped"),
        found("op").alias("op"), found("source.lsn").alias("lsn")))


@query
def cdc_parse(spark, sf_dir):
    parsed = ev.parse(ev.decode(raw_records(spark, sf_dir, ORDERS)), ORDERS)
    return shown(parsed.select(
        "*",
        F.col("before.status_order").alias("before_status"),
        F.col("after.status_order").alias("after_status"),
        F.col("after.id_order").alias("after_id"),
    ).drop("before", "after"))


@query
def cdc_before_after(spark, sf_dir):
    parsed = ev.parse(ev.decode(raw_records(spark, sf_dir, ORDERS)), ORDERS)
    return ev.with_image(parsed, ORDERS).select(
        "topic", "kafka_partition", "offset", "cdc_operation", "id_order", "id_client",
        "status_order")


@query
def cdc_normalize(spark, sf_dir):
    return shown(_events(spark, sf_dir))


@query
def cdc_quarantine(spark, sf_dir):
    """Order changes mixed with documents and event properties sent to the same topic."""
    def stray(name: str, key: str, value: str) -> DataFrame:
        rows = table(spark, sf_dir, name)
        return rows.select(
            F.lit(name).alias("topic"), F.lit(0).alias("kafka_partition"),
            F.col(key).alias("offset"), F.lit(None).cast("timestamp").alias("kafka_timestamp_utc"),
            F.col(key).cast("string").cast("binary").alias("key_raw"),
            F.col(value).cast("binary").alias("value_raw"))

    def spoilt(name: str, field: str, value: str) -> Column:
        """Topic and value of an order change in which every value of one field is replaced."""
        body = F.regexp_replace("text", rf'"{field}":("[^"]*"|[0-9]+)', f'"{field}":{value}')
        return F.struct(F.lit(name).alias("topic"), body.cast("binary").alias("value_raw"))

    columns = stray("events", "event_id", "props").columns
    orders = raw_records(spark, sf_dir, ORDERS, spread).withColumn("text", F.col("value_raw").cast("string"))
    # Each change is made once and sent five times.
    sent = orders.select(*[c for c in columns if c not in ("topic", "value_raw")], F.inline(F.array(
        F.struct("topic", "value_raw"), spoilt("no_position", "lsn", "null"), spoilt("no_key", "id_order", "null"),
        spoilt("no_time", "created_at", '"never"'), spoilt("no_amount", "amount", '"!"'))))
    mixed = (
        sent.select(*columns)
        .unionByName(stray("documents", "doc_id", "text"))
        .unionByName(stray("events", "event_id", "props"))
    )
    rejected = ev.quarantine(ev.parse(ev.decode(mixed), ORDERS), ORDERS)
    return rejected.groupBy("topic", "reject_reason").agg(F.count("*").alias("records"))


@query
def envelope_drift(spark, sf_dir):
    """Order changes in which a field is renamed, an amount is a number, a position is text or a field is
    added, a partition each, and documents sent to a topic of changes."""
    def changed(partition: int, pattern: str, to: str) -> Column:
        return F.when(F.col("kafka_partition") == partition, F.regexp_replace("value_json", pattern, to))

    decoded = ev.decode(raw_records(spark, sf_dir, ORDERS))
    value = F.coalesce(
        changed(1, '"status_order":', '"state_order":'), changed(2, '"amount":"[^"]*"', '"amount":1.5'),
        changed(3, '"lsn":([0-9]+)', '"lsn":"$1"'), changed(4, '"op":', '"extra":{"a":[1,"x",{}]},"op":'),
        F.col("value_json"))
    texts = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(
        F.lit("documents").alias("topic"), F.lit(None).cast("timestamp").alias("kafka_timestamp_utc"),
        F.concat(F.lit("text: "), "text").alias("value_json"))
    sent = decoded.select("topic", "kafka_timestamp_utc", value.alias("value_json")).unionByName(texts)
    return shown(drift.drift(sent, ORDERS))


@query
def connect_decimal_decode(spark, sf_dir):
    """Amounts of three tables through their encoded form, by both widths."""
    def amounts(name: str, key: str, amount: str) -> DataFrame:
        rows = table(spark, sf_dir, name)
        cents = F.round(F.col(amount) * 100).cast("bigint")
        return rows.select(F.lit(name).alias("source"), F.col(key).alias("id"),
                           encoded(cents).alias("encoded"))

    rows = (
        amounts("orders", "o_orderkey", "o_totalprice")
        .unionByName(amounts("customer", "c_custkey", "c_acctbal"))
        .unionByName(amounts("supplier", "s_suppkey", "s_acctbal"))
    )
    narrow = connect_decimal(F.col("encoded"), 10, 2)
    wide = connect_decimal(F.col("encoded"), 38, 2)
    return rows.select("source", "id", narrow.cast("string").alias("amount"),
                       wide.cast("string").alias("wide_amount"))


@query
def op_profile(spark, sf_dir):
    out = ev.operation_profile(_events(spark, sf_dir, ORDERS))
    for entity in (PAYMENTS, REFUNDS):
        out = out.unionByName(ev.operation_profile(_events(spark, sf_dir, entity)))
    return out


# --- current state --------------------------------------------------------------------------

@query
def orders_current(spark, sf_dir):
    return shown(state.latest(_events(spark, sf_dir), ORDERS))


@query
def orders_current_active(spark, sf_dir):
    return shown(state.active(state.latest(_events(spark, sf_dir), ORDERS)))


@query
def orders_current_shuffled(spark, sf_dir):
    return shown(state.latest(_events(spark, sf_dir).repartition(7), ORDERS))


@query
def orders_current_incremental(spark, sf_dir):
    """Later records first, then the earlier ones, then some again, folded step by step."""
    happened = written(_events(spark, sf_dir), "events")
    changed = F.col("cdc_operation").isin("u", "d")
    now = state.latest(happened.where(changed), ORDERS)
    for batch in (happened.where(~changed), happened.where(changed)):
        now = state.fold(now, batch, ORDERS)
    return shown(now)


@query
def payments_current(spark, sf_dir):
    return shown(state.latest(_events(spark, sf_dir, PAYMENTS), PAYMENTS))


@query
def refunds_current(spark, sf_dir):
    return shown(state.latest(_events(spark, sf_dir, REFUNDS), REFUNDS))


# --- history --------------------------------------------------------------------------------

@query
def orders_history(spark, sf_dir):
    """Every record delivered twice, kept once."""
    happened = _events(spark, sf_dir)
    return shown(past.distinct_events(happened.unionByName(happened)))


def _consolidation(spark, sf_dir) -> tuple[Consolidation, list]:
    root = stages.landing(spark, sf_dir, ORDERS, scattered=True)
    source = stages.publisher(spark, ORDERS, root)
    days = stages.landing_dates(spark, root)
    source.publish(days)
    return Consolidation(spark, ORDERS, source, scratch(spark, "consolidated")), days


def _measured(spark, sf_dir) -> Consolidation:
    """A history whose dates were built in two steps, some of its records landed on two dates."""
    root = stages.landing(spark, sf_dir, ORDERS, scattered=True)
    stages.land_again(spark, root)
    source = stages.publisher(spark, ORDERS, root)
    days = stages.landing_dates(spark, root)
    source.publish(days)
    job = Consolidation(spark, ORDERS, source, scratch(spark, "consolidated"))
    job.reprocess(days[2:])
    job.reprocess(days[:2])
    return job


@query
def history_reprocess_date(spark, sf_dir):
    """Dates built, then each built again: the history stays the same."""
    job, days = _consolidation(spark, sf_dir)
    job.reprocess(days)
    job.reprocess(days[:1])
    job.reprocess(days)
    return shown(job.history())


@query
def consolidated_current(spark, sf_dir):
    """Published runs folded into the stored current state in two batches, newer first."""
    job, days = _consolidation(spark, sf_dir)
    half = len(days) // 2
    job.apply(days[half:])
    job.apply(days[:half])
    return shown(job.current())


@query
def orders_current_table(spark, sf_dir):
    """The same through SQL, over a base, a repeated delta and a later one."""
    job, days = _consolidation(spark, sf_dir)
    half = len(days) // 2
    job.apply(days[half:])
    job.compact()
    job.apply(days[half:])
    job.apply(days[:half])
    return shown(spark.sql(f"SELECT * FROM {job.view()}"))


@query
def history_unique(spark, sf_dir):
    """Two partitions are landed again a quarter later; history is built newest dates first."""
    root = stages.landing(spark, sf_dir, ORDERS, scattered=True)
    stages.land_again(spark, root)
    source = stages.publisher(spark, ORDERS, root)
    days = stages.landing_dates(spark, root)
    source.publish(days)
    job = Consolidation(spark, ORDERS, source, scratch(spark, "consolidated"))
    half = len(days) // 2
    job.reprocess(days[half:])
    job.reprocess(days[:half])
    return shown(job.history())


@query
def history_side_by_side(spark, sf_dir):
    """Records landed again a quarter later, their dates rebuilt by two jobs: the second runs
    while the first is about to name its runs."""
    root = stages.landing(spark, sf_dir, ORDERS, scattered=True)
    stages.land_again(spark, root)
    source = stages.publisher(spark, ORDERS, root)
    days = stages.landing_dates(spark, root)
    source.publish(days)
    half, place = len(days) // 2, scratch(spark, "consolidated")
    other = Consolidation(spark, ORDERS, source, place)
    first = stages.InterruptedConsolidation(spark, ORDERS, source, place, meanwhile=lambda: other.reprocess(days[half:]))
    first.reprocess(days[:half])
    return shown(first.history())


@query
def current_rebuilt_partial_history(spark, sf_dir):
    """All dates folded, one of them in the history, and the state rebuilt from it: nothing is lost."""
    job, days = _consolidation(spark, sf_dir)
    half = len(days) // 2
    job.apply(days[half:])
    job.apply(days[:half])
    job.reprocess(days[:1])
    job.rebuild()
    return shown(job.current())


@query
def history_profile(spark, sf_dir):
    """Profile of a history from the measures stored beside it. Its dates hold some events twice."""
    return _measured(spark, sf_dir).operation_profile()


@query
def history_audit(spark, sf_dir):
    """Domain rules broken in a history, from the measures stored beside it."""
    return _measured(spark, sf_dir).domain_audit()


@query
def history_estimates(spark, sf_dir):
    """Sketches stored per date and merged: whether keys and quantiles are as close as they should be."""
    job = _measured(spark, sf_dir)
    late = F.unix_millis("kafka_timestamp_utc") - F.col("source_ts_ms")
    happened = job.history().select("topic", "id_order", late.alias("late"))
    keys = happened.groupBy("topic").agg(F.count_distinct("id_order").alias("keys"))
    told = F.broadcast(job.estimates())  # a row per topic

    def near(estimate: str, rank: float) -> Column:
        """Whether the estimated quantile lies within a fiftieth of its rank."""
        below = F.count_if(F.col("late") < F.col(estimate)) / F.count("late")
        upto = F.count_if(F.col("late") <= F.col(estimate)) / F.count("late")
        return (below <= rank + 0.02) & (upto >= rank - 0.02)

    ranks = happened.join(told, "topic").groupBy("topic", "distinct_keys").agg(
        near("median_ms", 0.5).alias("median_near"), near("p99_ms", 0.99).alias("p99_near"))
    return ranks.join(keys, "topic").select(
        "topic", (F.abs(F.col("distinct_keys") / F.col("keys") - 1) < 0.05).alias("keys_near"),
        "median_near", "p99_near")


@query
def current_value_audit(spark, sf_dir):
    """A state with the right positions in which cancelled orders count as delivered."""
    happened = _events(spark, sf_dir)
    now = state.latest(happened, ORDERS)
    wrong = F.when(F.col("status_order") == "CANCELLED", "DELIVERED").otherwise(F.col("status_order"))
    found = quality.current_audit(now.withColumn("status_order", wrong), happened, ORDERS)
    return found.groupBy("verdict").agg(F.count("*").alias("keys"))


@query
def current_audit(spark, sf_dir):
    """A state that ignored deletes, held against history."""
    happened = _events(spark, sf_dir)
    stale = state.latest(happened.where(F.col("cdc_operation") != "d"), ORDERS)
    found = quality.current_audit(stale, happened, ORDERS)
    return found.groupBy("verdict").agg(F.count("*").alias("keys"))


@query
def orders_versions(spark, sf_dir):
    """Every version of every order, with the position at which the next one replaced it."""
    return versions.versions(_events(spark, sf_dir), ORDERS).select(
        "id_order", "status_order", "cdc_operation", "source_lsn", "offset", "valid_to_lsn")


@query
def orders_at_position(spark, sf_dir):
    """The table of orders as it stood when the log had reached the middle of its orders."""
    valid = versions.versions(_events(spark, sf_dir), ORDERS)
    middle = table(spark, sf_dir, "orders").agg((F.max("o_orderkey") * 500).alias("lsn")).first().lsn
    return versions.at_position(valid, middle + 2).select("id_order", "status_order", "cdc_operation", "source_lsn")


@query
def orders_as_of(spark, sf_dir):
    """Payment events with the order's state at their position. Orders count as divided keys from four rows on."""
    payments = _events(spark, sf_dir, PAYMENTS, spread).select(
        "id_payment", "id_order", "status_payment", "source_lsn", "offset")
    orders = _events(spark, sf_dir, dealt=spread).where("source_lsn % 1000 <> 0")  # inserts are not known
    seen = orders.select("id_order", "source_lsn", "offset", "status_order",
                         F.col("source_lsn").alias("order_lsn"), F.col("offset").alias("order_offset"))
    return versions.as_of(payments, seen, "id_order", "source_lsn", "offset",
                          ("status_order", "order_lsn", "order_offset"), hot=4)


# --- fingerprints and layers ----------------------------------------------------------------

@query
def fingerprint(spark, sf_dir):
    """The hash sum is held against a sum of decimals, row by row."""
    raw = raw_records(spark, sf_dir, ORDERS)
    for entity in (PAYMENTS, REFUNDS):
        raw = raw.unionByName(raw_records(spark, sf_dir, entity))
    plain = raw.groupBy(*prints.GROUP).agg(F.sum(F.xxhash64(*IDENTITY).cast("decimal(38,0)")).alias("plain_sum"))
    return prints.fingerprint(raw).join(plain, list(prints.GROUP)).select(
        *prints.GROUP, "row_count", "min_offset", "max_offset",
        (F.col("hash_sum") == F.col("plain_sum")).alias("hash_agrees"))


@query
def fingerprint_diff(spark, sf_dir):
    """Orders lose their tombstones, refunds arrive doubled, payments are intact."""
    orders, payments, refunds = (raw_records(spark, sf_dir, e) for e in ALL)
    sent = orders.unionByName(payments).unionByName(refunds)
    kept = orders.where(F.col("value_raw").isNotNull())
    arrived = kept.unionByName(payments).unionByName(refunds).unionByName(refunds)
    found = prints.difference(prints.fingerprint(sent), prints.fingerprint(arrived))
    return found.drop("input_hash_sum", "output_hash_sum")


BLOCK_BITS = 8  # small blocks, as the derived topics are short


def _damaged(records: DataFrame) -> DataFrame:
    """Records of some blocks lost, of others doubled."""
    block = F.shiftright("offset", BLOCK_BITS)
    kept = records.where(~((block % 5 == 2) & (F.col("offset") % 3 == 0)))
    return kept.unionByName(kept.where((block % 7 == 3) & (F.col("offset") % 8 == 0)))


@query
def fingerprint_blocks(spark, sf_dir):
    """Blocks of offsets in which orders and payments arrived unlike they were sent, by stored trees."""
    sent = raw_records(spark, sf_dir, ORDERS).unionByName(raw_records(spark, sf_dir, PAYMENTS))
    places = []
    for records in (sent, _damaged(sent)):
        places.append(scratch(spark, "tree"))
        blocks.keep(blocks.tree(blocks.leaves(records, BLOCK_BITS)), places[-1])
    found = blocks.differing(*[blocks.kept(spark, p) for p in places])
    return blocks.bounds(found, BLOCK_BITS).drop("block")


@query
def layer_reconcile_blocks(spark, sf_dir):
    """Changes against an event layer that lost and doubled some; only differing blocks are opened."""
    raw = raw_records(spark, sf_dir, ORDERS)
    layers_ = []
    for name, records in (("changes", raw.where(F.col("value_raw").isNotNull())),
                          ("events", _damaged(ev.events(raw, ORDERS)))):
        path = scratch(spark, name)
        records.select(*IDENTITY).sortWithinPartitions(*IDENTITY).write.parquet(path)
        layers_.append(spark.read.parquet(path))
    trees = [blocks.tree(blocks.leaves(layer, BLOCK_BITS)) for layer in layers_]
    return blocks.reconcile_blocks(*layers_, blocks.differing(*trees), BLOCK_BITS)


@query
def offset_gaps(spark, sf_dir):
    """Stretches of offsets that none of three topics holds; refunds were landed twice."""
    orders, payments, refunds = (raw_records(spark, sf_dir, e) for e in ALL)
    return offsets.gaps(orders.unionByName(payments).unionByName(refunds).unionByName(refunds))


@query
def offset_coverage(spark, sf_dir):
    """Rows and different offsets per topic partition; refunds were landed twice."""
    orders, payments, refunds = (raw_records(spark, sf_dir, e) for e in ALL)
    landed = orders.unionByName(payments).unionByName(refunds).unionByName(refunds)
    return offsets.coverage(offsets.presence(landed))


@query
def raw_uniqueness(spark, sf_dir):
    """Line items taken as records: order, line number and flag do not identify them."""
    return prints.duplicates(table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("topic"),
        F.col("l_linenumber").alias("kafka_partition"),
        F.col("l_orderkey").alias("offset")))


@query
def layer_reconcile(spark, sf_dir):
    """Raw records against an event layer in which updates were doubled."""
    raw = raw_records(spark, sf_dir, ORDERS)
    happened = ev.events(raw, ORDERS)
    layer = happened.unionByName(happened.where(F.col("cdc_operation") == "u"))
    return quality.reconcile(raw, layer)


@query
def file_layout(spark, sf_dir):
    """Files per date from the listing, next to their rows from the read."""
    root = stages.landing(spark, sf_dir, ORDERS, scattered=True)
    listed = layers.file_layout(spark, root).groupBy(LANDING_DATE).agg(
        F.count("*").alias("files"), F.every(F.col("file_bytes") > 0).alias("sized"))
    day = F.to_date(F.regexp_extract("file_path", LANDING_DATE + "=([0-9-]+)", 1)).alias(LANDING_DATE)
    read = files_of(landing_scan(spark, root)).groupBy(day).agg(F.sum("file_rows").alias("file_rows"))
    return listed.join(read, LANDING_DATE)


@query
def output_layout(spark, sf_dir):
    """Files of compacted runs with the rows each holds."""
    root = stages.landing(spark, sf_dir, ORDERS, scattered=True)
    job = stages.publisher(spark, ORDERS, root)
    done = job.publish(stages.landing_dates(spark, root))
    paths = [r[0] for r in done.select("published_path").collect()]
    day = F.to_date(F.regexp_extract("file_path", LANDING_DATE + "=([0-9-]+)", 1)).alias(LANDING_DATE)
    return files_of(run_scan(spark, job.compacted, paths)).groupBy(day).agg(
        F.count("*").alias("files"), F.every(F.col("file_bytes") > 0).alias("sized"),
        F.sum("file_rows").alias("file_rows"))


@query
def compaction_policy(spark, sf_dir):
    """Documents as files of 4 KB per character, grouped by source and language."""
    layout = table(spark, sf_dir, "documents").select(
        "source", "lang", (F.col("n_chars") * 4096).alias("file_bytes"))
    return policy(layout, by=("source", "lang"))


# --- publication ----------------------------------------------------------------------------

def _publish(spark, sf_dir, entity, scattered, kind=Publisher, **choices):
    root = stages.landing(spark, sf_dir, entity, scattered)
    job = stages.publisher(spark, entity, root, kind, **choices)
    try:
        job.publish(stages.landing_dates(spark, root))
    except PublicationRejected:
        pass
    return job


def _verdicts(job: Publisher) -> DataFrame:
    return job.in_force().select(
        "dataset", "partition_date", "status", "operation", "input_files", "output_files",
        "input_rows", "output_rows", F.col("validation.result").alias("validation"),
        F.col("published_path").isNotNull().alias("published"))


@query
def publish_run(spark, sf_dir):
    return _verdicts(_publish(spark, sf_dir, ORDERS, scattered=True))


@query
def publish_rejected(spark, sf_dir):
    job = _publish(spark, sf_dir, ORDERS, scattered=True, kind=stages.LossyPublisher)
    return _verdicts(job).drop("input_files", "output_files")


@query
def publish_doubled(spark, sf_dir):
    job = _publish(spark, sf_dir, PAYMENTS, scattered=True, kind=stages.DoublingPublisher)
    return _verdicts(job).drop("input_files", "output_files")


@query
def publish_no_data(spark, sf_dir):
    """The day after each landing date, on which nothing has landed."""
    root = stages.landing(spark, sf_dir, PAYMENTS, scattered=False)
    job = stages.publisher(spark, PAYMENTS, root)
    job.publish([d + timedelta(days=1) for d in stages.landing_dates(spark, root)])
    return job.in_force().select("dataset", "partition_date", "status", "operation", "input_rows", "output_rows",
                                 F.col("published_path").isNotNull().alias("published"))


@query
def publish_error_captured(spark, sf_dir):
    """A publication that crashes after its runs are written."""
    root = stages.landing(spark, sf_dir, REFUNDS, scattered=False)
    job = stages.publisher(spark, REFUNDS, root, stages.CrashingPublisher)
    try:
        job.publish(stages.landing_dates(spark, root)[:2])
    except OSError:
        pass
    return job.in_force().select("dataset", "partition_date", "status", "error",
                                 F.col("published_path").isNotNull().alias("published"))


@query
def orphan_runs(spark, sf_dir):
    """Runs that a publication left which crashed on two dates, together and then one by one; all
    dates are published afterwards."""
    root = stages.landing(spark, sf_dir, REFUNDS, scattered=True)
    days = stages.landing_dates(spark, root)
    crashing = stages.publisher(spark, REFUNDS, root, stages.CrashingPublisher)
    try:
        crashing.publish(days[:2])
    except OSError:
        pass
    job = Publisher(spark, crashing.dataset, root, crashing.compacted, crashing.ledger_path)
    job.publish(days)
    return sweep.orphan_runs(job, older_than=timedelta(0)).groupBy(F.col(LANDING_DATE).alias("partition_date")).agg(
        F.count("*").alias("runs"), F.every(F.col("bytes") > 0).alias("sized"))


@query
def published_after_failed_republish(spark, sf_dir):
    """Late records, and a republication of all dates that fails: the first one stays visible."""
    root = stages.landing(spark, sf_dir, PAYMENTS, scattered=False)
    job = stages.publisher(spark, PAYMENTS, root)
    days = stages.landing_dates(spark, root)
    job.publish(days)
    stages.land_late(spark, sf_dir, PAYMENTS, root)
    rows = job.in_force().select("seq", "run_id", "started_at", "partition_date").collect()
    failed = [dict.fromkeys(LEDGER.fieldNames()) | r.asDict() | {
        "dataset": job.dataset, "seq": r.seq + 1, "status": "FAILED"} for r in rows]
    ledger.record(spark.createDataFrame(failed, LEDGER), job.ledger_path)
    return _identity(job.published())


@query
def published_after_late_files(spark, sf_dir):
    """Records that land after a publication in place stay hidden until republished."""
    root = stages.landing(spark, sf_dir, PAYMENTS, scattered=False)
    job = stages.publisher(spark, PAYMENTS, root)
    job.publish(stages.landing_dates(spark, root))
    stages.land_late(spark, sf_dir, PAYMENTS, root)
    return _identity(job.published())


@query
def ledger_tie_break(spark, sf_dir):
    """Events as ledger states that share their number: the one started last counts."""
    happened = table(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    states = happened.select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("dataset"),
        F.to_date(at).alias("partition_date"), F.lit(1).cast("long").alias("seq"), at.alias("started_at"),
        F.col("event_id").cast("string").alias("run_id"), F.col("event_type").alias("status"))
    return shown(ledger.latest(states.repartition(9)))


@query
def landing_backfill(spark, sf_dir):
    """Half of the partitions come by the stream, the others by a backfill beside it."""
    records, out = kafka_records(spark, sf_dir, PAYMENTS), scratch(spark, "landing")
    streamed = F.col("partition") < 3
    records.where(streamed).write.parquet(f"{out}/topic")
    catch_up(file_stream(spark, f"{out}/topic"), f"{out}/stream", f"{out}/checkpoint")
    land_batch(records.where(~streamed), f"{out}/backfill")
    job = stages.publisher(spark, PAYMENTS, f"{out}/stream", backfills=(f"{out}/backfill",))
    days = layers.landings_scan(spark, job.landings).select(LANDING_DATE).distinct().collect()
    job.publish([r[0] for r in days])
    return _identity(job.published())


@query
def publish_compacted(spark, sf_dir):
    """Limits so small that every date takes several files."""
    limits = Thresholds(target_bytes=20_000, small_bytes=15_000, min_small_files=0, fragmentation=0)
    job = _publish(spark, sf_dir, ORDERS, scattered=True, limits=limits)
    return _identity(job.published())


@query
def publish_passthrough(spark, sf_dir):
    return _identity(_publish(spark, sf_dir, PAYMENTS, scattered=False).published())


@query
def publish_materialized(spark, sf_dir):
    job = _publish(spark, sf_dir, REFUNDS, scattered=False, materialize=True, payload=True)
    return _identity(job.published())


@query
def published_read(spark, sf_dir):
    """What each of two publications shows: one sound, one with rejected dates."""
    sound = _publish(spark, sf_dir, PAYMENTS, scattered=False).published()
    lossy = _publish(spark, sf_dir, ORDERS, scattered=True, kind=stages.LossyPublisher).published()
    return sound.unionByName(lossy).groupBy("topic", LANDING_DATE).agg(
        F.count("*").alias("records"))


@query
def publication_ledger(spark, sf_dir):
    """All states recorded on the way, in order."""
    job = _publish(spark, sf_dir, PAYMENTS, scattered=False)
    return ledger.read(spark, job.ledger_path).select(
        "dataset", "partition_date", "seq", "status", "operation", "input_rows")


@query
def control_documents(spark, sf_dir):
    """Facts read back from the JSON form of the states in force."""
    job = _publish(spark, sf_dir, PAYMENTS, scattered=False)
    document = ledger.documents(job.in_force())
    return document.select(
        "dataset", "partition_date",
        F.get_json_object("document", "$.status").alias("status"),
        F.get_json_object("document", "$.operation").alias("operation"),
        F.get_json_object("document", "$.input_rows").cast("bigint").alias("input_rows"),
        F.get_json_object("document", "$.validation.result").alias("validation"))


# Moment the admission query is asked at; the supplied events end a few hours later.
ADMISSION_NOW = datetime(2024, 1, 30, 20, 0, tzinfo=timezone.utc)


@query
def publication_admission(spark, sf_dir):
    """Events as ledger states: one dataset per user, one date per day."""
    happened = table(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    dataset = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    status = (
        F.when(F.col("event_type") == "purchase", "COMPLETED")
        .when(F.col("event_type") == "error", "FAILED")
        .when(F.col("event_type") == "view", "PAUSED")
        .otherwise("RUNNING")
    )
    states = happened.select(
        dataset.alias("dataset"), F.to_date(at).alias("partition_date"),
        F.col("event_id").alias("seq"), status.alias("status"), at.alias("started_at"),
        F.lit(None).cast("bigint").alias("input_rows"))
    next_day = states.select("dataset", F.date_add("partition_date", 1).alias("partition_date"))
    wanted = states.select("dataset", "partition_date").unionByName(next_day).distinct()
    return ledger.admission(wanted, ledger.latest(states), ADMISSION_NOW)


@query
def run_identifiers(spark, sf_dir):
    """Run identifier of every event's time."""
    happened = table(spark, sf_dir, "events")
    return happened.select("event_id", run_id_column(F.col("ts").cast("timestamp")).alias("run_id"))


# --- audits ---------------------------------------------------------------------------------

@query
def domain_audit(spark, sf_dir):
    """Sound order events, and customers taken for orders, whose balances and segments are
    outside the rules."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id_order"),
        F.col("c_name").alias("id_client"),
        F.col("c_mktsegment").alias("status_order"),
        F.col("c_acctbal").cast("decimal(10,2)").alias("amount"),
        F.lit("x").alias("cdc_operation"),
        F.lit("customer").alias("topic"),
        F.col("c_nationkey").cast("int").alias("kafka_partition"),
        F.col("c_custkey").alias("offset"))
    mixed = _events(spark, sf_dir).unionByName(customers, allowMissingColumns=True)
    return quality.domain_audit(mixed, ORDERS)


@query
def table_types(spark, sf_dir):
    """Types of a stored history, and of a copy with an amount as text, a column lost and one more."""
    job, days = _consolidation(spark, sf_dir)
    job.reprocess(days)
    path = scratch(spark, "retyped")
    history = job.history().select(*ORDERS.event_columns)
    history.withColumn("amount", F.col("amount").cast("string")).withColumn("note", F.lit("x")).drop(
        "updated_at").write.parquet(path)
    copy = quality.type_audit(spark.read.parquet(path), ORDERS.event_schema)
    return job.type_audit().select(F.lit("history").alias("table_name"), "*").unionByName(
        copy.select(F.lit("copy").alias("table_name"), "*"))


@query
def referential_audit(spark, sf_dir):
    """Payments of deleted orders, and refunds of deleted payments."""
    orders, payments, refunds = (
        state.active(state.latest(_events(spark, sf_dir, e), e)) for e in ALL)
    lost = quality.referential_audit(payments, "id_order", orders, "id_order", ["id_payment"])
    unpaid = quality.referential_audit(
        refunds, "id_payment", payments, "id_payment", ["id_refund"])
    return lost.select(F.lit("payments").alias("child"), F.col("id_payment").alias("child_id"),
                       F.col("id_order").alias("parent_id")).unionByName(
        unpaid.select(F.lit("refunds").alias("child"), F.col("id_refund").alias("child_id"),
                      F.col("id_payment").alias("parent_id")))


@query
def referential_audit_bucketed(spark, sf_dir):
    """Payments of deleted orders, from an index of references that lies as the orders' state does."""
    jobs = {}
    for entity in (ORDERS, PAYMENTS):
        root = stages.landing(spark, sf_dir, entity, scattered=False)
        source = stages.publisher(spark, entity, root)
        days = stages.landing_dates(spark, root)
        source.publish(days)
        jobs[entity.name] = Consolidation(spark, entity, source, scratch(spark, "consolidated"))
        jobs[entity.name].apply(days)
    orders, payments = jobs["orders"], jobs["payments"]
    payments.index_references(orders.buckets)
    return payments.referential_audit(orders)


# --- catalog --------------------------------------------------------------------------------

@query
def table_roundtrip(spark, sf_dir):
    """Create, insert, select in order, drop."""
    source = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("description"))
    name = "roundtrip_" + scratch(spark, "t")[-32:]
    tables.create_table(spark, name, source.schema, location=scratch(spark, name))
    try:
        tables.insert_rows(source, name)
        kept = written(spark.sql(f"SELECT id, description FROM {name} ORDER BY id"), "roundtrip")
    finally:
        tables.drop_table(spark, name)
    return kept


@query
def catalog_describe(spark, sf_dir):
    """The supplied tables registered in a namespace, listed, and counted by name."""
    space = "catalog_" + scratch(spark, "n")[-32:]
    spark.sql(f"CREATE NAMESPACE {space}")
    names = ("orders", "lineitem", "customer", "supplier", "nation", "region")
    for name in names:
        path = f"{sf_dir}/{name}.parquet"
        tables.create_table(spark, f"{space}.{name}", table(spark, sf_dir, name).schema, path)
    listed = tables.tables_in(spark, space)
    counted = None
    for name in names:
        one = spark.table(f"{space}.{name}").agg(F.count("*").alias("table_rows")).select(
            F.lit(name).alias("tableName"), "table_rows")
        counted = one if counted is None else counted.unionByName(one)
    described = tables.describe_namespace(spark, space).where(F.col("info_name").isin("Namespace Name"))
    out = written(
        listed.join(counted, "tableName").join(described, F.col("info_value") == F.col("namespace"))
        .select(F.col("tableName").alias("table_name"), "table_rows"), "catalog")
    spark.sql(f"DROP NAMESPACE {space} CASCADE")  # the tables are external: their files stay
    return out
