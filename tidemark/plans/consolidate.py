"""Published records to history and current state.

Both are written first and named last, by rows of append-only lists, so readers and
restarted jobs never meet a half-written table, and nothing is overwritten.

History is one run per landing date; the newest named run of a date counts. A run holds
exactly the date's own events, so it does not depend on what other dates hold. Events that
landed on several dates are listed apart, and readers keep their earliest copy. Measures of each run are
stored beside it: profile, audit and estimates of the whole history read those alone.

Current state is a base and the deltas written since. A fold writes its reduced batch as
one more delta; deltas gather in tiers, and ``compact`` makes a new base. Deltas can be merged in any order and any number of
times, so folds that run side by side lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.calendar import run_id as new_run_id
from tidemark.functions.calendar import utc_now
from tidemark.operators import current as state
from tidemark.operators import history as past
from tidemark.operators import offsets, quality
from tidemark.operators.events import events
from tidemark.plans.publish import Publisher, confirm
from tidemark.schemas import IDENTITY, LANDING_DATE, Entity
from tidemark.session import append, empty, written
from tidemark.sources.layers import existing, run_path
from tidemark.sources.tables import attach_bucketed, drop_table, write_bucketed

_BASE, _DELTA = "base", "delta"
_VERSIONS = ("version string, kind string, path string, buckets int, includes array<string>, "
             "dates array<date>, tier int, created_at timestamp")
_RUNS = f"{LANDING_DATE} date, run string, events bigint, created_at timestamp"
_PRESENCE = (f"{LANDING_DATE} date, run string, topic string, kafka_partition int, bucket bigint, rows bigint, "
             "from_offset bigint, to_offset bigint, bits binary")
_MEASURES = f"{LANDING_DATE} date, run string, {past.MEASURES}"
_INDEXES = "version string, path string, buckets int, created_at timestamp"
_REPEATED = "topic string, kafka_partition int, offset bigint"


@dataclass(frozen=True)
class Consolidation:
    """History and current state of one entity below ``root``.

    ``buckets`` sizes the current table: aim at a few hundred MB per bucket. ``fan`` deltas of a tier make one of the next.
    """

    spark: SparkSession
    entity: Entity
    publisher: Publisher
    root: str
    buckets: int = 8
    fan: int = 8

    @property
    def history_path(self) -> str:
        return f"{self.root}/history"

    def batch(self, dates: Iterable[date] | None = None) -> DataFrame:
        """Normalised events of the published dates, with their landing date."""
        return events(self.publisher.published(dates), self.entity, carry=(LANDING_DATE,))

    def _list(self, name: str, schema: str) -> DataFrame | None:
        """All rows ever added to a list; none before the first."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _add(self, rows: DataFrame, name: str, schema: str) -> None:
        """Rows appear in a list whole or not at all."""
        names = T.StructType.fromDDL(schema).fieldNames()
        append(rows.select(*names).coalesce(1).write, f"{self.root}/{name}")

    # -- history ------------------------------------------------------------------------

    def _runs(self) -> DataFrame | None:
        """The run in force of every date."""
        runs = self._list("history-runs", _RUNS)
        if runs is None:
            return None
        newest = F.max_by(F.struct("run", "events"), F.struct("created_at", "run"))
        return runs.groupBy(LANDING_DATE).agg(newest.alias("r")).select(LANDING_DATE, "r.*")

    def _rows_of(self, runs: DataFrame | None) -> DataFrame:
        """Events of the named runs, one row per date in ``runs``."""
        schema = self.entity.event_schema.add(LANDING_DATE, "date")
        paths = [] if runs is None else [
            run_path(self.history_path, r[LANDING_DATE], r.run)
            for r in runs.where("events > 0").orderBy(LANDING_DATE).collect()]
        if not paths:
            return empty(self.spark, schema)
        rows = self.spark.read.schema(schema).option("basePath", self.history_path).parquet(*paths)
        return rows.select(*schema.fieldNames())

    def history(self) -> DataFrame:
        """Every event once."""
        rows, repeated = self._rows_of(self._runs()), self._list("history-repeated", _REPEATED)
        return rows if repeated is None else past.without_repeats(rows, repeated)

    def reprocess(self, dates: Iterable[date]) -> None:
        """Rebuild the history of ``dates`` from what is published for them. A date without
        events any more loses those it had.

        The published records are first read by identity alone: the bitmaps of their offsets tell
        whether any record is there twice, and their number whether any is lost. The run is written, then its
        bitmaps are listed, then repeats are looked for among all listed runs, then it is named. Of two jobs
        side by side the one that lists later sees the other's bitmaps, whichever is named first.
        """
        days = sorted(set(dates))
        run, now = new_run_id(), utc_now()
        pointers = self.publisher.pointers(days)
        published = self.publisher.records_of(pointers)
        held = written(offsets.presence(published, (LANDING_DATE,)), "presence")
        confirm(held.groupBy(LANDING_DATE).agg(F.sum("rows").alias("rows")), pointers)
        batch = events(published, self.entity, carry=(LANDING_DATE,))
        if not held.where(F.col("rows") > F.bitmap_count("bits")).isEmpty():
            batch = past.once_per_date(batch, published.select(LANDING_DATE, *IDENTITY))
        rows = batch.withColumn("run_id", F.lit(run)).sortWithinPartitions("topic", "kafka_partition", "offset")
        append(rows.write.partitionBy(LANDING_DATE, "run_id"), self.history_path)
        found = self._existing_rows([(d, run) for d in days])
        self._add(past.measures(found, self.entity).withColumn("run", F.lit(run)), "history-measures", _MEASURES)
        self._add(held.withColumn("run", F.lit(run)), "history-presence", _PRESENCE)
        self._list_repeated(days, run)
        own = self._list("history-measures", _MEASURES).where(F.col("run") == run)
        counted = {r[0]: r[1] for r in own.groupBy(LANDING_DATE).agg(F.sum("events")).collect()}
        named = [(d, run, counted.get(d, 0), now) for d in days]
        self._add(self.spark.createDataFrame(named, _RUNS), "history-runs", _RUNS)

    def _existing_rows(self, runs: Iterable[tuple[date, str]]) -> DataFrame:
        """Events of the runs (date, run) that have any."""
        there = existing(self.spark, [run_path(self.history_path, d, run) for d, run in runs])
        schema = self.entity.event_schema.add(LANDING_DATE, "date")
        if not there:
            return empty(self.spark, schema)
        rows = self.spark.read.schema(schema).option("basePath", self.history_path).parquet(*there)
        return rows.select(*schema.fieldNames())

    def _replaced(self) -> set[tuple[date, str]]:
        """Named runs (date, run) that another one has replaced."""
        runs = self._list("history-runs", _RUNS)
        if runs is None:
            return set()
        named = {(r[LANDING_DATE], r.run) for r in runs.select(LANDING_DATE, "run").collect()}
        return named - {(r[LANDING_DATE], r.run) for r in self._runs().select(LANDING_DATE, "run").collect()}

    def _list_repeated(self, days: list[date], run: str) -> None:
        """Note identities that the new run and runs of other dates hold, or several dates of the new one.

        Runs in force count, and those listed but not named yet. Bitmaps of the same offsets tell whether any is set
        twice; normally none is, and no history is read.
        """
        presence = self._list("history-presence", _PRESENCE)
        span = presence.where(F.col("run") == run).agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")).first()
        if span.low is None:
            return
        near = presence.where(F.col("bucket").between(span.low, span.high)
                              & ((F.col("run") == run) | ~F.col(LANDING_DATE).isin(days)))
        replaced = self._replaced()
        if replaced:
            gone = self.spark.createDataFrame(list(replaced), f"{LANDING_DATE} date, run string")
            near = near.join(F.broadcast(gone), [LANDING_DATE, "run"], "left_anti")  # a row per date and rebuild
        place = ["topic", "kafka_partition", "bucket"]
        met = near.groupBy(*place).agg(
            F.sum(F.bitmap_count("bits")).alias("single"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("together"))
        shared = written(met.where("single > together").select(*place), "shared")
        if shared.isEmpty():
            return
        holders = near.join(shared, place, "left_semi").select(LANDING_DATE, "run").distinct().collect()
        rows = self._existing_rows([tuple(r) for r in holders]).withColumn(
            "bucket", F.shiftright("offset", offsets.BITS))
        counted = rows.join(shared, place, "left_semi").groupBy(*IDENTITY).agg(F.count("*").alias("copies"))
        repeated = written(counted.where("copies > 1").select(*IDENTITY), "repeated")
        if not repeated.isEmpty():
            self._add(repeated, "history-repeated", _REPEATED)

    # -- what history holds, without reading it -----------------------------------------------

    def measures(self) -> DataFrame:
        """Measures of the runs in force (``history.measures``). Where events are listed as repeated, measures of
        the copies that readers leave out are taken off, by negative numbers."""
        listed, runs = self._list("history-measures", _MEASURES), self._runs()
        if listed is None or runs is None:
            return empty(self.spark, T.StructType.fromDDL(_MEASURES)).drop("run")
        held = listed.join(runs.select(LANDING_DATE, "run"), [LANDING_DATE, "run"], "left_semi").drop("run")
        repeated = self._list("history-repeated", _REPEATED)
        if repeated is None:
            return held
        copies = self._rows_of(runs).join(repeated.select(*IDENTITY).distinct(), list(IDENTITY), "left_semi")
        kept = past.distinct_events(copies)
        columns = held.columns
        return held.unionByName(past.negative(past.measures(copies, self.entity)).select(*columns)).unionByName(
            past.measures(kept, self.entity).select(*columns))

    def operation_profile(self) -> DataFrame:
        """``events.operation_profile`` of the history."""
        return past.profile(self.measures())

    def domain_audit(self) -> DataFrame:
        """``quality.domain_audit`` of the history."""
        return past.violations(self.measures(), self.entity)

    def estimates(self) -> DataFrame:
        """Estimates per topic, over all dates, from stored sketches: different keys and quantiles of the
        milliseconds from the source's change to the log. Copies of an event change neither much."""
        return past.estimates(self.measures())

    # -- current state --------------------------------------------------------------------

    def type_audit(self) -> DataFrame:
        """``quality.type_audit`` of the stored files of the runs in force, which are read by their own schemas, not by
        the one stated here; files of one column in types that do not go together are an error of the read."""
        runs = self._runs()
        paths = [] if runs is None else [run_path(self.history_path, r[LANDING_DATE], r.run)
                                         for r in runs.where("events > 0").orderBy(LANDING_DATE).collect()]
        if not paths:
            return quality.type_audit(empty(self.spark, self.entity.event_schema), self.entity.event_schema)
        held = self.spark.read.option("mergeSchema", "true").option("basePath", self.history_path).parquet(*paths)
        return quality.type_audit(held.drop(LANDING_DATE, "run_id"), self.entity.event_schema)

    def _versions(self) -> tuple[Row | None, list[Row]]:
        """The base in force and the deltas that neither it nor a larger delta includes."""
        listed = self._list("current-versions", _VERSIONS)
        rows = [] if listed is None else listed.orderBy("created_at", "version").collect()
        base = max((r for r in rows if r.kind == _BASE), default=None, key=lambda r: (r.created_at, r.version))
        deltas = [r for r in rows if r.kind == _DELTA]
        seen = set(base.includes if base else ()).union(*[d.includes for d in deltas])
        return base, [r for r in deltas if r.version not in seen]

    def _table(self, version: Row) -> DataFrame:
        return attach_bucketed(self.spark, self._name(version.version), version.path,
                               self.entity.event_schema, self.entity.key, version.buckets)

    def _name(self, version: str) -> str:
        return f"{self.entity.name}_current_{version}"

    def current(self) -> DataFrame:
        """The current state: the base and its deltas, bucket by bucket; empty before the first fold."""
        base, deltas = self._versions()
        parts = ([base] if base else []) + deltas
        return self._merged(parts) if parts else empty(self.spark, self.entity.event_schema)

    def _merged(self, parts: list[Row]) -> DataFrame:
        # Joins, not one union: a union of bucketed scans is taken for bucketed, and keys then meet wrongly.
        return reduce(lambda a, b: state.merge(a, b, self.entity), [self._table(v) for v in parts])

    def view(self) -> str:
        """Name of a view over the state in force, for SQL; call again after a fold."""
        name = f"{self.entity.name}_current"
        self.current().createOrReplaceTempView(name)
        return name

    def folded_dates(self) -> list[date]:
        """Landing dates that the state holds."""
        base, deltas = self._versions()
        return sorted({d for v in ([base] if base else []) + deltas for d in v.dates})

    def rebuild(self) -> None:
        """Write a new base from the whole history.

        Deltas all of whose dates have a history are in it. The others stay in force beside it, and a base
        that holds dates without a history is merged into it, so nothing that was folded is lost.
        """
        base, deltas = self._versions()
        runs = self._runs()
        dates = set() if runs is None else {r[0] for r in runs.select(LANDING_DATE).collect()}
        rows = state.latest(self.history(), self.entity)
        if base and not dates.issuperset(base.dates):
            rows = state.merge(rows, self._table(base), self.entity)
            dates |= set(base.dates)
        self._write(rows, _BASE, sorted(dates), base, [d for d in deltas if dates.issuperset(d.dates)])

    def compact(self) -> None:
        """Write a new base from the base in force and its deltas."""
        base, deltas = self._versions()
        if deltas:
            self._write(self.current(), _BASE, self.folded_dates(), base, deltas)
            for old in [base, *deltas] if base else deltas:
                drop_table(self.spark, self._name(old.version))

    def apply(self, dates: Iterable[date]) -> None:
        """Fold the events of ``dates`` into the state, as a delta: from their history where
        that is built, else from what is published."""
        days = sorted(set(dates))
        runs = self._runs()
        built = None if runs is None else runs.where(F.col(LANDING_DATE).isin(days))
        source = self._rows_of(built) if built is not None and built.count() == len(days) else self.batch(days)
        self._write(state.latest(source, self.entity), _DELTA, days)
        self._gather()

    def _gather(self) -> None:
        """Merge ``fan`` deltas of a tier into one of the next, so that a state of n folds is read from fewer than
        ``fan`` parts a tier and each row is written once per tier. The base is not touched."""
        _, deltas = self._versions()
        for tier in range(max((d.tier for d in deltas), default=0) + 1):
            same = [d for d in deltas if d.tier == tier]
            if len(same) >= self.fan:
                days = sorted({day for d in same for day in d.dates})
                self._write(self._merged(same), _DELTA, days, deltas=same, tier=tier + 1)
                _, deltas = self._versions()

    # -- references to another entity ---------------------------------------------------------

    def index_references(self, buckets: int | None = None) -> None:
        """Write which active row names which row of the parent, bucketed by the latter as the parent's state
        is (``buckets``, by default as many as here)."""
        buckets, ref = buckets or self.buckets, self.entity.ref
        version = new_run_id().lower()
        path = f"{self.root}/references/{version}"
        named = state.active(self.current()).select(ref, self.entity.key).repartition(buckets, ref)
        write_bucketed(named, self._name(f"by_{ref}_{version}"), path, ref, buckets)
        self._add(self.spark.createDataFrame([(version, path, buckets, utc_now())], _INDEXES), "references-versions", _INDEXES)

    def referential_audit(self, parent: Consolidation) -> DataFrame:
        """Rows of the newest index that name no active row of ``parent``. Index and state lie in buckets of the same
        key, so the audit of a state of one part (as after ``compact``) moves neither."""
        listed = self._list("references-versions", _INDEXES)
        if listed is None:
            raise ValueError("no index of references: call index_references first")
        newest = max(listed.collect(), key=lambda r: (r.created_at, r.version))
        ref, key = self.entity.ref, self.entity.key
        schema = T.StructType([self.entity.event_schema[ref], self.entity.event_schema[key]])
        children = attach_bucketed(self.spark, self._name(f"by_{ref}_{newest.version}"), newest.path, schema, ref,
                                   newest.buckets)
        return quality.referential_audit(children, ref, state.active(parent.current()), parent.entity.key, [key])

    def _write(self, rows: DataFrame, kind: str, dates: list[date], base: Row | None = None,
               deltas: Iterable[Row] = (), tier: int = 0) -> None:
        now = utc_now()
        version = new_run_id(now).lower()
        path = f"{self.root}/current/{version}"
        write_bucketed(rows.repartition(self.buckets, self.entity.key), self._name(version), path,
                       self.entity.key, self.buckets)
        includes = [*(base.includes if base else []), *(d.version for d in deltas)]
        row = (version, kind, path, self.buckets, includes, sorted(dates), tier, now)
        self._add(self.spark.createDataFrame([row], _VERSIONS), "current-versions", _VERSIONS)
