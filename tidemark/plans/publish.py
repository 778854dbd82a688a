"""Publish landing dates as validated runs.

All admitted dates go through together: one listing, one rewrite, one fingerprint per
side. A date becomes visible by one ledger row, written after its run has proved equal to
the landing; whatever a crash leaves behind has no row and is never read.

The driver holds one row per date and nothing that grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import business_date, run_id, utc_now
from tidemark.operators import fingerprint as prints
from tidemark.operators import ledger
from tidemark.operators.compaction import Thresholds, policy
from tidemark.schemas import (
    COMPLETED,
    DO_COMPACTION,
    FAILED,
    IDENTITY,
    LANDING_DATE,
    LEDGER,
    NO_NEED,
    PASSED,
    RAW_LANDING,
    RUNNING,
    VALIDATION_METHOD,
)
from tidemark.session import append, empty, packed_session, written
from tidemark.sources.layers import (
    PublishedRunLost,
    existing,
    file_layout,
    landing_scan,
    landings_scan,
    raw_columns,
    run_path,
    run_scan,
)


ROW_GROUP = 8 * 1024 * 1024  # a file is taken to hold at most one row group per so many bytes, and one more
BRANCHES = 64  # dates of one file each that a plan names one by one


class PublicationRejected(RuntimeError):
    """A run does not hold exactly the records of its landing date."""


@dataclass
class Attempt:
    """One date's way through a publication; its fields become a ledger row."""

    dataset: str
    partition_date: date
    seq: int
    run_id: str
    started_at: datetime
    status: str = RUNNING
    facts: dict = field(default_factory=dict)

    def row(self) -> dict:
        self.seq += 1
        named = {name: getattr(self, name, None) for name in LEDGER.fieldNames()}
        return named | self.facts

    def validated(self, result: str) -> None:
        self.facts["validation"] = {
            "method": VALIDATION_METHOD,
            "identity_columns": list(IDENTITY),
            "result": result,
        }

    def finish(self, status: str, error: str | None = None) -> None:
        self.status = status
        self.facts |= {"finished_at": utc_now(), "error": error}


@dataclass(frozen=True)
class Publisher:
    """Publishes one dataset.

    A date that needs no rewrite is published in place: the ledger names the landing and
    the newest ingestion time validated, and readers take the date's records up to it.
    ``materialize`` writes such dates as runs of their own instead. ``payload`` extends
    the proof from identities to key and value bytes. ``backfills`` names further landings of
    the dataset, filled outside the stream; with them every date is written as a run, as
    ingestion times of two writers bound nothing.
    """

    spark: SparkSession
    dataset: str
    landing: str
    compacted: str
    ledger_path: str
    limits: Thresholds = Thresholds()
    stale_after: timedelta = ledger.STALE_AFTER
    payload: bool = False
    materialize: bool = False
    republish_grown: bool = False
    backfills: tuple[str, ...] = ()

    @property
    def landings(self) -> tuple[str, ...]:
        return (self.landing, *self.backfills)

    # -- reading ------------------------------------------------------------------------

    def in_force(self) -> DataFrame:
        states = ledger.read(self.spark, self.ledger_path)
        return ledger.latest(states.where(F.col("dataset") == self.dataset))

    def pointers(self, dates: Iterable[date] | None = None) -> list[Row]:
        """What is published, a row per date: partition_date, published_path, published_through, output_rows."""
        return pointers(self.spark, self.ledger_path, self.dataset, dates)

    def published(self, dates: Iterable[date] | None = None, verify: bool = False) -> DataFrame:
        """Records of the published runs; empty where nothing is published. ``verify`` counts them first."""
        named = self.pointers(dates)
        records = self.records_of(named)
        if verify:
            confirm(records.groupBy(LANDING_DATE).agg(F.count("*").alias("rows")), named)
        return records

    def records_of(self, named: list[Row]) -> DataFrame:
        return pointed_read(self.spark, named, self.landing, self.compacted)

    # -- publishing ---------------------------------------------------------------------

    def publish(self, dates: Iterable[date] | None = None, now: datetime | None = None) -> DataFrame:
        """Publish ``dates``, by default the day before today; return the states in force."""
        started = now or utc_now()
        attempts = self._admit(sorted(set(dates or [business_date(now=started)])), started)
        self._record(attempts)
        self._isolated(attempts)
        rejected = [str(a.partition_date) for a in attempts if a.status == FAILED]
        if rejected:
            raise PublicationRejected("fingerprint mismatch on " + ", ".join(rejected))
        return self.in_force()

    def _admit(self, dates: list[date], now: datetime) -> list[Attempt]:
        wanted = self.spark.createDataFrame(
            [(self.dataset, d) for d in dates], "dataset string, partition_date date"
        )
        landed = None
        if self.republish_grown:
            counts = landings_scan(self.spark, self.landings, dates).groupBy(LANDING_DATE)
            landed = counts.agg(F.count("*").alias("landed_rows")).select(
                F.lit(self.dataset).alias("dataset"),
                F.col(LANDING_DATE).alias("partition_date"), "landed_rows")
        verdicts = ledger.admission(wanted, self.in_force(), now, self.stale_after, landed)
        rows = verdicts.orderBy("partition_date").collect()
        unknown = [r for r in rows if r.verdict == ledger.UNKNOWN_STATUS]
        if unknown:
            raise ValueError(f"unknown status {unknown[0].status} on {unknown[0].partition_date}")
        run = run_id()  # from the clock, not from ``now``: a repeated call never reuses a run
        return [Attempt(self.dataset, r.partition_date, r.seq, run, now)
                for r in rows if r.verdict in ledger.ADMITTED]

    def _record(self, attempts: list[Attempt]) -> None:
        if attempts:
            rows = self.spark.createDataFrame([a.row() for a in attempts], LEDGER)
            ledger.record(rows, self.ledger_path)

    def _run(self, attempts: list[Attempt]) -> None:
        by_date = {a.partition_date: a for a in attempts}
        layout = reduce(DataFrame.unionByName, [
            file_layout(self.spark, root, list(by_date)) for root in self.landings])
        decisions = {r[LANDING_DATE]: r for r in policy(layout, limits=self.limits).collect()}

        no_data = [a for d, a in by_date.items() if d not in decisions]
        for attempt in no_data:
            attempt.facts |= dict.fromkeys(
                ("input_files", "output_files", "input_bytes", "output_bytes",
                 "input_rows", "output_rows"), 0)
            attempt.finish(COMPLETED)
        self._record(no_data)

        filled = [by_date[d] for d in sorted(decisions)]
        for attempt in filled:
            decision = decisions[attempt.partition_date]
            attempt.facts |= {
                "operation": decision.operation,
                "input_files": decision.input_files,
                "input_bytes": decision.input_bytes,
            }
        self._record(filled)
        if not filled:
            return

        records = landings_scan(self.spark, self.landings, [a.partition_date for a in filled])
        rewritten = [a for a in filled if self.materialize or self.backfills
                     or a.facts["operation"] == DO_COMPACTION]
        packed = landings_scan(packed_session(self.spark, self.limits.target_bytes), self.landings,
                               [a.partition_date for a in filled])
        self.write_runs(packed, {a.partition_date: self._file_count(decisions, a)
                                 for a in rewritten}, run=filled[0].run_id)
        self._validate(records, filled, rewritten)
        self._record(filled)

    def _isolated(self, attempts: list[Attempt]) -> None:
        """Run all dates together; after a failure, those still open by halves, so that only
        the dates at fault fail. The error of the first of them is raised in the end."""
        try:
            self._run(attempts)
        except Exception as error:
            open_ones = [a for a in attempts if a.status == RUNNING]
            if len(open_ones) < 2:
                for attempt in open_ones:
                    attempt.finish(FAILED, str(error))
                self._record(open_ones)
                raise
            failed = None
            half = len(open_ones) // 2
            for part in (open_ones[:half], open_ones[half:]):
                again = run_id()  # what the failed write left behind belongs to no run
                for attempt in part:
                    attempt.run_id = again
                try:
                    self._isolated(part)
                except Exception as inner:
                    failed = failed or inner
            if failed:
                raise failed from error

    def _file_count(self, decisions: dict, attempt: Attempt) -> int | None:
        if attempt.facts["operation"] == NO_NEED:
            return None
        # Two tasks next to each other read more than one target, so twice the number is never exceeded.
        # Pieces of a file that hold no row group give no rows: with targets far below a file's size, most tasks would read
        # nothing, and each still reports to the driver.
        decision = decisions[attempt.partition_date]
        filled = decision.input_files + decision.input_bytes // ROW_GROUP
        return 1 if decision.expected_files == 1 else min(2 * decision.expected_files, filled)

    def write_runs(self, records: DataFrame, files: dict[date, int | None], run: str) -> None:
        """Write each date into at most its number of files; ``None`` keeps the file count.

        A large date keeps its own tasks and is not shuffled: ``records`` come packed by bytes, so each
        task reads at most one target file's worth of files and writes one file, however unequal they
        are. Dates that fit one file are one task each, without a shuffle, as long as they are at most
        ``BRANCHES``; more share one shuffle instead of a plan branch each.
        """
        date_column = F.col(LANDING_DATE)
        single = [d for d, n in files.items() if n == 1]
        kept = [d for d, n in files.items() if n is None]
        parts = []
        if len(single) <= BRANCHES:
            parts += [records.where(date_column == F.lit(d)).coalesce(1) for d in sorted(single)]
        else:
            parts.append(records.where(date_column.isin(single))
                         .repartition(len(single), date_column))
        if kept:
            parts.append(records.where(date_column.isin(kept)))
        parts += [records.where(date_column == F.lit(d)).coalesce(n)
                  for d, n in sorted(files.items()) if n is not None and n > 1]
        if parts:
            rows = reduce(DataFrame.unionByName, parts).withColumn("run_id", F.lit(run))
            append(rows.write.partitionBy(LANDING_DATE, "run_id"), self.compacted)

    def _validate(self, records: DataFrame, filled: list[Attempt], rewritten: list[Attempt]) -> None:
        by = (LANDING_DATE,)
        before = written(
            prints.fingerprint(records, by, self.payload, ingested=True), "fingerprint-input")
        newest = before.groupBy(LANDING_DATE).agg(F.max("last_ingested_at"))
        through = {r[0]: r[1] for r in newest.collect()}
        paths = {a.partition_date: run_path(self.compacted, a.partition_date, a.run_id)
                 for a in rewritten}
        in_place = {d: at for d, at in through.items() if d not in paths}
        # A run that lost all its rows has no directory; its comparison then fails.
        written_paths = existing(self.spark, list(paths.values()))
        output = raw_columns(run_scan(self.spark, self.compacted, written_paths))
        if in_place:
            output = output.unionByName(_landing_through(self.spark, self.landing, in_place))
        after = prints.fingerprint(output, by, self.payload)
        found = prints.comparison(before, after, by).groupBy(LANDING_DATE).agg(
            F.coalesce(F.sum("input_row_count"), F.lit(0)).alias("input_rows"),
            F.coalesce(F.sum("output_row_count"), F.lit(0)).alias("output_rows"),
            F.every("equal").alias("equal"))
        results = {r[LANDING_DATE]: r for r in found.collect()}
        out_files = {}
        if written_paths:
            layout = file_layout(self.spark, self.compacted, paths=written_paths)
            out_files = {r[LANDING_DATE]: r for r in policy(layout).collect()}

        for attempt in filled:
            day = attempt.partition_date
            files = out_files.get(day)
            own = attempt.facts if day in in_place else {}
            result = results.get(day)  # none where a listed date has files but no rows
            attempt.facts |= {
                "input_rows": result.input_rows if result else 0,
                "output_rows": result.output_rows if result else 0,
                "output_files": files.input_files if files else own.get("input_files", 0),
                "output_bytes": files.input_bytes if files else own.get("input_bytes", 0),
            }
            if result and not result.equal:
                attempt.validated(FAILED)
                attempt.finish(FAILED, "identity fingerprints of input and output differ")
                continue
            attempt.validated(PASSED)
            if day in paths:
                attempt.facts["published_path"] = paths[day]
            elif day in in_place:
                attempt.facts["published_path"] = f"{self.landing}/{LANDING_DATE}={day}"
                attempt.facts["published_through"] = in_place[day]
            attempt.finish(COMPLETED)


def _landing_through(spark: SparkSession, landing: str, through: dict[date, datetime]) -> DataFrame:
    """Landing records of the given dates, each up to its newest validated ingestion time."""
    limits = spark.createDataFrame(
        list(through.items()), f"{LANDING_DATE} date, published_through timestamp")
    landed = landing_scan(spark, landing, list(through))
    bounded = landed.join(F.broadcast(limits), LANDING_DATE)  # one row per date
    return raw_columns(bounded.where(F.col("ingested_at_utc") <= F.col("published_through")))


def pointers(spark: SparkSession, ledger_path: str, dataset: str, dates: Iterable[date] | None = None) -> list[Row]:
    """Published dates of a dataset, one row each."""
    states = ledger.read(spark, ledger_path).where(F.col("dataset") == dataset)
    if dates is not None:
        states = states.where(F.col("partition_date").isin(list(dates)))
    return ledger.visible(states).select(
        "partition_date", "published_path", "published_through", "output_rows").collect()


def confirm(counted: DataFrame, named: list[Row]) -> None:
    """Hold the ``rows`` read per date against those published. A date that lost some, or all, is an
    error that names it: what is left would look complete."""
    found = {r[0]: r[1] for r in counted.select(LANDING_DATE, "rows").collect()}
    lost = [f"{p.partition_date}: {p.output_rows} records published, {found.get(p.partition_date, 0)} found"
            for p in named if found.get(p.partition_date, 0) != p.output_rows]
    if lost:
        raise PublishedRunLost("; ".join(sorted(lost)))


def published_read(spark: SparkSession, ledger_path: str, dataset: str, landing: str,
                   compacted: str, dates: Iterable[date] | None = None) -> DataFrame:
    """Records of what is published, of all dates or of some.

    A date without a completed state or without a published path gives no rows; a published
    run, or a date published in place, whose folder is gone is an error that names it. ``confirm``
    finds lost files too. The result always has the landing columns.
    """
    return pointed_read(spark, pointers(spark, ledger_path, dataset, dates), landing, compacted)


def pointed_read(spark: SparkSession, named: list[Row], landing: str, compacted: str) -> DataFrame:
    runs = [p.published_path for p in named if p.published_through is None]
    in_place = {p.partition_date: p.published_through
                for p in named if p.published_through is not None}
    parts = []
    if runs:
        parts.append(raw_columns(run_scan(spark, compacted, runs)))
    if in_place:
        folders = {f"{landing}/{LANDING_DATE}={d}": d for d in in_place}
        there = existing(spark, list(folders))
        gone = [str(d) for path, d in folders.items() if path not in there]
        if gone:
            raise PublishedRunLost("published in place, and gone: " + ", ".join(sorted(gone)))
        parts.append(_landing_through(spark, landing, in_place))
    if not parts:
        return empty(spark, RAW_LANDING)
    return reduce(DataFrame.unionByName, parts)
