"""Checks that count what breaks the source tables' own rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.current import ORDERING, latest
from tidemark.schemas import IDENTITY, OPERATIONS, Entity


def domain_rules(entity: Entity) -> dict[str, Column]:
    """Rule name to the condition that breaks it."""
    amount = F.col("amount")
    too_low = amount < 0 if entity.zero_allowed else amount <= 0
    missing = [c for c in entity.event_columns[:6]] + list(IDENTITY)
    return {
        "status_domain": ~F.col(entity.status).isin(*entity.states),
        "amount_bound": too_low,
        "operation_domain": ~F.col("cdc_operation").isin(*OPERATIONS),
    } | {f"{c}_not_null": F.col(c).isNull() for c in missing}


def domain_audit(events: DataFrame, entity: Entity) -> DataFrame:
    """Violations per rule; all rules are counted in one pass over the events."""
    rules = domain_rules(entity)
    counts = events.agg(*[F.count_if(broken).alias(name) for name, broken in rules.items()])
    listed = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules
    ])
    return counts.select(F.inline(listed))


def type_audit(held: DataFrame, stated: T.StructType) -> DataFrame:
    """Columns of a table, read by its own schema, against those stated for it: ``ok``, ``retyped``, ``missing``
    or ``unexpected``, with the number of values each holds. One pass over the table; names compare by case."""
    found = {f.name: f.dataType.simpleString() for f in held.schema}
    due = {f.name: f.dataType.simpleString() for f in stated}
    counts = held.agg(*[F.count(F.col(f"`{name}`")).alias(f"n{k}") for k, name in enumerate(found)])
    at = {name: F.col(f"n{k}") for k, name in enumerate(found)}

    def verdict(name: str) -> str:
        if name not in found:
            return "missing"
        if name not in due:
            return "unexpected"
        return "ok" if found[name] == due[name] else "retyped"

    listed = F.array(*[
        F.struct(F.lit(name).alias("column_name"), F.lit(due.get(name)).cast("string").alias("stated"),
                 F.lit(found.get(name)).cast("string").alias("found"), F.lit(verdict(name)).alias("verdict"),
                 at.get(name, F.lit(0)).cast("long").alias("held_values"))
        for name in dict.fromkeys([*due, *found])
    ])
    return counts.select(F.inline(listed))


def referential_audit(child: DataFrame, ref: str, parent: DataFrame, key: str,
                      child_key: Sequence[str]) -> DataFrame:
    """Child rows whose ``ref`` names no parent row. A null ``ref`` names nothing and is not
    an orphan, as in a database foreign key.

    Both sides are of one size class and meet by sorting: sizes guessed from files do not know how many rows
    a file becomes, and by them the keys of all parents could be sent through the driver.
    """
    parents = parent.select(F.col(key).alias("_key")).hint("merge")
    children = child.where(F.col(ref).isNotNull()).select(*dict.fromkeys([*child_key, ref]))
    return children.join(parents, F.col(ref) == F.col("_key"), "left_anti")


def reconcile(left: DataFrame, right: DataFrame, identity: Sequence[str] = IDENTITY) -> DataFrame:
    """Identities whose number of copies differs between two layers.

    Both layers are counted per identity before they meet, so many copies of one record
    travel as one row.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*identity).agg(F.count("*").alias(name))

    both = counted(left, "left_copies").join(
        counted(right, "right_copies"), list(identity), "full_outer")
    filled = both.na.fill(0, ["left_copies", "right_copies"])
    verdict = (
        F.when(F.col("right_copies") == 0, "lost")
        .when(F.col("left_copies") == 0, "unexpected")
        .when(F.col("right_copies") > F.col("left_copies"), "doubled")
        .otherwise("fewer")
    )
    differing = filled.where(F.col("left_copies") != F.col("right_copies"))
    return differing.withColumn("verdict", verdict)


def current_audit(current: DataFrame, history: DataFrame, entity: Entity) -> DataFrame:
    """Keys whose current state is not the latest event of ``history``, with a verdict: ``repeated`` (more than
    one row), ``missing``, ``unexpected``, ``differs`` (another position) or ``altered`` (its position, other values)."""
    key = entity.key
    rest = [c for c in entity.event_columns if c not in (key, *ORDERING)]
    row = F.struct(*ORDERING, *rest)
    held = current.groupBy(key).agg(F.count("*").alias("rows"), F.max(row).alias("held"))
    due = latest(history, entity).select(key, row.alias("due"))
    elsewhere = F.lit(False)
    for c in ORDERING:
        elsewhere = elsewhere | ~F.col(f"held.{c}").eqNullSafe(F.col(f"due.{c}"))
    verdict = (
        F.when(F.col("rows") > 1, "repeated")
        .when(F.col("held").isNull(), "missing")
        .when(F.col("due").isNull(), "unexpected")
        .when(elsewhere, "differs")
        .when(~F.col("held").eqNullSafe(F.col("due")), "altered")
    )
    both = held.join(due, key, "full_outer").select(key, verdict.alias("verdict"))
    return both.where(F.col("verdict").isNotNull())
