"""The supplied tables as queries and pipeline read them, and the removal of rows by a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import written

BROADCAST_ROWS = 1_000_000  # of two numbers; a longer list meets the documents by a shuffle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(docs: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that are no columns of ``docs``, in any case of their letters."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(docs: DataFrame, dropped: DataFrame, computed: dict[str, Column]) -> DataFrame:
    """``docs`` less the rows that ``dropped`` lists by doc_id and the ``computed`` columns. Texts
    are shuffled only if the list is too long to be sent to every task. Rows without an id are
    matched like any other."""
    names = dict(zip(dropped.columns, fresh(docs, *dropped.columns)))
    listed = written(dropped.select(*[F.col(c).alias(n) for c, n in names.items()]), "dropped")
    own = {"doc_id": F.col("doc_id").cast("long")} | computed
    on = [own[c].eqNullSafe(F.col(n)) for c, n in names.items()]
    short = listed.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(listed) if short else listed, on, "left_anti")
