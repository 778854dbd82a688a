"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import written

TASK_LINKS = 50_000


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); nodes share a root if a path joins them.

    Each round every node moves to the neighbour, or itself, that a hash of the round ranks
    lowest. That leaves a fraction of the nodes whatever the shape of the graph, chains
    included. Links then join the places moved to; those inside one place vanish. All
    tables stay on the cluster and are written once a round.
    """
    def held(rows: DataFrame, label: str, size: int) -> DataFrame:
        # Few rows are written by few tasks.
        return written(rows.coalesce(1 + size // TASK_LINKS), label)

    links = written(links.where("a <> b").select("a", "b").distinct(), "links")
    place = None
    turn = first = 0
    while size := links.count():
        rank = lambda c, t=turn: F.xxhash64(F.lit(t), F.col(c))
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        own = F.struct(rank("a").alias("r"), F.col("a").alias("v"))
        low = F.min(F.struct(rank("b").alias("r"), F.col("b").alias("v")))
        moved = held(
            both.groupBy("a").agg(low.alias("low"))
            .select(F.col("a").alias("node"), F.least(own, "low")["v"].alias("root")), "moved", size)
        first = first or size
        place = moved if place is None else held(
            place.join(moved.select(F.col("node").alias("root"), F.col("root").alias("next")),
                       "root", "left")
            .select("node", F.coalesce("next", "root").alias("root")), "place", first)
        to = lambda c: moved.select(F.col("node").alias(c), F.col("root").alias(f"{c}_to"))
        links = held(
            links.join(to("a"), "a").join(to("b"), "b")
            .select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
            .where("a <> b").distinct(), "links", size)
        turn += 1
    if place is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return place
