"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import durable


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, root): for each end of an edge (a, b) the smallest id reachable from it.

    Every round is two aggregations keyed by a node; a node's links are reduced by a
    partial min, never gathered. Rounds are written to the checkpoint folder.
    Nulls in a or b drop the edge. No edges give no rows.
    """
    e = (
        edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = durable(e)
    before = None
    for _ in range(max_rounds):
        # large star: each neighbour above the node links to the least of the node and its neighbours
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the node and its lower neighbours link to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(least, "u")
        small = j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        e = durable(small)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before is not None and (now["n"], now["h"]) == before:
            break
        before = (now["n"], now["h"])
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(e.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()
