"""Operators next to the scan: dense ids and page blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import block_text, word_count
from lexweave.session import durable, shuffle_partitions


def dense_ids(df: DataFrame, keys: list[str], name: str, start: int = 0) -> DataFrame:
    """df with dense ids in the order of keys, which must be unique.

    Range partitions are numbered on their own and shifted by the rows before them, so that no
    task sees more than its range. Only the keys are written out to fix the ranges.
    """
    n = shuffle_partitions(df.sparkSession)
    k = durable(df.select(*keys).repartitionByRange(n, *keys).withColumn("__range", F.spark_partition_id()))
    sizes = k.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("__range", before.alias("__before"))  # a row per range
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*keys))
    ids = k.join(F.broadcast(shift), "__range").select(*keys, (F.col("__before") + own - 1 + start).cast("bigint").alias(name))
    return df.join(ids, keys)


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df, which should be narrow, with each row's number within its group from 0; null keys are a group of their own.

    Range partitions are numbered on their own, so that a group of any size is spread over tasks. Only
    the first group of a range can have begun in an earlier one: a row per range says how far it was.
    Rows equal in group and order are numbered in any order.
    """
    n = shuffle_partitions(df.sparkSession)
    k = durable(df.repartitionByRange(n, *group, *order).withColumn("__range", F.spark_partition_id()))
    sizes = k.groupBy("__range", *group).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.withColumn("__before", before).where("__before > 0").select(F.col("__range").alias("__r"), *[F.col(g).alias(f"__g_{g}") for g in group], "__before")
    own = F.row_number().over(Window.partitionBy("__range", *group).orderBy(*order)) - 1
    same = [k["__range"] == F.col("__r")] + [k[g].eqNullSafe(F.col(f"__g_{g}")) for g in group]
    j = k.withColumn(name, own).join(F.broadcast(shift), same, "left")  # a row per range at most
    return j.withColumn(name, (F.col(name) + F.coalesce("__before", F.lit(0))).cast("bigint")).select(*df.columns, name)


def text_blocks(blocks: DataFrame, margin: float = 50.0, least_chars: int = 10, margin_words: int = 15) -> DataFrame:
    """Text blocks worth keeping: type 0, long enough, and inside the page's margins unless they have many words.

    blocks: text, block_type, y0, y1, page_height and any other columns.
    """
    b = blocks.withColumn("text", block_text(F.col("text")))
    inside = (F.col("y0") >= margin) & (F.col("y1") <= F.col("page_height") - margin)
    return b.where((F.col("block_type") == 0) & (F.length("text") >= least_chars) & (inside | (word_count(F.col("text")) >= margin_words)))
