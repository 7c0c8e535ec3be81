"""Rhetorical role labels of paragraphs, in batches within a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import roles as R
from lexweave.operators.scans import numbered

BATCH = 4


def ruled(paragraphs: DataFrame) -> DataFrame:
    """paragraphs with lower, size, routed (role, source by patterns), rule (role by all rules) and spare (role for all else)."""
    p = paragraphs.withColumn("lower", F.lower("text")).withColumn("size", F.length("text"))
    p = p.withColumn("routed", R.routed(F.col("lower"), F.col("size")))
    return p.withColumn("rule", R.hard_rule(F.col("lower"), F.col("size"), F.col("position"), F.col("routed.role"))).withColumn("spare", R.fallback(F.col("lower"), F.col("size"), F.col("position")))


def batched(paragraphs: DataFrame, size: int = BATCH) -> DataFrame:
    """Usable paragraphs, which should be narrow rows, with `batch`, the number of their group of `size` in their case's order, and all_ruled.

    A case of any size is numbered in ranges; the windows that follow see one batch each.
    """
    u = paragraphs.where(F.coalesce("usable_for_evidence", F.lit(True)))
    b = numbered(u, ["case_id"], ["para_id"], "batch").withColumn("batch", F.floor(F.col("batch") / size).cast("bigint"))
    return b.withColumn("all_ruled", F.bool_and(F.col("rule").isNotNull()).over(Window.partitionBy("case_id", "batch"))) if "rule" in b.columns else b


def label(paragraphs: DataFrame, model: Column | None = None) -> DataFrame:
    """case_id, para_id, role, source, confidence.

    A batch that rules decide throughout takes them. In others, without a model, every
    paragraph takes the router's role, else the fallback's; with a model (a column of its
    labels, null where it failed), those without a rule take its corrected label. Unusable
    paragraphs are 'other', auto_filled, 0. A paragraph that was sent again counts once. Rules are
    worked out where the texts are read; duplicates and windows see narrow rows: no text is shuffled.
    """
    p = ruled(paragraphs)
    low, size = F.col("lower"), F.col("size")
    answer = F.lit(None).cast("string") if model is None else model
    # step by step, each a column of its own: nested in one expression they would double at every step
    p = p.withColumn("a", R.synonym(answer)).withColumn("a", R.unbias(low, F.col("a"))).withColumn("a", R.boost(low, F.col("a")))
    p = p.withColumn("a", F.when(F.col("a").isin(R.ROLES), F.col("a")).otherwise("other"))
    p = p.withColumn("a", R.boost(low, F.col("a"))).withColumn("a", R.unbias(low, F.col("a"))).withColumn("a", R.safety(low, size, F.col("a")))
    narrow = p.select("case_id", "para_id", "usable_for_evidence", "routed", "rule", "spare", F.when(answer.isNotNull(), F.col("a")).alias("answer")).dropDuplicates(["case_id", "para_id"])
    b = batched(narrow)
    failed = F.max(F.col("rule").isNull() & F.col("answer").isNull()).over(Window.partitionBy("case_id", "batch"))
    b = b.withColumn("failed", failed)
    three = lambda role, source, conf: F.struct(F.col(role).alias("role") if isinstance(role, str) else role.alias("role"), (F.lit(source) if isinstance(source, str) else source).alias("source"), F.lit(conf).cast("double").alias("confidence"))
    single = F.when(F.col("routed").isNotNull(), three(F.col("routed.role"), F.col("routed.source"), 0.9)).otherwise(three("spare", "rule_fallback", 0.4))
    one = F.when(F.col("all_ruled"), three("rule", "rule", 0.9)).when(F.col("failed"), single).when(F.col("rule").isNotNull(), three("rule", "rule", 0.9))
    one = one.when(F.col("answer") == "other", three("answer", "llm", 0.5)).otherwise(three("answer", "llm", 0.8))
    done = b.select("case_id", "para_id", one.alias("x")).select("case_id", "para_id", "x.*")
    unused = paragraphs.where(~F.coalesce("usable_for_evidence", F.lit(True))).select("case_id", "para_id", F.lit("other").alias("role"), F.lit("auto_filled").alias("source"), F.lit(0.0).alias("confidence")).distinct()
    return done.unionByName(unused)


def label_single(paragraphs: DataFrame, model: Column) -> DataFrame:
    """case_id, para_id, role, source, confidence, each paragraph on its own.

    A pattern decides at 0.9; else the model's label (a column, null where its call failed), reduced to letters and
    underscores, at 0.75 if it is a role; else the fallback, at 0.5, or at 0.4 where the call failed. All
    paragraphs are labelled, usable or not; one that was sent again counts once.
    """
    p = ruled(paragraphs).withColumn("a", F.regexp_replace(F.lower(model), "[^a-z_]", ""))
    three = lambda role, source, conf: F.struct(role.alias("role"), source.alias("source"), F.lit(conf).cast("double").alias("confidence"))
    x = F.when(F.col("routed").isNotNull(), three(F.col("routed.role"), F.col("routed.source"), 0.9)).when(F.col("a").isNull(), three(F.col("spare"), F.lit("rule_fallback"), 0.4))
    x = x.when(F.col("a").isin(R.ROLES), three(F.col("a"), F.lit("llm_single"), 0.75)).otherwise(three(F.col("spare"), F.lit("llm_fallback"), 0.5))
    return p.select("case_id", "para_id", x.alias("x")).select("case_id", "para_id", "x.*").dropDuplicates(["case_id", "para_id"])


def distribution(labels: DataFrame) -> DataFrame:
    """(case_id, role, n)."""
    return labels.groupBy("case_id", "role").agg(F.count("*").alias("n"))


def distribution_maps(labels: DataFrame) -> DataFrame:
    return distribution(labels).groupBy("case_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n")))).alias("role_distribution"))


def summaries(paragraphs: DataFrame, labels: DataFrame, least: int = 100) -> DataFrame:
    """case_id and the texts of five roles, joined by blank lines in order; cases whose facts or reasoning are too short are left out."""
    j = paragraphs.select("case_id", "para_id", "text").join(labels.select("case_id", "para_id", "role"), ["case_id", "para_id"])
    names = {"facts": "facts", "issues": "issues", "arguments": "arguments", "reasoning": "reasoning", "final_decision": "decision"}
    j = j.where(F.col("role").isin(list(names)))
    parts = [F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("para_id", "text")))), lambda x: x["text"]), "\n\n").alias(n) for r, n in names.items()]
    return j.groupBy("case_id").agg(*parts).where((F.length("facts") > least) & (F.length("reasoning") > least))


def text_hashes(paragraphs: DataFrame) -> DataFrame:
    """(case_id, text_hash): SHA-256 of a case's stripped usable texts in order."""
    from lexweave.functions.text import strip

    u = paragraphs.where(F.coalesce("usable_for_evidence", F.lit(True)))
    g = u.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("para_id", strip(F.col("text")).alias("text")))).alias("x"))
    return g.select("case_id", F.sha2(F.array_join(F.transform("x", lambda v: v["text"]), ""), 256).alias("text_hash"))
