"""The case-level quality gate and its reports."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import half_up


@dataclass(frozen=True)
class Gate:
    least_paragraphs: int = 5
    most_paragraphs: int = 800
    most_failed_tenths: int = 3
    long_chars: int = 2000
    most_long: int = 5
    least_chars: int = 800
    least_chars_unargued: int = 2000


def validated(paragraphs: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """A row per case: n, failed, long, total, argued, reasons (those against it) and valid.

    A paragraph's length is its stored one, if that is neither null nor 0, else its text's. Null
    texts have no length; a null alignment_failed counts as aligned. A paragraph sent again counts
    once; what is shuffled is a paragraph's measures, not its text.
    """
    size = F.coalesce(F.nullif("length", F.lit(0)), F.length("text"))
    roles = F.coalesce("paragraph_roles", F.array().cast("array<string>"))
    argued = F.array_contains(roles, "reasoning") | F.array_contains(roles, "facts")
    own = paragraphs.select("case_id", "para_id", size.alias("size"), F.col("alignment_failed").alias("failed"), argued.alias("argued")).dropDuplicates(["case_id", "para_id"])
    c = own.groupBy("case_id").agg(
        F.count("*").alias("n"),
        F.count_if("failed").alias("failed"),
        F.count_if(F.col("size") > gate.long_chars).alias("long"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total"),
        F.bool_or("argued").alias("argued"),
    )
    why = lambda test, name, value=None: F.when(test, F.lit(name) if value is None else F.concat(F.lit(name + "_"), F.col(value).cast("string")))
    reasons = F.array_compact(
        F.array(
            why(F.col("n") < gate.least_paragraphs, "too_few_paragraphs", "n"),
            why(F.col("n") > gate.most_paragraphs, "too_many_paragraphs", "n"),
            why(F.col("failed") * 10 > F.col("n") * gate.most_failed_tenths, "high_align_fail"),
            why(F.col("long") > gate.most_long, "too_many_long_paragraphs", "long"),
            why(F.col("total") < gate.least_chars, "doc_too_short", "total"),
            why(~F.col("argued") & (F.col("total") < gate.least_chars_unargued), "no_reasoning_or_facts"),
        )
    )
    return c.withColumn("reasons", reasons).withColumn("valid", F.size("reasons") == 0)


def breakdown(cases: DataFrame) -> DataFrame:
    return cases.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def report(cases: DataFrame) -> DataFrame:
    kept = F.count_if("valid")
    return cases.agg(F.count("*").alias("total"), kept.alias("kept"), F.count_if(~F.col("valid")).alias("removed"), half_up(kept * F.lit(100.0) / F.nullif(F.count("*"), F.lit(0)), 2).alias("kept_pct"))


def truncated(paragraphs: DataFrame, most: int = 2000) -> DataFrame:
    """Texts over `most` characters cut, with their new length and `truncated` true; null for others."""
    over = F.length("text") > most
    p = paragraphs.withColumn("truncated", F.when(over, True))
    return p.withColumn("length", F.when(over, F.lit(most)).otherwise(F.col("length"))).withColumn("text", F.when(over, F.substring("text", 1, most)).otherwise(F.col("text")))


def with_metadata(cases: DataFrame, gate: Gate = Gate(), version: str = "1") -> DataFrame:
    """cases with `filter`: version, time and a digest of the gate that is the same in every run."""
    digest = F.substring(F.sha2(F.lit(json.dumps(asdict(gate), sort_keys=True)), 256), 1, 10)
    return cases.withColumn("filter", F.struct(F.lit(version).alias("version"), F.current_timestamp().cast("string").alias("filtered_at"), digest.alias("config_digest")))


def segmentation_stats(cases: DataFrame) -> DataFrame:
    n = F.sum("n")
    return cases.agg(
        F.count("*").alias("cases"), n.alias("paragraphs"), half_up(n.cast("double") / F.count("*"), 4).alias("mean_paragraphs"), F.max("n").alias("most"), F.min("n").alias("least"),
        F.count_if(F.col("failed") > 0).alias("with_failures"), F.count_if(F.col("failed") * 10 > F.col("n") * 3).alias("low_quality"),
    )


def samples(cases: DataFrame, first: int = 50, ends: int = 25) -> DataFrame:
    """The first cases, those of most and those of fewest paragraphs; a case may be in several."""
    part = lambda name, k, *order: cases.orderBy(*order).limit(k).select(F.lit(name).alias("sample"), "case_id", "n")
    return part("first", first, "case_id").unionByName(part("longest", ends, F.desc("n"), "case_id")).unionByName(part("shortest", ends, "n", "case_id"))


def cleaning_stats(texts: DataFrame, least_raw: int = 100, least_clean: int = 100) -> DataFrame:
    """texts: raw and clean lengths. Counts of kept and skipped texts, floored mean lengths, and the share removed."""
    raw_ok, ok = F.col("raw") >= least_raw, (F.col("raw") >= least_raw) & (F.col("clean") >= least_clean)
    ratio = F.lit(1.0) - F.col("clean").cast("double") / F.nullif("raw", F.lit(0))
    kept = F.count_if(ok)
    mean = lambda c: F.expr(f"coalesce(sum(case when raw >= {least_raw} and clean >= {least_clean} then {c} end), 0) div greatest(count_if(raw >= {least_raw} and clean >= {least_clean}), 1)")
    return texts.agg(
        F.count("*").alias("total"), kept.alias("kept"), F.count_if(~raw_ok).alias("skipped_raw"), F.count_if(raw_ok & (F.col("clean") < least_clean)).alias("skipped_clean"),
        mean("raw").alias("mean_raw"), mean("clean").alias("mean_clean"), half_up(F.max(F.when(ok, ratio)), 4).alias("max_ratio"), F.count_if(ok & (ratio > 0.5)).alias("over_half"),
    )
