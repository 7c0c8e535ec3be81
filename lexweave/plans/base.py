"""What the query modules share: registration and the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """judgments_paragraphs with paragraphs that were sent again once."""
    return table(spark, folder, "judgments_paragraphs").drop("ingested_at").dropDuplicates(["case_id", "para_id"])


#: The same for the SQL side.
PARAS = "(select distinct * exclude (ingested_at) from judgments_paragraphs)"
STRIP = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def any_of(c: str, words: list[str]) -> str:
    """SQL: whether the text contains one of the words."""
    return "(" + " or ".join("contains({}, '{}')".format(c, w.replace("'", "''")) for w in words) + ")"
