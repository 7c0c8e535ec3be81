"""JSON lines: tolerant scans, maps and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.session import durable


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON lines file by a given schema; lines that do not parse have their text in _bad, blank lines are skipped."""
    return spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def parse_lines(df: DataFrame, line: str, schema: str) -> DataFrame:
    """df with `parsed` and `status`: read, blank (null or white space) or corrupt."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    d = df.withColumn("parsed", F.from_json(F.col(line), schema + ", _bad string", options))
    blank = F.col(line).isNull() | ~F.col(line).rlike(r"\S")
    return d.withColumn("status", F.when(blank, "blank").when(F.col("parsed").isNull() | F.col("parsed._bad").isNotNull(), "corrupt").otherwise("read"))


def explode_map(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, key, value: a row for each member of a JSON object; texts that are none give no row."""
    return df.select(*keys, F.explode(F.from_json(F.col(text), "map<string,string>")).alias("key", "value"))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_report(row: DataFrame, path: str) -> None:
    """A one-row report as a single JSON file."""
    row.coalesce(1).write.mode("overwrite").json(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        durable(spark.range(1))
    return jsc.getCheckpointDir().get()


def roundtrip(df: DataFrame) -> DataFrame:
    """df written as JSON lines to the shared folder and read back by its own schema."""
    path = f"{shared_folder(df.sparkSession)}/jsonl-{uuid.uuid4().hex}"
    write_jsonl(df, path)
    return df.sparkSession.read.schema(df.schema).json(path)
