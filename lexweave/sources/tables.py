"""CSV, Parquet, literal and vector sources and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.session import durable


def read_csv_optional(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A CSV file with a header by a schema of strings; None where there is no file."""
    if not _exists(spark, path):
        return None
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def save_index(vectors: DataFrame, path: str, kind: str = "flat") -> None:
    """Vectors (vec_id, embedding, other columns) with a manifest of their dimension, kind and number."""
    if kind not in ("flat", "cosine"):
        raise ValueError("kind is flat or cosine")
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    m = vectors.agg(F.max(F.size("embedding")).alias("dimension"), F.min(F.size("embedding")).alias("least"), F.count("*").alias("total_vectors")).first()
    if m["dimension"] != m["least"]:
        raise ValueError(f"vectors of {m['least']} and {m['dimension']} dimensions")
    manifest = [(m["dimension"], kind, m["total_vectors"])]
    vectors.sparkSession.createDataFrame(manifest, "dimension int, index_type string, total_vectors bigint").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The vectors and the manifest; FileNotFoundError where there is none."""
    try:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    except Exception as e:
        raise FileNotFoundError(path) from e
    return spark.read.parquet(f"{path}/vectors"), manifest


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def replace_documents(new: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Rows stored by document: the documents in `new` take the place of all that was stored of them, others stay.

    Used for an index's chunks and for summaries. Documents fall into buckets, and only the buckets
    touched are written anew. Rows with a null key are left out; an empty `new` changes nothing.
    """
    spark = new.sparkSession
    n = durable(new.where(F.col(key).isNotNull()).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
    touched = [r["bucket"] for r in n.select("bucket").distinct().collect()]  # at most `buckets`
    if not touched:
        return
    if _exists(spark, path):
        old = spark.read.schema(n.schema).parquet(path).where(F.col("bucket").isin(touched))
        n = n.unionByName(durable(old.join(n.select(key).distinct(), key, "left_anti")))
    n.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def stored_documents(spark: SparkSession, path: str) -> DataFrame:
    """What replace_documents stored; FileNotFoundError where there is nothing."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path).drop("bucket")
