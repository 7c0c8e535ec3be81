"""Exact vector search as expressions and as an Arrow kernel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that one broadcast matrix holds; more are searched in blocks of this size.
BLOCK = 4096
#: Queries of a block that are compared with an Arrow batch at once.
SLICE = 512


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def nearest(vectors: DataFrame, query: list[float], k: int, kind: str = "flat") -> DataFrame:
    """vec_id, score, similarity_pct of the k nearest to one query, ties by id; fewer if there are fewer.

    kind flat: squared distance, cosine: inner product of unit vectors. Null vectors are left out.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    v = vectors.where("embedding is not null").select("vec_id", doubles(F.col("embedding")).alias("v"))
    if kind == "flat":
        s = v.select("vec_id", squared_distance(F.col("v"), q).alias("score")).orderBy("score", "vec_id")
        return s.limit(k).withColumn("similarity_pct", F.greatest(F.lit(0.0), F.lit(100.0) / (F.col("score") + 1)))
    s = v.select("vec_id", dot(unit(F.col("v")), unit(q)).alias("score")).orderBy(F.desc("score"), "vec_id")
    return s.limit(k).withColumn("similarity_pct", F.col("score") * 100)


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest (squared distance, ties by id) to each query.

    Queries go to the tasks in blocks of at most BLOCK, so vectors are not shuffled; each task
    keeps k candidates a query, and only these are ranked over all. A batch's candidates are all
    vectors that rounding leaves in reach of its k-th distance. queries: query_id, embedding; null
    vectors on either side are left out. Queries and vectors of different dimensions raise a ValueError.
    """
    queries = queries.where("query_id is not null and embedding is not null")
    spark = vectors.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    numbered = queries.select("query_id", "embedding")
    out = None
    for b in range(blocks):
        part = numbered if blocks == 1 else numbered.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = part.collect()  # about BLOCK rows
        q = spark.sparkContext.broadcast((np.array([r["query_id"] for r in rows], np.int64), np.array([r["embedding"] for r in rows], np.float64)))

        def search(batches, q=q):
            ids, m = q.value
            best = None
            for pdf in batches:
                pdf = pdf[pdf["embedding"].notna()]
                if not len(pdf) or not len(ids):
                    continue
                v = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
                if v.shape[1] != m.shape[1]:
                    raise ValueError(f"vectors of {v.shape[1]} dimensions searched by queries of {m.shape[1]}")
                own = pdf["vec_id"].to_numpy(np.int64)
                # of equal vectors only the k lowest ids can be among the nearest
                rows = np.ascontiguousarray(v).view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel()
                low = pd.Series(own).groupby(np.unique(rows, return_inverse=True)[1]).rank(method="first").to_numpy() <= k
                v, own = v[low], own[low]
                squares, take = (v * v).sum(1), min(len(own), k)
                parts = []
                for a in range(0, len(ids), SLICE):
                    mine = m[a : a + SLICE]
                    # candidates by the fast form, then their distances term by term in index order
                    rough = squares[None, :] - 2 * mine @ v.T
                    # twice the rounding errors of both forms, for the two vectors compared
                    reach = 8 * (v.shape[1] + 4) * np.finfo(np.float64).eps * (np.sqrt(np.fmax.reduce(squares)) + np.sqrt((mine * mine).sum(1))) ** 2
                    bound = np.partition(rough, take - 1, axis=1)[:, take - 1] + reach
                    of, near = np.nonzero(~(rough > bound[:, None]))
                    exact = np.zeros(len(of))
                    for j in range(v.shape[1]):
                        d = v[near, j] - mine[of, j]
                        exact += d * d
                    parts.append(pd.DataFrame({"query_id": ids[a + of], "vec_id": own[near], "score": exact}))
                found = pd.concat(parts)
                best = found if best is None else pd.concat([best, found])
                best = best.sort_values(["query_id", "score", "vec_id"]).groupby("query_id").head(k)
            if best is not None:
                yield best

        found = vectors.select("vec_id", "embedding").mapInPandas(search, "query_id long, vec_id long, score double")
        out = found if out is None else out.union(found)
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def check_dimension(vectors: DataFrame) -> DataFrame:
    """dimension, least: the largest and smallest number of components; a search needs them equal."""
    return vectors.agg(F.max(F.size("embedding")).alias("dimension"), F.min(F.size("embedding")).alias("least"), F.count("*").alias("total_vectors"))
