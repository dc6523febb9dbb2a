"""Similarity search by exact cosine distance."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.vectors import cosine_distance, usable
from palimpsest.schema import DEFAULT_TOPIC, MAX_DISTANCE, SEARCH_K

BLOCK = 8192


def by_topic(rows: DataFrame, topic: str | None) -> DataFrame:
    """Empty and default topics mean all topics here."""
    return rows.where(F.col("topic") == topic) if topic and topic != DEFAULT_TOPIC else rows


def topk(rows: DataFrame, query: list[float], key: str, vector: str = "embedding", k: int = SEARCH_K, topic: str | None = None, most: float = MAX_DISTANCE) -> DataFrame:
    """The k nearest rows within the distance, with distance. The threshold rises with the order, so it comes first."""
    q = F.array(*(F.lit(float(x)) for x in query))
    near = by_topic(rows, topic).where(usable(F.col(vector), len(query))).withColumn("distance", cosine_distance(F.col(vector), q))
    return near.where(F.col("distance") <= most).orderBy("distance", key).limit(k)


def text_topk(rows: DataFrame, text: str, embed: Callable[[Column], Column], key: str, vector: str = "embedding", k: int = SEARCH_K, topic: str | None = None, most: float = MAX_DISTANCE) -> DataFrame:
    """topk() for a text; embed is the column function that made the rows' vectors. The text is embedded when this is called."""
    query = rows.sparkSession.range(1).select(embed(F.lit(text)).alias("q")).first()["q"]
    return topk(rows, list(query), key, vector, k, topic, most)


def approx_topk(rows: DataFrame, query: list[float], key: str, vector: str = "embedding", k: int = SEARCH_K, tables: int = 8, width: float = 1.0) -> DataFrame:
    """The k nearest rows among those that share a hash bucket with the query; distances are exact.

    On unit vectors the squared Euclidean distance is twice the cosine distance, so buckets of random projections serve.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    vectors = rows.where(usable(F.col(vector), len(query))).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("raw"))
    unit = Normalizer(inputCol="raw", outputCol="unit").transform(vectors)
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", numHashTables=tables, bucketLength=width, seed=1).fit(unit)
    norm = sum(x * x for x in query) ** 0.5
    near = model.approxNearestNeighbors(unit, Vectors.dense([x / norm for x in query]), k)
    return near.select(key, (F.col("distCol") ** 2 / 2).alias("distance")).orderBy("distance", key)


def batch_topk(queries: DataFrame, rows: DataFrame, key: str, vector: str = "embedding", k: int = SEARCH_K, dims: int = 64) -> DataFrame:
    """query, neighbour, distance, rank: the k nearest rows of each query, the query itself among them.

    Both sides are cut into blocks; every pair of blocks meets in one group, gives its k best, and these are merged.
    """
    clean = lambda df: df.where(usable(F.col(vector), dims)).select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    left, right = clean(queries), clean(rows)
    n_left, n_right = (max(1, -(-df.count() // BLOCK)) for df in (left, right))
    block = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.select(block(n_left).alias("a"), every(n_right).alias("b"), F.col("key").alias("key"), F.col("v").alias("v"))
    right = right.select(every(n_left).alias("a"), block(n_right).alias("b"), F.col("key").alias("key"), F.col("v").alias("v"))

    def meet(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({"query": [], "neighbour": [], "distance": []}).astype({"query": "int64", "neighbour": "int64"})
        unit = lambda s: (x := np.stack(s.to_numpy())) / np.linalg.norm(x, axis=1, keepdims=True)
        x, y, keys, out = unit(q["v"]), unit(d["v"]), d["key"].to_numpy(), []
        for i in range(0, len(x), 512):
            dist = 1 - x[i : i + 512] @ y.T
            worst = np.partition(dist, min(k, len(keys)) - 1, axis=1)[:, min(k, len(keys)) - 1, None]
            r, c = np.nonzero(dist <= worst + 1e-9)  # ties stay, the merge orders them by key
            out.append(pd.DataFrame({"query": q["key"].to_numpy()[r + i], "neighbour": keys[c], "distance": dist[r, c]}))
        return pd.concat(out)

    met = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(meet, "query bigint, neighbour bigint, distance double")
    order = Window.partitionBy("query").orderBy(F.round("distance", 9), "neighbour")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
