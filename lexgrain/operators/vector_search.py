"""Exact nearest vectors: one query as an ordered limit, many queries in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgrain.functions.vectors import cosine


def top_k(rows: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """``key, score``: the k rows of highest cosine, ties by key; rows without a usable vector stay out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.where(F.col(vector).isNotNull()).select(key, cosine(F.col(vector), q).alias("score")).where("score is not null and not isnan(score)").orderBy(F.desc("score"), key).limit(k)


def top_k_batch(rows: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int, dims: int, block: int = 4096) -> DataFrame:
    """``query_key, key, score, position`` for many queries against all rows, exactly.

    Queries are taken in blocks of about ``block`` vectors, the only thing that is sent to the tasks; each block is one scan of the
    rows as matrix products, and only the k best of each query leave a task. For more queries than a few blocks, an index is
    the better way. Vectors of other lengths, null or without direction stay out.
    """
    spark = rows.sparkSession
    kinds = dict(rows.dtypes)[key], dict(queries.dtypes)[query_key]
    qs = queries.where(F.size(query_vector) == dims).select(F.col(query_key).alias("q"), F.col(query_vector).cast("array<double>").alias("v"))
    data = rows.where(F.size(vector) == dims).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-qs.count() // block))

    def unit(x):
        with np.errstate(all="ignore"):
            return x / np.linalg.norm(x, axis=1, keepdims=True)

    def against(own) -> DataFrame:
        names, y = own.column("q"), own.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        shared = spark.sparkContext.broadcast((names.combine_chunks(), unit(y)))

        def scan(batches):
            names, y = shared.value
            best, keys = np.full((len(y), 0), -9.0), []
            at = np.zeros((len(y), 0), np.int64)
            for batch in batches:
                for begin in range(0, batch.num_rows, 512):
                    part = batch.slice(begin, 512)
                    x = unit(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                    s = np.nan_to_num(y @ x.T, nan=-9.0)
                    first = sum(map(len, keys))
                    keys.append(part.column(0))
                    best, at = np.concatenate([best, s], 1), np.concatenate([at, np.broadcast_to(np.arange(first, first + s.shape[1]), s.shape)], 1)
                    if best.shape[1] > k:
                        # ties at the edge are kept, so that the smallest keys among them can win
                        edge = np.partition(np.round(best, 9), -k, axis=1)[:, -k][:, None]
                        top = np.argsort(np.where(np.round(best, 9) >= edge, 0, 1), axis=1, kind="stable")[:, : max(k, int((np.round(best, 9) >= edge).sum(1).max()))]
                        best, at = np.take_along_axis(best, top, 1), np.take_along_axis(at, top, 1)
            if keys and best.shape[1]:
                who, place = np.nonzero(best > -8)
                flat = pa.concat_arrays(keys)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(who)), flat.take(pa.array(at[who, place])), pa.array(best[who, place])], names=["q", "key", "score"])

        return data.mapInArrow(scan, f"q {kinds[1]}, key {kinds[0]}, score double")

    met = None
    for b in range(blocks):
        own = qs.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toArrow()
        if own.num_rows:
            met = against(own) if met is None else met.unionByName(against(own))
    if met is None:
        met = data.select(F.lit(None).cast(kinds[1]).alias("q"), "key", F.lit(0.0).alias("score")).limit(0)
    ranked = met.withColumn("position", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "key"))).where(F.col("position") <= k)
    return ranked.select(F.col("q").alias(query_key), F.col("key").alias(key), "score", "position")
