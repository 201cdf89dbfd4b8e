"""One ranking from several scores of different scale, by robust rank aggregation.

Only positions enter, so no score weighs more because of its range. An item's positions, divided by the size of its list,
are sorted; the k-th smallest of m is compared with the k-th order statistic of m uniform numbers, whose distribution is
Beta(k, m - k + 1). The smallest of these probabilities, times m (at most 1), is the item's significance.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.operators.ranking import positions


def _order_statistic(r: Column, k: int, m: int) -> Column:
    """P(k-th smallest of m uniform numbers <= r): the sum of binomial terms j >= k."""
    total = F.lit(0.0)
    for j in range(k, m + 1):
        total = total + comb(m, j) * F.pow(r, j) * F.pow(1 - r, m - j)
    return total


def fuse(rows: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    """``group, item, position_<score>..., position_sum, significance, rank`` of every item of every group.

    A position is 1 plus the number of items of the group with a higher score; null and NaN are missing and stand below all
    others. Repeated rows of one (group, item) count once, with the highest of each score. Rows with a null group or item stay
    out. Items of equal significance are ranked by position_sum, then by item, so rank has no ties. An empty table gives no rows.
    Positions come from range-partitioned counting: a group with a third of all rows is spread over many tasks.
    """
    clean = [F.when(F.isnan(F.col(s).cast("double")), None).otherwise(F.col(s).cast("double")) for s in scores]
    one = rows.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).alias("g"), F.col(item).alias("i"), *[c.alias(f"s{k}") for k, c in enumerate(clean)])
    one = one.groupBy("g", "i").agg(*[F.max(f"s{k}").alias(f"s{k}") for k in range(len(scores))])
    long = one.select("g", "i", F.posexplode(F.array(*[f"s{k}" for k in range(len(scores))])).alias("kind", "s"))
    placed = positions(long, ["kind", "g"], [F.col("s").isNull(), -F.col("s")])
    m = len(scores)
    sides = placed.groupBy("g", "i").agg(*[F.max(F.when(F.col("kind") == k, F.col("position"))).alias(f"p{k}") for k in range(m)])
    sizes = one.groupBy("g").agg(F.count("*").alias("n"))
    ranks = sides.join(sizes, "g").withColumn("r", F.array_sort(F.array(*[F.col(f"p{k}") / F.col("n") for k in range(m)])))
    least = F.least(*[_order_statistic(F.col("r")[k - 1], k, m) for k in range(1, m + 1)]) if m > 1 else F.col("r")[0]
    scored = ranks.withColumn("rho", F.least(F.lit(1.0), F.round(m * least, 12))).withColumn("total", sum((F.col(f"p{k}") for k in range(1, m)), F.col("p0")))
    ranked = positions(scored.drop("r", "n"), ["g"], [F.col("rho"), F.col("total"), F.col("i")], "rank")
    return ranked.select(
        F.col("g").alias(group), F.col("i").alias(item), *[F.col(f"p{k}").alias(f"position_{s}") for k, s in enumerate(scores)],
        F.col("total").alias("position_sum"), F.col("rho").alias("significance"), "rank",
    )


SCORES = ["vector_score", "lexical_score", "rerank_score"]


def p7_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The whole ranking of every request."""
    return fuse(spark.read.parquet(f"{folder}/candidates.parquet"), "query_id", "chunk_id", SCORES)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The first of each request: of the fused rows, the one with the smallest sum of positions (then significance, then id)."""
    first = p7_ranking(spark, folder).groupBy("query_id").agg(F.min_by("chunk_id", F.struct("position_sum", "rank")).alias("chunk_id"))
    return first.select("query_id", "chunk_id")


QUERIES = {"p7_found": p7_found, "p7_ranking": p7_ranking}
_POSITIONS = """
WITH one AS (
  SELECT query_id, chunk_id, max(CASE WHEN isnan(vector_score) THEN NULL ELSE vector_score END) AS v,
         max(CASE WHEN isnan(lexical_score) THEN NULL ELSE lexical_score END) AS l,
         max(CASE WHEN isnan(rerank_score) THEN NULL ELSE rerank_score END) AS r
  FROM candidates WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL),
placed AS (
  SELECT query_id, chunk_id, count(*) OVER (PARTITION BY query_id) AS n,
         rank() OVER (PARTITION BY query_id ORDER BY v DESC NULLS LAST) AS pv,
         rank() OVER (PARTITION BY query_id ORDER BY l DESC NULLS LAST) AS pl,
         rank() OVER (PARTITION BY query_id ORDER BY r DESC NULLS LAST) AS pr FROM one),
sorted AS (SELECT *, list_sort([pv / n, pl / n, pr / n]) AS q FROM placed),
scored AS (
  SELECT *, least(1.0, round(3 * least(1 - pow(1 - q[1], 3), 3 * q[2] * q[2] * (1 - q[2]) + pow(q[2], 3), pow(q[3], 3)), 12)) AS rho FROM sorted)
"""
SQL = {
    "p7_found": _POSITIONS + "SELECT query_id, arg_min(chunk_id, pv + pl + pr) AS chunk_id FROM scored GROUP BY query_id",
    "p7_ranking": _POSITIONS
    + """SELECT query_id, chunk_id, pv AS position_vector_score, pl AS position_lexical_score, pr AS position_rerank_score, pv + pl + pr AS position_sum,
  rho AS significance, rank() OVER (PARTITION BY query_id ORDER BY rho, pv + pl + pr, chunk_id) AS rank FROM scored""",
}
