"""Reranking of candidates: a heuristic over all, a fusion of normalised signals over a shortlist, a gate on the subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrain.functions.text import folded, terms
from lexgrain.operators.facets import containing

# The weights of the signals.
FUSION = {"cross": 0.55, "vector": 0.20, "lexical": 0.15, "overlap": 0.10}
HEURISTIC = {"vector": 0.55, "path": 0.20, "content": 0.15, "reliability": 0.10}


def reliability_weight(c: Column) -> Column:
    """high 1, medium 0.6, low 0.3; anything else 1."""
    return F.when(c == "medium", 0.6).when(c == "low", 0.3).otherwise(1.0)


def reliability_rank(c: Column) -> Column:
    return F.when(c == "high", 3).when(c == "medium", 2).when(c == "low", 1).otherwise(0)


def overlap(query_terms: Column, own_terms: Column) -> Column:
    """The share of the query's terms among the text's (both distinct); 0 for a query without terms."""
    return F.when(F.size(query_terms) > 0, F.size(F.array_intersect(query_terms, own_terms)) / F.size(query_terms)).otherwise(0.0)


def min_max(value: Column, group: str) -> Column:
    """Between 0 and 1 within the group; a constant signal is 1."""
    by = Window.partitionBy(group)
    low, high = F.min(value).over(by), F.max(value).over(by)
    return F.when(high == low, 1.0).otherwise((value - low) / (high - low))


def gate(queries: DataFrame, key: str, question: str, subjects: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows with ``gate``: 1 where the question names no stored subject or this one, else 0.25 (also for a null subject).

    queries: ``key, question``, one row each, so that a question is searched once however many rows it has.
    """
    asked = queries.select(F.col(key).alias("_key"), folded(F.col(question)).alias("_q"))
    stored = subjects.select(F.col("value").alias("_d"))
    named = containing(asked, stored).groupBy("_key").agg(F.collect_set("_d").alias("_named"))
    joined = rows.join(named, F.col(key) == F.col("_key"), "left")
    return joined.withColumn("gate", F.when(F.col("_named").isNull() | F.coalesce(F.array_contains("_named", F.lower("subject")), F.lit(False)), 1.0).otherwise(0.25)).drop("_named", "_key")


def _path_terms() -> Column:
    return terms(F.array_join(F.coalesce("hierarchy_path", F.array().cast("array<string>")), " "))


def heuristic(rows: DataFrame, group: str, k: int) -> DataFrame:
    """``heuristic_score, position`` of the k best of each group. Columns: vector_score, hierarchy_path, reliability, chunk_id, and the
    distinct terms ``query_terms`` and ``content_terms``, worked out once for each query and chunk (of the chunk's, those asked for do)."""
    score = (
        HEURISTIC["vector"] * F.coalesce("vector_score", F.lit(0.0)) + HEURISTIC["path"] * overlap(F.col("query_terms"), _path_terms())
        + HEURISTIC["content"] * overlap(F.col("query_terms"), F.coalesce("content_terms", F.array().cast("array<string>"))) + HEURISTIC["reliability"] * reliability_weight(F.col("reliability"))
    )
    by = Window.partitionBy(group).orderBy(F.desc(F.round("heuristic_score", 9)), "chunk_id")
    return rows.withColumn("heuristic_score", score).withColumn("position", F.row_number().over(by)).where(F.col("position") <= k)


def shortlist(rows: DataFrame, group: str, keep: int = 20) -> DataFrame:
    """The ``keep`` rows of each group with the best vector score (missing as 0), before any text is looked at."""
    first = Window.partitionBy(group).orderBy(F.desc(F.coalesce("vector_score", F.lit(0.0))), "chunk_id")
    return rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= keep).drop("_n")


def fusion(short: DataFrame, group: str, k: int) -> DataFrame:
    """``fused_score, position`` of the k best of a shortlist. Columns: vector_score, lexical_score, rerank_score (the cross-encoder's),
    hierarchy_path, gate, chunk_id, query_terms, content_terms as for ``heuristic``. A missing score counts as 0."""
    own = F.array_union(_path_terms(), F.coalesce("content_terms", F.array().cast("array<string>")))
    signals = short.select("*", *[F.coalesce(f"{s}_score", F.lit(0.0)).alias(f"_{s}") for s in ("vector", "lexical", "rerank")], overlap(F.col("query_terms"), own).alias("_overlap"))
    fused = (
        FUSION["cross"] * min_max(F.col("_rerank"), group) + FUSION["vector"] * min_max(F.col("_vector"), group) + FUSION["lexical"] * min_max(F.col("_lexical"), group) + FUSION["overlap"] * min_max(F.col("_overlap"), group)
    ) * F.col("gate")
    by = Window.partitionBy(group).orderBy(F.desc(F.round("fused_score", 9)), "chunk_id")
    return signals.withColumn("fused_score", fused).withColumn("position", F.row_number().over(by)).where(F.col("position") <= k).drop("_vector", "_lexical", "_rerank", "_overlap")
