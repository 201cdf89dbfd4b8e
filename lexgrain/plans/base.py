"""The tables as the operators take them, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.session import small, written
from lexgrain.sources.tables import latest, table

CHUNKS = "ch AS (SELECT * FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC NULLS LAST) = 1)"
DOCUMENTS = "doc AS (SELECT * FROM source_documents WHERE document_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY updated_at DESC NULLS LAST) = 1)"
CANDIDATES = "cand AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY logged_at DESC NULLS LAST) = 1)"


WIDE = {"content", "indexed_content", "embedding"}


def chunks(spark: SparkSession, folder: str, *columns: str, of: DataFrame | None = None, **made) -> DataFrame:
    """The latest delivery of every chunk, the named columns only. of: only the chunks of these ids. made: columns worked out where the
    rows are read, so that what they are made from is not carried along."""
    keep = list(dict.fromkeys(["chunk_id", *columns, "created_at"]))
    rows = table(spark, folder, "chunks")
    if of is not None:  # written, as finding them may be a plan of its own
        rows = rows.join(small(written(of.select("chunk_id").distinct(), "ids")), "chunk_id", "left_semi")
    return latest(rows.select(*keep, *[c.alias(k) for k, c in made.items()]), ["chunk_id"], "created_at", wide=of is None and bool(WIDE & set(columns)))


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The latest delivery of every source document."""
    keep = list(dict.fromkeys(["document_id", *columns, "updated_at"]))
    return latest(table(spark, folder, "source_documents").select(*keep), ["document_id"], "updated_at")


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate of every request once, missing scores as null."""
    rows = latest(table(spark, folder, "candidates"), ["query_id", "chunk_id"], "logged_at")
    for s in ("vector_score", "lexical_score", "rerank_score"):
        rows = rows.withColumn(s, F.when(F.isnan(s), None).otherwise(F.col(s)))
    return rows


def clean_filter(c: str):
    """A filter as a request may state it: null, blank and the placeholder "string" mean none."""
    return F.when(F.col(c).isNull() | (F.trim(c) == "") | (F.trim(c) == "string"), None).otherwise(F.col(c))


def clean_filter_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR trim({x}) = '' OR trim({x}) = 'string' THEN NULL ELSE {x} END"


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests with sanitised filters; a top_k of null or 0 means 8."""
    return table(spark, folder, "search_requests").select("query_id", "question", F.coalesce(F.nullif("top_k", F.lit(0)), F.lit(8)).alias("k"), *[clean_filter(c).alias(c) for c in ("subject", "level", "track")], "asked_at")
