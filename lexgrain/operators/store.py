"""The document and chunk tables as relations: upsert, delete, counts, the quality report, integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an existing row takes from a new delivery; all other columns stay as they are.
DOCUMENT_UPDATES = ["subject", "level", "track", "cycle", "language", "document_type", "document_profile", "page_count", "gaps", "diagnostics", "updated_at"]
CHUNK_UPDATES = ["content", "indexed_content", "content_hash", "hierarchy", "metadata", "reliability", "embedding"]


def upsert(old: DataFrame, new: DataFrame, key: str, updates: list[str]) -> DataFrame:
    """Rows of either; of a key in both, the ``updates`` columns are the new ones (also if null) and the rest the old ones."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    known, given = F.col(f"a.{key}").isNotNull(), F.col(f"b.{key}").isNotNull()
    cols = [F.coalesce(f"a.{key}", f"b.{key}").alias(key) if c == key else F.when(given if c in updates else ~known, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in old.columns]
    return both.select(*cols)


def delete_documents(documents: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the documents in ``gone`` (document_id); their chunks go with them."""
    return documents.join(gone, "document_id", "left_anti"), chunks.join(gone, "document_id", "left_anti")


def chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``document_id, chunk_count`` of all documents, 0 without chunks."""
    n = chunks.groupBy("document_id").agg(F.count("*").alias("n"))
    return documents.select("document_id").join(n, "document_id", "left").select("document_id", F.coalesce("n", F.lit(0)).alias("chunk_count"))


def orphans(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks without a document."""
    return chunks.join(documents.select("document_id"), "document_id", "left_anti")


def quality_report(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per document, chunks or none: counts, embedded, mean and largest size, rows of tables, scans, gaps."""
    per = chunks.groupBy("document_id").agg(
        F.count("chunk_id").alias("chunk_total"), F.count("embedding").alias("embedded"), F.round(F.avg("char_count")).cast("long").alias("avg_chars"), F.max("char_count").alias("max_chars"),
        F.count_if(F.col("reliability") == "low").alias("low_reliability"), F.count_if(F.col("chunk_type") == "table_row").alias("table_rows"),
    )
    zero = ["chunk_total", "embedded", "low_reliability", "table_rows"]
    joined = documents.join(per, "document_id", "left")
    return joined.select("document_id", "source_file", "subject", "level", "track", "document_profile", "page_count", *[F.coalesce(c, F.lit(0)).alias(c) for c in zero], "avg_chars", "max_chars", F.coalesce(F.size("gaps"), F.lit(0)).alias("gap_count")).orderBy("source_file")


def corpus_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Counts of documents, chunks and embedded chunks."""
    one, none = F.lit(1), F.lit(0)
    rows = documents.select(one.alias("d"), none.alias("c"), none.alias("e")).unionByName(chunks.select(none.alias("d"), one.alias("c"), F.col("embedding").isNotNull().cast("int").alias("e")))
    return rows.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(name) for x, name in (("d", "documents"), ("c", "chunks"), ("e", "embedded"))])


def profile(kind: Column) -> Column:
    """Over a group's rows: tabular from 40 % tables, structured from 40 % lists and headings, else narrative (as for no rows)."""
    share = lambda *some: F.coalesce(F.avg(F.when(kind.isin(*some), 1.0).otherwise(0.0)), F.lit(0.0))
    return F.when(share("table_block", "table_row") >= 0.4, "tabular").when(share("list", "heading") >= 0.4, "structured").otherwise("narrative")


def with_vectors(rows: DataFrame, key: str, vectors: DataFrame, vector_key: str, vector: str, dims: int) -> DataFrame:
    """The rows with their vector, joined by key and never by place; ``usable`` tells vectors of the right length."""
    own = vectors.where(F.col(vector_key).isNotNull()).select(F.col(vector_key).alias("_vk"), F.col(vector).alias("vector"))
    return rows.join(own, F.col(key) == F.col("_vk"), "left").drop("_vk").withColumn("usable", F.coalesce(F.size("vector") == dims, F.lit(False)))


def pairing_errors(rows: DataFrame, key: str, vectors: DataFrame, vector_key: str) -> DataFrame:
    """``problem, n``: rows without a vector and vectors without a row; none of either means that the two fit."""
    a, b = rows.select(F.col(key).alias("k")).distinct(), vectors.select(F.col(vector_key).alias("k")).distinct()
    missing = a.join(b, "k", "left_anti").agg(F.count("*").alias("n")).select(F.lit("no vector").alias("problem"), "n")
    return missing.unionByName(b.join(a, "k", "left_anti").agg(F.count("*").alias("n")).select(F.lit("no row").alias("problem"), "n"))


def preview(planned: DataFrame, order: list[str], rows: int = 3) -> DataFrame:
    """The first rows that a plan would write; nothing is written."""
    return planned.orderBy(*order).limit(rows)


def stamped(rows: DataFrame, column: str = "updated_at") -> DataFrame:
    """The rows touched now."""
    return rows.withColumn(column, F.current_timestamp())


def new_id(digits: int = 16) -> Column:
    """A random id of so many hex digits, as for threads (16) and generated documents (8)."""
    return F.left(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(digits))


def json_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Nested columns as JSON text, nulls inside included and nothing escaped; a null column is an empty array or object."""
    kinds = dict(rows.dtypes)
    made = {c: F.coalesce(F.to_json(F.col(c), {"ignoreNullFields": "false"}), F.lit("[]" if kinds[c].startswith("array") else "{}")) for c in columns}
    return rows.withColumns(made)


def tolerant_json(text: Column) -> Column:
    """A JSON object as a map of texts; an empty one for text that is none."""
    kind = "map<string,string>"
    return F.coalesce(F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, kind)), F.from_json(F.lit("{}"), kind))


def column_check(found: dict[str, list[str]], expected: dict[str, list[str]]) -> list[tuple[str, str, bool]]:
    """(table, column, present) of all columns that the store needs."""
    return [(t, c, c in found.get(t, [])) for t, columns in expected.items() for c in columns]


def accepted_values(rows: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """``column, value, rows`` of values outside their list; nulls pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in rules])).alias("p")
    bad = reduce(lambda a, b: a | b, [(F.col("column") == c) & ~F.col("value").isin(*v) for c, v in rules.items()])
    return rows.select(pairs).select("p.column", "p.value").where(bad).groupBy("column", "value").agg(F.count("*").alias("rows"))
