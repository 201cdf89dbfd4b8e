"""The numbered context of an answer, within a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block(index: Column, file: Column, page: Column, path: Column, content: Column) -> Column:
    """"[i] (file, p.N — path)" over the content; an unknown page or page 0 is "?", an empty path is left out."""
    shown = F.when(page.isNull() | (page == 0), F.lit("?")).otherwise(page.cast("string"))
    trail = F.array_join(F.coalesce(path, F.array().cast("array<string>")), " > ")
    return F.concat(F.lit("["), index.cast("string"), F.lit("] ("), file, F.lit(", p."), shown, F.when(trail != "", F.concat(F.lit(" — "), trail)).otherwise(""), F.lit(")\n"), F.coalesce(content, F.lit("")))


def within_budget(rows: DataFrame, group: str, order: str, text: str, budget: int) -> DataFrame:
    """The rows of each group, in order, until their running length passes the budget; the first always stays."""
    by = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("_sum", F.sum(F.length(text)).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(by)).where((F.col("_sum") <= budget) | (F.col("_n") == 1)).drop("_sum", "_n")
