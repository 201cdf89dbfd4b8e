"""Reading the parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.session import small


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a folder of parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, key: list[str], by: str, wide: bool = False) -> DataFrame:
    """One row per key, the one with the largest ``by`` (nulls lowest); rows with a null key stay out.

    The aggregate combines before the shuffle, so many deliveries of one key cost one row per task. wide: the rows carry texts or
    vectors, so the keys delivered more than once are counted first, on the key alone; where they are few, all other rows stay
    where they are and only those of the few are shuffled.
    """
    rest = [c for c in df.columns if c not in key]
    full = df.dropna(subset=key)
    for c in key:
        full = full.where(F.col(c).isNotNull())

    def picked(rows: DataFrame) -> DataFrame:
        one = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.coalesce(F.col(by).cast("double"), F.lit(-1e300))).alias("_row"))
        return one.select(*key, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)

    if not wide:
        return picked(full)
    again = full.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(*key)
    few = small(again)
    return full.join(few, key, "left_anti").select(*df.columns).unionByName(picked(full.join(few, key, "left_semi")))
