"""Positions within groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrain.session import written


def positions(df: DataFrame, group: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """Adds 1 + the number of rows of the group that come before in ``order`` (ties share a position).

    The rows are range-partitioned by group and order, so a group with a third of all rows is spread
    over many tasks; ranks are taken inside (range, group) and shifted by the sizes of the ranges before.
    """
    names = [f"_k{i}" for i in range(len(order))]
    keyed = df.select("*", F.struct(*[o.alias(n) for o, n in zip(order, names)]).alias("_key"))
    ranged = keyed.repartitionByRange(*group, "_key").withColumn("_range", F.spark_partition_id())
    # written once: the ranges come from a sample, and both sides of the join below must see the same ones
    fixed = written(ranged.select(*df.columns, "_key", "_range"), "ranges")
    local = fixed.withColumn("_local", F.rank().over(Window.partitionBy("_range", *group).orderBy("_key")))
    sizes = fixed.groupBy("_range", *group).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    on = F.col("_range") == F.col("_at")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return local.join(shift, on).select(*df.columns, (F.col("_local") + F.col("_shift")).cast("long").alias(name))
