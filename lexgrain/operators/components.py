"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrain.operators.skew import join_facts
from lexgrain.session import written


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 40) -> DataFrame:
    """``node, component`` (the smallest node of each) of all nodes of ``edges``; nulls and self-links are ignored.

    Links stay a distributed table through every round; each round is written to the shared folder, which cuts
    the lineage, and only two numbers (rows and their sum of hashes) reach the driver, beside the names of hot nodes. A star is one
    row per link, never an array, and a node with a third of all links is met in many tasks (``skew.join_facts``).
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    links = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = join_facts(both, low, "u", "v", "inner").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = join_facts(large, low, "u", "v", "inner")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        links = written(small, "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == tuple(now):
            break
        seen = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    own = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return own.unionByName(own.select(F.col("component").alias("node"), "component").distinct())
