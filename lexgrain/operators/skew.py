"""Joins of rows with facts about a key that a third of all rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys are called hot, whatever the table.
HOT = 256


def join_facts(rows: DataFrame, facts: DataFrame, key: str, spread: str, how: str = "left", part: int = 50_000) -> DataFrame:
    """The rows joined to the one row of facts of their key.

    Keys with more than ``part`` rows (and more than a 256th of all) are met in as many tasks as they have such parts: their rows
    are told apart by the hash of the column ``spread``, and their facts are repeated as often. Rows with a null key have none.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"))
    least = max(part, (sizes.agg(F.sum("n")).first()[0] or 0) // HOT)
    hot = {r[0]: -(-r[1] // least) for r in sizes.where((F.col("n") > least) & F.col(key).isNotNull()).collect()}
    if not hot:
        return rows.join(facts, key, how)
    salts = F.coalesce(F.create_map(*[F.lit(x) for kv in hot.items() for x in kv])[F.col(key)].cast("long"), F.lit(1))
    repeated = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), salts)).join(repeated, [key, "_salt"], how).drop("_salt")
