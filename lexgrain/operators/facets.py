"""Facet filters and the routing of stated values to stored ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrain.functions.text import folded, unaccented
from lexgrain.session import small

# The only columns that a filter may name.
FILTERABLE = ("subject", "level", "track", "cycle", "language", "document_type")
FACETS = ("subject", "level", "track", "document_type")
# What people call a subject.
SYNONYMS = {
    "maths": "mathematiques", "math": "mathematiques", "mathematique": "mathematiques", "mathematiques": "mathematiques", "lettres": "francais",
    "philo": "philosophie", "svt": "svt", "sciences de la vie": "svt", "physique": "sciences_physiques", "physique chimie": "sciences_physiques",
    "ses": "sciences_economiques_sociales", "histoire geographie": "histoire_geographie", "hist geo": "histoire_geographie",
}


def facet_filter(filters: dict[str, str | None]) -> Column:
    """All stated filters must agree, accents and case aside; unknown names and empty values are ignored."""
    parts = [unaccented(F.col(c)) == unaccented(F.lit(v)) for c, v in filters.items() if c in FILTERABLE and v]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def same(stored: Column, stated: Column) -> Column:
    """No filter stated, or equal to the stored value, accents and case aside."""
    return stated.isNull() | F.coalesce(unaccented(stored) == unaccented(stated), F.lit(False))


def facet_values(documents: DataFrame) -> DataFrame:
    """``facet, value``: the distinct lower-case values of every facet, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.lower(c).alias("value")) for c in FACETS])).alias("p")
    return documents.select(pairs).select("p.facet", "p.value").where("value is not null and value <> ''").distinct()


def common_prefix(a: Column, b: Column) -> Column:
    """The number of equal characters at the start of both."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n > 0, F.coalesce(F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i))), F.lit(0))).otherwise(0)


def align(stated: DataFrame, values: DataFrame) -> DataFrame:
    """``facet, stated, value``: the stored value meant by each stated one; those without a match stay out.

    Subjects go through the synonyms first. Equal wins over a prefix either way, which wins over four equal letters at the
    start; ties go to the first value in string order. values comes from ``facet_values``.
    """
    form = folded(F.col("stated"))
    pairs = [x for kv in SYNONYMS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]
    form = F.when(F.col("facet") == "subject", F.coalesce(F.create_map(*pairs)[form], form)).otherwise(form)
    left = stated.distinct().withColumn("v", form)
    right = values.withColumn("d", folded(F.col("value")))
    # forms of four letters and more meet by their first four; shorter ones by the whole of the shorter
    starts = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.substr(F.col(c), F.lit(1), i)))
    four = left.where(F.length("v") >= 4).withColumn("i", F.left("v", F.lit(4))).join(right.where(F.length("d") >= 4).withColumn("i", F.left("d", F.lit(4))), ["facet", "i"])
    short_stated = left.where(F.length("v").between(1, 3)).withColumn("i", F.col("v")).join(right.withColumn("i", starts("d")), ["facet", "i"])
    short_stored = left.withColumn("i", starts("v")).join(right.where(F.length("d").between(1, 3)).withColumn("i", F.col("d")), ["facet", "i"])
    met = four.unionByName(short_stated).unionByName(short_stored)
    v, d = F.col("v"), F.col("d")
    rank = F.when(v == d, 1).when(d.startswith(v) | v.startswith(d), 2).when((F.length(v) >= 4) & (F.length(d) >= 4) & (F.left(v, F.lit(4)) == F.left(d, F.lit(4))), 3)
    best = met.withColumn("rank", rank).where("rank is not null").groupBy("facet", "stated").agg(F.min(F.struct("rank", "value")).alias("b"))
    return best.select("facet", "stated", "b.value")


def containing(texts: DataFrame, values: DataFrame) -> DataFrame:
    """The pairs of texts (with ``_q``) and values (with ``_d``, not empty) where the text contains the value.

    An equality join on the first three letters of the value (fewer for shorter ones) with the letters at every place of the
    text. The exploded texts are many times the table they come from, which Spark's estimate does not know, so they are never the
    side that is broadcast; the values are, as long as they are counted to be few.
    """
    n = F.length("_q")
    grams = F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substr(F.col("_q"), i, k))).otherwise(F.array().cast("array<string>"))))
    spread = texts.withColumn("_g", F.explode(F.array_distinct(grams)))
    keyed = values.where(F.length("_d") > 0).withColumn("_g", F.left("_d", F.lit(3)))
    return spread.join(small(keyed), "_g").where(F.col("_q").contains(F.col("_d"))).drop("_g")


def mentioned(questions: DataFrame, key: str, question: str, values: DataFrame) -> DataFrame:
    """``key, facet, value``: the first value of each facet that stands in the question as whole words."""
    spaced = lambda c: F.concat(F.lit(" "), F.regexp_replace(folded(c), "[^a-z0-9_]+", " "), F.lit(" "))
    texts = questions.select(F.col(key).alias("_key"), spaced(F.col(question)).alias("_q"))
    known = values.where(F.length(folded(F.col("value"))) > 0).select("facet", "value", spaced(F.col("value")).alias("_d"))
    return containing(texts, known).groupBy("_key", "facet").agg(F.min("value").alias("value")).withColumnRenamed("_key", key)


def relaxed(attempts: DataFrame, key: str) -> DataFrame:
    """The rows of the first attempt that found any. attempts: ``key, attempt, ...``, numbered from the strictest."""
    return attempts.withColumn("_r", F.rank().over(Window.partitionBy(key).orderBy("attempt"))).where("_r = 1").drop("_r")
