"""Full-text search: any query term matches, rank is a tenth of the matching occurrences.

Only the terms that are asked for ever leave the scan. A set of questions up to a checked size is looked up where the text is
read, so a row carries its hits instead of its text; beyond that size the terms of all texts meet those of the questions in a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrain.functions.text import all_terms, terms
from lexgrain.session import small

#: Up to so many different terms are looked up in the scan.
MOST_TERMS = 20_000


def asked_terms(queries: DataFrame, question: str, most: int = MOST_TERMS) -> list[str] | None:
    """The different terms of all questions; None if they are more than ``most``."""
    got = queries.select(F.explode(terms(question)).alias("t")).distinct().limit(most + 1).collect()
    return sorted(r[0] for r in got) if len(got) <= most else None


def hits(text: Column | str, asked: list[str] | None) -> Column:
    """The occurrences of asked terms in a text, in order, with repeats; of all terms where there is no list."""
    own = all_terms(text)
    return own if asked is None else F.filter(own, lambda t: t.isin(*asked)) if asked else F.array().cast("array<string>")


def postings(rows: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """``key, keep..., term, tf``: a full index, for storing."""
    return rows.select(key, *keep, F.explode(all_terms(text)).alias("term")).groupBy(key, *keep, "term").agg(F.count("*").alias("tf"))


def scores(rows: DataFrame, key: str, found: str, queries: DataFrame, query_key: str, question: str, where: Column | None = None, *keep: str) -> DataFrame:
    """``query_key, key, lexical_score`` of every pair that shares a term. found: the rows' column of ``hits``, one row for each key.

    Rows partitioned by their key stay where they are: the pairs are counted there, and only each query's best are exchanged.
    """
    asked = small(queries.select(query_key, *keep, F.explode(terms(question)).alias("term")))
    each = rows.withColumn("term", F.explode(found)).drop(found)
    met = each.join(asked, "term")
    if where is not None:
        met = met.where(where)
    return met.groupBy(query_key, key).agg((F.count("*") * F.lit(0.1)).alias("lexical_score"))


def _against(rows: DataFrame, key: str, found: str, queries: list, query_kind: str, facets: list[str], each) -> DataFrame:
    """``each`` applied to the counts of matching occurrences of a batch of rows (down) and a block of queries (across).

    queries: ``(key, terms, facet values)``; a stated facet that differs from the row's makes the count 0.
    """
    spark = rows.sparkSession
    place = {t: i for i, t in enumerate(sorted({t for _, terms, _ in queries for t in terms}))}
    matrix = np.zeros((len(place), len(queries)), np.float32)
    for j, (_, own, _) in enumerate(queries):
        matrix[[place[t] for t in own], j] = 1
    values = [{v: i for i, v in enumerate(sorted({q[2][k] for q in queries if q[2][k] is not None}))} for k in range(len(facets))]
    stated = [np.array([-1 if q[2][k] is None else values[k][q[2][k]] for q in queries]) for k in range(len(facets))]
    shared = spark.sparkContext.broadcast((place, matrix, values, stated))
    names = [q[0] for q in queries]

    def run(batches):
        place, matrix, values, stated = shared.value

        def counts():
            for batch in batches:
                for begin in range(0, batch.num_rows, 2000):
                    part = batch.slice(begin, 2000)
                    lists = part.column(1)
                    flat = [place.get(t, -1) for t in lists.flatten().to_pylist()]
                    sizes = np.nan_to_num(np.array(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False), float)).astype(np.int64)
                    row, term = np.repeat(np.arange(len(sizes)), sizes), np.array(flat, np.int64)
                    row, term = row[term >= 0], term[term >= 0]
                    own = np.bincount(row * len(place) + term, minlength=len(sizes) * len(place)).reshape(len(sizes), len(place)).astype(np.float32)
                    s = own @ matrix
                    for k, known in enumerate(values):
                        mine = np.array([known.get(v, -2) for v in part.column(2 + k).to_pylist()])
                        s *= (stated[k] == -1) | (mine[:, None] == stated[k][None, :])
                    yield part.column(0), s

        yield from each(names, counts())

    return rows.select(key, found, *facets).mapInArrow(run, f"q {query_kind}, key {dict(rows.dtypes)[key]}, n double")


def best_matches(rows: DataFrame, key: str, found: str, queries: DataFrame, query_key: str, question: str, k: int | None, facets: dict[str, str] | None = None, block: int = 512) -> DataFrame:
    """``query_key, key, lexical_score`` of the k best rows of each query, ties by key; or, without k, ``query_key, matches``: how many rows match.

    found: the rows' column of ``hits``, one row for each key. facets: column of the rows -> column of the queries that must be equal
    where stated. Queries are taken in blocks; a block's terms and queries make a matrix that is sent to the tasks, so pairs
    of row and query are never rows of their own: of each task only what can still be among the best leaves.
    """
    facets = facets or {}
    kinds = dict(queries.dtypes)[query_key], dict(rows.dtypes)[key]
    asked = queries.select(query_key, F.array_distinct(terms(question)).alias("t"), *facets.values()).where(F.col(query_key).isNotNull() & (F.size("t") > 0))
    blocks = max(1, -(-asked.count() // block))

    def keep(names, counts):
        held = np.full((len(names), k), 0, np.float32)
        for keys, s in counts:
            held = -np.partition(-np.concatenate([held, s.T], 1), k - 1, axis=1)[:, :k]
            row, col = np.nonzero((s >= held.min(1)[None, :]) & (s > 0))
            yield pa.RecordBatch.from_arrays([pa.array([names[j] for j in col.tolist()], arrow[0]), keys.take(pa.array(row)), pa.array(s[row, col].astype(float))], names=["q", "key", "n"])

    def count(names, counts):
        total = np.zeros(len(names))
        for _, s in counts:
            total += (s > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(names, arrow[0]), pa.nulls(len(names), arrow[1]), pa.array(total)], names=["q", "key", "n"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    arrow = [to_arrow_type(_parse_datatype_string(x)) for x in kinds]
    met = None
    for b in range(blocks):
        own = [(r[0], r[1], r[2:]) for r in asked.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b).collect()]
        if own:
            part = _against(rows, key, found, own, kinds[0], list(facets), keep if k else count)
            met = part if met is None else met.unionByName(part)
    if met is None:
        met = rows.select(F.lit(None).cast(kinds[0]).alias("q"), F.col(key).alias("key"), F.lit(0.0).alias("n")).limit(0)
    if not k:
        return met.groupBy(F.col("q").alias(query_key)).agg(F.sum("n").cast("long").alias("matches")).where("matches > 0")
    by = Window.partitionBy("q").orderBy(F.desc("n"), "key")
    ranked = met.withColumn("position", F.row_number().over(by)).where(F.col("position") <= k)
    return ranked.select(F.col("q").alias(query_key), F.col("key").alias(key), (F.col("n") * F.lit(0.1)).alias("lexical_score"), "position")


def top(scored: DataFrame, query_key: str, key: str, k: int | Column) -> DataFrame:
    """The k best of each query, ties by key."""
    by = Window.partitionBy(query_key).orderBy(F.desc(F.round("lexical_score", 6)), key)
    return scored.withColumn("position", F.row_number().over(by)).where(F.col("position") <= k)
