"""Held-out texts inside a corpus, found with a positional inverted index.

1. The terms of the index are runs of ``gram`` words. The corpus is read and cut into words once: the postings of every term
   that the test texts contain (document and the places where it stands, a row per term and document) are written to the shared
   folder. A bitmap of fixed size (1 MB) keeps terms of no test text out before anything is written.
2. Document frequencies are counts over the stored postings. A shared run of ``run`` words covers at least one window of ``run``
   words of the test text. Of each window the ``anchors`` rarest terms that the corpus has are its anchors.
3. Postings of the anchors, less the anchor's place, are offsets of the test text in the document. Offsets at which ``agree``
   anchors meet go on to the texts themselves: a common run meets in all anchors of its window, a passage with some words
   changed in those it has left.
4. There the longest common run through the offset is measured: an exact match when it is long enough, otherwise a
   proximity match if most of a window's words stand near their places in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.functions.text import folded_sql
from lexgrain.functions.words import WordIds, runs
from lexgrain.operators.bitmaps import bitmap, has
from lexgrain.session import written

BITS = 23
#: A bitmap of 2 MB tells the documents whose texts are asked for.
DOCS_BITS = 24


def postings(corpus: DataFrame, bits, gram: int) -> DataFrame:
    """``term, doc, places``: the positional index of the terms in the (broadcast) bitmap. corpus: ``doc, text``."""

    def index(batches):
        ids = WordIds()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                terms, rows, places = [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    h = runs(ids.of(text), gram)
                    at = np.flatnonzero(has(bits.value, h)) if len(h) else h
                    if len(at):
                        terms.append(h[at])
                        places.append(at.astype(np.int32))
                        rows.append(np.full(len(at), i, np.int64))
                if not terms:
                    continue
                t, r, p = np.concatenate(terms), np.concatenate(rows), np.concatenate(places)
                order = np.lexsort((p, t, r))
                t, r, p = t[order], r[order], p[order]
                begin = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (r[1:] != r[:-1])))
                lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(t)).astype(np.int32)), pa.array(p))
                yield pa.RecordBatch.from_arrays([pa.array(t[begin].view(np.int64)), part.column(0).take(pa.array(r[begin])), lists], names=["term", "doc", "places"])

    return corpus.mapInArrow(index, f"term long, doc {dict(corpus.dtypes)['doc']}, places array<int>")


def _item_terms(items: DataFrame, gram: int) -> DataFrame:
    def cut(batches):
        ids = WordIds()
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                h = runs(ids.of(text), gram).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(h), i))), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h, pa.int64())], names=["item", "place", "term"])

    return items.mapInArrow(cut, f"item {dict(items.dtypes)['item']}, place int, term long")


def _anchors(terms: DataFrame, run: int, anchors: int) -> DataFrame:
    """``item, term, place, n``: of each window of ``run`` terms the ``anchors`` rarest that the corpus has; n: how many the item has."""

    def choose(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("place").to_numpy())
        df, term = table.column("df").to_numpy()[order], table.column("term").to_numpy()[order]
        width, wanted = min(run, len(df)), set()
        for start in range(len(df) - width + 1):
            own = np.flatnonzero(df[start : start + width]) + start
            wanted.update(own[np.argsort(df[own], kind="stable")[:anchors]].tolist())
        places = sorted(wanted)
        return pa.table({"item": pa.array([table.column("item")[0].as_py()] * len(places), table.schema.field("item").type), "term": pa.array(term[places], pa.int64()), "place": pa.array(places, pa.int32()), "n": pa.array([len(places)] * len(places), pa.int32())})

    return terms.groupBy("item").applyInArrow(choose, f"item {dict(terms.dtypes)['item']}, term long, place int, n int")


def longest_run(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """The longest common run of words with b's places shifted by ``offset`` against a, and its first place in a."""
    lo, hi = max(0, offset), min(len(a), offset + len(b))
    if hi <= lo:
        return 0, -1
    ends = np.flatnonzero(np.concatenate([[True], a[lo:hi] != b[lo - offset : hi - offset], [True]]))
    sizes = np.diff(ends) - 1
    k = int(sizes.argmax())
    return (int(sizes[k]), lo + int(ends[k])) if sizes[k] else (0, -1)


def near_window(a: np.ndarray, b: np.ndarray, offset: int, width: int, near: float, slack: int) -> int:
    """The first place of a window of b of ``width`` words of which the share ``near`` stands within ``slack`` words of its place in a; -1 for none."""
    at = np.arange(offset, offset + len(b))[:, None] + np.arange(-slack, slack + 1)
    hit = ((a[np.clip(at, 0, len(a) - 1)] == b[:, None]) & (at >= 0) & (at < len(a))).any(1)
    total = np.concatenate([[0], np.cumsum(hit)])
    good = np.flatnonzero(total[width:] - total[:-width] >= near * width)
    return int(good[0]) if len(good) else -1


def leaks(corpus: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, run: int = 18, anchors: int = 4, agree: int = 2, gram: int = 4, near: float = 0.8, slack: int = 4) -> DataFrame:
    """``doc, item, match, run_words, doc_place, item_place``, one row for each document and test text that meet.

    match is "exact" (a common run of at least ``run`` words, or the whole test text if it is shorter) or "proximity" (at least
    the share ``near`` of some window of the test text's words stands within ``slack`` words of its place). Places count words from 0.
    Null texts and keys and texts of fewer than ``gram`` words are in no row; repeated rows of a key count once; empty tables give no rows.
    """
    corpus = corpus.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    items = items.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).alias("item"), F.col(item_text).alias("text")).dropDuplicates(["item"])
    spark = corpus.sparkSession
    terms = written(_item_terms(items, gram), "test-terms")
    index = written(postings(corpus, spark.sparkContext.broadcast(bitmap(terms, "term", BITS)), gram), "postings")
    frequent = index.groupBy("term").agg(F.count("*").alias("df"))
    known = terms.join(frequent, "term", "left").select("item", "place", "term", F.coalesce("df", F.lit(0)).alias("df"))
    chosen = written(_anchors(known, run - gram + 1, anchors), "anchors")
    met = index.join(chosen, "term").select("doc", "item", "place", "n", F.explode("places").alias("p"))
    agreed = met.groupBy("doc", "item", (F.col("p") - F.col("place")).alias("offset")).agg(F.count("*").alias("met"), F.first("n").alias("n")).where(F.col("met") >= F.least(F.col("n"), F.lit(agree)))
    # at most as many offsets as the document has words
    spots = written(agreed.groupBy("doc", "item").agg(F.collect_set("offset").alias("offsets")), "spots")
    # neither the keys of these documents nor their pairs with test texts go through the driver: both grow with the corpus
    held = spark.sparkContext.broadcast(bitmap(spots.select(F.xxhash64("doc").alias("id")), "id", DOCS_BITS))

    def asked(batches):
        for batch in batches:
            yield batch.filter(pa.array(has(held.value, batch.column(0).to_numpy().view(np.uint64))))

    named = corpus.select(F.xxhash64("doc").alias("id"), "doc", F.col("text").alias("t"))
    texts = named.mapInArrow(asked, named.schema).drop("id")

    def judge(batches):
        ids = WordIds()
        last, a = None, None
        for batch in batches:
            out = []
            tests: dict[str, np.ndarray] = {}
            for i, (offsets, t, u) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))):
                if t != last:
                    last, a = t, ids.of(t)
                if u not in tests:
                    tests[u] = ids.of(u)
                b = tests[u]
                best = max((*longest_run(a, b, o), -o) for o in offsets)
                width = min(run, len(b))
                if best[0] >= width:
                    out.append((i, "exact", best[0], best[1], best[1] + best[2]))
                    continue
                for o in sorted(offsets):
                    w = near_window(a, b, o, width, near, slack)
                    if w >= 0:
                        out.append((i, "proximity", best[0], w + o, w))
                        break
            row = pa.array([o[0] for o in out], pa.int64())
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *[pa.array([o[k + 1] for o in out], kinds[k]) for k in range(4)]], names=["doc", "item", "match", "run_words", "doc_place", "item_place"])

    types = dict(spots.dtypes)
    pairs = spots.hint("merge").join(texts, "doc").join(items.withColumnRenamed("text", "u"), "item").select("doc", "item", "offsets", "t", "u")
    judged = pairs.mapInArrow(judge, f"doc {types['doc']}, item {types['item']}, match string, run_words int, doc_place int, item_place int")
    rest = [F.col(c) for c in ("match", "run_words", "doc_place", "item_place")]
    one = judged.groupBy("doc", "item").agg(F.max_by(F.struct(*rest), F.struct("run_words", "doc_place")).alias("r"))
    return one.select(F.col("doc").alias(doc), F.col("item").alias(item), "r.*")


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Exact and proximity matches of every document and test item."""
    return leaks(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text", spark.read.parquet(f"{folder}/eval_items.parquet"), "item_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and items with at least 18 consecutive words in common."""
    return p9_leaks(spark, folder).where("match = 'exact' AND run_words >= 18").select("doc_id", "item_id")


QUERIES = {"p9_found": p9_found, "p9_leaks": p9_leaks}
_RUNS = lambda table, key: f"SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - 16), lambda i: hash(array_to_string(w[i:i + 17], ' ')))) AS r FROM (SELECT {key}, regexp_extract_all({folded_sql('text')}, '[a-z0-9]+') AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) >= 18"
SQL = {"p9_found": f"WITH d AS ({_RUNS('documents', 'doc_id')}), e AS ({_RUNS('eval_items', 'item_id')}) SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (r)"}
