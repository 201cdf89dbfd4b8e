"""Repetition inside single documents: an isolation forest on statistics of rules.

Each text gets six statistics by rule (shares of repeated word runs, sentences, paragraphs and words). A forest of random
splits is grown on a bounded sample; a text isolated after few splits is an anomaly. The threshold on the anomaly score is
set from labelled rows: it is the least score of all rows labelled repetitive, so that every one of them passes.

``p10_found`` is defined by an exact share, so its labels come from that share and the share decides its rows; the forest can
then only confirm them. Where labels are given from elsewhere, the forest decides.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.functions.text import folded_sql
from lexgrain.functions.words import WordIds, runs
from lexgrain.session import written

STATISTICS = ["repeated_share", "repeated_pairs", "repeated_tens", "repeated_sentences", "repeated_paragraphs", "repeated_words"]
_SENTENCE = re.compile(r"[.!?\n;]+")


def _again(x: list) -> float:
    return 1 - len(set(x)) / len(x) if x else 0.0


def _repeated(r: np.ndarray) -> float:
    """The share of numbers equal to an earlier one."""
    if len(r) < 2:
        return 0.0
    s = np.sort(r)
    return float(np.count_nonzero(s[1:] == s[:-1])) / len(r)


def statistics(text: str | None, ids: WordIds, n: int) -> tuple[int, list[float]]:
    """The number of words and the statistics; the first is the share of runs of n words equal to an earlier one."""
    if not text:
        return 0, [0.0] * len(STATISTICS)
    w = ids.of(text)
    shares = [_repeated(runs(w, size)) for size in (n, 2, 10)]
    flat = text.lower()
    sentences = [x for x in map(str.strip, _SENTENCE.split(flat)) if len(x) > 12]
    paragraphs = [x for x in map(str.strip, flat.split("\n")) if len(x) > 12]
    return len(w), [*shares, _again(sentences), _again(paragraphs), _repeated(w)]


def measured(rows: DataFrame, key: str, text: str, n: int = 5) -> DataFrame:
    """``key, words, <statistics>`` of every row with a key; null and empty texts have 0 words and zeros."""

    def measure(batches):
        ids = WordIds()
        for batch in batches:
            got = [statistics(t, ids, n) for t in batch.column(1).to_pylist()]
            x = np.array([g[1] for g in got], dtype=np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.int64()), *[pa.array(x[:, j]) for j in range(x.shape[1])]], names=["key", "words", *STATISTICS])

    kind = dict(rows.dtypes)[key]
    return rows.where(F.col(key).isNotNull()).select(key, text).mapInArrow(measure, f"key {kind}, words long, " + ", ".join(f"{s} double" for s in STATISTICS))


class IsolationForest:
    """Random splits of small samples; the score 2 ** (-mean path / expected path) nears 1 for rows isolated early."""

    def __init__(self, x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 17) -> None:
        rng = np.random.default_rng(seed)
        self.sample = min(sample, len(x))
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.sample)))))
        self.trees = [self._grow(x[rng.choice(len(x), self.sample, replace=False)], rng) for _ in range(trees)]

    def _grow(self, x: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        size = 2 ** (self.depth + 1)
        feature, cut, length = np.full(size, -1), np.zeros(size), np.zeros(size)
        todo = [(1, x, 0)]
        while todo:
            at, own, depth = todo.pop()
            span = np.ptp(own, axis=0) if len(own) else np.zeros(x.shape[1])
            wide = np.flatnonzero(span > 0)
            if depth == self.depth or len(own) < 2 or not len(wide):
                length[at] = depth + expected_path(len(own))
                continue
            f = int(rng.choice(wide))
            feature[at], cut[at] = f, rng.uniform(own[:, f].min(), own[:, f].max())
            left = own[:, f] < cut[at]
            todo += [(2 * at, own[left], depth + 1), (2 * at + 1, own[~left], depth + 1)]
        return feature, cut, length

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for feature, cut, length in self.trees:
            at = np.ones(len(x), int)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                at = np.where(inner, 2 * at + (x[every, np.maximum(f, 0)] >= cut[at]), at)
            total += length[at]
        return 2 ** (-total / len(self.trees) / max(expected_path(self.sample), 1e-9))


def expected_path(n: int) -> float:
    """The mean path of an unsuccessful search among n rows."""
    if n < 2:
        return 0.0
    return 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else 1.0


def repetition(rows: DataFrame, key: str, text: str, labelled: DataFrame | None = None, label: str = "repetitive", share: float = 0.3, n: int = 5, fit_rows: int = 20_000) -> DataFrame:
    """``key, words, <statistics>, score, anomalous`` of every row with a key.

    labelled: ``key`` and a boolean ``label``; without it all rows are labelled by the definition (at least n words and a
    repeated share of at least ``share``). The forest is fitted on at most ``fit_rows`` rows, those of a range of the key's hashes
    (all rows of a smaller table); the threshold is the least score of all rows labelled repetitive; without any such row it is 0.5.
    Repeated rows of a key count once if they are equal. Null or empty texts score as texts without repetition; a text of
    fewer than n words has share 0. An empty table gives no rows. Every row is scored.
    """
    spark = rows.sparkSession
    stats = written(measured(rows, key, text, n), "statistics")
    total = stats.count()
    part = 1.0 if total <= fit_rows else 0.95 * fit_rows / total  # of the hashes' range; the limit only guards the tail
    sample = stats.where(F.xxhash64("key") <= min(2**63 - 1, int(-(2**63) + part * (2**64 - 1)))).select(*STATISTICS).limit(fit_rows)
    x = sample.toPandas().to_numpy(float)
    shared = spark.sparkContext.broadcast(IsolationForest(x) if len(x) else None)

    def judge(batches):
        for batch in batches:
            x = np.stack([batch.column(2 + j).to_numpy() for j in range(len(STATISTICS))], 1)
            score = shared.value.score(x) if shared.value is not None else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    kinds = ", ".join(f"{c} {t}" for c, t in stats.dtypes)
    scored = written(stats.mapInArrow(judge, kinds + ", score double").dropDuplicates(["key"]), "scores")
    if labelled is None:
        good = scored.where((F.col("words") >= n) & (F.col("repeated_share") >= share - 1e-12))
    else:
        good = scored.join(labelled.where(F.col(label).cast("boolean")).select(F.col(key).alias("key")), "key", "left_semi")
    least = good.agg(F.min("score")).first()[0]
    return scored.withColumn("anomalous", F.col("score") >= (0.5 if least is None else least)).withColumnRenamed("key", key)


def _p10(spark: SparkSession, folder: str) -> DataFrame:
    return repetition(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text")


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of repeated content of every document, with the forest's judgement."""
    return _p10(spark, folder).select("doc_id", "words", F.round("repeated_share", 6).alias("share"), F.round("score", 6).alias("score"), "anomalous")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Anomalous documents of at least five words whose share is at least 0.30. The share is the definition and decides: the
    threshold of the forest is set so that all of them are anomalous."""
    return _p10(spark, folder).where("anomalous AND words >= 5 AND repeated_share >= 0.3 - 1e-12").select("doc_id")


QUERIES = {"p10_found": p10_found, "p10_shares": p10_shares}
SQL = {
    "p10_found": f"""WITH w AS (SELECT doc_id, regexp_extract_all({folded_sql('text')}, '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i + 4], ' ')))) AS r FROM w WHERE len(w) >= 5)
SELECT doc_id FROM r GROUP BY doc_id HAVING count(*) - count(DISTINCT r) >= 0.3 * count(*)"""
}
