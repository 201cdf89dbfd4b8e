"""Texts put into containers of fixed capacity with little room left over.

Everything is planned on the histogram of sizes (``capacity`` numbers, whatever the corpus). All combinations of up to three
sizes that fill the upper window of a container are enumerated, non-negative least squares finds how often each should be
used to consume the histogram, the counts are rounded down, and the sizes left are packed greedily, largest first, each
container filled with the largest sizes that still fit. A plan is a list of (combination, times). Texts are read once, for their
sizes, which are written; from there on only keys and sizes move. They are numbered within their size by distributed ranking
(ranges of the order, so a size that every third piece has is spread over many tasks) and take the places of the plan in order,
by binary search in its ranges; no text is ever gathered on the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.operators.ranking import positions
from lexgrain.session import written

#: Runs of letters and numbers, and every other character that is not white space.
TOKENS = r"(?U)[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"


def token_count(text: Column) -> Column:
    """The size in tokens by rule; null for null."""
    return F.regexp_count(text, F.lit(TOKENS)).cast("long")


def tokenizer_count(text: Column, ranks_path: str, pattern: str) -> Column:
    """The size in tokens of a byte-pair vocabulary in tiktoken's rank format; the file must be readable on the executors."""

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return s.map(lambda t: None if t is None else len(coder.encode_ordinary(t)))

    return count(text)


def _combinations(sizes: np.ndarray, capacity: int, window: int) -> np.ndarray:
    """All multisets of one to three of the sizes with a sum in (capacity - window, capacity]; zeros fill unused places."""
    have = np.zeros(capacity + 1, bool)
    have[sizes] = True
    out = [np.stack([s := sizes[(sizes > capacity - window)], np.zeros_like(s), np.zeros_like(s)], 1)]
    for slack in range(window):
        rest = capacity - slack - sizes
        ok = (rest > 0) & (rest <= sizes)
        ok[ok] = have[rest[ok]]
        out.append(np.stack([sizes[ok], rest[ok], np.zeros(ok.sum(), int)], 1))
    a, b = np.meshgrid(sizes, sizes, indexing="ij")
    a, b = a[a >= b], b[a >= b]
    for slack in range(window):
        rest = capacity - slack - a - b
        ok = (rest > 0) & (rest <= b)
        ok[ok] = have[rest[ok]]
        out.append(np.stack([a[ok], b[ok], rest[ok]], 1))
    return np.concatenate(out).astype(np.int64)


def _least_squares(combos: np.ndarray, wanted: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Non-negative x with sum of x * combination near the histogram: accelerated projected gradient."""
    n = len(wanted)
    if not len(combos):
        return np.zeros(0)
    used = combos > 0
    flat, who = combos[used], np.nonzero(used)[0]
    apply = lambda x: np.bincount(flat, weights=x[who], minlength=n)
    back = lambda r: np.bincount(who, weights=r[flat], minlength=len(combos))
    v = np.ones(len(combos))
    for _ in range(30):  # the largest eigenvalue gives the step
        v = back(apply(v))
        scale = np.linalg.norm(v)
        v /= scale
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(apply(y) - wanted) / (1.05 * scale))
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / u * (new - x)
        x, t = new, u
    return x


def plan(histogram: np.ndarray, capacity: int, window: int = 2) -> list[tuple[list[int], int]]:
    """(sizes of one container, number of such containers); uses up histogram[1..capacity] exactly."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[list[int], int]] = []
    sizes = np.flatnonzero(left)
    combos = _combinations(sizes, capacity, window) if len(sizes) else np.zeros((0, 3), int)
    x = _least_squares(combos, left.astype(float))
    for j in np.argsort(-x, kind="stable"):
        times = int(x[j])
        own, uses = np.unique(combos[j][combos[j] > 0], return_counts=True)
        times = min([times, *(left[own] // uses)])
        if times > 0:
            left[own] -= times * uses
            out.append((np.repeat(own, uses).tolist(), int(times)))
    top = capacity
    while True:
        while top > 0 and not left[top]:
            top -= 1
        if top == 0:
            return out
        room, uses, at = capacity, {}, top
        while room > 0 and at > 0:
            at = min(at, room)
            while at > 0 and left[at] - uses.get(at, 0) <= 0:
                at -= 1
            if at > 0:
                n = int(min(room // at, left[at] - uses.get(at, 0)))
                uses[at] = uses.get(at, 0) + n
                room -= n * at
                at -= 1
        times = min(int(left[s]) // n for s, n in uses.items())
        for s, n in uses.items():
            left[s] -= times * n
        out.append(([s for s, n in uses.items() for _ in range(n)], times))


def pack(rows: DataFrame, key: str, size: Column, capacity: int = 1024, window: int = 2) -> DataFrame:
    """``key, piece, pieces, size, container`` of every row: piece 1 of 1 for what fits, else pieces of at most ``capacity``.

    Rows larger than the capacity are divided into full pieces and one rest; every full piece has a container of its own. A null
    or zero size needs no room: it joins container 0. Rows with a null key stay out; repeated rows of a key count once, with the
    largest size. Containers are numbered from 0; an empty table gives no rows. Which of the equally large rows stand
    together depends on the order of their keys' hashes only.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[key]
    # the size is worked out where the text is read; the largest of a repeated key is combined before the shuffle
    sized = written(rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.coalesce(size, F.lit(0)).cast("long").alias("n")).groupBy("k").agg(F.max("n").alias("n")), "sizes")
    parts = F.when(F.col("n") > capacity, F.ceil(F.col("n") / capacity)).otherwise(1).cast("int")
    pieces = sized.withColumn("pieces", parts).withColumn("piece", F.explode(F.sequence(F.lit(1), "pieces")))
    pieces = pieces.select("k", "piece", "pieces", F.least(F.lit(capacity).cast("long"), F.col("n") - (F.col("piece") - 1) * capacity).alias("s"))
    counts = pieces.groupBy("s").agg(F.count("*").alias("c")).toPandas()
    histogram = np.zeros(capacity + 1, np.int64)
    np.add.at(histogram, counts["s"].to_numpy(np.int64), counts["c"].to_numpy(np.int64))
    taken = np.zeros(capacity + 1, np.int64)
    lows: dict[int, list[int]] = {}
    bases: dict[int, list[int]] = {}
    base = 0
    for sizes, times in plan(histogram, capacity, window):
        for slot in sizes:
            lows.setdefault(slot, []).append(int(taken[slot]))
            bases.setdefault(slot, []).append(base)
            taken[slot] += times
        base += times
    # at most capacity x (containers of different kinds) ranges, whatever the number of texts
    shared = spark.sparkContext.broadcast({slot: (np.array(low), np.array(bases[slot])) for slot, low in lows.items()})

    def place(batches):
        for batch in batches:
            own, rank = batch.column(3).to_numpy(), batch.column(4).to_numpy() - 1
            spot = np.zeros(len(own), np.int64)
            for slot in np.unique(own[own > 0]).tolist():
                low, first = shared.value[slot]
                at = np.flatnonzero(own == slot)
                i = np.searchsorted(low, rank[at], side="right") - 1
                spot[at] = first[i] + rank[at] - low[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(spot)], names=["k", "piece", "pieces", "size", "container"])

    numbered = positions(pieces, ["s"], [F.xxhash64("k", "piece"), F.col("k"), F.col("piece")], "rank")
    return numbered.select("k", "piece", "pieces", "s", "rank").mapInArrow(place, f"k {kind}, piece int, pieces int, size long, container long").withColumnRenamed("k", key)


def _p8(spark: SparkSession, folder: str) -> DataFrame:
    return pack(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", token_count(F.col("text")))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document or of its pieces."""
    return _p8(spark, folder)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are."""
    per = _p8(spark, folder).groupBy("container").agg(F.sum("size").alias("used"))
    return per.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.round(F.sum("used") / (F.count("*") * 1024), 4).alias("fill"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents larger than a container, which had to be divided."""
    return _p8(spark, folder).where("piece = 2").select("doc_id")


QUERIES = {"p8_found": p8_found, "p8_containers": p8_containers, "p8_fill": p8_fill}
SQL = {
    "p8_found": r"""SELECT doc_id FROM documents
WHERE len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s\x{00A0}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]')) > 1024"""
}
