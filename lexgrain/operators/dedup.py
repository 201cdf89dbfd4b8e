"""Exact and near duplicates of chunks, best first by reliability and length."""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrain.operators.rerank import reliability_rank
from lexgrain.session import small, written


def exact(rows: DataFrame, hash_: str, size: str, order: Column, *scope: str) -> DataFrame:
    """The best row of each hash (within each ``scope``) by (reliability, size), the earliest on ties, with ``first_seen``, the place of the
    hash's first row.

    Rows without a hash stay out, as do those with a null in the scope. order: a column that orders the rows. Aggregates combine before the shuffle.
    """
    some = rows.where(F.col(hash_).isNotNull() & (F.col(hash_) != "")).withColumn("_o", order)
    value = F.struct(reliability_rank(F.col("reliability")).alias("r"), F.coalesce(F.col(size), F.lit(0)).alias("s"))
    keys = [hash_, *scope]
    best = some.groupBy(*keys).agg(F.max(value).alias("_best"), F.min("_o").alias("first_seen"))
    met = some.join(best, keys).where(value == F.col("_best"))
    return met.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), "_o").alias("_row"), F.first("first_seen").alias("first_seen")).select("_row.*", "first_seen")


def lcs_length(a: str, b: str, need: int = 0) -> int:
    """The longest common subsequence, bit-parallel over the characters of a; 0 where it is seen on the way not to reach ``need``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    step = max(32, len(b) // 16)
    for begin in range(0, len(b), step):
        part = b[begin : begin + step]
        for c in part:
            u = v & where.get(c, 0)
            v = ((v + u) | (v - u)) & full
        # of the first p of b at most len(b) - need are left out, and the others stand among the first p + len(a) - need of a
        p = begin + len(part)
        reach = min(len(a), p + len(a) - need)
        if reach - (v & ((1 << reach) - 1)).bit_count() < p - (len(b) - need):
            return 0
    return len(a) - v.bit_count()


def indel_ratio(a: str, b: str, least: float = 0.0) -> float:
    """100 * (1 - insertions and deletions over both lengths). Equal ends are put aside first; 0 where it cannot reach ``least``."""
    if not a and not b:
        return 100.0
    total, same = len(a) + len(b), 0
    if a == b:
        return 100.0
    n = min(len(a), len(b))
    while same < n and a[same] == b[same]:
        same += 1
    tail = 0
    while tail < n - same and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[same : len(a) - tail], b[same : len(b) - tail]
    if 200.0 * (same + tail + min(len(a), len(b))) / total < least:
        return 0.0
    need = max(0, int(least * total / 200) - same - tail - 1)
    if need > min(len(a), len(b)):
        need = 0
    found = 200.0 * (same + tail + lcs_length(a, b, need)) / total
    return found if found >= least else 0.0


GRAMS, LETTERS = 256, 64

#: Up to so many rows of one group and length bucket meet in a task at once.
BLOCK = 4000


def _counts(text: str) -> bytes:
    """Counts of single characters in 64 slots and of pairs of neighbours in 256, 255 at most (which only brings two texts nearer)."""
    x = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    one = np.bincount((x * np.uint32(0x9E3779B1)) >> np.uint32(26), minlength=LETTERS)
    two = np.bincount(((x[:-1] * np.uint32(31) + x[1:]) * np.uint32(0x9E3779B1)) >> np.uint32(24), minlength=GRAMS)
    return np.minimum(np.concatenate([one, two]), 255).astype(np.uint8).tobytes()


def _gram_counts(text: str, q: int) -> np.ndarray:
    """Counts of runs of q characters in 4096 slots, 255 at most."""
    x = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(x) < q:
        return np.zeros(4096, np.uint8)
    h = x[: len(x) - q + 1].copy()
    for k in range(1, q):
        h = h * np.uint32(0x01000193) + x[k : len(x) - q + 1 + k]
    return np.minimum(np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=4096), 255).astype(np.uint8)


def _near_grams(texts: list[str], n: np.ndarray, i: np.ndarray, j: np.ndarray, q: int, share: float) -> np.ndarray:
    """Which of the pairs (i, j) of texts have counts of runs of q characters that do not rule out the share."""
    some, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    s = np.stack([_gram_counts(texts[x], q) for x in some]) if len(some) else np.zeros((0, 4096), np.uint8)
    u, v, keep = at[: len(i)], at[len(i) :], np.zeros(len(i), bool)
    for b in range(0, len(i), 1024):
        x, y = s[u[b : b + 1024]], s[v[b : b + 1024]]
        keep[b : b + 1024] = (np.maximum(x, y) - np.minimum(x, y)).sum(1, dtype=np.int32) <= (2 * q - 1) * (1 - share) * (n[i[b : b + 1024]] + n[j[b : b + 1024]]) + 1e-6
    return keep


def _near_counts(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """The places (in x, in y) of all pairs whose counts and lengths n, m do not rule out the share. m is in order."""
    xs, ys, found = x[:, :LETTERS].astype(np.int16), np.ascontiguousarray(y[:, :LETTERS].T.astype(np.int16)), []
    order = np.argsort(n, kind="stable")
    for begin in range(0, len(order), 32):
        own = order[begin : begin + 32]
        low, high = np.searchsorted(m, n[own[0]] * share - 1), np.searchsorted(m, n[own[-1]] / share + 1)
        for left in range(low, high, 4096):
            right = min(high, left + 4096)
            far, step = np.zeros((len(own), right - left), np.int16), np.empty((len(own), right - left), np.int16)
            for slot in range(LETTERS):
                np.subtract(xs[own, slot, None], ys[None, slot, left:right], out=step)
                np.abs(step, out=step)
                np.add(far, step, out=far)
            both = n[own, None] + m[None, left:right]
            shorter, longer = np.minimum(n[own, None], m[None, left:right]), np.maximum(n[own, None], m[None, left:right])
            i, j = np.nonzero((far <= (1 - share) * both + 1e-6) & (shorter >= share * longer))
            i, j = own[i], j + left
            for at in range(0, len(i), 8192):
                u, v = i[at : at + 8192], j[at : at + 8192]
                a, b = x[u, LETTERS:], y[v, LETTERS:]
                keep = (np.maximum(a, b) - np.minimum(a, b)).sum(1, dtype=np.int32) <= 3 * (1 - share) * (n[u] + m[v]) + 1e-6
                found.append((u[keep], v[keep]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *part]) for part in (zip(*found) if found else ([], [])))


def _runs(batches, columns: int):
    """The rows of each run of equal first ``columns`` (longs) as one batch, in order, over the ends of batches."""
    open_, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(columns)], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for begin, end in zip(cuts, cuts[1:]):
            if open_ and (keys[begin] != last).any():
                yield pa.Table.from_batches(open_).combine_chunks()
                open_ = []
            open_.append(batch.slice(begin, end - begin))
            last = keys[begin]
    if open_:
        yield pa.Table.from_batches(open_).combine_chunks()


def linked(rows: DataFrame, group: list[str], key: str, text: str, threshold: float = 92.0, block: int = BLOCK) -> DataFrame:
    """``k1, n1, r1, k2, n2, r2, ratio``: pairs of one group whose shorter/longer length and indel ratio reach the threshold, the first the
    earlier by (length, key), with lengths and ranks of reliability.

    Candidates share a length bucket or its neighbour. They meet in blocks, where a pair is no row until its counts are near: one
    insertion or deletion changes at most 2 q - 1 counts of runs of q characters (q from 1 to 4), so pairs that differ in too many
    are out without a comparison of their texts, and no pair is lost. What is left is scored by row, spread by key. rows: key, text, reliability and the group; rows with null or empty texts are in no pair, nulls of the
    group are one value.
    """
    share = threshold / 100
    kind = dict(rows.dtypes)[key]
    gs = [f"g{i}" for i in range(len(group))]
    some = rows.where(F.col(text).isNotNull() & (F.length(text) > 0) & F.col(key).isNotNull())
    some = some.select(*[F.coalesce(F.col(g).cast("string"), F.lit("?")).alias(x) for g, x in zip(group, gs)], F.col(key).alias("k"), F.length(text).alias("n"), reliability_rank(F.col("reliability")).alias("r"), F.col(text).alias("t"))
    base = written(some.withColumn("b", F.floor(F.log(F.col("n").cast("double")) / F.lit(-log(share))).cast("int")), "texts")
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)

    # a cell is a bucket of a group; its rows are in blocks, told apart by the hash of their key
    cells = written(base.groupBy(*gs, "b").agg(F.count("*").alias("rows")).select(*gs, "b", "rows", F.ceil(F.col("rows") / block).cast("long").alias("blocks"), F.monotonically_increasing_id().alias("cell")), "cells")
    after = cells.select(*gs, (F.col("b") - 1).alias("b"), F.col("blocks").alias("after"))
    before = cells.select(*gs, (F.col("b") + 1).alias("b"), F.col("blocks").alias("before"), F.col("cell").alias("cell_before"))
    known = cells.join(after, [*gs, "b"], "left").join(before, [*gs, "b"], "left").where("rows > 1 or after is not null or before is not null").drop("rows")
    known = small(written(known, "cells"))

    placed = base.join(known, [*gs, "b"]).withColumn("u", F.pmod(F.xxhash64("k"), F.col("blocks")))
    # a task (cell, u, v): block u of the cell with itself (u = v), with block v of the cell (v > u) and with block v of the cell after
    span = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    task = lambda cell, u, v, role: F.struct(cell.alias("cell"), u.alias("u"), v.alias("v"), F.lit(role).alias("role"))
    none = F.array().cast("array<struct<cell:bigint,u:bigint,v:bigint,role:int>>")
    own = F.filter(F.transform(span(F.greatest("blocks", F.coalesce("after", F.lit(0)))), lambda v: task(F.col("cell"), F.col("u"), v, 0)), lambda x: (x["v"] >= F.col("u")) | (x["v"] < F.coalesce("after", F.lit(0))))
    later = F.when(F.col("u") > 0, F.transform(span(F.col("u")), lambda u: task(F.col("cell"), u, F.col("u"), 1))).otherwise(none)
    next_ = F.when(F.col("before").isNotNull(), F.transform(span(F.col("before")), lambda u: task(F.col("cell_before"), u, F.col("u"), 2))).otherwise(none)
    tasks = placed.select(F.explode(F.concat(own, later, next_)).alias("x"), "k", "n", "r", "t").select("x.cell", "x.u", "x.v", "x.role", "k", "n", "r", "t")
    # partitions by number, which are not merged for being small: the rows are few bytes, the pairs many
    tasks = tasks.repartition(parts, "cell", "u", "v").sortWithinPartitions("cell", "u", "v")

    def meet(batches):
        for rows_ in _runs(batches, 3):
            rows_ = rows_.take(pa.array(np.argsort(rows_["n"].to_numpy(), kind="stable")))
            role, n, ks, r = rows_["role"].to_numpy(), rows_["n"].to_numpy().astype(np.int64), rows_["k"].to_pylist(), rows_["r"].to_numpy()
            if len(n) < 2:
                continue
            ts = rows_["t"].to_pylist()
            s = np.frombuffer(b"".join(map(_counts, ts)), np.uint8).reshape(len(n), LETTERS + GRAMS)
            alike, first = rows_["u"][0].as_py() == rows_["v"][0].as_py(), np.flatnonzero(role == 0)
            pairs = []
            for other in ([first] if alike else []) + [np.flatnonzero(role == 1), np.flatnonzero(role == 2)]:
                if len(first) and len(other):
                    i, j = _near_counts(s[first], n[first], s[other], n[other], share)
                    i, j = first[i], other[j]
                    if other is first:
                        i, j = i[i < j], j[i < j]
                    pairs.append((i, j))
            if pairs:
                i, j = (np.concatenate(x) for x in zip(*pairs))
                for q in (3, 4):
                    keep = _near_grams(ts, n, i, j, q, share)
                    i, j = i[keep], j[keep]
                # the first is the earlier by (length, key)
                turn = np.array([(n[a], ks[a]) > (n[b], ks[b]) for a, b in zip(i, j)], bool)
                i, j = np.where(turn, j, i), np.where(turn, i, j)
                k = rows_["k"].combine_chunks()
                yield pa.RecordBatch.from_arrays([x for at in (i, j) for x in (k.take(pa.array(at)), pa.array(n[at].astype(np.int32)), pa.array(r[at].astype(np.int32)))], names=["k1", "n1", "r1", "k2", "n2", "r2"])

    facts = f"k1 {kind}, n1 int, r1 int, k2 {kind}, n2 int, r2 int"
    close = tasks.mapInArrow(meet, facts)
    texts = base.select("k", "t")
    one = close.join(texts.select(F.col("k").alias("k1"), F.col("t").alias("t1")).repartition(parts, "k1").hint("merge"), "k1").repartition(parts, "k2")
    both = one.join(texts.select(F.col("k").alias("k2"), F.col("t").alias("t2")).repartition(parts, "k2").hint("merge"), "k2")

    def score(batches):
        for batch in batches:
            t, u = batch.column(6).to_pylist(), batch.column(7).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array([indel_ratio(*x, least=threshold) for x in zip(t, u)], pa.float64())], names=["k1", "n1", "r1", "k2", "n2", "r2", "ratio"])

    return both.select("k1", "n1", "r1", "k2", "n2", "r2", "t1", "t2").mapInArrow(score, facts + ", ratio double").where(F.col("ratio") >= threshold)


def near(rows: DataFrame, group: list[str], key: str, text: str, threshold: float = 92.0) -> DataFrame:
    """``key_kept, key_dropped, ratio``: the pairs of ``linked``; of each the weaker by (reliability, length) is dropped, the earlier on ties."""
    weaker = F.col("r1") > F.col("r2")
    return linked(rows, group, key, text, threshold).select(F.when(weaker, F.col("k1")).otherwise(F.col("k2")).alias("key_kept"), F.when(weaker, F.col("k2")).otherwise(F.col("k1")).alias("key_dropped"), "ratio").distinct()


def survivors(rows: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """The rows that no pair drops; equals the sequential rule wherever reliability is the same in a group."""
    return rows.join(pairs.select(F.col("key_dropped").alias(key)).distinct(), key, "left_anti")


RANKS = (3, 2, 1, 0)


def near_sequential(rows: DataFrame, group: list[str], key: str, text: str, threshold: float = 92.0) -> DataFrame:
    """``key`` of the rows that the sequential rule drops, which depends on the order where reliabilities differ.

    Rows are taken in order of (length, key). A row not dropped yet meets the later linked ones that are not: the one of higher
    reliability stays, and of equal ones the later; a row goes on meeting others after it is dropped. As a later row is never
    shorter, only one of lower reliability can be dropped by an earlier one. So whether a row falls before its turn depends on rows
    of higher reliability alone: four ranks, decided from the highest down by joins on the table of links, whatever the size of a group.
    """
    pairs = written(linked(rows, group, key, text, threshold).withColumn("o1", F.struct("n1", "k1")).withColumn("o2", F.struct("n2", "k2")).select("k1", "r1", "o1", "k2", "r2", "o2"), "links")
    down = pairs.where("r1 > r2")
    fallen = pairs.select("k1").limit(0)  # those dropped before their turn, by rank
    for rank in RANKS[1:]:
        killers = down.where(F.col("r2") == rank).join(fallen, "k1", "left_anti")
        fallen = written(fallen.unionByName(killers.select(F.col("k2").alias("k1")).distinct()), "fallen")
    # when each row is dropped by an earlier one
    ends = down.join(fallen, "k1", "left_anti").groupBy("k2").agg(F.min("o1").alias("end"))
    up = pairs.where("r1 <= r2").join(fallen, "k1", "left_anti").join(ends, "k2", "left")
    own = up.where(F.col("end").isNull() | (F.col("end") > F.col("o1"))).select("k1")
    return fallen.unionByName(own).distinct().withColumnRenamed("k1", key)
