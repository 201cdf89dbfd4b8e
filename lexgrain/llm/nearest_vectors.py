"""The k most similar vectors of every vector, by balanced posting lists.

Centroids come from bounded samples by balanced bisection; every usable row is indexed. There is a list for every ``list_size`` rows.
Up to ``most_lists`` of them come from one sample (at most ``fit_rows`` rows, those of the smallest hashes of their vectors); of more,
that sample gives ``most_lists`` cells, and each cell is bisected in a task of its own on a sample of 16 rows for each list.
So the centroids, which are what is broadcast, are at most ``most_lists`` squared (67 MB for 512 and 64 numbers).

A row is stored in each list whose centroid is at most ``store_ratio`` times as far as its nearest one (boundary rows so stand in
several lists) and searched in each list within ``probe_ratio``. Lists are found by a beam search over the neighbour graph of the
centroids. A list that is expected to hold more than ``block`` rows is cut in blocks, and every pair of blocks is met in a task of
its own: no row of it is left out, and no task holds more than two blocks.

Equal vectors form one class that is searched once; a class of any size adds at most k + 1 of its keys to any answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrain.session import written


def unit_vectors(rows: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """``key, vec``: usable vectors (``dims`` finite numbers, not all zero) at length 1, as float32 bytes. Null keys stay out."""

    def unit(batches):
        for batch in batches:
            col = batch.column(1)
            sizes = np.nan_to_num(np.array(pa.compute.list_value_length(col).to_numpy(zero_copy_only=False), dtype=float), nan=-1)
            at = np.flatnonzero((sizes == dims) & batch.column(0).is_valid().to_numpy(zero_copy_only=False))
            x = np.array(pa.compute.list_flatten(col.take(pa.array(at))).to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(at), dims)
            with np.errstate(all="ignore"):
                peak = np.abs(x).max(axis=1, initial=0)
                good = np.isfinite(x).all(axis=1) & (peak > 0)
                x, at = x[good] / peak[good, None], at[good]
                x /= np.linalg.norm(x, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([v.tobytes() for v in x.astype(np.float32)], pa.binary())], names=["key", "vec"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, vector).mapInArrow(unit, f"key {kind}, vec binary").groupBy("key").agg(F.first("vec").alias("vec"))


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 5) -> np.ndarray:
    """Bisects until no part is larger than len(x) / lists, then settles the centres with three plain rounds."""
    rng, cap, parts, todo = np.random.default_rng(seed), max(1, -(-len(x) // lists)), [], [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= cap:
            parts.append(own)
            continue
        y = x[own]
        c = y[rng.choice(len(y), 2, replace=False)]
        for _ in range(6):
            lean = y @ (c[0] - c[1])
            left = lean > 0
            if left.all() or not left.any():
                break
            c = np.stack([y[left].mean(0), y[~left].mean(0)])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        order = np.argsort(-(y @ (c[0] - c[1])), kind="stable")
        cut = int(np.clip((y @ (c[0] - c[1]) > 0).sum(), max(1, 0.3 * len(y)), max(1, 0.7 * len(y))))
        todo += [own[order[:cut]], own[order[cut:]]]
    c = np.stack([x[p].mean(0) for p in parts])
    for _ in range(3):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        near = np.concatenate([np.argmax(x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(np.bincount(near, minlength=len(c))[:, None] > 0, total, c)
    return (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)).astype(np.float32)


class CentroidGraph:
    """Each centroid linked to its nearest ones; batches of vectors walk it with a beam.

    Links of many centroids are looked for among those of neighbouring cells (``cells``: coarser centroids), so that no matrix of
    all against all is made.
    """

    def __init__(self, centroids: np.ndarray, degree: int = 12, entries: int = 24, seed: int = 3, cells: np.ndarray | None = None) -> None:
        self.c, n = centroids, len(centroids)
        degree = min(degree, max(1, n - 1))
        near = np.zeros((n, degree), np.int64)
        if cells is None:
            s = centroids @ centroids.T
            np.fill_diagonal(s, -2)
            near = np.argsort(-s, axis=1)[:, :degree]
        else:
            home = np.concatenate([np.argmax(centroids[i : i + 4096] @ cells.T, axis=1) for i in range(0, n, 4096)])
            members = [np.flatnonzero(home == j) for j in range(len(cells))]
            beside = np.argsort(-(cells @ cells.T), axis=1)[:, :8]
            for j, own in enumerate(members):
                if not len(own):
                    continue
                around = np.concatenate([members[i] for i in beside[j]])
                if len(around) <= degree:
                    around = np.arange(min(n, 4 * degree + 1))
                s = centroids[own] @ centroids[around].T
                s[own[:, None] == around[None, :]] = -2
                near[own] = around[np.argsort(-s, axis=1)[:, :degree]]
        far = np.random.default_rng(seed).integers(0, n, (n, 2))
        self.links = np.concatenate([near, far], axis=1)
        if cells is not None:
            self.entry = sorted({int(own[np.argmax(centroids[own] @ cells[j])]) for j, own in enumerate(members) if len(own)})
            return
        self.entry = [0]
        best = centroids @ centroids[0]
        while len(self.entry) < min(entries, n):  # spread over the space
            self.entry.append(int(np.argmin(best)))
            best = np.maximum(best, centroids @ centroids[self.entry[-1]])

    def search(self, x: np.ndarray, beam: int = 8, hops: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """For every row of x the ``beam`` best centroids found and their cosines, best first."""
        entry = np.array(self.entry)
        ids, sims = np.broadcast_to(entry, (len(x), len(entry))), x @ self.c[entry].T
        for hop in range(hops + 1):
            top = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * beam]
            ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
            if hop == hops:
                break
            new = self.links[ids[:, : max(2, beam // 2)]].reshape(len(x), -1)
            more = np.einsum("nd,nkd->nk", x, self.c[new])
            ids, sims = np.concatenate([ids, new], 1), np.concatenate([sims, more], 1)
            order = np.argsort(ids, axis=1, kind="stable")
            i = np.take_along_axis(ids, order, 1)
            s = np.take_along_axis(sims, order, 1)
            s[:, 1:][i[:, 1:] == i[:, :-1]] = -9
            ids, sims = i, s
        return ids[:, :beam], sims[:, :beam]


def _sample(vectors: DataFrame, total: int, rows: int) -> DataFrame:
    """About ``rows`` of the vectors, those of a range of the hashes; all of them if they are no more."""
    share = 1.0 if total <= rows else 0.95 * rows / total
    return vectors.where(F.xxhash64("h") <= min(2**63 - 1, int(-(2**63) + share * (2**64 - 1))))


def _matrix(rows) -> np.ndarray:
    return np.stack([np.frombuffer(r[0], np.float32) for r in rows])


def centroid_graph(vectors: DataFrame, total: int, dims: int, list_size: int, most_lists: int, fit_rows: int, each: int = 16) -> tuple[CentroidGraph | None, np.ndarray]:
    """The graph of the lists' centroids, and how many of all rows each list is expected to hold."""
    sample = _sample(vectors, total, fit_rows).select("vec").limit(fit_rows).collect()  # the limit only guards the tail
    if not sample:
        return None, np.zeros(0)
    x = _matrix(sample)
    lists = max(total // list_size, max(1, min(64, total // 50)))
    if lists <= most_lists:
        graph = CentroidGraph(balanced_centroids(x, lists))
    else:
        lists = min(lists, most_lists * most_lists)
        cells = balanced_centroids(x, most_lists)
        shared = vectors.sparkSession.sparkContext.broadcast(cells)

        def home(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    part = batch.slice(at, 2000)
                    v = np.frombuffer(b"".join(part.column(0).to_pylist()), np.float32).reshape(-1, dims)
                    yield pa.RecordBatch.from_arrays([pa.array(np.argmax(v @ shared.value.T, axis=1).astype(np.int32)), part.column(0)], names=["cell", "vec"])

        most = 4 * each * most_lists

        def fit(table: pa.Table) -> pa.Table:
            v = np.frombuffer(b"".join(table.column("vec").slice(0, most).to_pylist()), np.float32).reshape(-1, dims)
            return pa.table({"c": pa.array([c.tobytes() for c in balanced_centroids(v, max(1, min(most_lists, round(len(v) / each))))], pa.binary())})

        found = _sample(vectors, total, each * lists).select("vec").mapInArrow(home, "cell int, vec binary").groupBy("cell").applyInArrow(fit, "c binary").collect()
        graph = CentroidGraph(_matrix(found), cells=cells)
    own = np.concatenate([graph.search(x[i : i + 512], beam=4)[0][:, 0] for i in range(0, len(x), 512)])
    return graph, np.bincount(own, minlength=len(graph.c)) * (total / len(x))


def nearest(
    rows: DataFrame, key: str, vector: str, k: int = 5, dims: int = 64, list_size: int = 1000, most_lists: int = 512, fit_rows: int = 8_000, store_ratio: float = 1.10, probe_ratio: float = 1.20, most_probes: int = 5, block: int = 20_000
) -> DataFrame:
    """``key, neighbour, cosine, position`` (1..k, ties by key) for every usable vector.

    Unusable vectors (null, other length, a null or non-finite number, all zero) and null keys are left out; repeated rows of a
    key count once. Fewer than k other vectors give fewer rows; an empty table gives none. Other columns are ignored.
    """
    spark = rows.sparkSession
    vectors = written(unit_vectors(rows, key, vector, dims).withColumn("h", F.xxhash64("vec")), "vectors")
    first = vectors.withColumn("n", F.row_number().over(Window.partitionBy("h").orderBy("key"))).where(F.col("n") <= k + 1)
    classes = first.groupBy("h").agg(F.min_by("vec", "n").alias("vec"), F.sort_array(F.collect_list("key")).alias("keys"))
    total = vectors.count()
    graph, expected = centroid_graph(vectors, total, dims, list_size, most_lists, fit_rows)
    # rows beside the nearest list's come from the lists around
    shared = spark.sparkContext.broadcast((graph, np.maximum(1, np.ceil(1.5 * expected / block)).astype(np.int64)))

    def place(batches):
        g, blocks = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = np.frombuffer(b"".join(part.column(1).to_pylist()), np.float32).reshape(-1, dims)
                ids, sims = g.search(x, beam=most_probes)
                far = np.sqrt(np.maximum(2 - 2 * sims, 1e-12))
                row, col = np.nonzero(far <= far[:, :1] * probe_ratio)
                stored = far[row, col] <= far[row, 0] * store_ratio
                lists = ids[row, col].astype(np.int64)
                many = blocks[lists]
                if (many == 1).all():
                    yield _placed(part, row, lists << 20, np.ones(len(row), bool), stored)
                    continue
                # row i of a list in m blocks asks in cells (own, *) and is stored in cells (*, own)
                mine = (part.column(0).to_numpy()[row].view(np.uint64) >> np.uint64(20)).astype(np.int64) % many
                out = []
                for m in np.unique(many).tolist():
                    some = np.flatnonzero(many == m)
                    other = np.tile(np.arange(m), len(some))
                    r = np.repeat(some, m)
                    asks = (lists[r] << 20) + (mine[r] << 10) + other
                    out.append((row[r], asks, np.ones(len(r), bool), stored[r] & (other == mine[r])))
                    apart = stored[r] & (other != mine[r])
                    out.append((row[r][apart], ((lists[r] << 20) + (other << 10) + mine[r])[apart], np.zeros(int(apart.sum()), bool), np.ones(int(apart.sum()), bool)))
                yield _placed(part, *(np.concatenate(c) for c in zip(*out)))

    def scan(table: pa.Table) -> pa.Table:
        h = table.column("h").to_numpy()
        x = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float32).reshape(-1, dims)
        kept = np.flatnonzero(table.column("stored").to_numpy())
        data, own = x[kept], h[kept]
        asks = np.flatnonzero(table.column("asks").to_numpy())
        x, h = x[asks], h[asks]
        who, best, sims = [], [], []
        for at in range(0, len(x), 512):
            s = x[at : at + 512] @ data.T
            s[h[at : at + 512, None] == own[None, :]] = -9
            m = min(k, s.shape[1])
            if m == 0:
                continue
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            q = np.repeat(np.arange(len(s)), m)
            top = top.ravel()
            good = s[q, top] > -8
            q, top = q[good] + at, top[good]
            who.append(h[q])
            best.append(own[top])
            sims.append(np.einsum("nd,nd->n", x[q].astype(np.float64), data[top].astype(np.float64)))
        flat = [np.concatenate(v) if v else np.empty(0, d) for v, d in ((who, np.int64), (best, np.int64), (sims, np.float64))]
        return pa.table({"h": flat[0], "other": flat[1], "cosine": flat[2]})

    placed = classes.select("h", "vec").mapInArrow(place, "cell long, h long, vec binary, asks boolean, stored boolean")
    found = placed.groupBy("cell").applyInArrow(scan, "h long, other long, cosine double")
    merged = found.groupBy("h", "other").agg(F.max("cosine").alias("cosine"))
    top = merged.withColumn("n", F.row_number().over(Window.partitionBy("h").orderBy(F.desc("cosine"), "other"))).where(F.col("n") <= k).drop("n")
    across = top.join(classes.select(F.col("h").alias("other"), "keys"), "other").select("h", F.explode("keys").alias("neighbour"), "cosine")
    within = classes.where(F.size("keys") > 1).select("h", F.explode("keys").alias("neighbour"), F.lit(1.0).alias("cosine"))
    offered = across.unionByName(within).withColumn("n", F.row_number().over(Window.partitionBy("h").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("n") <= k + 1).drop("n")
    answers = vectors.select("key", "h").join(offered, "h").where("key <> neighbour")
    ranked = answers.withColumn("position", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("position") <= k)
    return ranked.select("key", "neighbour", "cosine", "position")


def _placed(part: pa.RecordBatch, row: np.ndarray, cell: np.ndarray, asks: np.ndarray, stored: np.ndarray) -> pa.RecordBatch:
    at = pa.array(row)
    return pa.RecordBatch.from_arrays([pa.array(cell), part.column(0).take(at), part.column(1).take(at), pa.array(asks), pa.array(stored)], names=["cell", "h", "vec", "asks", "stored"])


def _p6_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{folder}/chunks.parquet").select("chunk_id", "embedding"), "chunk_id", "embedding")


def p6_top5(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar other chunks of every usable embedding."""
    return _p6_nearest(spark, folder).select(F.col("key").alias("chunk_id"), F.col("neighbour").alias("neighbour_id"), F.round("cosine", 4).alias("cosine"), "position")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks among the five nearest of either whose cosine is 0.90 or more."""
    near = _p6_nearest(spark, folder).where("cosine >= 0.9")
    return near.select(F.least("key", "neighbour").alias("chunk_id_a"), F.greatest("key", "neighbour").alias("chunk_id_b")).distinct()


QUERIES = {"p6_found": p6_found, "p6_top5": p6_top5}
SQL = {
    "p6_found": """WITH v AS MATERIALIZED (SELECT DISTINCT chunk_id, CAST(embedding AS DOUBLE[64]) AS e FROM chunks WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b FROM v a JOIN v b ON a.chunk_id < b.chunk_id AND array_cosine_similarity(a.e, b.e) >= 0.9"""
}
