"""Near-duplicate texts: improved consistent weighted sampling over TF-IDF word runs, banded, verified.

1. Texts that are equal letter for letter form one class; the class is represented once from there on.
2. Document frequencies of word runs are counted over all texts in a count table of fixed size
   (2**18 counters, 2 MB whatever the corpus), which is what gets broadcast.
3. Every text gets K consistent weighted samples of its runs with weight tf * sqrt(ln(1 + N / df)), or with weight 1 for each
   distinct run where the Jaccard similarity of the distinct runs is asked for: samples agree as often as what is asked for, so
   that what weighting pushes down (runs of a large family of texts, looping texts) is seen all the same. The draws (r, c, beta) of a
   run come from a pool of 2**14 triples per sample, chosen by hash; ln(weight) is rounded to steps of 0.1. Both
   only make the sampling coarser by a few percent and turn each draw into one table lookup.
4. The samples, a byte each, are written once. They are grouped in bands; texts with an equal band become candidates.
   A band shared by many texts is cut in blocks, and pairs of blocks are spread over tasks. Unrelated texts that share
   a band by chance grow as the square of the corpus: every row of a band carries half bytes of 24 samples outside the band,
   and pairs that agree in too few of them are dropped in the band, before they are written anywhere. Candidates whose
   samples agree far too seldom for the similarity asked for (five standard deviations) go no further.
5. Candidates are verified on the texts: weighted Jaccard of the TF-IDF runs, and Jaccard of the distinct runs.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.operators.bitmaps import bitmap, has
from lexgrain.session import written
from lexgrain.functions.text import folded_sql
from lexgrain.functions.words import WordIds, mixed, runs

COUNTERS_LOG = 18
POOL_LOG = 14
STEP = 0.1
LEVELS = 110  # ln(weight) from -1 to 10
LOWEST = -1.0
BLOCK = 128
PIECE = 30_000  # runs whose samples are drawn at a time: the arrays stay in the processor's cache


def _shingles(texts, n: int, ids: WordIds):
    """Distinct word runs of each text with their counts. A text shorter than n words counts as one run."""
    for text in texts:
        w = ids.of(text)
        if len(w) == 0:
            yield np.empty(0, np.uint64), np.empty(0, np.int64)
        elif len(w) < n:
            yield runs(w, len(w)), np.ones(1, np.int64)
        else:
            yield np.unique(runs(w, n), return_counts=True)


def _slots(u: np.ndarray) -> np.ndarray:
    return (u >> np.uint64(64 - COUNTERS_LOG)).astype(np.int64)


def _counters(found: DataFrame) -> tuple[np.ndarray, int]:
    """The counters as an array and the number of texts (in slot -1), from rows of ``at, n``: at most 2**18 + 1 numbers."""
    got = found.groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counters = np.zeros(1 << COUNTERS_LOG, np.int64)
    known = got[got["at"] >= 0]
    counters[known["at"].to_numpy()] = known["n"].to_numpy()
    return counters, int(got.loc[got["at"] == -1, "n"].sum())


def run_frequencies(texts: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Counters of document frequencies, by the upper bits of the run's number, and the number of texts."""

    def count(batches):
        ids, counters, total = WordIds(), np.zeros(1 << COUNTERS_LOG, np.int64), 0
        for batch in batches:
            own = [u for u, _ in _shingles(batch.column(0).to_pylist(), n, ids)]
            total += len(own)
            if own:
                counters += np.bincount(_slots(np.concatenate(own)), minlength=len(counters))
        at = np.flatnonzero(counters)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counters[at], total))], names=["at", "n"])

    return _counters(texts.mapInArrow(count, "at long, n long"))


def _idf(counters: np.ndarray, total: int) -> np.ndarray:
    return np.sqrt(np.log(1 + total / np.maximum(counters, 1)))


_TABLE: dict[int, np.ndarray] = {}
LOW_BITS = 11


def _table() -> np.ndarray:
    """For each weight level and pool entry: the rank of the value in the upper bits, a number of the quantum t in the lower 11."""
    if not _TABLE:
        rng = np.random.default_rng(20240611)
        size = 1 << POOL_LOG
        r, c, beta = rng.gamma(2, 1, size), rng.gamma(2, 1, size), rng.random(size)
        level = (LOWEST + STEP * np.arange(LEVELS))[:, None]
        t = np.floor(level / r + beta)
        a = np.log(c) - r * (t - beta) - r
        rank = np.argsort(np.argsort(a, axis=None)).reshape(a.shape).astype(np.uint32)
        ties = (mixed((t.astype(np.int64).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64((1 << LOW_BITS) - 1)).astype(np.uint32)
        _TABLE[0] = ((rank << np.uint32(LOW_BITS)) | ties).ravel()
    return _TABLE[0]


def _samples(elements: np.ndarray, levels: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """The k samples of each text (rows), a byte of (run, quantum) each."""
    table, odd = _table(), np.random.default_rng(7).integers(0, 2**31, size=k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    base = levels.astype(np.int64) << POOL_LOG
    high, low, shift = (elements >> np.uint64(32)).astype(np.uint32), (elements & np.uint64((1 << LOW_BITS) - 1)).astype(np.uint32), np.uint32(32 - POOL_LOG)
    out = np.empty((k, len(starts)), np.uint32)
    h, key, at = np.empty(len(elements), np.uint32), np.empty(len(elements), np.uint32), np.empty(len(elements), np.int64)
    for i in range(k):
        np.multiply(high, odd[i], out=h)
        np.right_shift(h, shift, out=h)
        np.add(h, base, out=at)
        np.take(table, at, out=key, mode="clip")
        np.bitwise_xor(key, low, out=key)
        np.minimum.reduceat(key, starts, out=out[i])
    return (out.T & np.uint32(0xFF)).astype(np.uint8)


_DRAWN = "id long, drawn binary, at array<int>, n array<int>"


def samples(texts: DataFrame, n: int, k: int, idf) -> DataFrame:
    """``id, drawn, at, n``: the k samples of every text of ``id, content`` that has a word, one byte each.

    idf: the broadcast table of weights, or None: every distinct run weighs 1, and the same pass counts the document
    frequencies (rows with a null id, counters in ``at`` and ``n``, the number of texts in slot -1).
    """

    def draw(batches):
        ids, seen, weights = WordIds(), set(), None if idf is None else idf.value
        counters, texts_met = np.zeros(1 << COUNTERS_LOG, np.int64), 0
        held, total = [], 0

        def row(keys, drawn, at, counts):
            kind = pa.list_(pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(drawn, pa.binary()), pa.array(at, kind), pa.array(counts, kind)], names=["id", "drawn", "at", "n"])

        def flush():
            starts = np.cumsum([0] + [len(u) for _, u, _ in held[:-1]])
            elements = np.concatenate([u for _, u, _ in held])
            w = np.ones(len(elements)) if weights is None else np.concatenate([c for _, _, c in held]) * weights[_slots(elements)]
            level = np.clip(np.rint((np.log(w) - LOWEST) / STEP), 0, LEVELS - 1)
            s = _samples(mixed(elements), level, starts, k)
            none = [None] * len(held)
            return row([i for i, _, _ in held], [x.tobytes() for x in s], none, none)

        for batch in batches:
            keys, counted = batch.column(0).to_pylist(), []
            for key, (u, c) in zip(keys, _shingles(batch.column(1).to_pylist(), n, ids)):
                texts_met += 1
                counted.append(u)
                if key in seen:
                    continue
                seen.add(key)
                if len(u):
                    held.append((key, u, c))
                    total += len(u)
                    if total >= PIECE:
                        yield flush()
                        held, total = [], 0
            if weights is None and counted:
                counters += np.bincount(_slots(np.concatenate(counted)), minlength=len(counters))
        if held:
            yield flush()
        if weights is None and texts_met:
            at = np.flatnonzero(counters)
            for j in range(0, len(at), 20_000):
                yield row([None], [None], [at[j : j + 20_000].astype(np.int32)], [counters[at[j : j + 20_000]].astype(np.int32)])
            yield row([None], [None], [[-1]], [[texts_met]])

    return texts.select("id", "content").mapInArrow(draw, _DRAWN)


SIGNED = 24  # samples in the signature of a row of a band, half a byte each
SHORT = (1 << 32) - 1  # the bits of an id that stand for it in the rows of bands and in candidates; those of one short id stand together
WANTED_LOG = 24  # a bitmap of 2 MB tells the texts that are in likely pairs
# cell: 30 bits of the band's number, two of the side
_ENTRY = np.dtype([("cell", "<u4"), ("id", "<u4"), ("sign_low", "<u4"), ("sign", "<u8")])
PACKED = 1_000_000  # rows of bands that are packed at a time


@lru_cache(maxsize=8)
def _places(k: int, rows: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(which samples make each band, which others make the signature of its rows), of k samples a text."""
    bands = np.concatenate([np.arange(k), np.random.default_rng(11).permutation(k)])[: rows * count].reshape(count, rows)
    rng = np.random.default_rng(13)
    return bands, np.stack([rng.permutation(np.setdiff1d(np.arange(k), own))[:SIGNED] for own in bands])


def _keys(batch: pa.RecordBatch, rows: int, count: int, signed: bool = False):
    """(ids, band numbers of each, signatures in two parts): every text under its bands, some of them from samples used before, in other company."""
    for k in range(0, batch.num_rows, 1000):
        part = batch.slice(k, 1000)
        s = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
        bands, others = _places(s.shape[1], rows, count)
        key = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64), (part.num_rows, count)).copy()
        for j in range(rows):
            key = (key << np.uint64(8)) | s[:, bands[:, j]]
        sign, low = np.zeros(key.shape, np.uint64), np.zeros(key.shape, np.uint32)
        for j in range(16 * signed):
            sign = (sign << np.uint64(4)) | (s[:, others[:, j]] & np.uint8(15))
        for j in range(16, SIGNED * signed):
            low = (low << np.uint32(4)) | (s[:, others[:, j]] & np.uint8(15))
        yield part.column(0).to_numpy(), mixed(key), sign, low


def agreeing(similarity: float) -> int:
    """How many of a signature's samples must agree: as many as a pair at 0.9 times the similarity has in 94 of 100 bands at least."""
    p = 0.9 * similarity + (1 - 0.9 * similarity) / 16
    over = [sum(comb(SIGNED, i) * p**i * (1 - p) ** (SIGNED - i) for i in range(t, SIGNED + 1)) for t in range(SIGNED + 1)]
    return max(t for t, share in enumerate(over) if share >= 0.94)


def _unlike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many half bytes of two unsigned numbers differ."""
    z = x ^ y
    z |= z >> z.dtype.type(2)
    z |= z >> z.dtype.type(1)
    return np.bitwise_count(z & z.dtype.type(0x1111111111111111 & np.iinfo(z.dtype).max))


SKETCH = 128


def likely_pairs(pairs: DataFrame, drawn: DataFrame, similarity: float) -> DataFrame:
    """Of candidates (ids by their lower bits) the ``a, b`` whose first 128 samples, half a byte each, agree as often as a similarity
    five standard deviations below ``similarity`` would.

    Called with 0.9 times the similarity asked for: a pair at exactly 0.5 is lost with a chance under 1e-9, above it less.
    """
    p = similarity + (1 - similarity) / 16
    least = SKETCH * p - 5 * np.sqrt(SKETCH * p * (1 - p))

    def halved(batches):
        for batch in batches:
            s = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)[:, :SKETCH] & np.uint8(15)
            both = (s[:, ::2] << np.uint8(4)) | s[:, 1::2]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in both], pa.binary())], names=["id", "s"])

    def agree(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (2, 3))
            keep = pa.array(np.flatnonzero(SKETCH - _unlike(x, y).sum(1, dtype=np.int64) >= least))
            yield pa.RecordBatch.from_arrays([batch.column(i).take(keep) for i in (0, 1)], names=["a", "b"])

    short = drawn.mapInArrow(halved, "id long, s binary").groupBy("id").agg(F.first("s").alias("s"))
    short = short.select("id", "s", F.col("id").bitwiseAND(SHORT).alias("of")).repartition("of")
    left = pairs.join(short.select(F.col("of").alias("a"), F.col("id").alias("i"), F.col("s").alias("x")), "a")
    both = left.join(short.select(F.col("of").alias("b"), F.col("id").alias("j"), F.col("s").alias("y")), "b")
    likely = both.select("i", "j", "x", "y").mapInArrow(agree, "a long, b long")
    return likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def crowded(drawn: DataFrame, rows: int, count: int) -> tuple[np.ndarray, int]:
    """How many rows stand in each of 2**18 slots of band numbers, and their total: a bounded picture of which bands are hot."""

    def add(batches):
        counters = np.zeros(1 << COUNTERS_LOG, np.int64)
        for batch in batches:
            for _, key, _, _ in _keys(batch, rows, count):
                counters += np.bincount(_slots(key.ravel()), minlength=len(counters))
        at = np.flatnonzero(counters)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counters[at], counters.sum()))], names=["at", "n"])

    return _counters(drawn.select("id", "drawn").mapInArrow(add, "at long, n long"))


def candidate_pairs(drawn: DataFrame, rows: int, count: int, part: int = 4_000_000, cell: int = 20_000, similarity: float = 0.5) -> DataFrame:
    """Distinct ``a, b`` (a < b), by the lower 32 bits of the ids, that share a band and whose signatures in it agree as ``similarity`` asks (``agreeing``).

    Bands that may be hot (their slot holds ``cell`` rows more than the average slot) are cut before the shuffle: each text
    takes one of the blocks of about ``cell`` rows, and each pair of blocks is a cell of its own, so no task receives more of
    a band than two blocks. Partitions are as many as the rows ask for, about ``part`` rows each. Rows travel packed, 20 bytes each.
    """
    spark = drawn.sparkSession
    load, total = crowded(drawn, rows, count)
    blocks = np.maximum(1, -(-(load - total // len(load)) // cell)).astype(np.int64)
    blocks[load - total // len(load) < cell] = 1
    shared = spark.sparkContext.broadcast(blocks)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(-(-total // part)))
    most = SIGNED - agreeing(similarity)

    def place(batches):
        blocks, held, rows_held = shared.value, [], 0
        for batch in batches:
            for own, key, sign, low in _keys(batch, rows, count, True):
                who, band, sign, low = np.repeat(own, count), key.ravel(), sign.ravel(), low.ravel()
                many = blocks[_slots(band)]
                cold = many == 1
                held.append((band[cold], who[cold], sign[cold], low[cold], np.zeros(int(cold.sum()), np.uint32)))
                rows_held += len(held[-1][0])
                hot = np.flatnonzero(~cold)
                for i in hot.tolist():
                    m = int(many[i])
                    mine = int(mixed(who[i : i + 1].view(np.uint64))[0] % np.uint64(m))
                    other = np.arange(m)
                    first, last = np.minimum(other, mine).astype(np.uint64), np.maximum(other, mine).astype(np.uint64)
                    names = mixed(band[i] + mixed(first * np.uint64(1 << 20) + last + np.uint64(1)))
                    held.append((names, np.full(m, who[i]), np.full(m, sign[i]), np.full(m, low[i]), np.where(other == mine, 0, np.where(other > mine, 1, 2)).astype(np.uint32)))
                    rows_held += m
                if rows_held >= PACKED:
                    yield _packed(held, parts)
                    held, rows_held = [], 0
        if held:
            yield _packed(held, parts)

    def group(batches):
        got = [np.frombuffer(x, _ENTRY) for b in batches for x in b.column(0).to_pylist()]
        if not got:
            return
        got = np.concatenate(got)
        order = np.lexsort((got["id"], got["cell"] >> np.uint32(2)))
        cell, own = got["cell"][order], got["id"][order].astype(np.int64)
        band, side = cell >> np.uint32(2), cell & np.uint32(3)
        keep = np.append(True, (band[1:] != band[:-1]) | (own[1:] != own[:-1]))
        band, side, own, order = band[keep], side[keep], own[keep], order[keep]
        sign, low = got["sign"][order], got["sign_low"][order]
        del got, order, cell
        begin = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
        sizes = np.diff(np.append(begin, len(band)))
        # whole bands of up to BLOCK rows: every row with the next one of its band, with the one after that, and so on
        few = (sizes <= BLOCK) & (side[begin] == 0)
        after = np.repeat(np.where(few, begin + sizes, 0), sizes) - np.arange(len(band)) - 1
        at, step = np.flatnonzero(after > 0), 1
        while len(at):
            for k in range(0, len(at), 1 << 18):
                x = at[k : k + (1 << 18)]
                x = x[_unlike(sign[x], sign[x + step]) + _unlike(low[x], low[x + step]) <= most]
                if len(x):
                    yield _paired(own[x], own[x + step])
            step += 1
            at = at[after[at] >= step]
        for s, m in zip(begin[~few], sizes[~few]):
            if side[s] == 0:
                met = ((np.arange(i, min(i + BLOCK, s + m)), np.arange(j, min(j + BLOCK, s + m))) for i in range(s, s + m, BLOCK) for j in range(i, s + m, BLOCK))
            else:
                x, y = s + np.flatnonzero(side[s : s + m] == 1), s + np.flatnonzero(side[s : s + m] == 2)
                met = ((x[i : i + BLOCK], y[j : j + BLOCK]) for i in range(0, len(x), BLOCK) for j in range(0, len(y), BLOCK))
            for x, y in met:
                i, j = np.nonzero(_unlike(sign[x][:, None], sign[y][None, :]) + _unlike(low[x][:, None], low[y][None, :]) <= most)
                if x[0] == y[0]:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    yield _paired(own[x[i]], own[y[j]])

    packed = drawn.select("id", "drawn").mapInArrow(place, "part int, rows binary")
    return packed.repartitionById(parts, "part").select("rows").mapInArrow(group, "a long, b long").repartition("a").distinct()


def _packed(held: list, parts: int) -> pa.RecordBatch:
    """A row for each partition that gets any of the rows (name of the cell, id, signature, side)."""
    name, who, sign, low, side = (np.concatenate([h[k] for h in held]) for k in range(5))
    at = ((name & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int32 if parts > 65_535 else np.uint16)
    order = np.argsort(at, kind="stable")
    rows = np.empty(len(name), _ENTRY)
    # the lowest of the 30 bits keeps cells of two sides apart from whole ones, should the others be equal
    number = ((name >> np.uint64(35)) << np.uint64(1)) | (side > 0)
    rows["cell"] = ((number << np.uint64(2)) | side).astype(np.uint32)[order]
    rows["id"], rows["sign"], rows["sign_low"] = (who[order] & SHORT).astype(np.uint32), sign[order], low[order]
    ends = np.flatnonzero(np.append(np.diff(at[order].astype(np.int64)) > 0, True)) + 1
    begins = np.append(0, ends[:-1])
    return pa.RecordBatch.from_arrays([pa.array(at[order][begins].astype(np.int32)), pa.array([rows[i:j].tobytes() for i, j in zip(begins, ends)], pa.binary())], names=["part", "rows"])


def _paired(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _verify(pairs: DataFrame, n: int, idf) -> DataFrame:
    def score(batches):
        ids, weights, kept = WordIds(), idf.value, {}

        def of(key, text):
            if key not in kept:
                if len(kept) > 2000:
                    kept.clear()
                kept[key] = next(_shingles([text], n, ids))
            return kept[key]

        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            plain, weighted = [], []
            for i in range(len(a)):
                u, cu = of(a[i], x[i])
                v, cv = of(b[i], y[i])
                _, p, q = np.intersect1d(u, v, assume_unique=True, return_indices=True)
                plain.append(len(p) / max(1, len(u) + len(v) - len(p)))
                wu = cu * weights[(u >> np.uint64(64 - COUNTERS_LOG)).astype(np.int64)]
                wv = cv * weights[(v >> np.uint64(64 - COUNTERS_LOG)).astype(np.int64)]
                shared = np.minimum(wu[p], wv[q]).sum()
                weighted.append(float(shared / max(1e-12, wu.sum() + wv.sum() - shared)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(plain, pa.float64()), pa.array(weighted, pa.float64())], names=["a", "b", "jaccard", "weighted"])

    return pairs.mapInArrow(score, "a long, b long, jaccard double, weighted double")


def near_duplicate_classes(
    rows: DataFrame, content: str = "content", n: int = 5, similarity: float = 0.8, measure: str = "weighted", band_rows: int = 4, band_count: int = 100
) -> DataFrame:
    """``a, b, jaccard, weighted``: pairs of classes of equal texts whose ``measure`` reaches ``similarity``.

    A class is the xxhash64 of its text. Null texts and texts without a word are in no pair; empty input gives no rows.
    measure: "weighted" (Jaccard of TF-IDF weights) or "jaccard" (of distinct runs); the samples are drawn by the same measure.
    band_rows and band_count set the chance that a pair is seen: about 1 - (1 - s**rows)**count, 0.997 at a similarity of 0.5
    of that measure with the defaults, whatever the corpus.
    """
    return _classes(rows, content, n, similarity, measure, band_rows, band_count)[0]


def _classes(rows: DataFrame, content: str, n: int, similarity: float, measure: str, band_rows: int, band_count: int) -> tuple[DataFrame, DataFrame]:
    """(the pairs of classes, the samples of every class that has a word)."""
    spark = rows.sparkSession
    texts = rows.where(F.col(content).isNotNull()).select(F.xxhash64(content).alias("id"), F.col(content).alias("content"))
    k = max(SKETCH, band_rows * ((4 * band_count + 4) // 5))
    if measure == "weighted":
        counters, total = run_frequencies(texts.select("content"), n)
        idf = spark.sparkContext.broadcast(_idf(counters, total))
        drawn = written(samples(texts, n, k, idf), "samples")
    else:
        drawn = written(samples(texts, n, k, None), "samples")
        counted = drawn.where("id is null").select(F.explode(F.arrays_zip("at", "n")).alias("c")).select("c.at", "c.n")
        idf = spark.sparkContext.broadcast(_idf(*_counters(counted)))
    drawn = drawn.where("id is not null").select("id", "drawn")
    pairs = written(likely_pairs(candidate_pairs(drawn, band_rows, band_count, similarity=similarity), drawn, 0.9 * similarity), "likely")
    bits = spark.sparkContext.broadcast(bitmap(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id", WANTED_LOG))

    def asked(batches):
        for batch in batches:
            yield batch.filter(pa.array(has(bits.value, batch.column(0).to_numpy().view(np.uint64))))

    one = texts.mapInArrow(asked, texts.schema).groupBy("id").agg(F.first("content").alias("content"))
    left = pairs.join(one.select(F.col("id").alias("a"), F.col("content").alias("x")), "a")
    both = left.join(one.select(F.col("id").alias("b"), F.col("content").alias("y")), "b").select("a", "b", "x", "y")
    return written(_verify(both, n, idf).where(F.col(measure) >= similarity), "links"), drawn


def near_duplicate_pairs(
    rows: DataFrame, key: str, content: str = "content", n: int = 5, similarity: float = 0.8, measure: str = "weighted", band_rows: int = 4, band_count: int = 100, expanded: int | None = 16
) -> DataFrame:
    """``{key}_a, {key}_b, jaccard, weighted`` with a < b, for keys whose texts are equal or similar.

    Repeated rows of one key count once; a null key is in no pair. Classes of up to ``expanded`` equal texts come out as all
    their pairs. A larger class of equal texts is represented by its smallest key: every other member is paired with it, and
    links to other texts are stated for it, so no link between different texts is lost and the output stays linear.
    expanded=None states every pair of keys, whatever the size of a class.
    """
    a, b = f"{key}_a", f"{key}_b"
    members = rows.where(F.col(content).isNotNull() & F.col(key).isNotNull()).select(F.xxhash64(content).alias("id"), F.col(key).alias("k")).distinct()
    sizes = members.groupBy("id").agg(F.count("*").alias("n"), F.min("k").alias("first"))
    links, drawn = _classes(rows, content, n, similarity, measure, band_rows, band_count)
    wanted = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    many = sizes.where("n > 1").join(drawn.select("id"), "id", "left_semi")  # a text without a word is in no pair
    shown = members.join(many.select("id", "n", "first").unionByName(sizes.where("n = 1").join(wanted, "id", "left_semi").select("id", "n", "first")), "id")
    is_small = F.lit(True) if expanded is None else F.col("n") <= expanded
    small = shown.where(is_small)
    speak = small.select("id", "k").unionByName(sizes.where(~is_small).select("id", F.col("first").alias("k")))
    across = (
        links.join(speak.select(F.col("id").alias("a"), F.col("k").alias("x")), "a").join(speak.select(F.col("id").alias("b"), F.col("k").alias("y")), "b").select("x", "y", "jaccard", "weighted")
    )
    equals = small.where("n > 1").select("id", "k")
    inside = equals.withColumnRenamed("k", "x").join(equals.withColumnRenamed("k", "y"), "id").where("x < y").select("x", "y")
    stars = shown.where(~is_small).where("k <> first").select(F.col("first").alias("x"), F.col("k").alias("y"))
    equal = inside.unionByName(stars).select("x", "y", F.lit(1.0).alias("jaccard"), F.lit(1.0).alias("weighted"))
    out = across.unionByName(equal)
    return out.select(F.least("x", "y").alias(a), F.greatest("x", "y").alias(b), "jaccard", "weighted").where(F.col(a) < F.col(b)).groupBy(a, b).agg(F.max("jaccard").alias("jaccard"), F.max("weighted").alias("weighted"))


def near_duplicate_groups(rows: DataFrame, key: str, content: str = "content", **how) -> DataFrame:
    """``{key}, class_id, links``: for every key with a partner, its group (named by its smallest key) and its number of links."""
    from lexgrain.operators.components import components

    pairs = written(near_duplicate_pairs(rows, key, content, **how), "pairs")
    a, b = f"{key}_a", f"{key}_b"
    degree = pairs.select(F.explode(F.array(a, b)).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    return components(pairs, a, b).join(degree, "node").select(F.col("node").alias(key), F.col("component").alias("class_id"), "links")


def _p4_rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/chunks.parquet").select("chunk_id", "content")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks whose distinct runs of three words have a Jaccard similarity of 0.5 or more."""
    return near_duplicate_pairs(_p4_rows(spark, folder), "chunk_id", n=3, similarity=0.5, measure="jaccard").select("chunk_id_a", "chunk_id_b")


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk with a version of it elsewhere, the group of versions and its number of links."""
    return near_duplicate_groups(_p4_rows(spark, folder), "chunk_id", n=3, similarity=0.5, measure="jaccard")


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}
_PAIRS = f"""c AS (SELECT DISTINCT chunk_id, content FROM chunks WHERE content IS NOT NULL), w AS (SELECT chunk_id, regexp_extract_all({folded_sql('content')}, '[a-z0-9]+') AS w FROM c),
r AS MATERIALIZED (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: hash(array_to_string(w[i:i + 2], ' ')))) AS r FROM w WHERE len(w) >= 3), n AS (SELECT chunk_id, count(*) AS n FROM r GROUP BY chunk_id),
p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS common FROM r a JOIN r b ON a.r = b.r AND a.chunk_id < b.chunk_id GROUP BY ALL),
pairs AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b WHERE common >= 0.5 * (x.n + y.n - common))"""
SQL = {
    "p4_found": f"WITH {_PAIRS} SELECT a AS chunk_id_a, b AS chunk_id_b FROM pairs",
    "p4_groups": f"""WITH RECURSIVE {_PAIRS}, links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached AS (SELECT DISTINCT a AS node, a AS other FROM links UNION SELECT reached.node, links.b FROM reached JOIN links ON links.a = reached.other),
class AS (SELECT node, min(other) AS class_id FROM reached GROUP BY node) SELECT node AS chunk_id, class_id, links FROM class JOIN (SELECT a AS node, count(*) AS links FROM links GROUP BY a) USING (node)""",
}
