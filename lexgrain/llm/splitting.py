"""Oversized texts cut into pieces under a limit, at natural boundaries, with a fixed overlap.

The tokens of a text (words and what stands between them) have character offsets by prefix sums; the ends of paragraphs,
sentences, lines and words are sorted offset arrays. A cut is the last boundary under the limit, found by binary search in
the strongest array that has one in the upper half of the piece; without any boundary it is a hard cut, kept off combining
marks. The next piece starts ``overlap`` characters before the cut, so the text is piece 1 plus every later piece
without its first ``overlap`` characters.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s+|\w+|[^\w\s]+")


def boundaries(text: str) -> list[np.ndarray]:
    """Sorted offsets where a piece may end: after paragraphs, sentences, lines, words."""
    tokens = _TOKEN.findall(text)
    ends = np.cumsum([len(t) for t in tokens]) if tokens else np.empty(0, int)
    paragraphs, sentences, lines, spaces = [], [], [], []
    for i, t in enumerate(tokens):
        if not t[0].isspace():
            continue
        breaks = t.count("\n")
        if breaks > 1:
            paragraphs.append(ends[i])
        elif breaks:
            lines.append(ends[i])
        if i and tokens[i - 1][-1] in ".!?…":
            sentences.append(ends[i])
        spaces.append(ends[i])
    return [np.array(x, dtype=np.int64) for x in (paragraphs, sentences, lines, spaces)]


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """The (start, end) of each piece; one piece where the text fits."""
    levels, out, start, n = boundaries(text), [], 0, len(text)
    while n - start > limit:
        top, least = start + limit, start + max(overlap + 1, limit // 2)
        end = 0
        for level in levels:
            at = np.searchsorted(level, top, side="right") - 1
            if at >= 0 and level[at] >= least:
                end = int(level[at])
                break
        if not end:
            end = top
            while end > least and unicodedata.combining(text[end]):
                end -= 1
        out.append((start, end))
        start = end - overlap
    out.append((start, n))
    return out


def split_oversized(rows: DataFrame, keys: list[str], content: str, limit: int = 1500, overlap: int = 150) -> DataFrame:
    """``keys, piece, start, end, pieces, content``: the pieces of every text longer than ``limit`` characters (code points).

    Texts within the limit and null texts give no row. Repeated rows of one key are cut once; a null in a key is a value of its
    own. Other columns are ignored, whatever their names. An empty table gives no rows. Needs 0 <= overlap < limit / 2.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be under half the limit")

    def cut(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                row, spans, texts = [], [], part.column(len(keys)).to_pylist()
                for i, text in enumerate(texts):
                    own = cuts(text, limit, overlap)
                    row += [i] * len(own)
                    spans += [(p + 1, a, b, len(own), text[a:b]) for p, (a, b) in enumerate(own)]
                cols = [part.column(j).take(pa.array(row, pa.int64())) for j in range(len(keys))]
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string())
                cols += [pa.array([s[j] for s in spans], kinds[j]) for j in range(5)]
                yield pa.RecordBatch.from_arrays(cols, names=[f"k{j}" for j in range(len(keys))] + ["piece", "start", "end", "pieces", "text"])

    types = dict(rows.dtypes)
    long = rows.select(*[F.col(k).alias(f"k{j}") for j, k in enumerate(keys)], F.col(content).alias("text")).where(F.length("text") > limit)
    one = long.dropDuplicates([f"k{j}" for j in range(len(keys))])
    schema = ", ".join(f"k{j} {types[k]}" for j, k in enumerate(keys)) + ", piece int, start long, end long, pieces int, text string"
    return one.mapInArrow(cut, schema).select(*[F.col(f"k{j}").alias(k) for j, k in enumerate(keys)], "piece", "start", "end", "pieces", F.col("text").alias("content"))


def _p5(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(spark.read.parquet(f"{folder}/chunks.parquet"), ["document_id", "chunk_id"], "content")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of the chunks longer than 1,500 characters."""
    return _p5(spark, folder)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks that were cut."""
    return _p5(spark, folder).where("piece = 1").select("document_id", "chunk_id")


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces}
SQL = {"p5_found": "SELECT DISTINCT document_id, chunk_id FROM chunks WHERE length(content) > 1500"}
