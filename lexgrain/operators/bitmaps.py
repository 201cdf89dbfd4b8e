"""Bitmaps of fixed size over 64-bit numbers: which may belong to a set, told where the rows are read."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmap(rows: DataFrame, column: str, log: int) -> np.ndarray:
    """A bit for each value of the upper ``log`` bits of a long column, set where a row has it.

    The bits are put together by 64 in the executors: at most 2**(log - 6) rows reach the driver, as Arrow batches.
    """
    at = rows.where(F.col(column).isNotNull()).select(F.shiftrightunsigned(column, 64 - log).alias("at"))
    put = at.groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63L as int)))").alias("bits"))
    got, words = put.toArrow(), np.zeros(1 << (log - 6), np.uint64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return words


def has(words: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether the bit of each (unsigned) number is set."""
    shift = np.uint64(58 - len(words).bit_length() + 1)
    at = numbers >> shift
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
