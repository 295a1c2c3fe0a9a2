"""A Bloom filter of bounded size as a predicate, so that rows without a partner aren't shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

#: 2 ** 26 bits, 8 MB, at most, whatever the number of keys; beyond that the filter lets more pass.
MOST_BITS_LOG2 = 26
MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def places(keys: np.ndarray, log2: int) -> Iterator[np.ndarray]:
    x = keys.astype(np.int64).view(np.uint64)
    for m in MULTIPLIERS:
        h = (x ^ (x >> np.uint64(31))) * m
        h = (h ^ (h >> np.uint64(29))) * MULTIPLIERS[2]
        yield (h >> np.uint64(64 - log2)).astype(np.int64)


def one_of(keys: DataFrame) -> Callable[[str], Column]:
    """A predicate on a bigint column that is true for all of the keys (one column, bigint) and for few others, false for null."""
    name = keys.columns[0]
    log2 = min(MOST_BITS_LOG2, max(10, int(np.ceil(np.log2(12 * max(keys.count(), 1))))))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << log2, bool)
        for batch in batches:
            for at in places(batch.column(name).to_numpy(zero_copy_only=False), log2):
                bits[at] = True
        words = np.packbits(bits).view(np.int64)
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words[used])], names=["k", "word"])

    rows = keys.where(F.col(name).isNotNull()).mapInArrow(mark, "k bigint, word bigint").groupBy("k").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros((1 << log2) // 64, np.int64)
    words[rows.column("k").to_numpy()] = rows.column("word").to_numpy()

    @pandas_udf(BooleanType())
    def within(x: pd.Series) -> pd.Series:
        bits, known = words.view(np.uint8), x.notna().to_numpy()
        ok, keys = known.copy(), x.fillna(0).to_numpy(np.int64)
        for at in places(keys, log2):
            ok &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return pd.Series(ok)

    return lambda c: within(F.col(c))
