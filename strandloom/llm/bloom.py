"""A blocked Bloom filter over 64-bit hashes, built by Spark and probed in numpy.

An entry sets eight bits, one in each 32-bit word of one 256-bit block.  The size follows
the number of entries up to ``max_blocks`` blocks of 32 bytes; beyond that the filter only
lets more through, so whoever uses it has to check what passes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Odd multipliers, one for each word of a block.
SALTS = (1203114875, 1150766481, 2284105051, 2729912477, 1884591559, 770785867, 2667333959, 1550580529)
MAX_BLOCKS = 1 << 20  # 32 MB


class Bloom:
    def __init__(self, table: np.ndarray):
        self.table = table

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        h = np.ascontiguousarray(hashes, np.int64).view(np.uint64)
        low = h & np.uint64(0x7FFFFFFF)
        words = self.table[(h >> np.uint64(32)).astype(np.int64) & (len(self.table) - 1)]
        ok = np.ones(len(h), bool)
        for i, s in enumerate(SALTS):
            bit = ((low * np.uint64(s)) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
            ok &= (words[:, i] >> bit.astype(np.uint32)) & 1 == 1
        return ok


def may_hold(bloom: Bloom, spark: SparkSession, *columns: str) -> Column:
    """Whether the filter passes the ``xxhash64`` of ``columns``; only the hash goes to Python."""
    sent = spark.sparkContext.broadcast(bloom)

    @F.pandas_udf("boolean")
    def passes(hashes: pd.Series) -> pd.Series:
        return pd.Series(sent.value.passes(hashes.to_numpy()))

    return passes(F.xxhash64(*columns))


def build(entries: DataFrame, hash_col: str, n: int, max_blocks: int = MAX_BLOCKS) -> Bloom:
    """The filter of the ``n`` long hashes in ``hash_col``: 12 bits each, ``max_blocks`` at most."""
    blocks = 1
    while blocks < min(max_blocks, -(-n * 12 // 256)):
        blocks *= 2
    h = F.col(hash_col)
    low = h.bitwiseAND(F.lit(0x7FFFFFFF))  # products stay below 2 ** 63
    words = [
        F.bit_or(
            F.call_function(
                "shiftleft", F.lit(1), F.shiftright((low * F.lit(s)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int")
            )
        ).alias(f"w{i}")
        for i, s in enumerate(SALTS)
    ]
    block = F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(blocks - 1)).cast("int")
    made = entries.groupBy(block.alias("block")).agg(*words).toArrow()  # at most ``blocks`` rows
    table = np.zeros((blocks, 8), np.uint32)
    if made.num_rows:
        at = made.column("block").to_numpy()
        for i in range(8):
            table[at, i] = made.column(f"w{i}").to_numpy().view(np.uint32)
    return Bloom(table)
