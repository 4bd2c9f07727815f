"""Shards by jump consistent hashing.

A row's shard follows from its key and the number of shards alone: no ring, no
table. With one more shard, a row either stays or goes into the new one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runaudit.llm.common import gapless

_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key. A key jumps ahead, by a stride drawn
    from its own pseudo-random sequence, until it would pass the last shard."""
    state = keys.astype(np.uint64)
    at = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = ahead[live]
        with np.errstate(over="ignore"):
            state[live] = state[live] * _STEP + np.uint64(1)
        drawn = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[live] = np.minimum((at[live] + 1) * (float(1 << 31) / drawn), shards).astype(np.int64)
        live = live[ahead[live] < shards]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard in 0..shards-1 of a key of any type; null is a key like any other."""

    @F.pandas_udf("int")
    def jumped(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards))

    return jumped(F.xxhash64(key))


def assign(df: DataFrame, key: str, shards: int, order: list[Column]) -> DataFrame:
    """Adds `shard`, `grown_shard` (with one shard more) and `slot`, the row's
    gapless place in its shard. A shard is numbered in hashed blocks, so that its
    rows never meet in one task. Equal rows get different slots.

    Null keys share one shard; an empty table gives no rows; other columns stay,
    but those three names are replaced.
    """
    placed = df.drop("shard", "grown_shard", "slot").withColumns(
        {"shard": shard_of(F.col(key), shards), "grown_shard": shard_of(F.col(key), shards + 1)}
    )
    return gapless(placed, ["shard"], order, "slot", blocks=1024)


def write(df: DataFrame, path: str) -> None:
    """One folder per shard; a shard's rows are split over files by size."""
    df.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
