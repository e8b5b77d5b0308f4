"""A bit map of fixed size over 64-bit hashes: says for sure that a hash is not in a table, so that the rest need not be shuffled.

A hash takes the slot of its first bits. A wrong yes costs a row that the next join or aggregate drops; no result depends on it. The map has
2^bits bits whatever the size of the table, which bounds what the driver holds and broadcasts.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

SLICES = 8                  # the map is built in 2^SLICES parts


def slots(table: DataFrame, column: str, bits: int = 27) -> Broadcast:
    """Broadcast bit map of the hashes in ``column``. Slots are made distinct first, so no group exceeds 2^(bits - SLICES) rows."""
    width = 1 << (bits - SLICES)
    taken = table.where(F.col(column).isNotNull()).select(F.shiftrightunsigned(column, 64 - bits).alias("slot")).distinct()

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(width, bool)
        part[rows["slot"].to_numpy() & (width - 1)] = True
        return pd.DataFrame({"slice": [key[0]], "part": [np.packbits(part).tobytes()]})

    parts = taken.groupBy(F.shiftright("slot", bits - SLICES).alias("slice")).applyInPandas(pack, "slice long, part binary").collect()
    whole = np.zeros((1 << SLICES, width // 8), np.uint8)
    for r in parts:
        whole[r["slice"]] = np.frombuffer(r["part"], np.uint8)
    return table.sparkSession.sparkContext.broadcast((bits, whole.ravel()))


def within(shared: Broadcast, hashes: np.ndarray) -> np.ndarray:
    bits, whole = shared.value
    slot = hashes.view(np.uint64) >> np.uint64(64 - bits)
    return (whole[slot >> np.uint64(3)] << (slot & np.uint64(7)).astype(np.uint8)) & 128 > 0


def maybe(shared: Broadcast, column):
    """Column: false only where the hash is surely not in the table (null: false)."""
    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        known = values.notna()
        out = np.zeros(len(values), bool)
        out[known] = within(shared, values[known].to_numpy(np.int64))
        return pd.Series(out)

    return test(column)
