"""Bit maps of hashes: small filters that are built in Spark and let through whatever they hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The largest filter: 2**26 bits, 8 MB, whatever the input. A full filter lets all rows through.
MAX_BITS = 26


class Filter:
    """Bit ``hash >> (64 - bits)`` of each hash that was put in is set."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def build(hashes: DataFrame, column: str) -> Filter:
    """A filter of the 64-bit hashes (as longs) in ``column``; rows are combined into 4 KB maps before they come to the driver."""
    n = hashes.count()
    bits = int(min(MAX_BITS, max(15, np.ceil(np.log2(max(1, n) * 16)))))
    at = F.shiftrightunsigned(F.col(column), 64 - bits)
    maps = hashes.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(32767)).alias("map")).collect()
    data = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in maps:
        data[r["block"] << 12:(r["block"] + 1) << 12] = np.frombuffer(bytes(r["map"]), dtype=np.uint8)
    return Filter(bits, data)
