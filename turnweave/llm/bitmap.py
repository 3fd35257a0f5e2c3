"""Bitmaps of 64-bit hashes, made in tasks and told to all tasks: what isn't marked is in no set."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.runtime import ship_package

#: At most 2**MAP_BITS bits (16 MB) whatever the number of hashes. Fuller maps let more through, which the
#: joins behind them then drop. Made in 2**MAP_PARTS parts.
MAP_BITS, MAP_PARTS = 27, 6


def bitmap_of(hashes: DataFrame, column: str = "gram", each: int = 32) -> np.ndarray:
    """Bits for the hashes by their high bits, ``each`` for a hash where that fits, built part by part in tasks; a fixed size comes to the driver."""
    hashes = hashes.select(F.col(column).alias("gram"))
    n = hashes.count()
    bits = min(MAP_BITS, max(MAP_PARTS + 3, (each * n).bit_length()))
    size = 1 << (bits - MAP_PARTS - 3)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        at = (pdf["gram"].to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) & (size * 8 - 1)
        flags = np.zeros(size * 8, bool)
        flags[at] = True
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "data": [np.packbits(flags, bitorder="little").tobytes()]})

    ship_package(hashes.sparkSession)
    parts = hashes.select("gram", F.shiftrightunsigned("gram", 64 - MAP_PARTS).alias("part"))
    # each place of the map once, however many hashes fall on it
    slots = parts.groupBy("part", F.shiftrightunsigned("gram", 64 - bits).alias("slot")).agg(F.min("gram").alias("gram"))
    out = np.zeros(size << MAP_PARTS, np.uint8)
    for r in slots.groupBy("part").applyInPandas(build, "part long, data binary").collect():
        out[r.part * size : (r.part + 1) * size] = np.frombuffer(r.data, np.uint8)
    return out


def marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - (len(bitmap).bit_length() + 2))).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
