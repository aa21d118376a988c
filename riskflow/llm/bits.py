"""Bitmaps of 64-bit hashes that tasks test against: a yes may be wrong, a no never is."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bits:
    table: np.ndarray
    shift: int

    def test(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) >> np.uint64(self.shift)
        return (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap(hashes: DataFrame, per_hash: int = 32, most: int = 27) -> Bits:
    """Bitmap of the stored, well mixed 64-bit hashes ``h``: ``per_hash`` bits for each, 2^``most`` bits at most.

    Only the bitmap comes to the driver, in words of 64 bits and as Arrow columns: a million
    of them as Python rows take some 200 MB. Beyond the bound it says yes more often, so
    whoever uses it must check what passes.
    """
    n = max(hashes.count(), 1)
    power = min(max((n * per_hash - 1).bit_length(), 16), most)
    at = F.shiftrightunsigned("h", 64 - power)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - power}) & 63 as int))")
    found = hashes.groupBy(F.shiftright(at, 6).alias("place")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(1 << (power - 6), np.int64)
    for part in found.to_batches():
        table[part["place"].to_numpy()] = part["bits"].to_numpy()
    return Bits(table.view(np.uint8), 64 - power)
