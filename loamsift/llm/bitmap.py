"""A bitmap filter of fixed size: what the driver gathers and sends doesn't grow with the data.

It only says which rows may match; an exact join behind it decides. When a huge set fills it, more rows go to that join
and results stay the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 25  # 4 MB; at most 2 ** (BITS - 6) rows of 16 bytes come to the driver


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """Bits for the values (64-bit hashes) of a column."""
    low = F.col(column).bitwiseAND(F.lit((1 << BITS) - 1))
    bit = F.expr(f"shiftleft(1L, cast({column} & 63 as int))")
    words = df.select(F.shiftright(low, 6).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    if words.num_rows:
        out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return out


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = hashes & np.uint64((1 << BITS) - 1)
    return ((bits[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1)).astype(bool)
