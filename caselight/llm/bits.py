"""A bit field of bounded size that never denies a member, for leaving rows out before an exact join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.shipping import ship_by_value

ship_by_value(__name__)

MOST_BITS = 27  # 16 MB, however many keys there are


def bit_field(keys: DataFrame) -> tuple[int, np.ndarray]:
    """From a column ``key`` of well spread 64-bit values: gathered as words of 64 bits, so never more than the field holds."""
    width = int(min(MOST_BITS, max(13, np.ceil(np.log2(32 * max(keys.count(), 1))))))
    words = (keys.select(F.shiftrightunsigned("key", 64 - width).alias("p"))
             .groupBy(F.shiftright("p", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 AS int)))").alias("word")).toArrow())
    field = np.zeros(1 << (width - 6), np.uint64)
    field[words.column("at").to_numpy()] = words.column("word").to_numpy().view(np.uint64)
    return 64 - width, field


def holds(bits: tuple[int, np.ndarray], keys: np.ndarray) -> np.ndarray:
    shift, field = bits
    at = keys >> np.uint64(shift)
    return (field[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
