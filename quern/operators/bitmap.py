"""A set of 64-bit hashes as a bitmap, to drop rows before a shuffle.

The bitmap has a false positive for some hashes outside the set and never a false
negative, so a join must follow. It has about ``PER_HASH`` bits a hash, by an approximate
count of the distinct ones, between ``LEAST`` and ``MOST`` bits: that bounds what is
broadcast. Each hash sets two of them, so of other hashes one in 250 passes. A set beyond
the bound fills the bitmap more and more, and less is dropped before the join; results
don't depend on it.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_HASH = 32
#: The second place of a hash lies in its upper bits.
SECOND = 32
#: Logarithms of the fewest and most bits: 128 KB to 32 MB.
LEAST, MOST = 20, 28


def _log_bits(n: int) -> int:
    return min(max(LEAST, (PER_HASH * max(1, n) - 1).bit_length()), MOST)


def bitmap(df: DataFrame, column: str) -> Broadcast:
    """Broadcast bitmap of the BIGINT hashes in ``column``; nulls are left out."""
    hashes = df.select(F.col(column).alias("h")).filter("h IS NOT NULL")
    size = _log_bits(hashes.agg(F.approx_count_distinct("h", 0.1).alias("n")).first()["n"])
    places = hashes.select(F.explode(F.array("h", F.shiftright("h", SECOND))).alias("p"))
    low = F.col("p").bitwiseAND(F.lit((1 << size) - 1))
    words = (
        places.groupBy(F.shiftright(low, 6).cast("int").alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
        .toArrow()
    )
    bits = np.zeros(1 << (size - 6), np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    return df.sparkSession.sparkContext.broadcast(bits)


def membership(hashes: np.ndarray) -> np.ndarray:
    """The bitmap of an array of hashes."""
    size = _log_bits(len(hashes))
    bits = np.zeros(1 << (size - 6), np.int64)
    for shift in (0, SECOND):
        low = (hashes.view(np.int64) >> shift) & np.int64((1 << size) - 1)
        np.bitwise_or.at(bits, low >> 6, np.int64(1) << (low & 63))
    return bits


def member(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the set."""
    mask, h = np.int64(64 * len(bits) - 1), hashes.view(np.int64)
    low = h & mask
    out = (bits[low >> 6] >> (low & 63)) & 1 == 1
    some = np.flatnonzero(out)  # few, as a rule
    low = (h[some] >> SECOND) & mask
    out[some] = (bits[low >> 6] >> (low & 63)) & 1 == 1
    return out
