"""Sets of hashes as bitmaps of a fixed size.

A bitmap answers "may be in the set": it never denies a member, and of the others it
lets a share through that follows how full it is.  Its size is chosen beforehand and
doesn't grow with the set, so it can be sent to every executor whatever the corpus;
with a set far larger than the bitmap it filters less, and nothing else changes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 2 ** 26 bits, 8 MB.
BITS = 26
_BUCKET_BITS = 32768


def hash_bitmap(df: DataFrame, hashed: Column, bits: int = BITS) -> np.ndarray:
    """The bitmap of a column of 64-bit hashes; nulls are left out."""
    slot = F.pmod(hashed, F.lit(1 << bits)) + 1
    rows = (
        df.select(slot.alias("slot"))
        .where("slot is not null")
        .groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    )
    found = np.zeros((1 << bits) // 8, np.uint8)
    size = _BUCKET_BITS // 8
    for bucket, held in rows.collect():  # 2 ** bits / 32768 rows of 4 KB at most
        begin = (bucket - 1) * size
        part = np.frombuffer(bytes(held), np.uint8)[: len(found) - begin]
        found[begin : begin + len(part)] |= part
    return found


def may_hold(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of some hashes (uint64) may be in the set."""
    slots = hashes & np.uint64(8 * len(bitmap) - 1)
    held = bitmap[(slots >> np.uint64(3)).astype(np.int64)]
    return (held >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1


def xxhashes(values: pa.Array, seed: int) -> np.ndarray:
    """XXH64 of binary values, as Spark's xxhash64 has it of strings."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(v, seed) for v in values.to_pylist()), np.uint64, count=len(values)
    )
