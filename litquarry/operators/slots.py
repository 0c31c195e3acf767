"""Hashes marked in a bitmap of bounded size, so that rows without a partner are dropped before they are shuffled.

A marked slot proves nothing: the join that follows decides. An unmarked one proves that no row has the hash. The more hashes, the fuller the
bitmap and the fewer rows it drops; what is broadcast stays the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# The bitmap has 2**LEAST to 2**MOST bits, at most 16 MB; so many tasks send one each to the driver.
LEAST, MOST, TASKS = 20, 27, 3


def slots(hashes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit of each hash; its lowest bits may have a meaning of their own and are not used."""
    s = (hashes.astype(np.int64, copy=False) >> 8) & (8 * len(bits) - 1)
    return s >> 3, np.left_shift(1, s & 7).astype(np.uint8)


def marked(hashes: DataFrame, rows: int) -> np.ndarray:
    """The bitmap of the hashes, or arrays of hashes, in the only column; ``rows`` is about how many there are and sets its size."""
    size = 1 << min(max((8 * rows).bit_length(), LEAST), MOST) - 3

    def run(batches):
        got = np.zeros(size, np.uint8)
        for b in batches:
            c = b.column(0)
            c = (c.flatten() if pa.types.is_list(c.type) else c).drop_null()
            at, bit = slots(c.to_numpy(zero_copy_only=False), got)
            np.bitwise_or.at(got, at, bit)
        yield pa.RecordBatch.from_arrays([pa.array([got.tobytes()], type=pa.binary())], names=["bits"])

    out = np.zeros(size, np.uint8)
    for r in hashes.coalesce(TASKS).mapInArrow(run, "bits binary").collect():
        out |= np.frombuffer(r["bits"], np.uint8)
    return out


def held(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the slot of each hash is marked."""
    at, bit = slots(hashes, bits)
    return (bits[at] & bit) != 0


def held_of_lists(lists: pa.ListArray, bits: np.ndarray) -> pa.ListArray:
    """The hashes of each list whose slots are marked."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    keep = held(flat, bits)
    edges = np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(keep)][edges], type=pa.int32()), pa.array(flat[keep], type=pa.int64()))
