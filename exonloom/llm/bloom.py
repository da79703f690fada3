"""A Bloom filter over the keys of an index, of bounded size: the probing side drops what surely misses before anything is shuffled.

The filter has BITS_A_KEY bits for each key, as far as 2^BITS[1] bits (128 MB) reach - so much at most is collected and broadcast. A
fuller filter only lets more rows through to the join that follows, which decides alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least and most bits, as powers of two.
BITS = 20, 30
#: Bits that are set for a key, and bits wanted for each key.
PROBES, BITS_A_KEY = 4, 16


def _slots(keys: np.ndarray, bits: int, probe: int) -> np.ndarray:
    """The filter's bit of each key - a mixed 64-bit number - at a probe."""
    step = (keys >> np.uint64(32)) | np.uint64(1)
    return ((keys + np.uint64(probe) * step) & np.uint64((1 << bits) - 1)).astype(np.int64)


def build(index: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, filter as bytes) over the column `key` of an index, a written table; keys are mixed 64-bit numbers. Words of the filter are
    or-ed on the executors."""
    bits = max(BITS[0], min(BITS[1], (BITS_A_KEY * max(index.count(), 1) - 1).bit_length()))

    def run(batches):
        for b in batches:
            key = b.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([_slots(key, bits, p) for p in range(PROBES)]))
            word, first = np.unique(at >> 6, return_index=True)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first).view(np.int64))], names=["word", "set"])

    got = index.select("key").mapInArrow(run, "word long, set long").groupBy("word").agg(F.bit_or("set").alias("set")).toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[got.column("word").to_numpy()] = got.column("set").to_numpy()
    return bits, out.view(np.uint8)


def passing(bloom: tuple[int, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Positions of the keys that may be in the index."""
    bits, table = bloom
    at = np.arange(len(keys))
    for p in range(PROBES):
        slot = _slots(keys[at], bits, p)
        at = at[(table[slot >> 3] >> (slot & 7).astype(np.uint8)) & np.uint8(1) > 0]
    return at
