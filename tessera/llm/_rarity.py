"""A global order of tokens from rare to frequent, in a table of fixed size.

Tokens are 64-bit hashes. Their counts over all documents are kept for hash
buckets, so the table that tasks share never grows with the corpus. Any total
order keeps a prefix filter exact; a good one only makes it fast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _bytes as B

#: log2 of the number of buckets: 2**19 one-byte levels are shared.
BITS = 19
#: Buckets whose counts travel in one row.
BLOCK = 1 << 12
#: Tokens that a task holds before it adds them to its counts.
HELD_TOKENS = 1_000_000


def levels(docs: DataFrame, tokens: Callable[[np.ndarray, np.ndarray], np.ndarray], bits: int = BITS) -> np.ndarray:
    """One-byte frequency levels (four to a doubling) of all hash buckets.

    ``tokens`` gives the token hashes of a slice of texts. Each task sends a row
    of packed counts per block of buckets at most, and the driver gets one row
    per block.
    """
    shift, size = np.uint64(64 - bits), min(BLOCK, 1 << bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, waiting = np.zeros(1 << bits, np.int64), [], 0
        for batch in batches:
            for _, _, data, offsets in B.slices(batch["text"]):
                held.append((tokens(data, offsets) >> shift).astype(np.uint32))
                waiting += len(held[-1])
                if waiting > HELD_TOKENS:
                    total += np.bincount(np.concatenate(held), minlength=1 << bits)
                    held, waiting = [], 0
        total += np.bincount(np.concatenate([np.empty(0, np.uint32), *held]), minlength=1 << bits)
        total = total.reshape(-1, size)
        most = total.max(axis=1)
        some = np.flatnonzero(most)
        # in the narrowest type that holds the block's counts; the length tells which
        counts = [total[k].astype(np.min_scalar_type(most[k])).tobytes() for k in some]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts, pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch["block"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                total.setdefault(k, np.zeros(size, np.int64))
                total[k] += np.frombuffer(counts, f"u{len(counts) // size}").astype(np.int64)
        found = [np.floor(4 * np.log2(x + 1)).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(found, pa.binary())], ["block", "levels"])

    counted = docs.select(docs["text"].cast("string").alias("text")).mapInArrow(run, "block int, counts binary")
    out = np.zeros((1 << bits) // size * size, np.uint8).reshape(-1, size)
    for row in counted.repartition("block").mapInArrow(add, "block int, levels binary").collect():
        out[row.block] = np.frombuffer(row.levels, np.uint8)
    return out.reshape(-1)


def ordered_key(tokens: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sort keys: frequency level first, then the hash."""
    bits = len(table).bit_length() - 1
    level = table[(tokens >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
    return (level << np.uint64(56)) | (B.mix(tokens) >> np.uint64(8))
