"""A blocked Bloom filter of 64-bit hashes: a key sets one bit in each of a block's eight words.

A look-up touches one block of 32 bytes. The filter is built by Spark (bits per task, joined by
OR) and never larger than the bound it is given: beyond that it lets more false keys pass, and
never stops a true one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 8
BLOCK_BYTES = 4 * WORDS
# Odd multipliers, one for each word: consecutive multiples of the golden ratio's 32 bits, made odd.
MULTIPLIERS = np.array([(0x9E3779B9 * (i + 1) & 0xFFFFFFFF) | 1 for i in range(WORDS)], np.uint32)


def spread(hashes: np.ndarray) -> np.ndarray:
    """Any 64-bit keys mixed so that every bit depends on all of them."""
    x = hashes.astype(np.int64).view(np.uint64).copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def places(hashes: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Each key's block, from its high bits, and its eight one-bit words, from its low ones."""
    mixed = spread(hashes)
    block = ((mixed >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)
    low = (mixed & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    with np.errstate(over="ignore"):
        bit = (low[:, None] * MULTIPLIERS) >> np.uint32(27)
    return block.astype(np.int64), np.left_shift(np.uint32(1), bit)


def passes(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter ``words`` (n_blocks x 8, unsigned 32-bit)."""
    found = np.zeros(len(hashes), bool)
    for at in range(0, len(hashes), 1 << 18):
        block, bits = places(hashes[at : at + (1 << 18)], len(words))
        found[at : at + (1 << 18)] = ((words[block] & bits) == bits).all(axis=1)
    return found


def n_blocks_for(n_keys: int, bits_per_key: int, max_bytes: int) -> int:
    return max(1, min(-(-n_keys * bits_per_key // (8 * BLOCK_BYTES)), max_bytes // BLOCK_BYTES))


def build(keys: DataFrame, column: str, n_keys: int, *, bits_per_key: int = 16, max_bytes: int = 32 << 20) -> np.ndarray:
    """The filter of the 64-bit hashes in ``column``; NULLs are in no filter.

    ``n_keys`` is the number of keys, which sizes it. Tasks set bits in blocks of their own; blocks
    meet by OR, and what reaches the driver is the filter itself, at most ``max_bytes``.
    """
    n_blocks = n_blocks_for(n_keys, bits_per_key, max_bytes)
    names = ["block", *[f"w{i}" for i in range(WORDS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            block, bits = places(hashes, n_blocks)
            touched, at = np.unique(block, return_inverse=True)
            words = np.zeros((len(touched), WORDS), np.uint32)
            np.bitwise_or.at(words, at, bits)
            columns = [pa.array(touched), *[pa.array(words[:, i].astype(np.int64)) for i in range(WORDS)]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = keys.select(F.col(column).cast("long").alias("h")).mapInArrow(run, ", ".join(f"{c} long" for c in names))
    whole = rows.groupBy("block").agg(*[F.bit_or(c).alias(c) for c in names[1:]]).toArrow()
    words = np.zeros((n_blocks, WORDS), np.uint32)
    at = whole.column("block").to_numpy()
    for i, c in enumerate(names[1:]):
        words[at, i] = whole.column(c).to_numpy().astype(np.uint32)
    return words
