"""A filter of 64-bit keys: small enough to broadcast whatever the number of keys, and never without a key that it was given.

Keys are dealt out to blocks by hash, and two bits of its block stand for a key. Blocks are built where their keys meet, so neither a task nor
the driver holds the keys. There are 16 bits for a key up to MAX_BITS in all; a table that outgrows these gets a fuller filter that lets
more strangers through. What passes must be checked by an exact join.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm import words as W

#: Bits of a block, and of all blocks: 128 MB at most are broadcast.
BLOCK_BITS, MAX_BITS = 1 << 25, 1 << 30


class KeyFilter(NamedTuple):
    blocks: np.ndarray  # a row of bytes for each block

    def has(self, keys: np.ndarray) -> np.ndarray:
        """True for all keys that were given, and a few more."""
        block, first, second = _places(keys, len(self.blocks), self.blocks.shape[1] * 8)
        bit = lambda place: (self.blocks[block, place >> 3] >> (place & 7).astype(np.uint8)) & 1
        return (bit(first) & bit(second)).astype(bool)


def _places(keys: np.ndarray, n_blocks: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = W.mix(np.ascontiguousarray(keys).view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    g = W.mix(h)
    mask = np.uint64(bits - 1)
    return (h >> np.uint64(40)).astype(np.int64) % n_blocks, (h & mask).astype(np.int64), (g & mask).astype(np.int64)


def key_filter(keys: DataFrame, block_bits: int = BLOCK_BITS, max_bits: int = MAX_BITS) -> KeyFilter:
    """The filter of a table of one bigint column without nulls, which is read twice."""
    wanted = 16 * max(keys.count(), 64)
    bits = min(block_bits, 1 << (wanted - 1).bit_length())
    n_blocks = max(1, min(max_bits // bits, -(-wanted // bits)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, _, _ = _places(np.asarray(batch.column(0)), n_blocks, bits)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), batch.column(0)], ["block", "key"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            block, first, second = _places(np.asarray(batch.column(1)), n_blocks, bits)
            for k in np.unique(block).tolist():
                out = made.setdefault(k, np.zeros(bits // 8, np.uint8))
                place = np.concatenate([first[block == k], second[block == k]])
                np.bitwise_or.at(out, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))
        for k, out in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["block", "bits"])

    dealt = keys.toDF("key").mapInArrow(deal, "block int, key bigint").repartition(n_blocks, "block")
    blocks = np.zeros((n_blocks, bits // 8), np.uint8)
    for row in dealt.mapInArrow(build, "block int, bits binary").toLocalIterator():  # max_bits in all
        blocks[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return KeyFilter(blocks)
