"""A blocked Bloom filter: each key touches one 64-byte block, and keys are dealt to ranges of blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, ceil_div, ints, mix64

#: Bits of filter for each key, and the largest filter that is broadcast (bytes).  Past that many keys the
#: filter stays at its bound: more false positives pass, and the results stay exact.
BITS_PER_KEY = 16
MAX_FILTER_BYTES = 64 << 20
BLOCK_BYTES = 64
PROBES = 8
#: Blocks in a range: 64 KB, and 1024 ranges at most.
PIECE_BLOCKS = 1024


def bit_positions(hashes: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and its PROBES bit positions inside the block."""
    block = ((hashes >> U64(32)) * U64(n_blocks)) >> U64(32)
    second = mix64(hashes)
    bits = np.stack([(second >> U64(7 * i)) & U64(BLOCK_BYTES * 8 - 1) for i in range(PROBES - 1)] + [hashes & U64(511)], 1)
    return block.astype(np.int64), bits.astype(np.int64)


def set_bits(data: np.ndarray, first: int, n_blocks: int, hashes: np.ndarray) -> None:
    """Set the bits of hashes in data, the blocks of a filter from `first` on."""
    block, bits = bit_positions(hashes, n_blocks)
    at = (block - first)[:, None] * BLOCK_BYTES + (bits >> 3)
    np.bitwise_or.at(data, at.ravel(), (1 << (bits & 7)).astype(np.uint8).ravel())


class BlockedBloom:
    """A Bloom filter each of whose keys touches one 64-byte block."""

    def __init__(self, n_blocks: int, data: bytes | None = None):
        self.n_blocks = n_blocks
        self.data = np.zeros(n_blocks * BLOCK_BYTES, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    @classmethod
    def sized(cls, n_keys: int) -> "BlockedBloom":
        wanted = ceil_div(max(n_keys, 1) * BITS_PER_KEY, BLOCK_BYTES * 8)
        return cls(min(wanted, MAX_FILTER_BYTES // BLOCK_BYTES))

    def add(self, hashes: np.ndarray) -> None:
        set_bits(self.data, 0, self.n_blocks, hashes)

    def might_hold(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros(0, bool)
        block, bits = bit_positions(hashes, self.n_blocks)
        found = self.data[block[:, None] * BLOCK_BYTES + (bits >> 3)] >> (bits & 7).astype(np.uint8)
        return (found & 1).all(1)


def build(keys: DataFrame, n_keys: int, hashes_of: Callable[[pa.RecordBatch], np.ndarray]) -> BlockedBloom:
    """The filter of all keys.  Hashes are dealt to ranges of blocks, so every task fills its own ranges, one at a time,
    and the driver receives the bounded result only.  hashes_of gives the 64-bit hashes of a batch."""
    n_blocks = BlockedBloom.sized(n_keys).n_blocks

    def deal(batches):
        for batch in batches:
            hashes = np.unique(hashes_of(batch))
            piece = bit_positions(hashes, n_blocks)[0] // PIECE_BLOCKS
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(hashes.view(np.int64))], ["piece", "hash"])

    def fill(batches):
        at, part = None, None
        for batch in batches:
            pieces, hashes = ints(batch, "piece"), ints(batch, "hash").view(U64)
            ends = [*(np.flatnonzero(np.diff(pieces)) + 1).tolist(), len(pieces)]
            for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
                if hi > lo and pieces[lo] != at:
                    if part is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([part.tobytes()], pa.binary())], ["piece", "part"])
                    at, part = int(pieces[lo]), np.zeros(PIECE_BLOCKS * BLOCK_BYTES, np.uint8)
                if hi > lo:
                    set_bits(part, at * PIECE_BLOCKS, n_blocks, hashes[lo:hi])
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([part.tobytes()], pa.binary())], ["piece", "part"])

    bloom = BlockedBloom(n_blocks)
    rows = keys.mapInArrow(deal, "piece long, hash long").repartition("piece").sortWithinPartitions("piece")
    for row in rows.mapInArrow(fill, "piece long, part binary").collect():
        at = row["piece"] * PIECE_BLOCKS * BLOCK_BYTES
        bits = np.frombuffer(row["part"], np.uint8)[: len(bloom.data) - at]
        bloom.data[at : at + len(bits)] = bits
    return bloom
