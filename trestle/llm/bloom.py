"""Bloom filters of 64-bit keys, made by tasks and joined block by block, for looking rows up where they stand."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from trestle.llm.words import mix

_ODD = 0xD6E8FEB86659FD93
#: Bits of a filter: about 16 for each key, at least and at most so many. It is sent to every task; a full one only lets more rows pass.
FILTER_BITS = (1 << 20, 1 << 30)
#: Parts of an array that are added up apart from each other.
BLOCKS = 64


def added_up(partial: DataFrame, combine: Callable) -> dict[int, bytes]:
    """Arrays that tasks send in compressed blocks (block, data), combined block by block; the driver gets one array in all."""

    def add(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        total = combine(unpack(x) for x in table.column("data").to_pylist())
        return pa.table({"block": table.column("block")[:1], "data": pa.array([total.tobytes()], pa.binary())})

    return dict(partial.groupBy("block").applyInArrow(add, "block int, data binary").collect())


def in_blocks(parts: list[bytes]) -> pa.RecordBatch:
    pack = zstandard.ZstdCompressor(level=1).compress
    return pa.record_batch([pa.array(range(BLOCKS), pa.int32()), pa.array([pack(x) for x in parts], pa.binary())], names=["block", "data"])


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Four places of each key in a filter of so many bits (a power of two)."""
    keys = mix(keys)
    return [(((keys >> np.uint64(s)) ^ (keys * np.uint64(_ODD + 2 * s))) & np.uint64(bits - 1)).astype(np.int64) for s in (0, 11, 23, 31)]


def passes(told: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in a filter: all that are, and a few others."""
    out = np.ones(len(keys), bool)
    for places in _places(keys, 8 * len(told)):
        out &= (told[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
    return out


def bloom_filter(rows: DataFrame, n: int, keys_of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The filter, as bytes, of the n keys (unsigned 64-bit) that keys_of finds in batches of rows: at most FILTER_BITS[1] / 8 bytes in all."""
    bits = FILTER_BITS[0]
    while bits < min(16 * n, FILTER_BITS[1]):
        bits *= 2
    each = bits // BLOCKS

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # only the places in use are sent
            if b.num_rows:
                places = np.unique(np.concatenate(_places(keys_of(b), bits)))
                cuts = np.searchsorted(places, np.arange(BLOCKS + 1) * each)
                yield in_blocks([(places[i:j] - k * each).astype("<u4").tobytes() for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False))])

    def join(parts: Iterator[bytes]) -> np.ndarray:
        total = np.zeros(each, bool)
        for x in parts:
            total[np.frombuffer(x, "<u4")] = True
        return np.packbits(total, bitorder="little")

    found = added_up(rows.mapInArrow(part, "block int, data binary"), join)
    return np.concatenate([np.frombuffer(found[i], np.uint8) for i in range(BLOCKS)]) if found else np.zeros(bits // 8, np.uint8)
