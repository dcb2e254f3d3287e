"""Counts of hashed things over a whole table, in a fixed number of counters."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .workers import mapped

#: Counters that travel together.
SLICE = 1 << 16


def _counted(hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], counters: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(counters, np.uint32)  # one task's own
        for batch in batches:
            for own in hashes(batch):
                at, n = np.unique((own % np.uint64(counters)).astype(np.int32), return_counts=True)
                counts[at] += n.astype(np.uint32)
        press = zstandard.ZstdCompressor(level=1)
        for k in range(0, counters, SLICE):
            own = counts[k : k + SLICE]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // SLICE], pa.int32()), pa.array([press.compress(own.tobytes())], pa.binary())], ["slice", "counts"])

    return run


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint32).astype(np.uint64)
            sums[k] = sums[k] + own if k in sums else own
    press = zstandard.ZstdCompressor(level=1)
    for k, own in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([press.compress(own.tobytes())], pa.binary())], ["slice", "counts"])


def sketch(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], counters: int, kind: type = np.uint64) -> np.ndarray:
    """How many of the hashes that ``hashes`` makes of a batch fall to each counter, as numbers
    of a kind (no greater than it allows)."""
    schema = "slice int, counts binary"
    slices = df.transform(mapped, _counted(hashes, counters), schema).repartition("slice")
    out = np.zeros(counters, kind)
    for r in slices.transform(mapped, _summed, schema).collect():  # as many numbers as counters
        own = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["counts"]), np.uint64)
        out[r["slice"] * SLICE : r["slice"] * SLICE + len(own)] = np.minimum(own, np.iinfo(kind).max)
    return out
