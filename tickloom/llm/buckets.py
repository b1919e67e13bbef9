"""Occurrence counts in a fixed number of hash buckets, gathered from all rows.

One table of saturating counters serves as a two-pass Bloom filter ("seen twice"),
as a plain Bloom filter ("seen") and as a frequency sketch.  Its size is a
parameter and never follows the data, so it may be collected and broadcast.
Each task sends only the buckets it touched, by slices of 65,536 buckets; slices
are added as they stream in, so no task holds more than the slices dealt to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_SLICE = 16


def _schema(kind: str) -> str:
    return f"slice int, at binary, {kind} binary"


def bucket_counts(df: DataFrame, positions: Callable[[pa.RecordBatch], Iterable[np.ndarray]], log2: int, top: int = 255) -> np.ndarray:
    """Counts by bucket over all rows, at most `top` each; `positions` gives a batch's bucket numbers, in parts of a bounded
    size, which are counted one after the other.

    The result is one array of 2**log2 numbers (uint8 where top < 256, else uint32).
    """
    if not 1 <= log2 <= 28:
        raise ValueError("log2 must be between 1 and 28")
    size, step = 1 << log2, min(1 << log2, 1 << _SLICE)
    small = top < 256
    kind = np.uint8 if small else np.uint32

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(size, kind)
        for batch in batches:
            for got in positions(batch):
                if len(got) * 8 > size:
                    more = np.bincount(got, minlength=size)
                    np.minimum(more, top, out=more)
                    np.add(have, more, out=more, casting="unsafe")
                    np.copyto(have, np.minimum(more, top, out=more), casting="unsafe")
                elif len(got):
                    at, n = np.unique(got, return_counts=True)
                    have[at] = np.minimum(have[at] + n, top)
        for s in range(size // step):
            part = have[s * step : (s + 1) * step]
            at = np.flatnonzero(part)
            if len(at):
                dense = len(at) * 3 > step if small else len(at) * 2 > step
                n = part if dense else part[at]
                yield pa.RecordBatch.from_pydict(
                    {"slice": pa.array([s], pa.int32()), "at": pa.array([None if dense else at.astype(np.uint16).tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary())}
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, at, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                have = sums.setdefault(s, np.zeros(step, np.int64))
                n = np.frombuffer(n, np.uint8 if small else np.uint32)
                if at is None:
                    have += n
                else:
                    have[np.frombuffer(at, np.uint16)] += n
        for s, have in sums.items():
            have = np.minimum(have, top).astype(kind)
            yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int32()), "n": pa.array([have.tobytes()], pa.binary())})

    parts = df.mapInArrow(local, _schema("n")).repartition("slice").mapInArrow(merge, "slice int, n binary")
    out = np.zeros(size, kind)
    for row in parts.toLocalIterator():
        out[row["slice"] * step : row["slice"] * step + step] = np.frombuffer(row["n"], kind)
    return out


class BitSet:
    """A packed set of buckets, small enough to broadcast."""

    def __init__(self, flags: np.ndarray) -> None:
        self.mask = np.uint64(len(flags) - 1)
        self.bits = np.packbits(flags, bitorder="little")

    def has(self, at: np.ndarray) -> np.ndarray:
        at = at.astype(np.uint64) & self.mask
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
