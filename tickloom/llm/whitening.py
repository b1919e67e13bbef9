"""Embedding whitening from exact integer scatter.

Entries become integers (scaled, floored, shifted).  The tasks add up sums and cross-products of the integers without the
shift, in arbitrary precision: integers are cut into limbs of 20 bits, so that products of limbs of a block of rows add up
exactly in doubles, and the block sums go into Python integers.  From them n * X'X - S S' is formed exactly and only then
turned into floating point, divided by n squared and decomposed.

Rows whose vector is null, or holds a null or an entry that is not finite, are left out, and so are vectors whose length is
not the most frequent one (of equally frequent ones the longest; empty vectors count as no vectors).  An empty table, or one
with no vector left, gives no rows.  Repeated rows count and come out as often as they are there, ties of eigenvalues are
ordered as the decomposition gives them.  Components without variance (an eigenvalue within rounding of zero) are left out,
since nothing can be divided by it.  Values beyond a 64-bit integer stay exact in the sums; a deviation beyond it is null,
while `deviation_digits` has it in decimal digits.  Only the id and vector columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entry c becomes floor(SCALE * c) + SHIFT; components given at most.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Longest vectors worked on: the matrices of a task and of the driver have this square of entries.
MOST_DIMENSIONS = 4096
#: Bits of a limb, and rows of a block: products of two limbs, added over a block, stay below 2**53.
LIMB_BITS, BLOCK = 20, 4096
#: Numbers of the whitened rows of one output batch.
BATCH = 1 << 20


def integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * c) as int64, or as Python integers where one does not fit."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * float(scale))
    if not scaled.size or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    exact = lambda c: int(np.floor(c * float(scale))) if np.isfinite(c * float(scale)) else int(c) * scale
    return np.array([exact(float(c)) for c in vectors.ravel()], dtype=object).reshape(vectors.shape)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """y as a sum of limbs[k] * 2**(LIMB_BITS * k): doubles below 2**LIMB_BITS, the last of them with the sign."""
    out = []
    while True:
        if np.abs(y).max(initial=0) < 1 << LIMB_BITS:
            return [*out, y.astype(float)]
        out.append((y & ((1 << LIMB_BITS) - 1)).astype(float))
        y = y >> LIMB_BITS


def scatter(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, cross-products) of the rows of y as Python integers."""
    d = y.shape[1]
    sums, products = np.zeros(d, object), np.zeros((d, d), object)
    whole = np.frompyfunc(int, 1, 1)
    for a in range(0, len(y), BLOCK):
        cut = limbs(y[a : a + BLOCK])
        for i, low in enumerate(cut):
            sums += whole(low.sum(0)) * (1 << LIMB_BITS * i)
            for j, high in enumerate(cut):
                products += whole(low.T @ high) * (1 << LIMB_BITS * (i + j))
    return sums, products


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, d)


def fitting(embeddings: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, vector of doubles) of the rows that count, and their length (0 without any)."""
    rows = embeddings.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    rows = rows.filter((F.size("vector") > 0) & F.forall("vector", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.agg(F.max(F.struct("n", "d")).alias("m")).select("m.d").first()
    d = most["d"] or 0
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors have {d} entries, at most {MOST_DIMENSIONS} can be whitened")
    return rows.filter(F.size("vector") == d), d


def exact_scatter(rows: DataFrame, d: int, scale: int = SCALE) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, cross-products) of the integers without shift.

    A task sends one line of digits for each dimension; lines are added by dimension, so what reaches one task or the
    driver is bounded by the dimensions and the number of tasks.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            more = scatter(integers(_matrix(batch.column(0), d), scale))
            n, sums, products = n + batch.num_rows, sums + more[0], products + more[1]
        if n:
            lines = [[str(n), str(sums[i]), *map(str, products[i])] for i in range(d)]
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "line": pa.array(lines, pa.list_(pa.string()))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines[i] = lines.get(i, 0) + np.array([int(v) for v in line], object)
        for i, line in lines.items():
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "line": pa.array([[str(v) for v in line]], pa.list_(pa.string()))})

    parts = rows.select("vector").mapInArrow(local, "i int, line array<string>").repartition("i").mapInArrow(add, "i int, line array<string>")
    found = sorted(parts.collect())
    return int(found[0]["line"][0]), [int(r["line"][1]) for r in found], [[int(v) for v in r["line"][2:]] for r in found]


def components(n: int, sums: list[int], products: list[list[int]], most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, unit eigenvectors as columns, trace) of the covariance with divisor n."""
    d = len(sums)
    v = np.array([[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in range(d)] for i in range(d)])  # the quotient of integers is rounded once
    values, vectors = np.linalg.eigh(v)
    trace = float(sum(n * products[i][i] - sums[i] * sums[i] for i in range(d)) / (n * n))
    falling = np.argsort(-values, kind="stable")[:most]
    falling = falling[values[falling] > trace * d * np.finfo(float).eps]
    return values[falling], vectors[:, falling], trace


class Whitener:
    """What tasks need: the sums and the projection."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, scale: int = SCALE) -> None:
        self.n, self.sums, self.scale = n, sums, scale
        self.project = vectors / np.sqrt(values)

    def centred(self, vectors: np.ndarray) -> np.ndarray:
        """n * x - S, exactly; the shift cancels."""
        y = integers(vectors, self.scale)
        if y.dtype != object and int(np.abs(y).max(initial=0)) * self.n + max(map(abs, self.sums)) < 2**63:
            return y * self.n - np.array(self.sums, np.int64)
        return y.astype(object) * self.n - np.array(self.sums, object)

    def deviations(self, u: np.ndarray) -> list[int]:
        """Sums of squares by row, exactly."""
        if u.dtype == object or int(np.abs(u).max(initial=0)) ** 2 * u.shape[1] >= 2**63:
            u = u.astype(object)
        return [int(v) for v in (u * u).sum(1)]

    def whitened(self, u: np.ndarray) -> np.ndarray:
        return (u / self.n).astype(float) @ self.project


def _identity_error(rows: DataFrame, d: int, white: Whitener) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity; means and centred scatter of the
    parts are put together pairwise."""
    k = white.project.shape[1]

    def together(a, b):
        if a is None:
            return b
        n, gap = a[0] + b[0], b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = None
        for batch in batches:
            if batch.num_rows:
                z = white.whitened(white.centred(_matrix(batch.column(0), d)))
                mean = z.mean(0)
                have = together(have, (len(z), mean, (z - mean).T @ (z - mean)))
        if have:
            yield pa.RecordBatch.from_pydict({"n": pa.array([have[0]], pa.int64()), "mean": pa.array([have[1].tobytes()], pa.binary()), "m": pa.array([have[2].tobytes()], pa.binary())})

    have = None
    for row in rows.select("vector").mapInArrow(local, "n long, mean binary, m binary").toLocalIterator():
        have = together(have, (row["n"], np.frombuffer(row["mean"]), np.frombuffer(row["m"]).reshape(k, k)))
    return float(np.abs(have[2] / have[0] - np.eye(k)).max(initial=0.0))


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT, most: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component: vec_id, component from 1, n, deviation, whitened, explained, identity_error,
    deviation_digits.

    `shift` is part of the definition of the integers; as it is the same for all of them it changes no result, so the sums
    are kept without it.
    """
    rows, d = fitting(embeddings, id_col, vector_col)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"
    if not d:
        return embeddings.sparkSession.createDataFrame([], schema)
    n, sums, products = exact_scatter(rows, d, scale)
    values, vectors, trace = components(n, sums, products, most)
    k = len(values)
    if not k:
        return embeddings.sparkSession.createDataFrame([], schema)
    white = Whitener(n, sums, values, vectors, scale)
    error = _identity_error(rows, d, white)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, max(1, BATCH // k)):
                part = batch.slice(a, max(1, BATCH // k))
                u = white.centred(_matrix(part.column(1), d))
                m, square = len(u), white.deviations(u)
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part.column(0).take(pa.array(each)), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), "n": pa.array(np.full(m * k, n, np.int64)),
                    "deviation": pa.array([v if v < 2**63 else None for v in square], pa.int64()).take(pa.array(each)), "whitened": pa.array(white.whitened(u).ravel()),
                    "explained": pa.array(np.tile(values / trace, m)), "identity_error": pa.array(np.full(m * k, error)), "deviation_digits": pa.array([str(v) for v in square]).take(pa.array(each)),
                })

    return rows.mapInArrow(run, schema)
