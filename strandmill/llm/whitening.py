"""Whitening of embeddings from an exact integer scatter matrix.

Vectors become integers. Around a shift that is the same for all rows, sums and
cross-products are accumulated without any rounding: a block's products are made
by floating-point matrix products of limbs so short that every partial sum is an
exact integer, and blocks are added as integers of any size. Only the matrix
n * X'X - S S', exact as well, becomes floating point, and ``eigh`` decomposes it.

Tasks hand on their totals as limbs of 60 bits, which Spark adds up by position, so
the driver sees one matrix and no totals of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import ship_library, tidy

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Rows of a block and bits of a limb: 2^11 products of 2 * 20 bits stay below 2^53.
BLOCK_ROWS, LIMB_BITS = 2048, 20
#: Base of the limbs by which tasks hand on their totals.
TOTAL_BITS = 60
#: Directions with less than this share of the largest eigenvalue hold no variance to scale.
LEAST_SHARE = 1e-12
_SCATTER = "i int, j int, limb int, value long"


@dataclass
class Whitening:
    """What the fit list says: its size, exact sums, and components with their eigenvalues."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def integers(entries: np.ndarray) -> np.ndarray:
    """floor(64 * c) + 1000000, as int64 where all fit and as Python's integers else."""
    scaled = np.floor(SCALE * entries)
    if not scaled.size or np.abs(scaled).max() < 2**61:
        return scaled.astype(np.int64) + OFFSET
    return np.array([int(c) + OFFSET for c in scaled.ravel()], dtype=object).reshape(scaled.shape)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """x as a sum of limbs times powers of 2^20, each small enough for exact products."""
    half, out = 1 << (LIMB_BITS - 1), []
    while True:
        low = (x + half) % (1 << LIMB_BITS) - half
        out.append(low.astype(np.float64))
        x = (x - low) >> LIMB_BITS
        if not x.any():
            return out


def cross_products(x: np.ndarray) -> np.ndarray:
    """x'x of a block of integers, exact, as Python's integers."""
    limbs, total = _limbs(x), 0
    for a, left in enumerate(limbs):
        for b, right in enumerate(limbs):
            total = total + (left.T @ right).astype(np.int64).astype(object) * (1 << (LIMB_BITS * (a + b)))
    return total


def _blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Row blocks with their vectors; all have the same length."""
    for rows in batches:
        for at in range(0, rows.num_rows, BLOCK_ROWS):
            part = rows.slice(at, BLOCK_ROWS)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _emitted(totals: dict[tuple[int, int], int]) -> pa.RecordBatch:
    """Totals as limbs of 60 bits under their position; the sign is the limbs' own."""
    rows = []
    for (i, j), value in totals.items():
        sign, value, limb = (1 if value >= 0 else -1), abs(value), 0
        while value:
            rows.append((i, j, limb, sign * (value & ((1 << TOTAL_BITS) - 1))))
            value >>= TOTAL_BITS
            limb += 1
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["i", "j", "limb", "value"])


def usable(vectors: DataFrame) -> DataFrame:
    """Rows to fit and transform, with ``_sm_x`` as doubles.

    Vectors that are null or hold null or non-finite entries are left out, and so are
    those of another length than most have (of equally frequent lengths the longest);
    empty vectors have no components and no rows. Repeated rows count as often as they come.
    """
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("_sm_x")).where(F.col("embedding").isNotNull() & fine & (F.size("embedding") > 0))
    lengths = rows.groupBy(F.size("_sm_x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.where(F.size("_sm_x") == (lengths["length"] if lengths else 0))


def fit(rows: DataFrame) -> Whitening | None:
    """The exact fit over all rows of ``usable``; None where there is none.

    The driver holds one matrix, which vectors' length bounds. Components without
    variance, up to rounding, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, 0, 0
        for _, entries in _blocks(batches, "_sm_x"):
            x = integers(entries) - OFFSET
            n += len(x)
            sums = sums + np.array([int(s) for s in x.astype(object).sum(axis=0)], dtype=object)
            cross = cross + cross_products(x)
        if n:
            d = len(sums)
            totals = {(-1, -1): n} | {(-1, j): sums[j] for j in range(d)} | {(i, j): cross[i, j] for i in range(d) for j in range(i, d)}
            yield _emitted(totals)

    # A limb has 60 bits, so decimals hold the sum over 10^20 tasks.
    added = rows.select("_sm_x").mapInArrow(tidy(run), _SCATTER).groupBy("i", "j", "limb").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"))
    found: dict[tuple[int, int], int] = {}
    for r in added.collect():
        found[r["i"], r["j"]] = found.get((r["i"], r["j"]), 0) + int(r["value"]) * (1 << (TOTAL_BITS * r["limb"]))
    if not found:
        return None
    return decomposed(found)


def decomposed(totals: dict[tuple[int, int], int]) -> Whitening:
    """Eigenvectors of the covariance from exact totals around the shift; what is zero may be absent."""
    n = totals[-1, -1]
    d = 1 + max(max(i, j) for i, j in totals)
    shifted = [totals.get((-1, j), 0) for j in range(d)]
    covariance = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            # An integer over an integer: Python rounds the true quotient once.
            covariance[i, j] = covariance[j, i] = (n * totals.get((i, j), 0) - shifted[i] * shifted[j]) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = int((values > max(values[0], 0.0) * LEAST_SHARE).sum()) if values[0] > 0 else 0
    keep = min(keep, COMPONENTS)
    return Whitening(n, [s + n * OFFSET for s in shifted], values[:keep].copy(), vectors[:, :keep].copy(), float(np.trace(covariance)))


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: int64 where that has room, Python's integers else."""
    if x.dtype != object and n * int(np.abs(x).max(initial=0)) < 2**61 and max(map(abs, sums), default=0) < 2**61:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def deviations(moved: np.ndarray) -> list[int | None]:
    """Exact sums of squares over dimensions; None where a long has no room for one."""
    if moved.dtype != object and moved.shape[1] * int(np.abs(moved).max(initial=0)) ** 2 < 2**63:
        return (moved * moved).sum(axis=1).tolist()
    return [s if s < 2**63 else None for s in (sum(int(v) ** 2 for v in row) for row in moved)]


def _projected(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    moved = centred(x, model.n, model.sums)
    away = moved.astype(np.float64) / model.n if moved.dtype != object else np.array([[int(v) / model.n for v in row] for row in moved])
    return moved, away @ model.vectors / np.sqrt(model.values)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity.

    Whitened values are centred by their exact mean before they are multiplied.
    """
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for _, entries in _blocks(batches, "_sm_x"):
            w = _projected(integers(entries), model)[1]
            total += w.T @ w
        yield pa.RecordBatch.from_pydict({"i": np.repeat(np.arange(k, dtype=np.int32), k), "j": np.tile(np.arange(k, dtype=np.int32), k), "value": total.ravel()})

    added = rows.select("_sm_x").mapInArrow(tidy(run), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    spread = np.zeros((k, k))
    for r in added.collect():
        spread[r["i"], r["j"]] = r["value"]
    return float(np.abs(spread / model.n - np.eye(k)).max(initial=0.0))


def whitened(vectors: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each usable row.

    One row per component, numbered from 1 by falling eigenvalue, 32 at most. See
    ``usable`` for the rows that take part; a null vec_id is kept as it is. Where no
    direction has any variance, or no row is left, there are no rows. A deviation too
    large for a long is null.
    """
    spark = vectors.sparkSession
    ship_library(spark)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(vectors)
    model = fit(rows)
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    error = identity_error(rows, model)
    shares = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for part, entries in _blocks(batches, "_sm_x"):
            moved, w = _projected(integers(entries), model)
            m = len(w)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    pa.array(deviations(moved), pa.int64()).take(each),
                    pa.array(w.ravel()),
                    pa.array(np.tile(shares, m)),
                    pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(tidy(run), schema)
