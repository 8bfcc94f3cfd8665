"""Whitening of vectors, with the covariance taken from squares alone (polarisation).

Components become integers x. With the number of vectors n and the sums S of each
dimension, y = n * x - S is centred and exact. Tasks add up (y_i)^2 for every dimension
and (y_i + y_j)^2 for every pair of dimensions; then

    2 * sum(y_i * y_j) = sum((y_i + y_j)^2) - sum(y_i^2) - sum(y_j^2)

gives all cross-covariances without an error, and the matrix goes to ``eigh``. What a
task hands on are d * (d + 1) / 2 sums, added in Spark by pair; as many reach the driver.

Squares do not fit 64 bits once n is large, so a centred value is split in limbs of 24
bits and the sums of limb products are kept apart by their weight. How many limbs there
are follows from the least and largest x; all sums are exact at every size.

Defined results: rows whose vector is null or holds a null, NaN or infinite entry are
left out, as are vectors of another length than ``dims`` (not given: the most frequent
length, the longer one of equally frequent ones). Repeated rows count each, null ids are kept.
A component without variance (fewer different vectors than dimensions) has a null
``whitened`` and is left out of ``identity_error``. Extra columns are dropped. An empty
table gives an empty table. Entries of 2**47 or more, or centred values of 2**61 or more,
raise ``ValueError``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType, DecimalType

from bloomtide.llm.centroid_clusters import finite

LIMB = 24
BLOCK = 8192  # rows whose limb products are added in 64 bits: 2 * 24 + 13 < 63
LARGEST_X = 1 << 53
#: A component with less of the trace than this counts as one without variance.
NO_VARIANCE = 1e-13


def finite_vectors(df: DataFrame, key: str, vector: str, dims: int | None = None) -> tuple[DataFrame, int]:
    """``id, v`` of the vectors that take part, and their length."""
    kept = df.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter(finite("v"))
    if dims is None:
        lengths = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d"))
        first = lengths.first()
        dims = first["d"] if first else 0
    return kept.filter(F.size("v") == dims), dims


def integers(batch: pa.RecordBatch, dims: int, scale: int, shift: int) -> np.ndarray:
    """x of a batch, one line a dimension."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.clip(np.floor(flat * scale), -LARGEST_X, LARGEST_X).astype(np.int64) + shift
    return np.ascontiguousarray(x.reshape(-1, dims).T)


def blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    step = max(1, min(BLOCK, (1 << 22) // max(dims, 1)))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def limbs_of(z: np.ndarray, limbs: int) -> list[np.ndarray]:
    """z as a sum of parts times 2**(24 * place); the last part has the sign."""
    parts = []
    for _ in range(limbs - 1):
        parts.append(z & ((1 << LIMB) - 1))
        z = z >> LIMB
    return [*parts, z]


def add_squares(totals: np.ndarray, at: int, z: np.ndarray, limbs: int) -> int:
    """Add the squares of each line of ``z`` to ``totals[place, at...]``; the next free column."""
    parts, end = limbs_of(z, limbs), at + len(z)
    for a in range(limbs):
        for b in range(a, limbs):
            s = np.einsum("ij,ij->i", parts[a], parts[b]).astype(object)
            totals[a + b, at:end] += s if a == b else s * 2
    return end


def square_sums(y: np.ndarray, limbs: int, totals: np.ndarray) -> None:
    """Every dimension, then every pair (0, 1), (0, 2), ... of sums of two dimensions."""
    at = add_squares(totals, 0, y, limbs)
    for i in range(len(y) - 1):
        at = add_squares(totals, at, y[i] + y[i + 1:], limbs)


@dataclass(frozen=True)
class Whitening:
    """Exact moments of the fit list and the eigenvectors of its covariance."""

    n: int
    sums: tuple[int, ...]
    largest: int            # of |y|
    trace: float
    values: np.ndarray      # falling
    vectors: np.ndarray     # one column a component
    covariance: np.ndarray
    scale: int
    shift: int

    def centred(self, batch: pa.RecordBatch) -> np.ndarray:
        """y = n * x - S of a batch, one line a dimension; exact, as y itself fits 64 bits."""
        x = integers(batch, len(self.sums), self.scale, self.shift)
        return x * np.int64(self.n) - np.array(self.sums, np.int64)[:, None]

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """Rows by components; NaN where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scaled = np.where(self.varies, self.vectors / np.sqrt(np.maximum(self.values, 0)), np.nan)
        return (y / self.n).T @ scaled

    @property
    def varies(self) -> np.ndarray:
        return self.values > NO_VARIANCE * self.trace


def moments(vectors: DataFrame, dims: int, scale: int, shift: int) -> tuple[int, list[int], int, int]:
    """n, the sums of x, and its least and largest value."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = 0, np.zeros(dims, object), None, None
        for batch in blocks(batches, dims):
            x = integers(batch, dims, scale, shift)
            n += batch.num_rows
            # halves of 27 bits, so that a block of them adds up in 64 bits
            total += (x >> 27).sum(axis=1).astype(object) * (1 << 27) + (x & ((1 << 27) - 1)).sum(axis=1).astype(object)
            low = x.min(axis=1) if low is None else np.minimum(low, x.min(axis=1))
            high = x.max(axis=1) if high is None else np.maximum(high, x.max(axis=1))
        if n:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(dims, dtype=np.int32)), pa.array([n] * dims, pa.int64()),
                pa.array(decimals(total), pa.decimal128(38, 0)), pa.array(low), pa.array(high)], ["dim", "n", "s", "low", "high"])

    parts = vectors.select("v").mapInArrow(part, "dim int, n long, s decimal(38,0), low long, high long")
    rows = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"),
                                    F.max("high").alias("high")).orderBy("dim").collect()  # one row a dimension
    if not rows:
        return 0, [0] * dims, 0, 0
    return rows[0]["n"], [int(r["s"]) for r in rows], min(r["low"] for r in rows), max(r["high"] for r in rows)


def decimals(values: np.ndarray) -> list:
    from decimal import Decimal

    return [Decimal(int(v)) for v in values]


def pair_sums(vectors: DataFrame, model: Whitening) -> list[int]:
    """Sums of squares of every dimension and every pair sum, exact."""
    dims = len(model.sums)
    limbs = max(1, -(-((2 * model.largest).bit_length() + 1) // LIMB))
    m = dims * (dims + 1) // 2

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2 * limbs - 1, m), object)
        seen = False
        for batch in blocks(batches, dims):
            seen = True
            square_sums(model.centred(batch), limbs, totals)
        for place in range(len(totals) if seen else 0):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(m, dtype=np.int32)), pa.array([place] * m, pa.int32()),
                pa.array(decimals(totals[place]), pa.decimal128(38, 0))], ["pair", "place", "s"])

    parts = vectors.select("v").mapInArrow(part, "pair int, place int, s decimal(38,0)")
    out = [0] * m
    for r in parts.groupBy("pair", "place").agg(F.sum("s").alias("s")).collect():  # d * (d + 1) / 2 sums, some limbs each
        out[r["pair"]] += int(r["s"]) << (LIMB * r["place"])
    return out


def covariance_of(squares: list[int], dims: int, n: int) -> tuple[np.ndarray, float]:
    """The covariance matrix (divisor n) and its trace, each entry rounded once."""
    cov, at = np.zeros((dims, dims)), dims
    for i in range(dims):
        cov[i, i] = squares[i] / n**3
        for j in range(i + 1, dims):
            cov[i, j] = cov[j, i] = (squares[at] - squares[i] - squares[j]) / (2 * n**3)
            at += 1
    return cov, sum(squares[:dims]) / n**3


def fit_whitening(vectors: DataFrame, dims: int, scale: int = 64, shift: int = 1_000_000) -> Whitening | None:
    """Fit on all rows of ``finite_vectors``; None when there are none. ``vectors`` is read twice."""
    n, sums, low, high = moments(vectors, dims, scale, shift)
    if n == 0 or dims == 0:
        return None
    if max(abs(low - shift), abs(high - shift)) >= LARGEST_X:
        raise ValueError(f"entries of {LARGEST_X // scale} or more are not exact")
    largest = max(max(abs(n * low - s), abs(n * high - s)) for s in sums)
    if largest >= 1 << 61:
        raise ValueError(f"centred values reach {largest}, exact ones end at 2**61")
    empty = np.zeros((dims, dims))
    model = Whitening(n, tuple(sums), largest, 0.0, empty[0], empty, empty, scale, shift)
    cov, trace = covariance_of(pair_sums(vectors, model), dims, n)
    values, columns = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")
    return Whitening(n, tuple(sums), largest, trace, values[order], columns[:, order], cov, scale, shift)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened vectors minus the identity, from the vectors themselves."""
    use = np.flatnonzero(model.varies)
    k = len(use)
    if not k:
        return 0.0

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in blocks(batches, len(model.sums)):
            w = model.whitened(model.centred(batch))[:, use]
            total += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["cell", "s"])

    cells = vectors.select("v").mapInArrow(part, "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s"))
    total = np.zeros((k + 1) * k)
    for r in cells.collect():  # k * (k + 1) numbers
        total[r["cell"]] = r["s"]
    total = total.reshape(k + 1, k) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def top(model: Whitening, components: int) -> Whitening:
    keep = slice(0, components)
    return Whitening(model.n, model.sums, model.largest, model.trace, model.values[keep], model.vectors[:, keep],
                     model.covariance, model.scale, model.shift)


def with_whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32,
                  dims: int | None = None, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``, a row for each vector and component.

    ``deviation`` is the exact squared norm of y, as a decimal. The table is read once to
    find the length, twice to fit, once to measure the error and once for the result.
    """
    vectors, dims = finite_vectors(df, key, vector, dims)
    schema = StructType([
        StructField(key, df.schema[key].dataType), StructField("component", IntegerType()), StructField("n", LongType()),
        StructField("deviation", DecimalType(38, 0)), StructField("whitened", DoubleType()),
        StructField("explained", DoubleType()), StructField("identity_error", DoubleType())])
    fitted = fit_whitening(vectors, dims, scale, shift)
    if fitted is None:
        return df.sparkSession.createDataFrame([], schema)
    model = top(fitted, components)
    error = identity_error(vectors, model)
    k = len(model.values)
    explained = model.values / model.trace if model.trace else np.zeros(k)
    narrow = dims * model.largest**2 < 1 << 62

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, dims):
            y, rows = model.centred(batch), batch.num_rows
            if narrow:
                norm = pa.array(np.einsum("ij,ij->j", y, y)).cast(pa.decimal128(38, 0))
            else:
                norm = pa.array(decimals((y.astype(object) ** 2).sum(axis=0)), pa.decimal128(38, 0))
            owner = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(owner), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, model.n)), norm.take(owner),
                pa.array(model.whitened(y).ravel(), from_pandas=True), pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * k, error))], schema.names)

    return vectors.mapInArrow(part, schema)
