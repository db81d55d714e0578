"""Whitening of embeddings: covariance by Chan's merging of partitions, eigenvectors on the driver, a second pass that checks.

Rows whose vector is null, empty or holds null or non-finite entries are left out. An entry c becomes the whole number
x = floor(64 c) + 1,000,000. The fit list is each distinct vector x once, written to the shared folder, as two passes read it.
Of each partition one row comes back: how many vectors, their exact sums, their mean and their scatter about it. Pairs of
such rows are merged by Chan's formula in a tree (``treeReduce``), so the driver holds one of them. The second pass
projects the fit list and merges the covariance of the result in the same way; its distance from the identity is
``identity_error``.

Defined results: repeated rows each have their result, though the fit list has their vector once; vectors of another length
than most rows have (of equally frequent lengths the larger) are left out; an entry of which 64 c is beyond 2^53 counts as
2^53; a component whose eigenvalue is at most 1e-12 of their sum (as when all vectors are equal) has null ``whitened`` and
takes no part in ``identity_error``, which is null if no component is left; ``explained`` is null if that sum is zero;
``deviation`` is null where it is beyond a long; a table without vectors gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common

SCALE, BASE, COMPONENTS = 64, 1_000_000, 16
LARGEST = float(1 << 53)
#: Share of the eigenvalues' sum up to which one counts as zero.
NOTHING = 1e-12
SUMMARY = "n long, sums array<decimal(38,0)>, mean array<double>, scatter array<double>"
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Moments:
    """Of n vectors: their exact sums (None where the vectors are not whole), mean, and scatter about the mean."""

    n: int
    sums: list[int] | None
    mean: np.ndarray
    scatter: np.ndarray

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        apart = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * (other.n / n))
        if self.sums is None:
            return Moments(n, None, self.mean + apart * (other.n / n), scatter)
        sums = [a + b for a, b in zip(self.sums, other.sums)]
        return Moments(n, sums, np.array([s / n for s in sums]), scatter)  # quotients of whole numbers are rounded once


def moments(x: np.ndarray) -> Moments:
    """Of the rows of x; whole numbers keep their exact sums."""
    whole = x.dtype.kind == "i"
    if whole:
        safe = len(x) * float(np.abs(x).max(initial=0)) < 2.0**62
        sums = [int(s) for s in (x.sum(0) if safe else x.astype(object).sum(0))]
        mean = np.array([s / len(x) for s in sums])
    else:
        sums, mean = None, x.mean(0)
    centred = x - mean
    return Moments(len(x), sums, mean, centred.T @ centred)


@dataclass(frozen=True)
class Whitening:
    """A fitted transformation: vectors are given without BASE, as floor(64 c)."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    def project(self, y: np.ndarray) -> np.ndarray:
        """One column a component; NaN where the eigenvalue counts as zero."""
        mean = np.array([s / self.n for s in self.sums])
        usable = self.values > NOTHING * self.trace
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(usable, (y - mean) @ self.vectors / np.sqrt(np.where(usable, self.values, 1.0)), np.nan)

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """The exact sum of (n y - sum)^2 of each row."""
        largest = max(float(np.abs(y).max(initial=0)) * self.n, max((abs(s) for s in self.sums), default=0)) * 2.0
        if largest * largest * y.shape[1] < 2.0**62:
            off = y * self.n - np.array(self.sums, dtype=np.int64)
            return (off * off).sum(1).tolist()
        off = y.astype(object) * self.n - np.array(self.sums, dtype=object)
        return [v if v < 1 << 63 else None for v in map(int, (off * off).sum(1))]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, y): the whole numbers x without BASE of the rows that take part, whatever their length."""
    odd = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = vectors.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~odd)
    within = lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.lit(float(SCALE)) * c.cast("double")))
    return rows.select("vec_id", F.transform("embedding", lambda c: F.floor(within(c))).alias("y"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def gathered(rows: DataFrame, view) -> Moments | None:
    """The moments of all rows (y) as ``view`` turns them, merged pairwise in a tree; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for part in common.slices(batch):
                more = moments(view(matrix(part.column(0))))
                own = more if own is None else own.merged(more)
        if own is not None:
            sums = None if own.sums is None else [Decimal(s) for s in own.sums]
            yield pa.RecordBatch.from_arrays(
                [pa.array([own.n], pa.int64()), pa.array([sums], pa.list_(pa.decimal128(38, 0))), pa.array([own.mean.tolist()], pa.list_(pa.float64())), pa.array([own.scatter.ravel().tolist()], pa.list_(pa.float64()))],
                names=["n", "sums", "mean", "scatter"],
            )

    def read(r) -> list[Moments]:
        mean = np.array(r.mean)
        return [Moments(r.n, None if r.sums is None else [int(s) for s in r.sums], mean, np.array(r.scatter).reshape(len(mean), len(mean)))]

    def merge(a: list[Moments], b: list[Moments]) -> list[Moments]:
        return [a[0].merged(b[0])] if a and b else a or b

    parts = rows.select("y").mapInArrow(run, SUMMARY).rdd.map(read)
    found = parts.treeAggregate([], merge, merge, depth=3)  # as treeReduce, but empty tables are none
    return found[0] if found else None


def fitted(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, int]:
    """The whitening of rows (y), and the length of the vectors that it is for. Two passes over the distinct vectors."""
    lengths = rows.groupBy(F.size("y").alias("d")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.desc("d")).first()
    if lengths is None:
        return None, 0
    d = lengths.d
    fit = common.written(rows.where(F.size("y") == d).select("y").distinct(), "whitening")
    found = gathered(fit, lambda y: y)
    values, vectors = np.linalg.eigh(found.scatter / found.n)
    order = np.argsort(values)[::-1][:components]
    first = Whitening(found.n, found.sums, np.maximum(values[order], 0.0), vectors[:, order], float(np.trace(found.scatter) / found.n))
    told = gathered(fit, lambda y: np.nan_to_num(first.project(y)))
    good = first.values > NOTHING * first.trace
    off = np.abs(told.scatter / told.n - np.eye(len(good)))[np.ix_(good, good)]
    return Whitening(first.n, first.sums, first.values, first.vectors, first.trace, float(off.max()) if good.any() else None), d


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row per usable vector (vec_id, embedding) and
    component, the largest ``components`` of them."""
    rows = usable(vectors)
    model, d = fitted(rows, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        explained = [v / model.trace if model.trace > 0 else None for v in model.values]
        for batch in batches:
            for part in common.slices(batch):
                y, m = matrix(part.column(1)), part.num_rows
                deviation = model.deviations(y)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                        pa.array([v for v in deviation for _ in range(k)], pa.int64()), pa.array(model.project(y).ravel(), pa.float64(), from_pandas=True),
                        pa.array(explained * m, pa.float64()), pa.array([model.identity_error] * (m * k), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    own = rows.where(F.size("y") == d).select(F.col("vec_id").cast("long").alias("vec_id"), "y")
    return own.mapInArrow(run, SCHEMA)
