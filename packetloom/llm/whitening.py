"""Embedding whitening by a one-sided Jacobi singular value decomposition of a blockwise QR factor.

Vectors become fixed-point rows x = floor(64 c) + 1 000 000, whose sums are exact. Centred rows are compressed by
tall-skinny QR: every task folds its rows, block by block, into one triangular R, and the tasks' factors are folded
together in rounds until one is left, of dimension by dimension. Plane rotations then orthogonalise the columns of R;
their accumulated product is the matrix of components, and the columns' norms are the singular values, so that small
standard deviations come out as accurately as large ones (no covariance matrix is squared up). Signs are set so that a
component's largest entry is positive. A last pass over all rows measures the covariance of the whitened rows.

What passes through the driver has the size of the dimension (sums) or its square (R and that covariance).

Defined cases: rows whose vector is null, empty or of another length than most (ties to the longer), or holds null or
non-finite entries take no part. Rows without an id, and repeated rows, are rows like others. Entries beyond
2**53 / 64 are taken as that bound. Components without variance (standard deviation within rounding of zero, as with
fewer rows than dimensions) can't be whitened and are left out; a table without two different vectors gives an empty
result, as an empty one does. `deviation` is exact; where it passes the range of a long (some million rows), it is null
and `deviation_text` holds its digits. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.common import bounded_batches, materialize

SCALE = 64
SHIFT = 1_000_000
#: Fixed-point values stay integers of double precision.
LARGEST = 1 << 53
#: Factors of tasks that one task of the next round folds together.
FAN_IN = 32
#: Doubles of a block of rows that is folded into R at once.
BLOCK_VALUES = 1 << 20
SWEEPS = 60


@dataclass(frozen=True)
class Whitening:
    n: int
    #: Exact sums of each dimension.
    sums: list[int]
    #: Components as columns, by falling variance, and the variances (divisor n).
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0


def usable(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows that take part, and their length."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    most = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return fine.where(F.size("v") == (most.n if most else 0)), most.n if most else 0


def fixed_point(column: pa.Array, dim: int) -> np.ndarray:
    """The rows' x as integers."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.clip(np.floor(SCALE * c), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: as longs where they fit, else as Python's integers."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62 and max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return numerators(x, n, sums).astype(np.float64) / n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sums over dimensions of (n * x - S) ** 2."""
    d = numerators(x, n, sums)
    if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 1 << 63:
        return (d * d).sum(axis=1).tolist()
    return (d.astype(object) ** 2).sum(axis=1).tolist()


def matrices(batches: Iterator[pa.RecordBatch], at: int, dim: int) -> Iterator[np.ndarray]:
    rows = max(1, BLOCK_VALUES // dim)
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield fixed_point(batch.column(at).slice(low, rows), dim)


def exact_sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Rows and sums of each dimension: one small row per task and dimension, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, object)
        for x in matrices(batches, 0, dim):
            n += len(x)
            # Halves of 26 bits, so that no block's sum leaves the range of a long.
            total += (x >> 26).sum(axis=0).astype(object) * (1 << 26) + (x & ((1 << 26) - 1)).sum(axis=0).astype(object)
        if n:
            text = pa.array([str(s) for s in [n, *total]], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1), pa.int32()), text], names=["at", "total"])

    parts = bounded_batches(rows.select("v")).mapInArrow(run, "at int, total string")
    found = {r.at: int(r.total) for r in parts.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    return found.get(0, 0), [found.get(i + 1, 0) for i in range(dim)]


def folded(r: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    """R of the rows behind r and the rows x."""
    return np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")


def _factor_row(r: np.ndarray | None, task: int) -> Iterator[pa.RecordBatch]:
    if r is not None:
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([r.astype("<f8").tobytes()], pa.binary())], names=["task", "r"])


def triangular(rows: DataFrame, dim: int, centre: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The triangular factor of all centred rows: folded in each task, then in rounds of FAN_IN factors each."""

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for x in matrices(batches, 0, dim):
            r = folded(r, centre(x))
        yield from _factor_row(r, TaskContext.get().partitionId())

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for raw in batch.column(1):
                r = folded(r, np.frombuffer(raw.as_buffer(), "<f8").reshape(-1, dim))
        yield from _factor_row(r, TaskContext.get().partitionId())

    schema = "task long, r binary"
    factors = materialize(bounded_batches(rows.select("v")).mapInArrow(compress, schema), "factors")
    while (left := factors.count()) > FAN_IN:
        factors = materialize(factors.repartition(-(-left // FAN_IN), "task").mapInArrow(together, schema), "factors")
    r = None
    for row in factors.orderBy("task").toLocalIterator():
        r = folded(r, np.frombuffer(row.r, "<f8").reshape(-1, dim))
    return np.zeros((0, dim)) if r is None else r


def pairings(d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs of d columns in which every pair occurs once (a round-robin tournament)."""
    seats = list(range(d + d % 2))
    for _ in range(len(seats) - 1):
        pairs = [(a, b) for a, b in zip(seats[: len(seats) // 2], seats[: len(seats) // 2 - 1 : -1], strict=True) if a < d and b < d]
        if pairs:
            left, right = zip(*(sorted(p) for p in pairs), strict=True)
            yield np.array(left), np.array(right)
        seats = [seats[0], seats[-1], *seats[1:-1]]


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors of r, as columns, and its singular values, both by falling value.

    Columns p and q are turned in their plane until they are orthogonal, all pairs in sweeps, until none is left whose
    cosine passes rounding."""
    d = r.shape[1]
    a = np.zeros((d, d))
    a[: r.shape[0]] = r
    v = np.eye(d)
    floor = (np.finfo(float).eps * np.linalg.norm(a)) ** 2
    for _ in range(SWEEPS):
        turned = False
        for p, q in pairings(d):
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            off = np.abs(xy) > 1e-15 * np.sqrt(xx * yy) + floor * np.finfo(float).eps
            if not off.any():
                continue
            turned = True
            tau = (yy - xx) / np.where(off, 2 * xy, 1)
            t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1, tau))
            t = np.where(off, t, 0.0)
            c = 1 / np.hypot(1, t)
            s = c * t
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            x, y = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    sigma = np.sqrt((a * a).sum(0))
    order = np.argsort(-sigma, kind="stable")
    v = v[:, order]
    top = np.abs(v).argmax(axis=0)
    return v * np.where(v[top, np.arange(d)] < 0, -1.0, 1.0), sigma[order]


def fit(rows: DataFrame, dim: int, most: int = 32) -> Whitening | None:
    """Components of usable()'s rows, most at the utmost, with the measured error of the whitened covariance."""
    n, sums = exact_sums(rows, dim) if dim else (0, [])
    if not n:
        return None
    v, sigma = jacobi(triangular(rows, dim, lambda x: centred(x, n, sums)))
    trace = float((sigma**2).sum())
    k = int((sigma[:most] > 1e-13 * np.sqrt(dim) * sigma[0]).sum())
    if not k:
        return None
    model = Whitening(n, sums, v[:, :k], sigma[:k] ** 2 / n, trace / n)
    return Whitening(n, sums, model.components, model.variances, model.trace, identity_error(rows, model))


def whiten(x: np.ndarray, model: Whitening) -> np.ndarray:
    return centred(x, model.n, model.sums) @ model.components / np.sqrt(model.variances)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    dim, k = len(model.sums), len(model.variances)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(k), np.zeros((k, k))
        for x in matrices(batches, 0, dim):
            w = whiten(x, sent.value)
            total += w.sum(axis=0)
            square += w.T @ w
        values = np.concatenate([total, square.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], names=["at", "total"])

    parts = bounded_batches(rows.select("v")).mapInArrow(run, "at int, total double")
    found = {r.at: r.total for r in parts.groupBy("at").agg(F.sum("total").alias("total")).collect()}
    values = np.array([found[i] for i in range(k + k * k)]) / model.n
    mean, square = values[:k], values[k:].reshape(k, k)  # rows are centred before they are multiplied: mean is rounding
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def whitened(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 32) -> DataFrame:
    """One row per usable row and component."""
    kind = df.schema[id_col].dataType
    fields = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("deviation_text", T.StringType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(*f) for f in fields)])
    rows, dim = usable(df, id_col, vec_col)
    model = fit(rows, dim, most)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    k = len(model.variances)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            x = fixed_point(batch.column(1), dim)
            dev = deviations(x, m.n, m.sums)
            whole = [d if d < 1 << 63 else None for d in dev]
            each = pa.array(np.repeat(np.arange(len(x)), k))
            count = len(x) * k
            share = np.tile(m.variances / m.trace, len(x))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(count, m.n)), pa.array(whole, pa.int64()).take(each),
                    pa.array([str(d) for d in dev], pa.string()).take(each), pa.array(whiten(x, m).ravel()), pa.array(share), pa.array(np.full(count, m.identity_error)),
                ],
                names=schema.names,
            )

    return bounded_batches(rows).mapInArrow(run, schema)
