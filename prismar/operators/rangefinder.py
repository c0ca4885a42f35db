"""Principal components of wide vectors over all rows, by a randomised range finder with QR over row blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from prismar.operators.search import matrix
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXACT, SIGNS, FAN, SEED = 1024, 4, 16, 11
BAND = 1 << 17  # numbers of a partial sum that travel as one row


class Sketch:
    """A fixed random map from `width` places to `size` columns: each place goes to SIGNS columns with a random sign. Where size = width nothing is mapped."""

    def __init__(self, width: int, size: int, seed: int = SEED):
        self.size, self.plans = size, []
        for k in range(SIGNS if size < width else 0):
            rng = np.random.default_rng((seed, k))
            column = rng.integers(0, size, width)
            order = np.argsort(column, kind="stable")
            names, starts = np.unique(column[order], return_index=True)
            self.plans.append((order, rng.choice((-1.0, 1.0), width)[order], names, starts))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.plans:
            return x
        out = np.zeros((len(x), self.size))
        for order, sign, names, starts in self.plans:
            out[:, names] += np.add.reduceat(x[:, order] * sign, starts, axis=1)
        return out


def upper(*parts: np.ndarray) -> np.ndarray:
    """The triangle R of a QR of what is stacked."""
    return np.linalg.qr(np.vstack(parts), mode="r")


def triangles(rows: DataFrame, sketch: Sketch, parts: int) -> tuple[int, float, np.ndarray]:
    """Rows, sum of squares, and R of [1 | sketch] over all rows: each task folds its rows into one R, and these are folded FAN at a time."""
    kind = "part int, n long, squares double, r binary"
    width = sketch.size + 1

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, squares, held = 0, 0.0, [np.zeros((0, width))]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                x = matrix(batch.column("v").slice(at, 256), unit=False)
                n, squares = n + len(x), squares + float((x * x).sum())
                held.append(np.hstack([np.ones((len(x), 1)), sketch(x)]))
                if sum(map(len, held)) > 2 * width:
                    held = [upper(*held)]
        yield from triangle(TaskContext.get().partitionId(), n, squares, upper(*held))

    def triangle(part: int, n: int, squares: float, r: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([squares]), pa.array([r.tobytes()], pa.binary())], ["part", "n", "squares", "r"])

    def fold(key: tuple, found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, squares, r = 0, 0.0, np.zeros((0, width))
        for batch in found:
            for k in range(batch.num_rows):
                n, squares = n + batch.column("n")[k].as_py(), squares + batch.column("squares")[k].as_py()
                r = upper(r, np.frombuffer(batch.column("r")[k].as_buffer()).reshape(-1, width))
        yield from triangle(key[0].as_py(), n, squares, r)

    level = rows.mapInArrow(first, kind)
    while parts > 1:
        parts = -(-parts // FAN)
        level = level.groupBy(F.floor(F.col("part") / FAN).cast("int").alias("fan")).applyInArrow(fold, kind)
    found = level.collect()  # one row
    return sum(r.n for r in found), sum(r.squares for r in found), upper(*(np.frombuffer(r.r).reshape(-1, width) for r in found))


def projected(rows: DataFrame, sketch: Sketch, mean: np.ndarray, basis: np.ndarray, width: int) -> np.ndarray:
    """[1 | Q]^T times all rows. A task adds up one such matrix over all its rows and sends it in bands, which are added up apart."""
    shared = rows.sparkSession.sparkContext.broadcast((mean, basis))
    height = basis.shape[1] + 1
    step = max(1, BAND // height)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, basis = shared.value
        total = np.zeros((height, width))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                x = matrix(batch.column("v").slice(at, 256), unit=False)
                total += np.hstack([np.ones((len(x), 1)), (sketch(x) - mean) @ basis]).T @ x
        for band, a in enumerate(range(0, width, step)):
            yield pa.RecordBatch.from_arrays([pa.array([band], pa.int32()), pa.array([np.ascontiguousarray(total[:, a : a + step]).tobytes()], pa.binary())], ["band", "sums"])

    def fold(key: tuple, found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in found:
            for k in range(batch.num_rows):
                own = np.frombuffer(batch.column("sums")[k].as_buffer())
                out = own.copy() if out is None else out + own
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["band", "sums"])

    kind = "band int, sums binary"
    bands = rows.mapInArrow(add, kind).groupBy("band").applyInArrow(fold, kind).orderBy("band").toLocalIterator(prefetchPartitions=True)
    out = np.hstack([np.frombuffer(r.sums).reshape(height, -1) for r in bands])
    shared.unpersist()
    return out


def components(rows: DataFrame, dims: int, width: int, n: int, extra: int | None = None) -> dict:
    """components (dims x width), mean and variance (the sum of squares of the centred rows) of all rows (v: arrays of `width` doubles), in two passes.

    The first folds [1 | sketch] of the rows into triangles; the best dims + extra directions Q of the centred sketch follow from the last one. The second adds
    up Q^T times the rows, whose singular vectors are the components. Up to EXACT places the sketch is the rows themselves and the result exact; of wider ones
    it has 4 dims columns, EXACT at least (a test holds the variance that they retain to 1 % of the exact one).

    Memory: a task holds 256 rows, three squares of the sketch's width, and one matrix of (dims + extra) x width doubles, about what the model itself needs;
    no width x width matrix. So many rows go to one task (by coalescing, not by an exchange) that these sums are never more than a fraction of the rows.
    """
    size = width if width <= EXACT else min(width, max(EXACT, 4 * dims))
    sketch, kept = Sketch(width, size), dims + (max(64, dims // 4) if extra is None else extra)
    parts = max(1, min(rows.rdd.getNumPartitions(), n // (2 * kept)))
    some = rows.coalesce(parts)
    n, squares, r = triangles(some, sketch, parts)
    mean, (u, s, vt) = r[0, 1:] / r[0, 0], np.linalg.svd(r[1:, 1:]) if len(r) > 1 else (None, np.zeros(0), np.zeros((0, size)))
    keep = np.flatnonzero(s > 1e-10 * max(s.max(initial=0), 1e-300))[:kept]
    basis = vt[keep].T / s[keep]
    sums = projected(some, sketch, mean, basis, width)
    centre, b = sums[0] / n, sums[1:]
    left, value, _ = np.linalg.svd(upper(b.T).T) if len(b) else (np.zeros((0, 0)), np.zeros(0), None)
    live = int((value[:dims] > 1e-10 * max(value.max(initial=0), 1e-300)).sum())
    found = (left[:, :live].T @ b) / value[:live, None]
    return {"components": np.vstack([found, np.zeros((dims - live, width))]), "mean": centre, "variance": max(squares - n * float(centre @ centre), 0.0)}
