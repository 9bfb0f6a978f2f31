"""k-means for several numbers of clusters and many starts at once.

All (k, start) models advance together: one pass over the vectors serves every model that has not settled, each task
adds up its rows per model and cluster, and only these sums, one row per model, reach the driver.  So the number of passes is
that of the slowest model's iterations, not the sum over models.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from deskgraph.operators.vectors import matrix, usable_vector
from deskgraph.session import materialise

STARTS = 10
MAX_ITERATIONS = 100
TOLERANCE = 1e-4
#: First centres are drawn from so many rows, the first by a hash of their vector.
FIRST_ROWS = 2000


@dataclass(frozen=True)
class Clustering:
    """A model: its centres, and over all rows the clusters' sizes, vector sums and sums of squares, and the inertia."""

    k: int
    start: int
    centres: np.ndarray
    sizes: np.ndarray | None = None
    sums: np.ndarray | None = None
    squares: np.ndarray | None = None
    inertia: float = float("nan")
    silhouette: float = float("nan")


def gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of every row to every centre."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1), 0.0)


def first_centres(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spread-out rows of the sample: each next one is drawn with a chance that grows with its squared distance to those chosen."""
    chosen = [int(rng.integers(len(sample)))]
    while len(chosen) < k:
        near = gaps(sample, sample[chosen]).min(1)
        total = near.sum()
        chosen.append(int(rng.choice(len(sample), p=near / total if total > 0 else None)))
    return sample[chosen]


def _summed(rows: DataFrame, work: Callable[[np.ndarray], list[np.ndarray]], models: int) -> list[np.ndarray]:
    """Per model the sum over all rows of an array; ``work`` turns a block of rows into one array for each model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray] | None = None
        for batch in batches:
            if batch.num_rows:
                found = work(matrix(batch.column(0)))
                total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(models), pa.int32()), pa.array([t.ravel() for t in total], pa.list_(pa.float64()))], names=["model", "total"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"model": table["model"][:1], "total": pa.array([matrix(table["total"]).sum(0)], pa.list_(pa.float64()))})

    parts = rows.mapInArrow(run, "model int, total array<double>").groupBy("model").applyInArrow(add, "model int, total array<double>")
    found = parts.orderBy("model").toArrow()  # a row for each model
    return [np.array(t) for t in found["total"].to_pylist()]


def _statistics(rows: DataFrame, models: Sequence[Clustering]) -> list[Clustering]:
    """The models with sizes, sums, squares and inertia of their present centres, in one pass."""
    centres = [m.centres for m in models]

    def work(x: np.ndarray) -> list[np.ndarray]:
        square, out = (x * x).sum(1), []
        far = gaps(x, np.concatenate(centres))
        low = 0
        for c in centres:
            own = far[:, low : low + len(c)]
            low += len(c)
            label = own.argmin(1)
            one = np.zeros((len(c), len(x)))
            one[label, np.arange(len(x))] = 1.0
            out.append(np.column_stack([one @ x, one.sum(1), one @ square, one @ own.min(1)]))
        return out

    found = _summed(rows, work, len(models))
    done = []
    for m, total in zip(models, found, strict=True):
        t = total.reshape(len(m.centres), -1)
        done.append(replace(m, sums=t[:, :-3], sizes=t[:, -3], squares=t[:, -2], inertia=float(t[:, -1].sum())))
    return done


def fit(
    rows: DataFrame,
    ks: Sequence[int],
    vector: str = "embedding",
    seed: int = 42,
    starts: int = STARTS,
    max_iterations: int = MAX_ITERATIONS,
) -> list[Clustering]:
    """The best of ``starts`` models by inertia for each of ``ks``, with silhouettes.

    A start has settled when its centres move less than ``TOLERANCE`` of the vectors' variance.  A cluster without rows keeps its
    centre.  Vectors that are null or hold null, NaN or infinite values take no part; without any there are no models.
    """
    kept = materialise(rows.where(usable_vector(vector)).select(F.col(vector).cast("array<double>").alias("x")), "cluster-vectors")
    first = kept.orderBy(F.xxhash64("x"), "x").limit(FIRST_ROWS).toArrow()
    if not first.num_rows:
        return []
    sample = matrix(first["x"])
    moving = [Clustering(k, s, first_centres(sample, k, np.random.default_rng([seed, k, s]))) for k in ks for s in range(starts)]
    least, settled = TOLERANCE * sample.var(0).mean(), []
    for _ in range(max_iterations):
        going = []
        for m in _statistics(kept, moving):
            full = m.sizes[:, None] > 0
            centres = np.where(full, m.sums / np.where(full, m.sizes[:, None], 1.0), m.centres)
            moved = replace(m, centres=centres)
            (going if ((centres - m.centres) ** 2).sum() > least else settled).append(moved)
        moving = going
        if not moving:
            break
    best: dict[int, Clustering] = {}
    for m in sorted(_statistics(kept, [*settled, *moving]), key=lambda m: (m.k, m.inertia, m.start)):
        best.setdefault(m.k, m)
    return _silhouettes(kept, [best[k] for k in ks])


def _silhouettes(rows: DataFrame, models: list[Clustering]) -> list[Clustering]:
    """Mean squared-Euclidean silhouette over all rows, from the clusters' sums, in one pass.  A cluster of one row counts 0."""

    def work(x: np.ndarray) -> list[np.ndarray]:
        square, at, out = (x * x).sum(1), np.arange(len(x)), []
        for m in models:
            size = np.maximum(m.sizes, 1)
            mean = np.maximum(square[:, None] + m.squares / size - 2 * (x @ m.sums.T) / size, 0.0)
            label = gaps(x, m.centres).argmin(1)
            own = mean[at, label] * size[label] / np.maximum(size[label] - 1, 1)
            mean[at, label] = np.inf
            mean[:, m.sizes == 0] = np.inf
            other = mean.min(1)
            high = np.maximum(own, other)
            counts = (m.sizes[label] > 1) & np.isfinite(other) & (high > 0)
            out.append(np.array([((other - own)[counts] / high[counts]).sum(), len(x)]))
        return out

    found = _summed(rows, work, len(models))
    return [replace(m, silhouette=float(t[0] / t[1])) for m, t in zip(models, found, strict=True)]


def best_of(models: Sequence[Clustering]) -> Clustering:
    """The model of the first highest silhouette."""
    return max(models, key=lambda m: m.silhouette)


def assign(rows: DataFrame, model: Clustering, vector: str = "embedding", cluster: str = "cluster") -> DataFrame:
    """Rows with the number of their nearest centre, the lower one among equals; null without a usable vector."""
    centres = model.centres

    def nearest(column: pa.Array) -> pa.Array:
        known = np.asarray(column.is_valid())
        label = np.zeros(len(column), np.int32)
        if known.any():
            label[known] = gaps(matrix(column.drop_null()), centres).argmin(1)
        return pa.array(label, mask=~known)

    nearest.__annotations__ = {"column": pa.Array, "return": pa.Array}
    usable = F.when(usable_vector(vector, centres.shape[1]), F.col(vector))
    return rows.withColumn(cluster, arrow_udf(nearest, "int")(usable))


def scan(models: Sequence[Clustering], rows: DataFrame) -> DataFrame:
    """``k, silhouette_score, inertia, is_best`` of fitted models."""
    best = best_of(models).k if models else None
    table = [(m.k, round(m.silhouette, 4), round(m.inertia, 2), m.k == best) for m in models]
    return rows.sparkSession.createDataFrame(table, "k long, silhouette_score double, inertia double, is_best boolean")

