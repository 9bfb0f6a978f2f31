"""Vector operators: centroids and block products.

Vectors are ``array<float>`` or ``array<double>`` columns.  Products run as blocks inside
tasks on Arrow batches; Spark does the partitioning, shuffling and merging.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CENTROIDS = 4096
SCORE_CELLS = 4_000_000
TIE_DIGITS = 9


def matrix(column: pa.ChunkedArray | pa.Array, dtype: type | None = np.float64) -> np.ndarray:
    """Rows of a list column as a dense double matrix; without ``dtype`` in the type they have."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if rows == 0:
        return np.zeros((0, 0))
    lengths = column.value_lengths()
    if lengths.null_count or pc.min(lengths).as_py() != pc.max(lengths).as_py():
        raise ValueError("vectors of different lengths cannot form a matrix; leave out those that are not usable")
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
    return values if dtype is None else values.astype(dtype, copy=False)


def usable_vector(vector: str, width: int | None = None) -> Column:
    """Not null, of ``width`` values (any number without it), none of them null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    good = F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))
    return good if width is None else good & F.coalesce(F.size(vector) == width, F.lit(False))


def prototype_centroids(rows: DataFrame, label: str = "label", vector: str = "embedding", unit: bool = True) -> DataFrame:
    """Mean vector of each label, scaled to unit length: ``label, centroid``.

    The mean is a JVM aggregate with one buffer per label and task, so a hot label is
    reduced before the shuffle.
    """
    means = rows.groupBy(F.col(label).alias("label")).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))).alias("centroid")
    )
    if not unit:
        return means
    norm = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x * x))
    return means.withColumn("_norm", norm).select(
        "label", F.transform("centroid", lambda x: x / F.col("_norm")).alias("centroid")
    )


@dataclass(frozen=True)
class Centroids:
    """A fitted centroid table: one short row per label, its number checked."""

    labels: list
    values: np.ndarray

    @staticmethod
    def fit(centroids: DataFrame, limit: int = MAX_CENTROIDS) -> "Centroids":
        table = centroids.select("label", "centroid").orderBy("label").limit(limit + 1).toArrow()
        if table.num_rows > limit:
            raise ValueError(f"more than {limit} centroids; search them with a case index instead")
        return Centroids(table.column("label").to_pylist(), matrix(table.column("centroid")))


def centroid_products(rows: DataFrame, model: Centroids, vector: str = "embedding", distance: bool = False) -> DataFrame:
    """Add ``sims``: the dot product (or Euclidean distance) with every centroid in label order.

    A narrow, streaming step: one block product per Arrow batch of vectors, no shuffle; other columns stay in the
    JVM.  A row without a vector, or with one that does not fit the centroids, gets null.
    """
    centroids = model.values
    squares = (centroids * centroids).sum(axis=1)

    def score(column: pa.Array) -> pa.Array:
        valid = np.asarray(column.is_valid())
        out = np.zeros((len(column), len(centroids)))
        if valid.any():
            x = matrix(column.drop_null())
            dots = x @ centroids.T
            if distance:
                dots = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * dots + squares, 0.0))
            out[valid] = dots
        offsets = np.arange(len(column) + 1, dtype=np.int32) * len(centroids)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()), mask=pa.array(~valid))

    score.__annotations__ = {"column": pa.Array, "return": pa.Array}
    fitting = F.when(usable_vector(vector, centroids.shape[1]), F.col(vector))
    return rows.withColumn("sims", arrow_udf(score, "array<double>")(fitting))


def best_columns(scores: np.ndarray, width: int) -> np.ndarray:
    """Column numbers of the ``width`` highest scores per row, lower number first among equals."""
    if width == scores.shape[1]:
        return np.argsort(-scores, axis=1, kind="stable")
    floor = np.partition(scores, scores.shape[1] - width, axis=1)[:, -width]
    row, column = np.nonzero(scores >= floor[:, None])  # keeps every tie at the cut, lower columns first
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return column[place < width].reshape(len(scores), width)


def common_width(queries: DataFrame, corpus: DataFrame, vector: str) -> int | None:
    """The length that the most pairs of a query and a case share; without any pair the corpus's most frequent."""

    def lengths(rows: DataFrame, count: str) -> DataFrame:
        return rows.where(usable_vector(vector)).groupBy(F.size(vector).alias("width")).agg(F.count(F.lit(1)).cast("double").alias(count))

    both = lengths(corpus, "cases").join(lengths(queries, "asked"), "width", "left")
    pairs = F.coalesce(F.col("cases") * F.col("asked"), F.lit(0.0))
    first = both.orderBy(pairs.desc(), F.desc("cases"), F.desc("width")).first()
    return first and first["width"]
