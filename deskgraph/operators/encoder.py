"""A text encoder that is fitted once, stored, opened anywhere and applied to new texts.

A term falls on one of a fixed number of places by a digest, with a sign from the same digest, so that terms that share a
place cancel on average.  Weights are term counts times idf as counted when the encoder was fitted; a term that was not kept then
has the idf of a term in no text.  Vectors have unit length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from deskgraph import defaults as D
from deskgraph.operators import tfidf
from deskgraph.operators.vectors import Centroids, prototype_centroids

DIMENSIONS = 256
#: Terms whose place a task remembers.
HELD_TERMS = 100_000


def place(term: str, dimensions: int) -> tuple[int, float]:
    """Position and sign of a term: the first eight hexadecimal digits of its MD5, and the ninth."""
    digest = hashlib.md5(term.encode(), usedforsecurity=False).hexdigest()
    return int(digest[:8], 16) % dimensions, 1.0 if digest[8] < "8" else -1.0


@dataclass(frozen=True)
class TextEncoder:
    """A fitted encoder: idf of at most ``features`` terms, the idf of any other, and how texts become terms."""

    dimensions: int
    idf: dict[str, float]
    other: float
    stops: list[str]
    ngrams: int

    @staticmethod
    def fit(
        rows: DataFrame,
        text: str = "text",
        dimensions: int = DIMENSIONS,
        features: int = D.TFIDF_FEATURES,
        stops: Sequence[str] | None = None,
        ngrams: int = 1,
        counts: DataFrame | None = None,
    ) -> "TextEncoder":
        """Count terms over all ``rows``; the ``features`` most frequent ones, ties to the lower term, keep their own idf.

        ``counts`` are the :func:`tfidf.top_terms` of these rows, where a caller has them.
        """
        stops = tfidf.stop_words() if stops is None else list(stops)
        counts = tfidf.top_terms(rows, text, stops, ngrams, features, "encoder-terms") if counts is None else counts
        texts = counts.where(F.col("term").isNull()).agg(F.coalesce(F.sum("cases"), F.lit(0))).first()[0]
        kept = counts.where(F.col("term").isNotNull()).orderBy(F.desc("total"), "term").limit(features).toArrow()  # features rows
        idf = np.log((1.0 + texts) / (1.0 + kept["df"].to_numpy())) + 1.0
        return TextEncoder(dimensions, dict(zip(kept["term"].to_pylist(), idf.tolist(), strict=True)), float(np.log(1.0 + texts) + 1.0), stops, ngrams)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(list(self.idf.items()), "term string, idf double").coalesce(1).write.parquet(f"{path}/idf")
        about = [(self.dimensions, self.other, self.stops, self.ngrams)]
        spark.createDataFrame(about, "dimensions int, other double, stops array<string>, ngrams int").coalesce(1).write.parquet(f"{path}/about")

    @staticmethod
    def open(spark: SparkSession, path: str) -> "TextEncoder":
        about, idf = spark.read.parquet(f"{path}/about").first(), spark.read.parquet(f"{path}/idf").toArrow()
        known = dict(zip(idf["term"].to_pylist(), idf["idf"].to_pylist(), strict=True))
        return TextEncoder(about["dimensions"], known, about["other"], about["stops"], about["ngrams"])

    def vector(self, text: Column) -> Column:
        """Unit vectors of texts; null for a text without a term.  Rows stay where they are."""
        dimensions, idf, other = self.dimensions, self.idf, self.other

        def encode(column: pa.Array) -> pa.Array:
            places: dict[str, tuple[int, float]] = {}
            out = np.zeros((len(column), dimensions))
            begin = 0
            for part in tfidf.slices(column):
                row, term, names = tfidf.listed(part)
                if len(places) + len(names) > HELD_TERMS:
                    places.clear()
                own = names.to_pylist()
                for name in own:
                    if name not in places:
                        places[name] = place(name, dimensions)
                at = np.fromiter((places[n][0] for n in own), np.int64, len(own))
                signed = np.fromiter((places[n][1] for n in own), np.float64, len(own))
                weight = np.fromiter((idf.get(n, other) for n in own), np.float64, len(own))
                pairs, first, count = np.unique(row * max(1, len(own)) + term, return_index=True, return_counts=True)
                pairs, count = pairs[order := np.argsort(first)], count[order]  # summed in the order of the text
                row, term = pairs // max(1, len(own)), pairs % max(1, len(own))
                sums = np.bincount(row * dimensions + at[term], signed[term] * count * weight[term], len(part) * dimensions)
                out[begin : begin + len(part)] = sums.reshape(len(part), dimensions)
                begin += len(part)
            norms = np.sqrt((out * out).sum(axis=1))
            known = norms > 0
            out /= np.where(known, norms, 1.0)[:, None]
            offsets = pa.array(np.arange(len(column) + 1, dtype=np.int32) * dimensions)
            return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()), mask=pa.array(~known))

        encode.__annotations__ = {"column": pa.Array, "return": pa.Array}
        return arrow_udf(encode, "array<double>")(tfidf.terms(text, self.stops, self.ngrams))

    def apply(self, rows: DataFrame, text: str = "text", into: str = "embedding") -> DataFrame:
        """``rows`` with the vector of ``text``, also rows that the encoder was not fitted on."""
        return rows.withColumn(into, self.vector(F.col(text)))

    def centroids(self, prototypes: DataFrame, label: str = "label", text: str = "text", vector: str | None = None) -> Centroids:
        """The centroid of each label's prototype texts; those without a term count nowhere.  A ``vector`` that was made of the text is used as it is."""
        encoded = prototypes.select(F.col(label).alias("label"), (self.vector(F.col(text)) if vector is None else F.col(vector)).alias("embedding"))
        return Centroids.fit(prototype_centroids(encoded.where(F.col("embedding").isNotNull())))
