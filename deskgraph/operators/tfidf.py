"""Term weights as tables, sparse vectors for block search, and ML feature pipelines."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StopWordsRemover,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskgraph import defaults as D
from deskgraph.operators.skew import top_n_per_group
from deskgraph.session import materialise

TOKEN = r"[\p{L}\p{N}_]{2,}"
#: A task counts the terms of about so many characters.
TASK_CHARACTERS = 4_000_000
#: Terms that Python holds at once: as Arrow strings, and as strings of its own.
COUNTED_TERMS = 2_000_000
LISTED_TERMS = 200_000


def stop_words(language: str = "english") -> list[str]:
    """Spark's own stop-word list."""
    return StopWordsRemover.loadDefaultStopWords(language)


def terms(text: Column, stops: Sequence[str], ngrams: int = 1) -> Column:
    """Lower-cased words of two or more characters without stop words, then their pairs for ``ngrams=2``."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    kept = F.filter(found, lambda w: ~w.isin(*stops)) if stops else found
    if ngrams == 1:
        return kept
    pairs = F.zip_with(kept, F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(kept, F.filter(pairs, lambda p: p.isNotNull()))


def term_counts(
    rows: DataFrame, row_id: str, text: str, stops: Sequence[str] | None = None, ngrams: int = 1
) -> DataFrame:
    """``row_id, term, tf``.

    Rows are placed by id once, so counting per (row, term) and every later step per row
    happen where the row is; only the text itself is shuffled.  There are as many tasks as it takes for each to count
    about ``TASK_CHARACTERS``, so what a task holds does not grow with the table.
    """
    stops = stop_words() if stops is None else stops
    placed = rows.select(row_id, text).repartition(tasks(rows, text), row_id)
    exploded = placed.select(row_id, F.explode(terms(F.col(text), stops, ngrams)).alias("term"))
    return exploded.groupBy(row_id, "term").agg(F.count(F.lit(1)).alias("tf"))


def tasks(rows: DataFrame, text: str) -> int:
    """How many tasks get about ``TASK_CHARACTERS`` of ``text`` each."""
    characters = rows.agg(F.sum(F.length(text))).first()[0] or 0
    return 1 + characters // TASK_CHARACTERS


def count_terms(rows: DataFrame, text: str, stops: Sequence[str], ngrams: int = 1) -> DataFrame:
    """term, total (occurrences), df (rows) of all terms of ``text``; under a null term ``cases`` is the number of rows.

    Tasks count before the shuffle, so a term that is in every row is one row for each slice of ``COUNTED_TERMS`` terms.
    """
    words = rows.select(terms(F.col(text), stops).alias("words"))  # pairs are made of their numbers, as few of them differ
    count = lambda batches: _count(batches, ngrams)
    parts = words.mapInArrow(count, "term string, total long, df long, cases long").repartition(tasks(rows, text), "term")
    return parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("total", "df", "cases")])


def top_terms(rows: DataFrame, text: str, stops: Sequence[str], ngrams: int, features: int, purpose: str) -> DataFrame:
    """Of :func:`count_terms` the row of the null term and the ``features`` most frequent terms, ties to the lower term, stored."""
    counts = count_terms(rows, text, stops, ngrams)
    return materialise(counts.orderBy(F.col("term").isNotNull(), F.desc("total"), "term").limit(features + 1), purpose)


def _count(batches: Iterator[pa.RecordBatch], ngrams: int = 1) -> Iterator[pa.RecordBatch]:
    """Per slice of a batch of words: each term's occurrences and cases, and under a null term the number of cases."""
    for batch in batches:
        for part in slices(batch.column(0), COUNTED_TERMS // ngrams):
            row, word, names = listed(part)
            counted = [(names, *_totals(row, word, len(names)))]
            if ngrams > 1:
                near = np.flatnonzero(row[1:] == row[:-1])  # a word and the next one of its row
                pairs, pair = np.unique(word[near] * max(1, len(names)) + word[near + 1], return_inverse=True)
                two = [names.take(pa.array(p)) for p in (pairs // max(1, len(names)), pairs % max(1, len(names)))]
                counted.append((pc.binary_join_element_wise(*two, " "), *_totals(row[near], pair, len(pairs))))
            counted.append((pa.nulls(1, pa.string()), np.zeros(1, np.int64), np.zeros(1, np.int64)))
            term, total, df = zip(*counted, strict=True)
            cases = np.zeros(sum(map(len, term)), np.int64)
            cases[-1] = len(part)
            numbers = [pa.array(n.astype(np.int64)) for n in (np.concatenate(total), np.concatenate(df), cases)]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(term), *numbers], names=["term", "total", "df", "cases"])


def _totals(row: np.ndarray, term: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of each term, and its rows; a term counts once for a row."""
    rows = np.unique(row * max(1, terms) + term) % max(1, terms)
    return np.bincount(term, minlength=terms), np.bincount(rows, minlength=terms)


def slices(terms: pa.ListArray, most: int = LISTED_TERMS) -> Iterator[pa.ListArray]:
    """A column of terms in pieces of about ``most`` terms, a row at least."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(terms), 0).to_numpy())
    begin, known = 0, 0
    while begin < len(terms):
        end = max(begin + 1, int(np.searchsorted(ends, known + most, "right")))
        yield terms.slice(begin, end - begin)
        begin, known = end, int(ends[end - 1])


def listed(part: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row number and term number of every term in a column of terms, and the names of the terms, in the order they first come."""
    sizes = pc.fill_null(pc.list_value_length(part), 0).to_numpy()
    coded = part.flatten().dictionary_encode()
    return np.repeat(np.arange(len(part)), sizes), coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.string())


def vocabulary(counts: DataFrame, documents: Column, features: int = D.TFIDF_FEATURES) -> DataFrame:
    """The ``features`` most frequent terms with smoothed idf: ``term, df, idf``, at most ``features`` rows.

    ``documents`` is the number of documents, as a scalar.
    """
    ranked = counts.groupBy("term").agg(F.sum("tf").alias("_total"), F.count(F.lit(1)).alias("df"))
    top = ranked.orderBy(F.desc("_total"), "term").limit(features)
    return top.select("term", "df", smoothed_idf(documents).alias("idf"))


def smoothed_idf(documents: Column) -> Column:
    return F.log((F.lit(1.0) + documents) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)


def weigh(counts: DataFrame, vocab: DataFrame, row_id: str, keep: Sequence[str] = ()) -> DataFrame:
    """L2-normalised weights ``row_id, term, weight`` of the terms in ``vocab``.

    ``vocab`` is bounded by its feature limit, so it is broadcast, and so is the number of
    terms a row can have in the window.
    """
    raw = counts.join(F.broadcast(vocab.select("term", "idf", *keep)), "term").withColumn(
        "_w", F.col("tf") * F.col("idf")
    )
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(row_id)))
    return raw.select(row_id, "term", (F.col("_w") / norm).alias("weight"), *keep)


def tfidf_weights(
    rows: DataFrame,
    row_id: str,
    text: str,
    features: int = D.TFIDF_FEATURES,
    stops: Sequence[str] | None = None,
    ngrams: int = 1,
) -> DataFrame:
    """Weights of every row against the vocabulary of the same rows."""
    counts = term_counts(rows, row_id, text, stops, ngrams)
    return weigh(counts, vocabulary(counts, rows.agg(F.count(F.lit(1))).scalar(), features), row_id)


def cluster_keywords(
    rows: DataFrame,
    row_id: str,
    text: str,
    cluster: str = "cluster",
    features: int = D.CLUSTER_FEATURES,
    n: int = D.CLUSTER_KEYWORDS,
    stops: Sequence[str] | None = None,
) -> DataFrame:
    """The ``n`` terms with the highest mean weight per cluster: ``cluster, rank, term, mean_weight``."""
    weights = tfidf_weights(rows, row_id, text, features, stops)
    members = rows.select(row_id, cluster)
    sizes = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"))
    summed = weights.join(members, row_id).groupBy(cluster, "term").agg(F.sum("weight").alias("_sum"))
    means = summed.join(sizes, cluster).select(
        cluster, "term", F.round(F.col("_sum") / F.col("_n"), 9).alias("mean_weight")
    )
    return top_n_per_group(means, [cluster], [F.desc("mean_weight"), F.col("term")], n, rank="rank")


def fit_tfidf(
    rows: DataFrame, text: str, features: int = D.TFIDF_FEATURES, output: str = "features", stops: Sequence[str] | None = None
) -> PipelineModel:
    """Fitted ML stages from text to an L2-normalised vector of one- and two-word terms.

    Terms and weights are those of :func:`vocabulary`, so ties at its end fall alike in both forms.  The
    vocabulary has at most ``features`` terms; every stage maps rows where they are.
    """
    stops = stop_words() if stops is None else list(stops)
    counts = top_terms(rows, text, stops, 2, features, "feature-terms")
    documents = counts.where(F.col("term").isNull()).agg(F.coalesce(F.sum("cases"), F.lit(0))).scalar()
    # bounded by ``features``
    top = counts.where(F.col("term").isNotNull()).orderBy(F.desc("total"), "term").limit(features)
    known = top.select("term", smoothed_idf(documents).alias("idf")).orderBy("term").collect()
    if not known:
        raise ValueError("no text has a term to fit on")
    counter = CountVectorizerModel.from_vocabulary([r["term"] for r in known], inputCol="_terms", outputCol="_counts")
    return PipelineModel(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_words", pattern=TOKEN, gaps=False),
            StopWordsRemover(inputCol="_words", outputCol="_kept", stopWords=stops, caseSensitive=True),
            NGram(n=2, inputCol="_kept", outputCol="_pairs"),
            SQLTransformer(statement="SELECT *, concat(_kept, _pairs) AS _terms FROM __THIS__"),
            counter,
            ElementwiseProduct(scalingVec=Vectors.dense([r["idf"] for r in known]), inputCol="_counts", outputCol="_weighted"),
            Normalizer(inputCol="_weighted", outputCol=output),
            SQLTransformer(statement="SELECT * EXCEPT (_words, _kept, _pairs, _terms, _counts, _weighted) FROM __THIS__"),
        ]
    )


def tfidf_features(
    rows: DataFrame, text: str, features: int = D.TFIDF_FEATURES, stops: Sequence[str] | None = None
) -> DataFrame:
    """Fit and apply :func:`fit_tfidf`."""
    return fit_tfidf(rows, text, features, stops=stops).transform(rows)


Encoder = Callable[[pd.Series], "pd.Series"]


def text_vectorize(
    rows: DataFrame, text: str, dimensions: int = 256, encoder: Encoder | None = None, batch: int = 128
) -> DataFrame:
    """Add a unit-length ``embedding``, null for a text without a term.

    Without an ``encoder`` one is fitted on these rows (:class:`deskgraph.operators.encoder.TextEncoder`, which can also be kept
    and applied to others).  An ``encoder`` takes a series of texts and returns a series of vectors; it is called on
    batches of ``batch`` rows inside the tasks.
    """
    if encoder is None:
        from deskgraph.operators.encoder import TextEncoder

        return TextEncoder.fit(rows, text, dimensions).apply(rows, text)

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                yield part.assign(embedding=encoder(part[text].fillna("")).to_numpy())

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(encode, f"{schema}, embedding array<double>")
