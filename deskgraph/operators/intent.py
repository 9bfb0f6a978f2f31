"""Intent labels from centroid similarity, keyword rules and clusters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskgraph import defaults as D
from deskgraph.functions import rules
from deskgraph.functions import text as T
from deskgraph.functions.numeric import count_if, percent, round_dp
from deskgraph.operators.sampling import seeded_sample, seeded_top
from deskgraph.operators.skew import top_n_per_group
from deskgraph.operators.vectors import Centroids, centroid_products


def _labels(model: Centroids) -> Column:
    return F.array(*[F.lit(label) for label in model.labels])


def cosine_scores(rows: DataFrame, model: Centroids, vector: str = "embedding") -> DataFrame:
    """One row per input row and label with the similarity to that label's centroid."""
    scored = centroid_products(rows, model, vector)
    pairs = F.arrays_zip(_labels(model).alias("label"), F.col("sims").alias("similarity"))
    return scored.select(*rows.columns, F.inline(pairs).alias("label", "similarity"))


def softmax(sims: Column, scale: float = D.SOFTMAX_SCALE) -> Column:
    """``exp(scale * sim)`` over its sum, for an array of similarities."""
    powers = F.transform(sims, lambda s: F.exp(s * F.lit(scale)))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda p: p / total)


def softmax_calibration(rows: DataFrame, model: Centroids, vector: str = "embedding", scale: float = D.SOFTMAX_SCALE) -> DataFrame:
    """Add ``all_scores``, the label to probability map rounded to 4 places."""
    scored = centroid_products(rows, model, vector).withColumn("_probs", softmax(F.col("sims"), scale))
    rounded = F.transform("_probs", lambda p: round_dp(p, 4))
    return scored.withColumn("all_scores", F.map_from_arrays(_labels(model), rounded)).drop("sims", "_probs")


def nearest_centroid_classify(
    rows: DataFrame,
    model: Centroids,
    vector: str = "embedding",
    text: str | None = None,
    threshold: float = D.INTENT_THRESHOLD,
    scale: float = D.SOFTMAX_SCALE,
    other: str = D.OTHER_INTENT,
) -> DataFrame:
    """Add ``intent, intent_confidence, is_fallback, all_scores, nearest_intent, max_similarity``.

    Below ``threshold`` the label is ``other`` with confidence ``1 - best probability``.
    A blank text or missing vector gives ``other``, 0.0, fallback and a map of zeros.
    """
    scored = centroid_products(rows, model, vector)
    unusable = F.col("sims").isNull()
    if text is not None:
        unusable = unusable | T.is_blank(F.col(text))
    zero = F.map_from_arrays(_labels(model), F.array(*[F.lit(0.0) for _ in model.labels]))
    probs = F.col("_probs")
    best = F.array_position("sims", F.col("_max")).cast("int")
    prepared = (
        scored.withColumn("_blank", unusable)
        .withColumn("_probs", softmax(F.col("sims"), scale))
        .withColumn("_max", F.array_max("sims"))
        .withColumn("_best", F.when(~F.col("_blank"), best))
        .withColumn("_prob", F.try_element_at(probs, F.col("_best")))
        .withColumn("nearest_intent", F.try_element_at(_labels(model), F.col("_best")))
    )
    low = F.col("_max") < F.lit(threshold)
    rounded = F.transform("_probs", lambda p: round_dp(p, 4))
    return prepared.select(
        *rows.columns,
        F.when(F.col("_blank") | low, F.lit(other)).otherwise(F.col("nearest_intent").cast("string")).alias("intent"),
        F.when(F.col("_blank"), F.lit(0.0))
        .when(low, round_dp(F.lit(1.0) - F.col("_prob"), 4))
        .otherwise(round_dp(F.col("_prob"), 4))
        .alias("intent_confidence"),
        (F.col("_blank") | low).alias("is_fallback"),
        F.when(F.col("_blank"), zero)
        .otherwise(F.map_from_arrays(_labels(model), rounded))
        .alias("all_scores"),
        "nearest_intent",
        F.when(F.col("_blank"), F.lit(0.0)).otherwise(F.col("_max")).alias("max_similarity"),
    )


def centroid_batch_label(
    rows: DataFrame,
    model: Centroids,
    vector: str = "embedding",
    threshold: float = D.INTENT_THRESHOLD,
    other: str = D.OTHER_INTENT,
) -> DataFrame:
    """Add ``mapped_intent, nearest_intent, similarity_score`` without any probabilities."""
    scored = centroid_products(rows, model, vector).withColumn("_max", F.array_max("sims"))
    nearest = F.try_element_at(_labels(model), F.array_position("sims", F.col("_max")).cast("int")).cast("string")
    return scored.select(
        *rows.columns,
        F.when(F.col("_max") >= F.lit(threshold), nearest).otherwise(F.lit(other)).alias("mapped_intent"),
        nearest.alias("nearest_intent"),
        F.col("_max").alias("similarity_score"),
    )


def coverage_summary(labelled: DataFrame, label: str, other: str = D.OTHER_INTENT) -> DataFrame:
    """Rows, rows labelled ``other``, their percentage and the coverage rate."""
    return labelled.agg(F.count(F.lit(1)).alias("sample_size"), count_if(F.col(label) == other).alias("other_count")).select(
        "sample_size",
        "other_count",
        percent(F.col("other_count"), F.col("sample_size"), 1).alias("other_pct"),
        round_dp(F.lit(100.0) - percent(F.col("other_count"), F.col("sample_size"), 1), 1).alias("coverage_rate"),
    )


def taxonomy_coverage(
    rows: DataFrame,
    text: str,
    row_id: str,
    sample_size: int = 100,
    seed: int = 123,
    patterns: Mapping[str, str] = D.INTENT_PATTERNS,
    first: int = 15,
) -> dict[str, DataFrame]:
    """Keyword labels of a seeded sample: the summary, the counts per label and the first rows."""
    sample = seeded_sample(rows, sample_size, seed, row_id)
    labelled = sample.withColumn("predicted_intent", rules.keyword_first_match(F.col(text), patterns))
    return {
        "summary": coverage_summary(labelled, "predicted_intent"),
        "counts": labelled.groupBy("predicted_intent").agg(F.count(F.lit(1)).alias("n")),
        "examples": seeded_top(labelled, first, seed, row_id).select(row_id, text, "predicted_intent"),
    }


def semantic_coverage(
    rows: DataFrame,
    model: Centroids,
    row_id: str,
    sample_size: int = 100,
    seed: int = 123,
    threshold: float = D.INTENT_THRESHOLD,
    vector: str = "embedding",
    first: int = 25,
) -> dict[str, DataFrame]:
    """Like :func:`taxonomy_coverage` with centroid labels; keeps the nearest label of rejected rows."""
    sample = seeded_sample(rows, sample_size, seed, row_id)
    labelled = centroid_batch_label(sample, model, vector, threshold).withColumnRenamed("mapped_intent", "assigned_intent")
    return {
        "summary": coverage_summary(labelled, "assigned_intent"),
        "counts": labelled.groupBy("assigned_intent").agg(F.count(F.lit(1)).alias("n")),
        "examples": seeded_top(labelled, first, seed, row_id).select(
            row_id, "assigned_intent", "nearest_intent", round_dp(F.col("similarity_score"), 4).alias("similarity_score")
        ),
    }


def cluster_sizes(assigned: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Size and percentage of each cluster."""
    counts = assigned.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    total = assigned.agg(F.count(F.lit(1))).scalar()
    return counts.select(cluster, "size", percent(F.col("size"), total, 1).alias("percentage"))


def cluster_representatives(
    rows: DataFrame,
    model: Centroids,
    row_id: str,
    cluster: str = "cluster",
    vector: str = "embedding",
    n: int = D.CLUSTER_EXAMPLES,
) -> DataFrame:
    """The ``n`` rows nearest to their own cluster's centroid: ``cluster, rank, row_id, distance``."""
    measured = centroid_products(rows.select(row_id, cluster, vector), model, vector, distance=True)
    own = F.try_element_at("sims", F.array_position(_labels(model), F.col(cluster)).cast("int"))
    near = measured.select(cluster, row_id, F.round(own, 9).alias("distance"))
    return top_n_per_group(near, [cluster], [F.col("distance"), F.col(row_id)], n, rank="rank")


