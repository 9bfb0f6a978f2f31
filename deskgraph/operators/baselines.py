"""Two comparison systems with the output columns of the main one."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskgraph import defaults as D
from deskgraph.functions.numeric import round_dp
from deskgraph.functions.rules import keyword_escalation
from deskgraph.operators.replies import canned_reply
from deskgraph.operators.retrieval import verbatim_nearest_reply
from deskgraph.operators.text_index import TextIndex
from deskgraph.operators.tfidf import fit_tfidf
from deskgraph.session import materialise

OUTPUT = (
    "system_name",
    "example_id",
    "input_text",
    "predicted_intent",
    "intent_confidence",
    "generated_reply",
    "routing_decision",
    "routing_reason",
    "grounding_score",
    "grounding_pass",
    "latency_ms",
)


def trivial_baseline(
    rows: DataFrame, example_id: str = "example_id", text: str = "customer_text", majority_intent: str = D.INTENTS[0]
) -> DataFrame:
    """One constant intent, its canned reply, always automatic."""
    intent = F.lit(majority_intent)
    return rows.select(
        F.lit("trivial_baseline").alias("system_name"),
        F.col(example_id).alias("example_id"),
        F.col(text).alias("input_text"),
        intent.alias("predicted_intent"),
        F.lit(0.5).alias("intent_confidence"),
        canned_reply(intent).alias("generated_reply"),
        F.lit("auto_handle").alias("routing_decision"),
        F.lit(D.TRIVIAL_REASON).alias("routing_reason"),
        F.lit(0.5).alias("grounding_score"),
        F.lit(True).alias("grounding_pass"),
        F.lit(0.0).alias("latency_ms"),
    )


def logistic_intent(
    train: DataFrame,
    text: str = "customer_text",
    label: str = "pseudo_intent",
    features: int = D.TFIDF_FEATURES,
    max_iter: int = 500,
    c: float = 1.0,
    tolerance: float = 1e-4,
) -> PipelineModel:
    """Fit TF-IDF and multinomial logistic regression.

    ``c`` is the inverse penalty on the summed loss; Spark averages the loss, hence
    ``regParam = 1 / (c * rows)``.
    """
    indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(train)
    regression = LogisticRegression(
        featuresCol="_tfidf",
        labelCol="_label",
        predictionCol="_prediction",
        probabilityCol="_probability",
        rawPredictionCol="_raw",
        family="multinomial",
        maxIter=max_iter,
        tol=tolerance,
        regParam=1.0 / (c * max(1, train.count())),
        elasticNetParam=0.0,
        standardization=False,
    )
    back = IndexToString(inputCol="_prediction", outputCol="predicted_intent", labels=indexer.labels)
    vectors = fit_tfidf(train, text, features, output="_tfidf")
    # the fit reads its rows more than once, but texts become vectors once
    rows = materialise(vectors.transform(train.select(text, label)).select(label, "_tfidf"), "training-vectors")
    fitted = regression.fit(indexer.transform(rows))
    return PipelineModel(stages=[vectors, fitted, back])


def classify_logistic(model: PipelineModel, rows: DataFrame, text: str = "customer_text") -> DataFrame:
    """Add ``predicted_intent, intent_confidence``; the text is lower-cased, not cleaned."""
    kept = rows.withColumn("_given", F.col(text)).withColumn(text, F.lower(text))
    scored = model.transform(kept).withColumn(text, F.col("_given"))
    return scored.select(
        *rows.columns,
        "predicted_intent",
        round_dp(F.array_max(vector_to_array("_probability")), 4).alias("intent_confidence"),
    )


def simple_ml_baseline(
    model: PipelineModel,
    rows: DataFrame,
    corpus: DataFrame,
    example_id: str = "example_id",
    text: str = "customer_text",
    features: int = D.TFIDF_FEATURES,
    index: TextIndex | None = None,
) -> DataFrame:
    """Logistic intent, reply of the nearest case, keyword routing.  An ``index`` of the cases' texts is used as it is."""
    classified = classify_logistic(model, rows.select(example_id, text), text)
    answered = verbatim_nearest_reply(classified, corpus, example_id, text, features=features, ngrams=2, index=index)
    return keyword_escalation(answered, text).select(
        F.lit("simple_ml_baseline").alias("system_name"),
        F.col(example_id).alias("example_id"),
        F.col(text).alias("input_text"),
        "predicted_intent",
        "intent_confidence",
        "generated_reply",
        "routing_decision",
        "routing_reason",
        F.lit(1.0).alias("grounding_score"),
        F.lit(True).alias("grounding_pass"),
        F.lit(0.0).alias("latency_ms"),
    )
