"""Similar past cases: exact top-k over vectors or text, evidence and ids per query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskgraph import defaults as D
from deskgraph.functions import text as T
from deskgraph.functions.numeric import fixed, round_dp
from deskgraph.operators.case_index import CaseIndex, topk_similar
from deskgraph.operators.skew import join_to_unique
from deskgraph.operators.text_index import TextIndex
from deskgraph.session import materialise


def topk_similar_cases(
    queries: DataFrame,
    corpus: DataFrame | CaseIndex,
    k: int = D.TOP_K,
    query_id: str = "query_id",
    vector: str = "embedding",
    text: str | None = None,
    min_similarity: float | None = None,
    width: int | None = None,
) -> DataFrame:
    """Ranked cases of every query: ``query_id, rank, case_id, similarity`` and the case's other columns.

    ``corpus`` is an index with its cases, or the cases, of which an index is built for this call.  A blank ``text`` finds nothing.  ``min_similarity`` is off unless given; ``width`` is the length of usable vectors.  Few cases are
    chosen by very many queries, so the case columns come in through the spread join; the ids
    found are written first, so that looking for hot cases does not repeat the search.
    """
    asked = queries if text is None else queries.where(~T.is_blank(F.col(text)))
    found = topk_similar(asked, corpus, k, query_id=query_id, vector=vector, width=width)
    if min_similarity is not None:
        found = found.where(F.col("similarity") >= F.lit(min_similarity))
    found = found.withColumn("similarity", round_dp(F.col("similarity"), 4))
    cases = corpus.cases() if isinstance(corpus, CaseIndex) else corpus.drop(vector)
    if cases.columns == ["case_id"]:
        return found
    return join_to_unique(materialise(found, "found"), cases, "case_id", ["query_id"]).select(
        "query_id", "rank", "case_id", "similarity", *[c for c in cases.columns if c != "case_id"]
    )


def per_query(found: DataFrame) -> DataFrame:
    """One row per query with at least one case: best similarity, ids in rank order, evidence text.

    The collected group is the top ``k`` of one query, so it is bounded by ``k``.  A case's texts travel once; their block is made where they arrive.
    """

    def with_block(c):
        block = F.format_string(D.EVIDENCE_FORMAT, c["case_id"], fixed(c["similarity"], 2), c["customer_text"], c["brand_resolution"])
        return F.struct(c["rank"].alias("rank"), c["case_id"].alias("case_id"), c["similarity"].alias("similarity"), block.alias("block"), c["brand_resolution"].alias("brand_resolution"))

    entry = F.struct("rank", "case_id", "similarity", "customer_text", "brand_resolution")
    cases = F.sort_array(F.transform(F.collect_list(entry), with_block))
    return found.groupBy("query_id").agg(cases.alias("_c")).select(
        "query_id",
        F.transform("_c", lambda c: c["case_id"]).alias("retrieved_case_ids"),
        F.col("_c")[0]["similarity"].alias("max_similarity"),
        F.array_join(F.transform("_c", lambda c: c["block"]), "\n\n").alias("evidence_text"),
        F.col("_c")[0]["brand_resolution"].alias("best_resolution"),
    )


def with_evidence(queries: DataFrame, found: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Queries with the columns of :func:`per_query`; no case gives an empty list, 0.0 and ``""``."""
    summary = per_query(found).withColumnRenamed("query_id", query_id)
    return (
        queries.join(summary, query_id, "left")
        .withColumn("retrieved_case_ids", F.coalesce("retrieved_case_ids", F.array().cast("array<bigint>")))
        .withColumn("max_similarity", F.coalesce("max_similarity", F.lit(0.0)))
        .withColumn("evidence_text", F.coalesce("evidence_text", F.lit("")))
    )


def topk_by_text(
    queries: DataFrame,
    corpus: DataFrame | TextIndex,
    k: int = 1,
    query_id: str = "query_id",
    text: str = "text",
    case_id: str = "case_id",
    case_text: str = "customer_text",
    features: int = D.TFIDF_FEATURES,
    stops: Sequence[str] | None = None,
    ngrams: int = 1,
) -> DataFrame:
    """Exact top ``k`` cases by TF-IDF cosine that share a term with the query: ``query_id, case_id, similarity, rank``.

    ``corpus`` is an index, or the cases, of which an index is built for this call from the further arguments.
    """
    index = corpus if isinstance(corpus, TextIndex) else TextIndex.build(corpus, None, case_id, case_text, features, stops, ngrams)
    return index.search(queries, k, query_id, text)


def verbatim_nearest_reply(
    queries: DataFrame,
    corpus: DataFrame,
    query_id: str = "query_id",
    text: str = "text",
    features: int = D.TFIDF_FEATURES,
    stops: Sequence[str] | None = None,
    ngrams: int = 1,
    index: TextIndex | None = None,
) -> DataFrame:
    """Each query with the reply of its most similar case, word for word.

    A query that shares no term with any case gets the reply of the lowest case id.  An ``index`` of the cases' texts is
    used as it is; without one it is built for this call.
    """
    nearest = topk_by_text(queries, index or corpus, 1, query_id, text, features=features, stops=stops, ngrams=ngrams).select(
        F.col("query_id").alias(query_id), F.col("case_id").alias("_found"), F.col("similarity").alias("_similarity")
    )
    lowest = corpus.agg(F.min("case_id")).scalar()
    placed = queries.select(query_id).join(nearest, query_id, "left").select(
        query_id,
        F.coalesce("_found", lowest).alias("case_id"),
        round_dp(F.coalesce("_similarity", F.lit(0.0)), 4).alias("similarity"),
    )
    replies = corpus.select("case_id", F.col("brand_resolution").alias("generated_reply"))
    answered = join_to_unique(materialise(placed, "nearest"), replies, "case_id", [query_id])
    return queries.join(answered, query_id)
