"""The queries of this subpackage and their SQL, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskgraph.llm import alignment, extraction, graph, language, lexical, licenses, mixing, neardup, packing, quality, secrets, topk, warc
from deskgraph.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


TOPK_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.w, d.w)::BIGINT AS score
  FROM good q JOIN good d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op1_topk_search", TOPK_SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op2_license_scan")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents").select("doc_id", "text"))


@query("op3_near_duplicates")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))


@query("op4_html_extraction")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.main_text(table(spark, sf, "pages").select("page_id", "url", "html"))


@query("op5_secret_scan")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.fitted(spark, docs))
    return found.select(
        "doc_id",
        *[secrets.count_of("base_places", k).alias(f"n_{k}") for k in secrets.KINDS[:3]],
        F.sha2(secrets.spelled("base_places"), 256).alias("base_sha256"),
        secrets.spelled("secret_places").alias("spans"),
        secrets.count_of("markov_places", "markov").alias("n_markov"),
    )


@query("op6_quality")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    field = quality.train(docs, table(spark, sf, "labels"))
    return quality.score(docs, field, into="score").select(
        "doc_id",
        quality.held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= quality.PASS_SCORE, 1).otherwise(0).alias("predicted"),
    )


@query("op7_nearest_neighbours")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return graph.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


WARC_SQL = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + list_sum(list_transform(range(0, 5), lambda b:
           (((strpos('0123456789abcdef', substr(hex, ((5 * i + b) // 4 + 1)::INT, 1)) - 1) >> (3 - (5 * i + b) % 4)::INT) & 1) << (4 - b)::INT))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM hashed
"""


@query("op8_warc_archive", WARC_SQL)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(table(spark, sf, "pages").select("page_id", "url", "html")).drop("url")


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
totals AS (SELECT k, min(source) AS source, sum(size)::BIGINT AS source_size FROM sized GROUP BY k),
rated AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w,
         2.0 * source_size AS cap FROM totals),
levels AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
         , row_number() OVER (ORDER BY cap / w, source IS NULL, source) AS place
  FROM rated WINDOW before AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT k, source_size,
         least(cap, coalesce((SELECT arg_min(level, place) FROM levels WHERE level <= cap / w) * w, cap))::DOUBLE AS target
  FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target, round(target)::BIGINT AS goal,
         coalesce(sum(size) OVER (PARTITION BY k ORDER BY md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior
  FROM sized JOIN goals USING (k))
SELECT doc_id, size, source_size, round(target, 3) AS target,
       CASE WHEN source_size > 0
            THEN (goal // source_size) * size + greatest(0, least(size, goal % source_size - prior)) ELSE 0 END::BIGINT AS taken
FROM placed
"""


@query("op9_mix_sources", MIX_SQL)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op10_pack_sequences")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents").select("doc_id", "text"), tokenizer_path())


@query("op11_token_alignment")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = alignment.scored_links(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return found.withColumnRenamed("groups", "groups_sha256")


LEXICAL_SQL = """
WITH doc_terms AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts
  FROM documents),
item_terms AS MATERIALIZED (
  SELECT q, item_id, t, count(*)::BIGINT AS times
  FROM (SELECT q, item_id, unnest(ts) AS t
        FROM (SELECT row_number() OVER () AS q, item_id,
                     regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts
              FROM benchmark))
  GROUP BY q, item_id, t),
corpus AS MATERIALIZED (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS l FROM doc_terms WHERE len(ts) > 0),
counted AS MATERIALIZED (
  SELECT r, doc_id, t, count(*)::BIGINT AS tf, (100 - 75 + (75 * any_value(n) * any_value(n_docs)) // any_value(l))::BIGINT AS m
  FROM (SELECT r, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS t FROM doc_terms), corpus
  WHERE t IN (SELECT t FROM item_terms)
  GROUP BY r, doc_id, t),
weighted AS (
  SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counted, corpus GROUP BY t),
scored AS (
  SELECT q, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM item_terms JOIN weighted USING (t) JOIN counted USING (t)
  GROUP BY q, item_id, r, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op12_lexical_search", LEXICAL_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op13_language_id")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = language.train(docs.select("doc_id", "text", "lang"))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")
