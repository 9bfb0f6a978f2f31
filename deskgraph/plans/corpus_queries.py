"""Profiling, brand scoring, working set and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskgraph import defaults as D
from deskgraph.functions import text as T
from deskgraph.operators import brands, corpus, profile, quality, sampling
from deskgraph.plans import tables as t
from deskgraph.plans.oracle import clean, pct, q, seeded, sql
from deskgraph.plans.registry import query

# ----------------------------------------------------------------- profiling

_MESSAGE_COLUMNS = {
    "tweet_id": "bigint",
    "author_id": "string",
    "inbound": "boolean",
    "created_at": "string",
    "text": "string",
    "response_tweet_id": "string",
    "in_response_to_tweet_id": "bigint",
}


@query(
    "profile_shape",
    sql(
        "SELECT c.column_name, c.data_type, (SELECT count(*) FROM msgs) AS row_count, CAST(7 AS BIGINT) AS column_count FROM (VALUES "
        + ", ".join(f"({q(n)}, {q(k)})" for n, k in _MESSAGE_COLUMNS.items())
        + ") c(column_name, data_type)"
    ),
)
def _(spark, sf):
    return profile.profile_shape(t.messages(spark, sf))


@query(
    "profile_nulls",
    sql(
        " UNION ALL ".join(
            f"SELECT {q(n)} AS column_name, count(*) - count({n}) AS null_count, {pct(f'(count(*) - count({n}))', 'count(*)', 2)} AS null_pct FROM msgs"
            for n in _MESSAGE_COLUMNS
        )
    ),
)
def _(spark, sf):
    return profile.profile_nulls(t.messages(spark, sf))


@query(
    "value_counts",
    sql(
        f"SELECT CAST(inbound AS VARCHAR) AS value, count(*) AS n, {pct('count(*)', '(SELECT count(*) FROM msgs)', 1)} AS pct FROM msgs GROUP BY inbound"
    ),
)
def _(spark, sf):
    return profile.value_counts(t.messages(spark, sf), "inbound")


@query(
    "top_authors",
    sql(
        "SELECT author_id, count(*) AS replies, (SELECT count(DISTINCT author_id) FROM msgs WHERE NOT inbound) AS unique_authors "
        "FROM msgs WHERE NOT inbound GROUP BY author_id ORDER BY replies DESC, author_id LIMIT 20"
    ),
)
def _(spark, sf):
    return profile.top_authors(t.messages(spark, sf))


@query(
    "duplicate_text_rate",
    f"SELECT count(text) AS texts, count(DISTINCT text) AS distinct_texts, count(text) - count(DISTINCT text) AS duplicates, "
    f"{pct('(count(text) - count(DISTINCT text))', 'count(text)', 2)} AS duplicate_pct FROM documents",
)
def _(spark, sf):
    return profile.duplicate_text_rate(t.table(spark, sf, "documents"))


@query(
    "thread_field_coverage",
    sql(
        f"SELECT count(in_response_to_tweet_id) AS has_parent, {pct('count(in_response_to_tweet_id)', 'count(*)', 2)} AS has_parent_pct, "
        f"count(response_tweet_id) AS has_response, {pct('count(response_tweet_id)', 'count(*)', 2)} AS has_response_pct FROM msgs"
    ),
)
def _(spark, sf):
    return profile.thread_field_coverage(t.messages(spark, sf))


@query(
    "non_ascii_rate",
    "SELECT count(text) AS texts, count(*) FILTER (regexp_matches(text, '[^\\x00-\\x7F]')) AS non_ascii, "
    + pct("count(*) FILTER (regexp_matches(text, '[^\\x00-\\x7F]'))", "count(text)", 2)
    + " AS non_ascii_pct FROM documents",
)
def _(spark, sf):
    return profile.non_ascii_rate(t.table(spark, sf, "documents"))


@query(
    "sample_exchanges",
    sql(
        f"""SELECT r.author_id AS brand, coalesce(p.author_id, 'Customer') AS customer_author, r.in_response_to_tweet_id AS customer_tweet_id,
               coalesce(p.text, {q(profile.MISSING_PARENT_TEXT)}) AS customer_text, r.tweet_id AS brand_reply_id, r.text AS brand_reply_text
        FROM (SELECT * FROM msgs WHERE NOT inbound AND in_response_to_tweet_id IS NOT NULL
              ORDER BY {seeded(42, 'tweet_id')}, tweet_id LIMIT 10) r
        LEFT JOIN msgs p ON p.tweet_id = r.in_response_to_tweet_id"""
    ),
)
def _(spark, sf):
    return profile.sample_exchanges(t.messages(spark, sf))


# ------------------------------------------------------------- brand scoring

_CANDIDATES = (
    "(SELECT author_id AS brand, count(*) AS outbound_replies FROM msgs WHERE NOT inbound GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)"
)
_VOLUME = f"""SELECT c.brand, c.outbound_replies,
        (SELECT count(*) FROM msgs r JOIN msgs p ON p.tweet_id = r.in_response_to_tweet_id WHERE r.author_id = c.brand AND p.inbound) AS usable_inbound_volume
        FROM {_CANDIDATES} c"""
_SCORE_VIEWS = {
    "volume": _VOLUME,
    "ctexts": f"""SELECT brand, n, text FROM (
        SELECT r.author_id AS brand, row_number() OVER (PARTITION BY r.author_id ORDER BY r.tweet_id) AS n, p.text
        FROM msgs r JOIN msgs p ON p.tweet_id = r.in_response_to_tweet_id
        WHERE p.inbound AND r.author_id IN (SELECT brand FROM volume))""",
    "cwords": """SELECT brand, word, count(*) AS n FROM (
        SELECT brand, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS word FROM ctexts)
        WHERE regexp_full_match(word, '[a-z]{3,}') GROUP BY brand, word""",
    "centropy": """SELECT brand, round_even((log2(total) - weighted / total) / CASE WHEN k > 1 THEN log2(k) ELSE 1.0::DOUBLE END, 4) AS lexical_entropy
        FROM (SELECT brand, CAST(sum(n) AS DOUBLE) AS total, sum(n * log2(n)) AS weighted, CAST(count(*) AS DOUBLE) AS k FROM cwords GROUP BY brand)""",
    "cascii": f"""SELECT brand, {pct("count(*) FILTER (regexp_full_match(text, '[\\x00-\\x7F]+'))", "count(*)", 1)} AS ascii_pct FROM ctexts GROUP BY brand""",
    "csubst": f"""SELECT brand, round_even(avg(length(text)), 1) AS avg_reply_length,
        {pct("count(*) FILTER (length(text) > 60 AND NOT regexp_matches(lower(text), '^@[\\p{L}\\p{N}_]+[\\t-\\r ]+(sorry|hi|hello),?[\\t-\\r ]*please[\\t-\\r ]+dm[\\t-\\r ]+us([^\\p{L}\\p{N}_]|$)'))", "count(*)", 1)} AS substantive_pct
        FROM (SELECT author_id AS brand, text FROM msgs WHERE author_id IN (SELECT brand FROM volume)) GROUP BY brand""",
    "scored": f"""SELECT v.brand, v.outbound_replies, v.usable_inbound_volume, {pct('v.usable_inbound_volume', 'v.outbound_replies', 1)} AS thread_completeness_pct,
        coalesce(lexical_entropy, 0) AS lexical_entropy, coalesce(ascii_pct, 0) AS ascii_pct,
        coalesce(avg_reply_length, 0) AS avg_reply_length, coalesce(substantive_pct, 0) AS substantive_pct
        FROM volume v LEFT JOIN centropy USING (brand) LEFT JOIN cascii USING (brand) LEFT JOIN csubst USING (brand)""",
    "composed": """SELECT *, round_even(0.2::DOUBLE * least(1.0::DOUBLE, usable_inbound_volume / 50000.0::DOUBLE) + 0.25::DOUBLE * least(1.0::DOUBLE, thread_completeness_pct / 100.0::DOUBLE)
        + 0.2::DOUBLE * lexical_entropy + 0.15::DOUBLE * least(1.0::DOUBLE, ascii_pct / 100.0::DOUBLE) + 0.2::DOUBLE * least(1.0::DOUBLE, substantive_pct / 100.0::DOUBLE), 4) AS composite_score FROM scored""",
}


def _scored_sql(body: str) -> str:
    return sql(body, **_SCORE_VIEWS)


@query(
    "brand_candidates",
    sql(f"SELECT brand, outbound_replies FROM {_CANDIDATES}"),
)
def _(spark, sf):
    return brands.brand_candidates(t.messages(spark, sf))


@query("brand_usable_volume", _scored_sql("SELECT * FROM volume"))
def _(spark, sf):
    msgs = t.messages(spark, sf)
    return brands.brand_usable_volume(msgs, brands.brand_candidates(msgs))


@query(
    "thread_completeness",
    _scored_sql("SELECT brand, outbound_replies, usable_inbound_volume, thread_completeness_pct FROM scored"),
)
def _(spark, sf):
    msgs = t.messages(spark, sf)
    return brands.thread_completeness(brands.brand_usable_volume(msgs, brands.brand_candidates(msgs)))


@query(
    "lexical_entropy",
    """SELECT source AS brand, round_even((log2(total) - weighted / total) / CASE WHEN k > 1 THEN log2(k) ELSE 1.0::DOUBLE END, 4) AS lexical_entropy
    FROM (SELECT source, CAST(sum(n) AS DOUBLE) AS total, sum(n * log2(n)) AS weighted, CAST(count(*) AS DOUBLE) AS k
          FROM (SELECT source, word, count(*) AS n
                FROM (SELECT source, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS word FROM documents)
                WHERE regexp_full_match(word, '[a-z]{3,}') GROUP BY source, word) GROUP BY source)""",
)
def _(spark, sf):
    docs = t.table(spark, sf, "documents").withColumnRenamed("source", "brand")
    return brands.lexical_entropy(docs)


@query("ascii_homogeneity", _scored_sql("SELECT * FROM cascii"))
def _(spark, sf):
    msgs = t.messages(spark, sf)
    return brands.ascii_homogeneity(brands.customer_texts(msgs, brands.candidate_names(brands.brand_candidates(msgs))))


@query("resolution_substance", _scored_sql("SELECT * FROM csubst"))
def _(spark, sf):
    msgs = t.messages(spark, sf)
    return brands.resolution_substance(brands.first_replies(msgs, brands.candidate_names(brands.brand_candidates(msgs))))


@query("brand_composite", _scored_sql("SELECT * FROM composed"))
def _(spark, sf):
    return brands.brand_scores(t.messages(spark, sf))


@query(
    "brand_ranking",
    _scored_sql(
        """SELECT row_number() OVER (ORDER BY composite_score DESC, brand) AS rank, brand, composite_score,
        (SELECT brand FROM composed ORDER BY composite_score DESC, brand LIMIT 1) AS winner,
        (SELECT brand FROM composed ORDER BY composite_score DESC, brand LIMIT 1 OFFSET 1) AS runner_up FROM composed"""
    ),
)
def _(spark, sf):
    return brands.brand_ranking(brands.brand_scores(t.messages(spark, sf)))


# --------------------------------------------------------------- working set

@query(
    "normalize_corpus_text",
    f"SELECT page_id, {clean('html', q('Media'), ['support', 'help'], False)} AS clean_text FROM pages",
)
def _(spark, sf):
    return t.table(spark, sf, "pages").select(
        "page_id", T.normalize_corpus_text(F.col("html"), "Media").alias("clean_text")
    )


_PAIR_COLUMNS = "brand, customer_tweet_id, customer_author, customer_created_at, customer_text_raw, customer_parent_id, brand_tweet_id, brand_created_at, brand_reply_raw"


@query("reply_pairs", sql(f"SELECT {_PAIR_COLUMNS} FROM pairs"))
def _(spark, sf):
    return corpus.reply_pairs(t.messages(spark, sf), t.is_brand())


@query(
    "pair_funnel",
    sql(
        """SELECT count(*) AS brand_replies, count(*) FILTER (p.inbound) AS paired,
        count(*) FILTER (r.in_response_to_tweet_id IS NOT NULL AND p.tweet_id IS NULL) AS missing_parent,
        count(*) FILTER (p.tweet_id IS NOT NULL AND NOT p.inbound) AS non_inbound_parent
        FROM msgs r LEFT JOIN msgs p ON p.tweet_id = r.in_response_to_tweet_id WHERE starts_with(r.author_id, 'brand_')"""
    ),
)
def _(spark, sf):
    return corpus.pair_funnel(t.messages(spark, sf), t.is_brand())


@query(
    "dedup_keep_earliest",
    sql(
        """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY customer_text_clean ORDER BY customer_tweet_id, brand_tweet_id) AS rn FROM doc_pairs) WHERE rn = 1"""
    ),
)
def _(spark, sf):
    return corpus.dedup_keep_earliest(t.doc_pairs(spark, sf))


@query(
    "dedup_report",
    f"""SELECT count(*) AS before, count(DISTINCT text) AS after, count(*) - count(DISTINCT text) AS removed,
    {pct('(count(*) - count(DISTINCT text))', 'count(*)', 2)} AS removed_pct FROM documents""",
)
def _(spark, sf):
    return corpus.dedup_report(t.doc_pairs(spark, sf))


@query(
    "turn_and_length_features",
    sql(
        "SELECT customer_tweet_id, length(customer_text_clean) AS customer_char_len, customer_parent_id IS NULL AS is_first_turn FROM doc_pairs"
    ),
)
def _(spark, sf):
    return corpus.turn_and_length_features(t.doc_pairs(spark, sf)).select(
        "customer_tweet_id", "customer_char_len", "is_first_turn"
    )


@query(
    "tercile_bucket",
    """SELECT doc_id AS customer_tweet_id, length(text) AS customer_char_len,
    CASE WHEN length(text) <= (SELECT quantile_cont(length(text), 1.0::DOUBLE / 3) FROM documents) THEN 'short'
         WHEN length(text) <= (SELECT quantile_cont(length(text), 2.0::DOUBLE / 3) FROM documents) THEN 'medium' ELSE 'long' END AS length_bucket
    FROM documents""",
)
def _(spark, sf):
    return corpus.tercile_bucket(corpus.turn_and_length_features(t.doc_pairs(spark, sf))).select(
        "customer_tweet_id", "customer_char_len", "length_bucket"
    )


@query("holdout_split", sql("SELECT customer_tweet_id, split FROM doc_split"))
def _(spark, sf):
    return sampling.holdout_split(t.doc_pairs(spark, sf), "customer_tweet_id").select("customer_tweet_id", "split")


@query(
    "holdout_split_by_threshold",
    f"""SELECT doc_id AS customer_tweet_id, CASE WHEN CAST(concat('0x', substr({seeded(42, 'doc_id')}, 1, 8)) AS BIGINT) < {int(0.8 * 2**32)}
    THEN 'retrieval_pool' ELSE 'held_out_eval_pool' END AS split FROM documents""",
)
def _(spark, sf):
    return sampling.holdout_split(t.doc_pairs(spark, sf), "customer_tweet_id", exact=False).select(
        "customer_tweet_id", "split"
    )


def _split_docs(spark, sf):
    return sampling.holdout_split(t.doc_pairs(spark, sf), "customer_tweet_id")


@query(
    "split_leakage_ids",
    sql(
        """SELECT count(*) AS shared_ids FROM (SELECT customer_tweet_id FROM doc_split WHERE split = 'retrieval_pool'
        INTERSECT SELECT customer_tweet_id FROM doc_split WHERE split = 'held_out_eval_pool')"""
    ),
)
def _(spark, sf):
    return corpus.split_leakage_ids(_split_docs(spark, sf))


@query(
    "split_leakage_text",
    sql(
        """SELECT customer_tweet_id, split FROM doc_split WHERE split = 'retrieval_pool' OR customer_text_clean NOT IN
        (SELECT customer_text_clean FROM doc_split WHERE split = 'retrieval_pool')"""
    ),
)
def _(spark, sf):
    return corpus.split_leakage_text(_split_docs(spark, sf)).select("customer_tweet_id", "split")


@query("split_filter", sql("SELECT customer_tweet_id, brand FROM doc_split WHERE split = 'held_out_eval_pool'"))
def _(spark, sf):
    return sampling.split_filter(_split_docs(spark, sf), D.EVAL_POOL).select("customer_tweet_id", "brand")


@query(
    "seeded_sample",
    f"SELECT doc_id, lang, source FROM documents ORDER BY {seeded(7, 'doc_id')}, doc_id LIMIT 100",
)
def _(spark, sf):
    return sampling.seeded_sample(t.table(spark, sf, "documents"), 100, 7, "doc_id").select("doc_id", "lang", "source")


@query(
    "seeded_sample_large",
    f"SELECT doc_id, lang, source FROM documents ORDER BY {seeded(7, 'doc_id')}, doc_id LIMIT 150",
)
def _(spark, sf):
    return sampling.take_seeded(t.table(spark, sf, "documents"), 150, 7, "doc_id").select("doc_id", "lang", "source")


_WORKING_COLUMNS = (
    "brand",
    "customer_tweet_id",
    "customer_author",
    "customer_text_clean",
    "customer_parent_id",
    "brand_tweet_id",
    "brand_reply_clean",
    "customer_char_len",
    "is_first_turn",
    "length_bucket",
    "split",
)
WORKING_SQL = sql(
    f"""SELECT {', '.join(_WORKING_COLUMNS)} FROM working WHERE split = 'retrieval_pool' OR customer_text_clean NOT IN
    (SELECT customer_text_clean FROM working WHERE split = 'retrieval_pool')"""
)


def working_set(spark, sf):
    return corpus.working_set(t.messages(spark, sf), t.is_brand()).select(*_WORKING_COLUMNS)


@query("working_set", WORKING_SQL)
def _(spark, sf):
    return working_set(spark, sf)


@query(
    "split_summary",
    sql(
        """SELECT count(*) AS total_paired_records, count(*) FILTER (split = 'retrieval_pool') AS retrieval_pool_count,
        count(*) FILTER (split = 'held_out_eval_pool') AS held_out_eval_pool_count, count(*) FILTER (is_first_turn) AS first_turn_count,
        count(*) FILTER (NOT is_first_turn) AS follow_up_count, count(*) FILTER (length_bucket = 'short') AS short_count,
        count(*) FILTER (length_bucket = 'medium') AS medium_count, count(*) FILTER (length_bucket = 'long') AS long_count
        FROM working"""
    ),
)
def _(spark, sf):
    pairs = corpus.clean_pairs(t.messages(spark, sf), t.is_brand())
    return corpus.split_summary(sampling.holdout_split(corpus.tercile_bucket(pairs), "brand_tweet_id"))


@query(
    "corpus_build",
    sql(
        """SELECT customer_tweet_id AS case_id, customer_text_clean AS customer_text, brand_reply_clean AS brand_resolution, brand_tweet_id
        FROM doc_split WHERE split = 'retrieval_pool'"""
    ),
)
def _(spark, sf):
    return corpus.corpus_build(_split_docs(spark, sf))


# --------------------------------------------------------------- data quality

@query(
    "dq_required_columns",
    sql(
        " UNION ALL ".join(
            f"SELECT {q(c)} AS column_name, {'false' if c == 'split' else 'true'} AS present, "
            + ("count(NULL)" if c == "split" else f"count({c})")
            + " AS filled_rows FROM doc_pairs"
            for c in quality.WORKING_SET_COLUMNS
        )
    ),
)
def _(spark, sf):
    return quality.dq_required_columns(t.doc_pairs(spark, sf))


@query(
    "dq_null_blank",
    sql(
        " UNION ALL ".join(
            f"""SELECT {q(c)} AS column_name, count(*) FILTER ({c} IS NULL) AS null_rows,
            count(*) FILTER ({c} IS NOT NULL AND trim(CAST({c} AS VARCHAR)) = '') AS blank_rows FROM doc_pairs"""
            for c in ("customer_text_clean", "brand_reply_clean", "customer_parent_id")
        )
    ),
)
def _(spark, sf):
    return quality.dq_null_blank(
        t.doc_pairs(spark, sf), ["customer_text_clean", "brand_reply_clean", "customer_parent_id"]
    )


@query(
    "dq_volume_range",
    sql("SELECT count(*) AS row_count, count(*) BETWEEN 150 AND 250 AS in_range FROM gold"),
)
def _(spark, sf):
    return quality.dq_volume_range(t.gold(spark, sf))


@query(
    "dq_allowed_values",
    sql(
        "SELECT upper(routing_decision) AS value, count(*) AS n FROM preds WHERE upper(routing_decision) NOT IN ('AUTO_HANDLE') GROUP BY 1"
    ),
)
def _(spark, sf):
    return quality.dq_allowed_values(t.predictions(t.gold(spark, sf)), "routing_decision", ["AUTO_HANDLE"])


__all__ = ["WORKING_SQL", "working_set"]


@query(
    "corpus_build_sampled",
    sql(
        f"""SELECT customer_tweet_id AS case_id, customer_text_clean AS customer_text, brand_reply_clean AS brand_resolution, brand_tweet_id
        FROM doc_split WHERE split = 'retrieval_pool' ORDER BY {seeded(42, 'customer_tweet_id')}, customer_tweet_id LIMIT 5000"""
    ),
)
def _(spark, sf):
    return corpus.corpus_build(_split_docs(spark, sf), max_records=D.CORPUS_RECORDS)
