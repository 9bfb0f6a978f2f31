"""Gold-set construction and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskgraph import defaults as D
from deskgraph.functions import rules
from deskgraph.operators import corpus, gold
from deskgraph.plans import tables as t
from deskgraph.plans.oracle import has_word, has_words_in_line, lookup_case, pct, q, seeded, sql, word_count
from deskgraph.plans.registry import query
from deskgraph.session import materialise

# Patterns and quotas that fit the invented prose, so that every category occurs.
SAFETY = r"\b(worthless|stupid|disgusting|hate)\b"
SARCASM = r"\b(that|this)\b.*\b(was|are)\b"
FEW_WORDS = 30
QUOTAS = {"safety_legal_escalate": 16, "sarcasm_implicit_dissatisfaction": 12, "low_info_vague": 12}
INTENTS = {"support_intent": "fr", "driver_intent": "de"}

_LOW_INFO = r"(?i)^\s*(@[0-9a-z_]+\s+)*(help|hello|hi|broken|need\s+help|please\s+help|anyone\s+there)\s*[.!?]*$"
_EDGE = f"""CASE WHEN {has_word('customer_text_clean', 'worthless|stupid|disgusting|hate')} THEN 'safety_legal_escalate'
    WHEN {has_words_in_line('customer_text_clean', 'that|this', 'was|are')} THEN 'sarcasm_implicit_dissatisfaction'
    WHEN regexp_matches(customer_text_clean, {q(_LOW_INFO)}) OR {word_count('customer_text_clean')} <= {FEW_WORDS} THEN 'low_info_vague' ELSE 'standard' END"""
_KEY = seeded(42, "customer_tweet_id") + ", customer_tweet_id"
_VIEWS = {
    "pool": f"""SELECT *, {_EDGE} AS edge_category, customer_parent_id IS NULL AS is_first_turn,
        CASE WHEN length(customer_text_clean) <= (SELECT quantile_cont(length(text), 1.0::DOUBLE / 3) FROM documents) THEN 'short'
             WHEN length(customer_text_clean) <= (SELECT quantile_cont(length(text), 2.0::DOUBLE / 3) FROM documents) THEN 'medium' ELSE 'long' END AS length_bucket
        FROM doc_pairs""",
    "edges": f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY edge_category ORDER BY {_KEY}) AS rn FROM pool)
        WHERE rn <= {lookup_case('edge_category', {k: str(v) for k, v in QUOTAS.items()}, "'0'")}::BIGINT""",
    "fills": f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY mapped_intent ORDER BY {_KEY}) AS rn
        FROM pool WHERE customer_tweet_id NOT IN (SELECT customer_tweet_id FROM edges)) f
        WHERE rn <= greatest(0, 20 - (SELECT count(*) FROM edges e WHERE e.mapped_intent = f.mapped_intent))""",
    "chosen": "SELECT * FROM edges UNION ALL SELECT * FROM fills",
    "full_set": f"""SELECT * EXCLUDE (late) FROM (SELECT *, 0 AS late FROM chosen UNION ALL
        SELECT *, 1 AS late FROM pool WHERE customer_tweet_id NOT IN (SELECT customer_tweet_id FROM chosen)) ORDER BY late, {_KEY} LIMIT 200""",
    "numbered_set": f"SELECT *, concat('gold_', lpad(CAST(row_number() OVER (ORDER BY {_KEY}) AS VARCHAR), 3, '0')) AS example_id FROM full_set",
    "annotated": f"""SELECT example_id, customer_tweet_id, customer_text_clean AS customer_text,
        CASE WHEN is_first_turn THEN 'first_turn' ELSE 'follow_up' END AS turn_position, length_bucket, edge_category AS edge_case_category,
        mapped_intent AS gold_intent,
        CASE WHEN edge_category = 'safety_legal_escalate' OR mapped_intent IN ('fr', 'de') THEN 'ESCALATE' ELSE 'AUTO_HANDLE' END AS gold_routing_decision,
        CASE WHEN edge_category = 'safety_legal_escalate' THEN {q(D.GOLD_REASON_SAFETY)} WHEN mapped_intent = 'fr' THEN {q(D.GOLD_REASON_SUPPORT)}
             WHEN mapped_intent = 'de' THEN {q(D.GOLD_REASON_DRIVER)} ELSE {q(D.GOLD_REASONS[D.OTHER_INTENT])} END AS gold_escalate_reason,
        {q(D.GOLD_GUIDANCE[D.OTHER_INTENT])} AS gold_reply_reference, brand_reply_clean AS brand_historical_reply FROM numbered_set""",
    "audited_set": f"""SELECT example_id, customer_text AS text, gold_intent AS pass1_intent,
        CASE WHEN contains(body, 'tion') AND (contains(body, 'ing') OR contains(body, 'ment')) AND gold_intent = 'en' THEN 'es'
             WHEN contains(body, 'la') AND contains(body, 'que') AND gold_intent = 'fr' THEN 'de'
             WHEN (contains(body, 'und') OR contains(body, 'der')) AND gold_intent = 'de' THEN 'fr' ELSE gold_intent END AS pass2_intent,
        gold_routing_decision AS pass1_routing,
        CASE WHEN (contains(body, 'und') OR contains(body, 'der')) AND gold_intent = 'de' THEN 'ESCALATE' ELSE gold_routing_decision END AS pass2_routing
        FROM (SELECT *, lower(customer_text) AS body FROM annotated ORDER BY {seeded(99, 'example_id')}, example_id LIMIT 20)""",
    "agreed": f"""SELECT {pct('count(*) FILTER (pass1_intent = pass2_intent)', 'count(*)', 1)} AS intent_agreement_pct,
        {pct('count(*) FILTER (pass1_routing = pass2_routing)', 'count(*)', 1)} AS routing_agreement_pct FROM audited_set""",
}


def _kappa_sql(a: str, b: str, source: str) -> str:
    labels = f"(SELECT {a} AS v FROM {source} UNION SELECT {b} FROM {source})"
    return f"""(SELECT CASE WHEN pe = 1 THEN NULL ELSE round_even((po - pe) / (1 - pe), 4) END FROM (SELECT
        (SELECT CAST(count(*) FILTER ({a} = {b}) AS DOUBLE) / count(*) FROM {source}) AS po,
        (SELECT sum(CAST((SELECT count(*) FROM {source} WHERE {a} = v) AS DOUBLE) * (SELECT count(*) FROM {source} WHERE {b} = v)) FROM {labels})
        / (SELECT CAST(count(*) AS DOUBLE) * count(*) FROM {source}) AS pe))"""


def _sql(body: str) -> str:
    return sql(body, **_VIEWS)


def pool(spark, sf):
    rows = corpus.tercile_bucket(corpus.turn_and_length_features(t.doc_pairs(spark, sf)))
    category = rules.edge_category(F.col("customer_text_clean"), SAFETY, SARCASM, low_info_words=FEW_WORDS)
    return rows.withColumn("edge_category", category)


def golden(spark, sf):
    """The gold set, written once: the reports read its at most 200 rows several times."""
    chosen = gold.select_gold(pool(spark, sf), edge_quotas=QUOTAS)
    return materialise(gold.gold_annotation(gold.gold_example_id(chosen), **INTENTS), "gold")


def narrow_pool(spark, sf):
    return materialise(pool(spark, sf).select("customer_tweet_id", "edge_category", "mapped_intent"), "gold-pool")


def audit(rows):
    return gold.second_pass_relabel(
        rows,
        fare_intent="en",
        cancel_intent="es",
        lost_intent="de",
        driver_intent="fr",
        pickup_intent="de",
        rude_words=("und", "der"),
        cancel_words=("tion", ("ing", "ment")),
        lost_words=("la", "que"),
    )


@query("edge_category", _sql("SELECT customer_tweet_id, edge_category FROM pool"))
def _(spark, sf):
    return pool(spark, sf).select("customer_tweet_id", "edge_category")


@query("stratified_sample_edges", _sql("SELECT customer_tweet_id, edge_category FROM edges"))
def _(spark, sf):
    return gold.stratified_sample_edges(pool(spark, sf), QUOTAS).select("customer_tweet_id", "edge_category")


@query("stratified_fill_quota", _sql("SELECT customer_tweet_id, mapped_intent FROM fills"))
def _(spark, sf):
    rows = narrow_pool(spark, sf)
    edges = gold.stratified_sample_edges(rows, QUOTAS)
    return gold.stratified_fill_quota(rows, edges).select("customer_tweet_id", "mapped_intent")


@query("sample_fill_remainder", _sql("SELECT customer_tweet_id, mapped_intent FROM full_set"))
def _(spark, sf):
    rows = narrow_pool(spark, sf)
    edges = gold.stratified_sample_edges(rows, QUOTAS)
    chosen = edges.unionByName(gold.stratified_fill_quota(rows, edges))
    return gold.sample_fill_remainder(rows, chosen).select("customer_tweet_id", "mapped_intent")


@query("gold_example_id", _sql("SELECT example_id, customer_tweet_id FROM numbered_set"))
def _(spark, sf):
    return golden(spark, sf).select("example_id", "customer_tweet_id")


@query("gold_annotation", _sql("SELECT * FROM annotated"))
def _(spark, sf):
    return golden(spark, sf)


@query(
    "gold_distribution",
    _sql(
        "SELECT 'total' AS distribution, 'all' AS value, count(*) AS n FROM annotated UNION ALL "
        + " UNION ALL ".join(
            f"SELECT {q(n)}, {c}, count(*) FROM annotated GROUP BY {c}" for n, c in gold.GOLD_DISTRIBUTIONS.items()
        )
    ),
)
def _(spark, sf):
    return gold.gold_distribution(golden(spark, sf))


@query("second_pass_relabel", _sql("SELECT * FROM audited_set"))
def _(spark, sf):
    return audit(golden(spark, sf))


_DISAGREE = "pass1_intent <> pass2_intent OR pass1_routing <> pass2_routing"


@query("disagreement_cases", _sql(f"SELECT * FROM audited_set WHERE {_DISAGREE}"))
def _(spark, sf):
    return gold.disagreement_cases(audit(golden(spark, sf)))


@query("raw_agreement", _sql("SELECT * FROM agreed"))
def _(spark, sf):
    return gold.raw_agreement(audit(golden(spark, sf)))


@query(
    "gold_audit_report",
    _sql(
        f"""SELECT (SELECT count(*) FROM audited_set) AS audit_sample_size, (SELECT count(*) FROM annotated) AS golden_set_total_size,
        round_even((SELECT CAST(count(*) AS DOUBLE) FROM audited_set) / (SELECT count(*) FROM annotated) * 100.0::DOUBLE, 1) AS audit_fraction_pct,
        intent_agreement_pct AS intent_raw_agreement_pct, {_kappa_sql('pass1_intent', 'pass2_intent', 'audited_set')} AS intent_cohens_kappa,
        routing_agreement_pct AS routing_raw_agreement_pct, {_kappa_sql('pass1_routing', 'pass2_routing', 'audited_set')} AS routing_cohens_kappa,
        (SELECT count(*) FROM audited_set WHERE {_DISAGREE}) AS disagreement_count FROM agreed"""
    ),
)
def _(spark, sf):
    rows = golden(spark, sf)
    return gold.gold_audit_report(rows, audit(rows))


@query("cohens_kappa", sql(f"SELECT {_kappa_sql('true_action', 'pred_action', 'agree_rows')} AS kappa", agree_rows="SELECT true_action, pred_action FROM joined"))
def _(spark, sf):
    from deskgraph.operators import metrics

    rows = t.gold(spark, sf)
    return gold.cohens_kappa(metrics.prediction_gold_join(t.predictions(rows), rows), "true_action", "pred_action")
