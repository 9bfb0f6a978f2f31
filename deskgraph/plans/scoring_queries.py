"""Message features, threads, replies, grounding, routing and the whole scoring chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskgraph import defaults as D
from deskgraph.functions import rules
from deskgraph.functions import text as T
from deskgraph.operators import grounding, replies, routing, threads
from deskgraph.plans import message_scoring
from deskgraph.plans import tables as t
from deskgraph.plans.oracle import clean, has_word, lookup_case, q, sql, strip, word_count
from deskgraph.plans import registry
from deskgraph.plans.registry import query
from deskgraph.plans.vector_queries import THRESHOLD, _BEST, fitted
from deskgraph.session import shared_folder
from deskgraph.sources.snapshots import Snapshots

_ALIASES = list(D.MESSAGE_ALIASES)


def message_sql(expr: str, brand: str = D.BRAND_HANDLE) -> str:
    return clean(expr, q(brand.lower()), _ALIASES, True)


# ------------------------------------------------------------ message features

@query("normalize_message", f"SELECT page_id, {message_sql('html')} AS clean_text FROM pages")
def _(spark, sf):
    return t.table(spark, sf, "pages").select("page_id", T.normalize_message(F.col("html")).alias("clean_text"))


_FEATURES = f"""SELECT tweet_id, raw_text, clean_text, length(clean_text) AS char_length,
    CAST({word_count('clean_text')} AS BIGINT) AS word_count, regexp_full_match(clean_text, '[\\x00-\\x7F]+') AS is_ascii
    FROM (SELECT tweet_id, text AS raw_text, {message_sql('text', 'brand_1')} AS clean_text FROM msgs)"""


@query("message_features", sql(_FEATURES))
def _(spark, sf):
    done = threads.message_features(t.messages(spark, sf), "text", "brand_1")
    return done.select("tweet_id", "raw_text", "clean_text", "char_length", "word_count", "is_ascii")


# --------------------------------------------------------------------- threads

_ROLE = "CASE role WHEN 'user' THEN 'customer' ELSE role END"
_CONTEXT_WINDOW = "OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)"


def _context(spark, sf, chunk: int = threads.CHUNK):
    rows = t.table(spark, sf, "conversations").withColumn(
        "role", F.when(F.col("role") == "user", F.lit("customer")).otherwise(F.col("role"))
    )
    return threads.bounded_context(rows, chunk=chunk)


_CONTEXT = f"""SELECT conv_id, turn, CAST(count(*) {_CONTEXT_WINDOW} + 1 AS BIGINT) AS total_turns,
    coalesce(string_agg(concat({_ROLE}, '|', text), chr(10)) {_CONTEXT_WINDOW}, '') AS prior_turns FROM conversations"""


def _flat_turns(rows):
    flat = F.array_join(F.transform("prior_turns", lambda x: F.concat(x["role"], F.lit("|"), x["text"])), "\n")
    return rows.select("conv_id", "turn", "total_turns", flat.alias("prior_turns"))


@query("bounded_context", _CONTEXT)
def _(spark, sf):
    return _flat_turns(_context(spark, sf))


@query("bounded_context_in_chunks", _CONTEXT)
def _(spark, sf):
    return _flat_turns(_context(spark, sf, chunk=3))


@query(
    "thread_transcript",
    f"""SELECT conv_id, turn, concat(CASE WHEN prior IS NULL THEN '' ELSE concat(prior, chr(10)) END, 'Customer (Current): ', text) AS transcript
    FROM (SELECT conv_id, turn, text, string_agg(concat(CASE WHEN role = 'user' THEN 'Customer: ' ELSE 'Support Agent: ' END, text), chr(10)) {_CONTEXT_WINDOW} AS prior FROM conversations)""",
)
def _(spark, sf):
    transcript = threads.thread_transcript(F.col("prior_turns"), F.col("text"))
    return _context(spark, sf).select("conv_id", "turn", transcript.alias("transcript"))


@query(
    "turn_position",
    f"SELECT conv_id, turn, CASE WHEN count(*) {_CONTEXT_WINDOW} > 0 THEN 'follow_up' ELSE 'first_turn' END AS turn_position FROM conversations",
)
def _(spark, sf):
    return _context(spark, sf).select("conv_id", "turn", threads.turn_position(F.col("prior_turns")).alias("turn_position"))


# --------------------------------------------------------------------- replies

_PROMPT = D.REPLY_PROMPT.split("%s")


@query(
    "prompt_rows",
    sql(f"SELECT doc_id, concat({q(_PROMPT[0])}, reply_text, {q(_PROMPT[1])}, evidence_text, {q(_PROMPT[2])}) AS prompt FROM claims"),
)
def _(spark, sf):
    rows = replies.prompt_rows(t.claims(spark, sf), D.REPLY_PROMPT, ["reply_text", "evidence_text"])
    return rows.select("doc_id", "prompt")


def _reply_cache(spark, sf):
    """A cache holding the documents of even length; one entry per distinct text."""
    docs = t.table(spark, sf, "documents").where(F.col("n_chars") % 2 == 0)
    return docs.groupBy(replies.reply_key(F.col("text")).alias("cache_key")).agg(
        F.concat(F.lit("Stored reply "), F.min("doc_id").cast("string")).alias("reply_text"),
        F.when(F.min("doc_id") % 3 != 0, F.array(F.min("doc_id"))).alias("evidence_ids_used"),
    )


_CACHE = {
    "cache": """SELECT concat('reply_', md5(concat(text, 'v1.0'))) AS cache_key, concat('Stored reply ', CAST(min(doc_id) AS VARCHAR)) AS reply_text,
    CASE WHEN min(doc_id) % 3 <> 0 THEN CAST(min(doc_id) AS VARCHAR) END AS ids FROM documents WHERE n_chars % 2 = 0 GROUP BY text"""
}


@query(
    "reply_cache_join",
    sql(
        """SELECT doc_id, concat('reply_', md5(concat(text, 'v1.0'))) AS cache_key, reply_text,
        coalesce(ids, CAST(-doc_id AS VARCHAR)) AS evidence_ids_used, c.cache_key IS NOT NULL AS cached
        FROM documents d LEFT JOIN cache c ON c.cache_key = concat('reply_', md5(concat(d.text, 'v1.0')))""",
        **_CACHE,
    ),
)
def _(spark, sf):
    rows = t.table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("clean_text"), F.array(-F.col("doc_id")).alias("retrieved_case_ids")
    )
    done = replies.reply_cache_join(rows, _reply_cache(spark, sf), "doc_id")
    ids = F.array_join(F.transform("evidence_ids_used", lambda i: i.cast("string")), ",")
    return done.select("doc_id", "cache_key", "reply_text", ids.alias("evidence_ids_used"), "cached")


@query(
    "reply_cache_misses",
    sql(
        "SELECT DISTINCT concat('reply_', md5(concat(text, 'v1.0'))) AS cache_key, text AS clean_text FROM documents WHERE concat('reply_', md5(concat(text, 'v1.0'))) NOT IN (SELECT cache_key FROM cache)",
        **_CACHE,
    ),
)
def _(spark, sf):
    rows = t.table(spark, sf, "documents").select(F.col("text").alias("clean_text"))
    return replies.reply_cache_misses(rows, _reply_cache(spark, sf))


@query(
    "short_reply_fallback",
    f"""SELECT conv_id, turn, CASE WHEN reply IS NULL THEN {q(D.NO_REPLY_TEMPLATE)} WHEN length({strip('reply')}) < 25 THEN {q(D.SHORT_REPLY_TEMPLATE)}
    ELSE {strip('reply')} END AS reply_text FROM (SELECT conv_id, turn, CASE WHEN conv_id % 8 <> 5 THEN text END AS reply FROM conversations)""",
)
def _(spark, sf):
    reply = F.when(F.col("conv_id") % 8 != 5, F.col("text"))
    return t.table(spark, sf, "conversations").select("conv_id", "turn", replies.short_reply_fallback(reply).alias("reply_text"))


_INTENT_OF_LANG = {"en": D.INTENTS[0], "fr": D.INTENTS[2], "de": D.INTENTS[5]}


def _template_sql(resolution: str, intent: str) -> str:
    body = strip(f"replace({resolution}, '@customer', '')")
    policy = lookup_case(intent, D.REPLY_POLICIES, q(D.REPLY_POLICIES[D.OTHER_INTENT]))
    return f"CASE WHEN length({body}) > 20 AND NOT starts_with({body}, 'http') THEN concat('Hi there. ', {body}) ELSE {policy} END"


@query(
    "grounded_template_reply",
    f"""SELECT doc_id, {_template_sql('resolution', 'intent')} AS generated_reply FROM (
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('@customer ', text) WHEN 1 THEN concat('http', text) WHEN 2 THEN '@customer thanks' END AS resolution,
    {lookup_case('lang', _INTENT_OF_LANG, "'Unknown'")} AS intent FROM documents)""",
)
def _(spark, sf):
    kind = F.col("doc_id") % 4
    resolution = (
        F.when(kind == 0, F.concat(F.lit("@customer "), "text"))
        .when(kind == 1, F.concat(F.lit("http"), "text"))
        .when(kind == 2, F.lit("@customer thanks"))
    )
    intent = rules.lookup(F.col("lang"), _INTENT_OF_LANG, "Unknown")
    return t.table(spark, sf, "documents").select(
        "doc_id", replies.grounded_template_reply(resolution, intent).alias("generated_reply")
    )


@query(
    "canned_reply",
    f"""SELECT doc_id, {lookup_case('intent', D.CANNED_REPLIES, q(D.CANNED_DEFAULT))} AS generated_reply FROM (
    SELECT doc_id, {lookup_case('lang', _INTENT_OF_LANG, "'Unknown'")} AS intent FROM documents)""",
)
def _(spark, sf):
    intent = rules.lookup(F.col("lang"), _INTENT_OF_LANG, "Unknown")
    return t.table(spark, sf, "documents").select("doc_id", replies.canned_reply(intent).alias("generated_reply"))


# ------------------------------------------------------------------- grounding

_CURRENCY = r"(?i)\$[\t-\r ]*[0-9]+|[0-9]+[\t-\r ]*dollars?"
_PHONE_CORE = r"(?:\+?1[-.\t-\r ]?)?\(?[0-9]{3}\)?[-.\t-\r ]?[0-9]{3}[-.\t-\r ]?[0-9]{4}"


def currency_sql(reply: str, evidence: str) -> str:
    known = f"list_transform(regexp_extract_all({evidence}, {q(_CURRENCY)}), lambda x: lower(x))"
    return f"list_filter(regexp_extract_all({reply}, {q(_CURRENCY)}), lambda x: NOT list_contains({known}, lower(x)))[1]"


def phone_sql(reply: str, evidence: str) -> str:
    rx = rf"\b{_PHONE_CORE}\b"
    return f"list_filter(regexp_extract_all({reply}, {q(rx)}), lambda x: NOT list_contains(regexp_extract_all({evidence}, {q(rx)}), x))[1]"


@query("currency_claims", sql(f"SELECT doc_id, {currency_sql('reply_text', 'evidence_text')} AS claim FROM claims"))
def _(spark, sf):
    claim = grounding.currency_claims(F.col("reply_text"), F.col("evidence_text"))
    return t.claims(spark, sf).select("doc_id", claim.alias("claim"))


@query("phone_claims", sql(f"SELECT doc_id, {phone_sql('reply_text', 'evidence_text')} AS claim FROM claims"))
def _(spark, sf):
    claim = grounding.phone_claims(F.col("reply_text"), F.col("evidence_text"))
    return t.claims(spark, sf).select("doc_id", claim.alias("claim"))


def verdict_sql(source: str, key: str, reply: str, evidence: str, answer: str) -> str:
    score = f"coalesce(TRY_CAST(json_extract_string({answer}, '$.grounding_score') AS DOUBLE), 1.0::DOUBLE)"
    passed = f"coalesce(TRY_CAST(json_extract_string({answer}, '$.grounding_pass') AS BOOLEAN), true)"
    given = (
        f"CASE WHEN NOT coalesce(json_valid({answer}), false) THEN false WHEN json_type({answer}) <> 'OBJECT' THEN false "
        f"ELSE coalesce(json_type({answer}, '$.grounding_score') IN ('DOUBLE', 'UBIGINT', 'BIGINT'), true) END"
    )
    score, passed = (f"CASE WHEN {given} THEN {x} END" for x in (score, passed))
    return f"""SELECT {key}, CASE WHEN amount IS NOT NULL OR phone IS NOT NULL THEN false WHEN {given} THEN {passed} AND {score} >= 0.75::DOUBLE ELSE true END AS grounding_pass,
        CASE WHEN amount IS NOT NULL THEN 0.2::DOUBLE WHEN phone IS NOT NULL THEN 0.1::DOUBLE WHEN {given} THEN {score} ELSE 0.85::DOUBLE END AS grounding_score,
        CASE WHEN amount IS NOT NULL THEN concat('Fabricated currency amount ''', amount, ''' not present in historical evidence.')
             WHEN phone IS NOT NULL THEN concat('Fabricated contact phone number ''', phone, ''' not present in historical evidence.') ELSE '' END AS unsupported_claims,
        CASE WHEN amount IS NOT NULL THEN {q(D.CURRENCY_JUSTIFICATION)} WHEN phone IS NOT NULL THEN {q(D.PHONE_JUSTIFICATION)}
             WHEN {given} THEN {q(D.AUDITED_JUSTIFICATION)} ELSE {q(D.UNAVAILABLE_JUSTIFICATION)} END AS justification
        FROM (SELECT *, {currency_sql(reply, evidence)} AS amount, {phone_sql(reply, evidence)} AS phone FROM {source})"""


def _flat_verdict(rows, *keys):
    return rows.select(
        *keys, "grounding_pass", "grounding_score", F.array_join("unsupported_claims", "; ").alias("unsupported_claims"), "justification"
    )


@query("grounding_verdict", sql(verdict_sql("claims", "doc_id", "reply_text", "evidence_text", "answer")))
def _(spark, sf):
    rows = t.claims(spark, sf).withColumnRenamed("reply_text", "generated_reply")
    done = grounding.grounding_verdict(rows, verdict=grounding.parse_verdict(F.col("answer")))
    return _flat_verdict(done, "doc_id")


@query(
    "grounding_verdict_without_amounts",
    sql(
        verdict_sql(
            "(SELECT doc_id, text AS reply_text, coalesce((SELECT b.text FROM documents b WHERE b.doc_id = a.doc_id - 1), '') AS evidence_text, "
            "CASE WHEN n_chars % 4 <> 0 THEN concat('{\"grounding_score\": 0.', CAST(n_chars % 40 + 60 AS VARCHAR), '}') END AS answer FROM documents a)",
            "doc_id",
            "reply_text",
            "evidence_text",
            "answer",
        )
    ),
)
def _(spark, sf):
    docs = t.table(spark, sf, "documents")
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("evidence_text"))
    answer = F.when(
        F.col("n_chars") % 4 != 0,
        F.concat(F.lit('{"grounding_score": 0.'), (F.col("n_chars") % 40 + 60).cast("string"), F.lit("}")),
    )
    rows = docs.join(before, "doc_id", "left").select(
        "doc_id", F.col("text").alias("generated_reply"), F.coalesce("evidence_text", F.lit("")).alias("evidence_text"), answer.alias("answer")
    )
    return _flat_verdict(grounding.grounding_verdict(rows, verdict=grounding.parse_verdict(F.col("answer"))), "doc_id")


# --------------------------------------------------------------------- routing

_COMPOSITE = "round_even(0.3::DOUBLE * intent_confidence + 0.35::DOUBLE * {sim} + 0.35::DOUBLE * grounding_score, 4)"


@query(
    "composite_confidence",
    sql(f"SELECT example_id, {_COMPOSITE.format(sim='retrieval_similarity')} AS composite_confidence FROM route_in"),
)
def _(spark, sf):
    score = routing.composite_confidence(F.col("intent_confidence"), F.col("retrieval_similarity"), F.col("grounding_score"))
    return t.route_inputs(t.gold(spark, sf)).select("example_id", score.alias("composite_confidence"))


def safety_sql(category: str, text: str) -> str:
    words = " OR ".join(f"contains(lower({text}), {q(w)})" for w in D.SAFETY_WORDS)
    return f"({category} = 'safety_legal_escalate' OR {words})"


@query(
    "safety_trigger",
    sql(
        f"SELECT example_id, {safety_sql('edge_case_category', 'raw_text')} AS substring_form, "
        f"(edge_case_category = 'safety_legal_escalate' OR {has_word('raw_text', '|'.join(D.SAFETY_WORDS))}) AS whole_word_form FROM route_in"
    ),
)
def _(spark, sf):
    text, edge = F.col("raw_text"), F.col("edge_case_category")
    return t.route_inputs(t.gold(spark, sf)).select(
        "example_id",
        rules.safety_trigger(text, edge).alias("substring_form"),
        rules.safety_trigger(text, edge, whole_word=True).alias("whole_word_form"),
    )


def route_sql(source: str, keys: str, intent: str, sim: str, category: str, text: str, mandatory: list[str]) -> str:
    names = ", ".join(q(m) for m in mandatory)

    def cut(text_format: str, minimum: float, *values: str) -> str:
        parts = text_format.format(minimum=minimum).split("%s")
        out = [q(parts[0])]
        for value, part in zip(values, parts[1:], strict=True):
            out += [value, q(part)]
        return f"concat({', '.join(out)})"

    def two(expr: str) -> str:
        return f"printf('%.2f', {expr})"

    return f"""SELECT {keys}, CASE WHEN rule = 'HIGH_CONFIDENCE_AUTO_HANDLE' THEN 'AUTO_HANDLE' ELSE 'ESCALATE' END AS routing_decision,
        CASE WHEN rule = 'HIGH_CONFIDENCE_AUTO_HANDLE' THEN 'auto_handle' ELSE 'escalate' END AS action,
        CASE rule WHEN 'MANDATORY_SAFETY_OR_LEGAL_ESCALATION' THEN {q(D.REASON_SAFETY)}
             WHEN 'MANDATORY_INTENT_ESCALATION_' THEN {cut(D.REASON_INTENT, 0, intent)}
             WHEN 'GROUNDING_VERIFICATION_FAILED' THEN {cut(D.REASON_GROUNDING, 0.75, two('grounding_score'))}
             WHEN 'LOW_RETRIEVAL_SIMILARITY' THEN {cut(D.REASON_SIMILARITY, 0.4, two(sim))}
             WHEN 'HIGH_CONFIDENCE_AUTO_HANDLE' THEN {cut(D.REASON_AUTO, 0, two('intent_confidence'), two(sim), two('grounding_score'))}
             ELSE {cut(D.REASON_COMPOSITE, 0.7, two('composite_confidence'))} END AS routing_reason,
        CASE WHEN rule = 'MANDATORY_INTENT_ESCALATION_' THEN concat(rule, upper({intent})) ELSE rule END AS triggered_rule, composite_confidence
        FROM (SELECT *, CASE WHEN {safety_sql(category, text)} THEN 'MANDATORY_SAFETY_OR_LEGAL_ESCALATION'
              WHEN {intent} IN ({names}) THEN 'MANDATORY_INTENT_ESCALATION_'
              WHEN NOT grounding_pass OR grounding_score < 0.75::DOUBLE THEN 'GROUNDING_VERIFICATION_FAILED'
              WHEN {sim} < 0.4::DOUBLE THEN 'LOW_RETRIEVAL_SIMILARITY'
              WHEN composite_confidence >= 0.7::DOUBLE THEN 'HIGH_CONFIDENCE_AUTO_HANDLE' ELSE 'LOW_COMPOSITE_CONFIDENCE' END AS rule
              FROM (SELECT *, {_COMPOSITE.format(sim=sim)} AS composite_confidence FROM {source}))"""


@query(
    "route_decision",
    sql(route_sql("route_in", "example_id", "intent", "retrieval_similarity", "edge_case_category", "raw_text", ["de"])),
)
def _(spark, sf):
    policy = routing.RoutingPolicy(mandatory_intents=("de",))
    done = routing.route_decision(t.route_inputs(t.gold(spark, sf)), policy)
    return done.select(
        "example_id", "routing_decision", "action", "routing_reason", F.col("triggered_rules")[0].alias("triggered_rule"), "composite_confidence"
    )


_KEYWORDS = ("the", "les", "und", "que", "with", "nicht")


@query(
    "keyword_escalation",
    f"""SELECT doc_id, CASE WHEN len(hits) > 0 THEN 'escalate' ELSE 'auto_handle' END AS routing_decision,
    CASE WHEN len(hits) > 0 THEN concat({q(D.KEYWORD_REASON)}, array_to_string(hits, ', ')) ELSE {q(D.NO_KEYWORD_REASON)} END AS routing_reason
    FROM (SELECT doc_id, list_sort(list_filter([{', '.join(q(k) for k in _KEYWORDS)}], lambda k: list_contains(toks, k))) AS hits
          FROM (SELECT doc_id, string_split_regex(lower(text), '[\\t-\\r\\x1c-\\x20]+') AS toks FROM documents))""",
)
def _(spark, sf):
    done = rules.keyword_escalation(t.table(spark, sf, "documents"), "text", _KEYWORDS)
    return done.select("doc_id", "routing_decision", "routing_reason")


@query("execution_id", "SELECT doc_id, concat('exec_', substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS execution_id FROM documents")
def _(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", routing.execution_id(F.col("doc_id")).alias("execution_id"))


# -------------------------------------------------------------- whole scoring

def scoring_input(spark, sf):
    """Every user message with its prior turns, its edge category and one of the given vectors."""
    rows = threads.bounded_context(t.table(spark, sf, "conversations"))
    n = t.vectors(spark, sf).agg(F.count(F.lit(1))).scalar()
    users = rows.where(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("example_id"),
        F.when(F.col("conv_id") % 13 != 6, F.col("text")).alias("input_text"),
        "prior_turns",
        F.lit(D.STANDARD_CATEGORY).alias("edge_category"),
        ((F.col("conv_id") * 8 + F.col("turn")) % n).alias("vec_id"),
    )
    return users.join(t.vectors(spark, sf).select("vec_id", "embedding"), "vec_id").drop("vec_id")


_OUT = "execution_id, example_id, input_text, clean_text, turn_position, predicted_intent, intent_confidence, retrieved_case_ids, max_retrieval_similarity, generated_reply, grounding_pass, grounding_score, routing_decision, routing_reason, composite_confidence, latency_ms, error"
_SCORING_VIEWS = {
    "inputs": f"""SELECT conv_id * 1000 + turn AS example_id, CASE WHEN conv_id % 13 <> 6 THEN text END AS input_text, pos,
        (conv_id * 8 + turn) % (SELECT count(*) FROM embeddings) AS vec_id, {message_sql('text')} AS clean_text
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations) WHERE role = 'user'""",
    "labelled": f"""SELECT vec_id, CASE WHEN s < {THRESHOLD}::DOUBLE THEN 'Other_Or_Unclear' ELSE CAST(label AS VARCHAR) END AS intent,
        CASE WHEN s < {THRESHOLD}::DOUBLE THEN round_even(1.0::DOUBLE - p, 4) ELSE round_even(p, 4) END AS intent_confidence FROM ({_BEST})""",
    "hits": """SELECT vec_id, rank, case_id, round_even(s, 4) + 0.0::DOUBLE AS similarity FROM (
        SELECT vec_id, case_id, s, row_number() OVER (PARTITION BY vec_id ORDER BY round_even(s, 9) DESC, case_id) AS rank FROM (
            SELECT a.vec_id, b.vec_id AS case_id, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a, embeddings b)) WHERE rank <= 3""",
    "gathered": """SELECT vec_id, string_agg(CAST(h.case_id AS VARCHAR), ',' ORDER BY rank) AS ids, max(CASE WHEN rank = 1 THEN similarity END) AS similarity,
        max(CASE WHEN rank = 1 THEN c.brand_resolution END) AS resolution,
        string_agg(concat('[Historical Case #', CAST(h.case_id AS VARCHAR), ' (Similarity: ', printf('%.2f', similarity), ')]', chr(10),
            'Customer Query: ', c.customer_text, chr(10), 'Support Resolution: ', c.brand_resolution), chr(10) || chr(10) ORDER BY rank) AS evidence
        FROM hits h JOIN cases c ON c.case_id = h.case_id GROUP BY vec_id""",
    "drafted": f"""SELECT i.example_id, i.input_text, i.clean_text, i.pos, l.intent, l.intent_confidence, ids, similarity, evidence, {_template_sql('resolution', 'l.intent')} AS reply,
        CAST(NULL AS VARCHAR) AS answer FROM inputs i JOIN labelled l USING (vec_id) JOIN gathered g USING (vec_id) WHERE i.input_text IS NOT NULL""",
    "audited": "SELECT d.*, v.grounding_pass, v.grounding_score, 'standard' AS category FROM drafted d JOIN ("
    + verdict_sql("drafted", "example_id", "reply", "evidence", "answer")
    + ") v USING (example_id)",
    "routed": route_sql("audited", "*", "intent", "similarity", "category", "input_text", ["3", "7"]).replace(
        ", composite_confidence\n", "\n", 1
    ),
    "outputs": f"""SELECT concat('exec_', substr(md5(CAST(example_id AS VARCHAR)), 1, 8)) AS execution_id, example_id, input_text, clean_text,
        CASE WHEN pos > 1 THEN 'follow_up' ELSE 'first_turn' END AS turn_position, intent AS predicted_intent, intent_confidence, ids AS retrieved_case_ids,
        similarity AS max_retrieval_similarity, reply AS generated_reply, grounding_pass, grounding_score, routing_decision, routing_reason, composite_confidence,
        CAST(NULL AS DOUBLE) AS latency_ms, CAST(NULL AS VARCHAR) AS error FROM routed
        UNION ALL SELECT concat('exec_', substr(md5(CAST(example_id AS VARCHAR)), 1, 8)), example_id, input_text, input_text, 'first_turn', 'Other_Or_Unclear', 0.0::DOUBLE, '', 0.0::DOUBLE,
        {q(D.ERROR_REPLY)}, false, 0.0::DOUBLE, 'ESCALATE', concat({q(D.ERROR_REASON)}, 'missing input_text'), 0.0::DOUBLE, CAST(NULL AS DOUBLE), 'missing input_text'
        FROM inputs WHERE input_text IS NULL""",
}
SETTINGS = message_scoring.ScoringSettings(
    intent_threshold=THRESHOLD, policy=routing.RoutingPolicy(mandatory_intents=("3", "7"))
)


def output_text(done):
    """The output with its list of case ids as text, so that it compares with SQL."""
    ids = F.array_join(F.transform("retrieved_case_ids", lambda i: i.cast("string")), ",")
    return done.withColumn("retrieved_case_ids", ids).select(*message_scoring.OUTPUT)


def scored(spark, sf):
    return output_text(message_scoring.score_messages(scoring_input(spark, sf), fitted(spark, sf), t.cases(spark, sf), SETTINGS))


@query("scored_messages", sql(f"SELECT {_OUT} FROM outputs", **_SCORING_VIEWS))
def _(spark, sf):
    return scored(spark, sf)


@query(
    "scored_error_rows",
    f"""SELECT conv_id * 1000 + turn AS example_id, 'Other_Or_Unclear' AS predicted_intent, 'ESCALATE' AS routing_decision,
    concat({q(D.ERROR_REASON)}, 'missing input_text') AS routing_reason, 'missing input_text' AS error
    FROM conversations WHERE conv_id % 13 = 6""",
)
def _(spark, sf):
    rows = t.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("example_id"),
        F.when(F.col("conv_id") % 13 != 6, F.col("text")).alias("input_text"),
    )
    failed = rows.withColumn("error", message_scoring.invalid_reason(["input_text"])).where(F.col("error").isNotNull())
    return message_scoring.error_rows(failed).select(
        "example_id", "predicted_intent", "routing_decision", "routing_reason", "error"
    )


@query(
    "prediction_cache_join",
    sql(
        """SELECT example_id, CASE WHEN n_chars % 2 = 0 THEN concat('stored ', gold_intent) ELSE concat('fresh ', gold_intent) END AS predicted_intent,
        n_chars % 2 = 0 AS cached FROM gold"""
    ),
)
def _(spark, sf):
    gold = t.gold(spark, sf)
    cache = gold.where(F.col("n_chars") % 2 == 0).select(
        "example_id", F.concat(F.lit("stored "), "gold_intent").alias("predicted_intent")
    )

    store = Snapshots(spark, shared_folder(spark, "predictions"))
    store.write(cache)
    return message_scoring.with_cached_predictions(gold, store, _fresh)


def _fresh(rows):
    return rows.select("example_id", F.concat(F.lit("fresh "), "gold_intent").alias("predicted_intent"))


@query("prediction_cache_second_call", sql("SELECT example_id, concat('fresh ', gold_intent) AS predicted_intent, true AS cached FROM gold"))
def _(spark, sf):
    """What the first call scored is there for the second, which scores nothing."""
    gold, store = t.gold(spark, sf), Snapshots(spark, shared_folder(spark, "predictions"))
    message_scoring.with_cached_predictions(gold, store, _fresh)
    return message_scoring.with_cached_predictions(gold, store, lambda rows: rows.select("example_id", F.lit("scored twice").alias("predicted_intent")))



for _name, _same in (("pipeline_output", "scored_messages"), ("pipeline_error_rows", "scored_error_rows")):
    query(_name, registry.ORACLES[_same])(registry.QUERIES[_same])
