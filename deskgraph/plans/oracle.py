"""The input views and text steps of :mod:`deskgraph.plans.tables` as DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Sequence

from deskgraph.functions.text import SPACE

NOT_WORD = r"[^\p{L}\p{N}_]"
NOT_WORD_LINE = r"[^\p{L}\p{N}_\n]"


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def clean(expr: str, brand: str, aliases: Sequence[str], any_case_url: bool) -> str:
    """Normalised text.  ``brand`` is a SQL expression.

    RE2 has no look-ahead, so handle ends are marked first and the brand gets a sentinel.
    """
    flag = "(?i)" if any_case_url else ""
    step = f"regexp_replace({expr}, {q(flag + 'https?://[^' + SPACE + ']+|www[.][^' + SPACE + ']+')}, '[URL]', 'g')"
    step = f"regexp_replace({step}, '@([a-zA-Z0-9_]+)', concat('@\\1', chr(2)), 'g')"
    step = f"regexp_replace({step}, concat('(?i)@(?:', {brand}, '|{'|'.join(aliases)})', chr(2)), chr(3), 'g')"
    step = f"regexp_replace({step}, concat('@[a-zA-Z0-9_]+', chr(2)), '@customer', 'g')"
    step = f"replace({step}, chr(3), concat('@', {brand}))"
    return squeeze(step)


def squeeze(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '[{SPACE}]+', ' ', 'g'))"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def word_count(expr: str) -> str:
    s = squeeze(expr)
    return f"CASE WHEN {s} = '' THEN 0 ELSE len(string_split({s}, ' ')) END"


def has_word(expr: str, words: str) -> str:
    return f"regexp_matches({expr}, {q(f'(?i)(^|{NOT_WORD})({words})({NOT_WORD}|$)')})"


def has_words_in_line(expr: str, first: str, second: str) -> str:
    """``\\b first \\b .* \\b second \\b`` with a dot that stops at line ends."""
    gap = f"({NOT_WORD_LINE}|{NOT_WORD_LINE}[^\\n]*{NOT_WORD_LINE})"
    return f"regexp_matches({expr}, {q(f'(?i)(^|{NOT_WORD})({first}){gap}({second})({NOT_WORD}|$)')})"


def seeded(seed: int, expr: str) -> str:
    return f"md5(concat('{seed}:', CAST({expr} AS VARCHAR)))"


def pct(num: str, den: str, digits: int) -> str:
    return f"CASE WHEN {den} = 0 THEN 0.0::DOUBLE ELSE round_even(CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) * 100.0::DOUBLE, {digits}) END"


def lookup_case(key: str, table: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items())
    return f"CASE {key} {whens} ELSE {default} END"


VIEWS = {
    "msgs": """
        SELECT conv_id * 1000 + turn AS tweet_id,
               CASE role WHEN 'user' THEN concat('c', CAST(conv_id AS VARCHAR))
                         WHEN 'assistant' THEN concat('brand_', CAST(conv_id % 5 AS VARCHAR))
                         ELSE 'system' END AS author_id,
               (role = 'user' AND conv_id % 11 <> 3) AS inbound,
               concat('turn ', CAST(turn AS VARCHAR)) AS created_at,
               CASE role WHEN 'user' THEN concat('@Brand_', CAST(conv_id % 5 AS VARCHAR), ' ', text)
                         WHEN 'assistant' THEN concat('@c', CAST(conv_id AS VARCHAR), ' ',
                              CASE WHEN conv_id % 6 = 1 THEN 'Sorry, please DM us ' ELSE '' END, text,
                              ' https://t.co/', CAST(turn AS VARCHAR))
                         ELSE text END AS text,
               CASE WHEN role = 'user' THEN CAST(conv_id * 1000 + turn + 1 AS VARCHAR) END AS response_tweet_id,
               CASE WHEN turn = 3 AND conv_id % 7 = 0 THEN conv_id * 1000 + 900
                    WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS in_response_to_tweet_id
        FROM conversations""",
    "pairs": f"""
        SELECT r.author_id AS brand, p.tweet_id AS customer_tweet_id, p.author_id AS customer_author,
               p.created_at AS customer_created_at, p.text AS customer_text_raw,
               p.in_response_to_tweet_id AS customer_parent_id, r.tweet_id AS brand_tweet_id,
               r.created_at AS brand_created_at, r.text AS brand_reply_raw
        FROM msgs r JOIN msgs p ON p.tweet_id = r.in_response_to_tweet_id
        WHERE starts_with(r.author_id, 'brand_') AND p.inbound""",
    "clean_pairs": f"""
        SELECT *, {clean('customer_text_raw', 'brand', ['support', 'help'], False)} AS customer_text_clean,
               {clean('brand_reply_raw', 'brand', ['support', 'help'], False)} AS brand_reply_clean
        FROM pairs""",
    "working": """
        SELECT * EXCLUDE (rn, n, pos),
               CASE WHEN customer_char_len <= (SELECT quantile_cont(customer_char_len, 1.0::DOUBLE/3) FROM kept) THEN 'short'
                    WHEN customer_char_len <= (SELECT quantile_cont(customer_char_len, 2.0::DOUBLE/3) FROM kept) THEN 'medium'
                    ELSE 'long' END AS length_bucket,
               CASE WHEN pos <= floor(n * 0.8::DOUBLE) THEN 'retrieval_pool' ELSE 'held_out_eval_pool' END AS split
        FROM kept""",
    "kept": """
        SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY md5(concat('42:', CAST(brand_tweet_id AS VARCHAR)))) AS pos
        FROM (SELECT *, length(customer_text_clean) AS customer_char_len, customer_parent_id IS NULL AS is_first_turn,
                     row_number() OVER (PARTITION BY customer_text_clean ORDER BY customer_tweet_id, brand_tweet_id) AS rn
              FROM clean_pairs) WHERE rn = 1""",
    "doc_pairs": """
        SELECT source AS brand, doc_id AS customer_tweet_id, concat('author_', lang) AS customer_author,
               text AS customer_text_clean, CASE WHEN doc_id % 3 = 0 THEN doc_id - 1 END AS customer_parent_id,
               doc_id + 1000000000 AS brand_tweet_id,
               concat('Reply from ', source, ' to ', CAST(n_chars AS VARCHAR), ' characters') AS brand_reply_clean,
               lang AS mapped_intent
        FROM documents""",
    "doc_split": """
        SELECT *, CASE WHEN row_number() OVER (ORDER BY md5(concat('42:', CAST(customer_tweet_id AS VARCHAR)))) <= floor(count(*) OVER () * 0.8::DOUBLE)
                       THEN 'retrieval_pool' ELSE 'held_out_eval_pool' END AS split
        FROM doc_pairs""",
    "cases": """
        SELECT e.vec_id AS case_id, a.text AS customer_text, concat('@customer ', b.text) AS brand_resolution, e.embedding
        FROM embeddings e JOIN documents a ON a.doc_id = e.vec_id % (SELECT count(*) FROM documents)
        JOIN documents b ON b.doc_id = (e.vec_id + 1) % (SELECT count(*) FROM documents)""",
    "centroids": """
        SELECT label, list(m / norm ORDER BY pos) AS centroid
        FROM (SELECT label, pos, m, sqrt(sum(m * m) OVER (PARTITION BY label)) AS norm
              FROM (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m
                    FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
                    GROUP BY label, pos))
        GROUP BY label""",
    "sims": """
        SELECT e.vec_id, c.label, list_inner_product(CAST(e.embedding AS DOUBLE[]), c.centroid) AS sim
        FROM embeddings e, centroids c""",
    "gold": """
        SELECT d.doc_id AS example_id, d.text AS customer_text, d.lang AS gold_intent,
               CASE WHEN l.toxic = 1 OR l.quality = 0 THEN 'ESCALATE' ELSE 'AUTO_HANDLE' END AS gold_routing_decision,
               CASE WHEN d.n_chars < 300 THEN 'low_info_vague' WHEN l.toxic = 1 THEN 'safety_legal_escalate' ELSE 'standard' END AS edge_case_category,
               CASE WHEN d.n_chars < 400 THEN 'short' WHEN d.n_chars < 1500 THEN 'medium' ELSE 'long' END AS length_bucket,
               CASE WHEN d.doc_id % 3 = 0 THEN 'follow_up' ELSE 'first_turn' END AS turn_position,
               d.n_chars
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
    "preds": """
        SELECT 'trivial_baseline' AS system_name, example_id, 'en' AS predicted_intent, 'auto_handle' AS routing_decision,
               TRUE AS grounding_pass, 0.5::DOUBLE AS grounding_score, 0.0::DOUBLE AS latency_ms FROM gold
        UNION ALL SELECT 'simple_ml_baseline', example_id, CASE WHEN example_id % 4 = 0 THEN 'fr' ELSE gold_intent END,
               CASE WHEN n_chars % 5 = 0 THEN 'escalate' ELSE 'auto_handle' END, example_id % 9 <> 0, 1.0::DOUBLE,
               CAST(n_chars % 50 AS DOUBLE) / 10 FROM gold
        UNION ALL SELECT 'proposed_system', example_id, CASE WHEN example_id % 10 = 0 THEN 'other' ELSE gold_intent END,
               CASE WHEN gold_routing_decision = 'ESCALATE' OR n_chars % 3 = 0 THEN 'ESCALATE' ELSE 'AUTO_HANDLE' END,
               example_id % 20 <> 0, 0.95::DOUBLE, CAST(n_chars % 400 AS DOUBLE) / 4 FROM gold""",
    "joined": """
        SELECT p.system_name, CAST(p.example_id AS VARCHAR) AS example_id, g.gold_intent AS true_intent, p.predicted_intent AS pred_intent,
               lower(g.gold_routing_decision) AS true_action, lower(p.routing_decision) AS pred_action,
               g.edge_case_category AS edge_category, p.grounding_pass, p.grounding_score, p.latency_ms
        FROM preds p JOIN gold g ON g.example_id = p.example_id""",
    "label_counts": """
        SELECT system_name, label, CAST(sum(t) AS DOUBLE) AS t, CAST(sum(p) AS DOUBLE) AS p, CAST(sum(tp) AS DOUBLE) AS tp
        FROM (SELECT system_name, true_intent AS label, 1 AS t, 0 AS p, CASE WHEN true_intent = pred_intent THEN 1 ELSE 0 END AS tp FROM joined
              UNION ALL SELECT system_name, pred_intent, 0, 1, 0 FROM joined)
        GROUP BY system_name, label""",
    "f1s": """
        SELECT system_name, label, t, p, tp,
               CASE WHEN p = 0 THEN 0.0::DOUBLE ELSE tp / p END AS prec,
               CASE WHEN t = 0 THEN 0.0::DOUBLE ELSE tp / t END AS rec,
               CASE WHEN t + p = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * tp / (t + p) END AS f1
        FROM label_counts""",
    "macro": """
        SELECT system_name, round_even(sum(tp) / sum(t), 4) AS accuracy, round_even(avg(f1), 4) AS macro_f1 FROM f1s GROUP BY system_name""",
    "esc": """
        SELECT system_name, tp, fp, fn, tn, prec, rec,
               CASE WHEN prec + rec = 0 THEN 0.0::DOUBLE ELSE (2.0::DOUBLE * (prec * rec)) / (prec + rec) END AS f1
        FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS prec,
                        CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS rec
              FROM (SELECT system_name,
                           count(*) FILTER (true_action = 'escalate' AND pred_action = 'escalate') AS tp,
                           count(*) FILTER (true_action <> 'escalate' AND pred_action = 'escalate') AS fp,
                           count(*) FILTER (true_action = 'escalate' AND pred_action <> 'escalate') AS fn,
                           count(*) FILTER (true_action <> 'escalate' AND pred_action <> 'escalate') AS tn
                    FROM joined GROUP BY system_name))""",
    "grounded": """
        SELECT system_name, round_even(CAST(count(*) FILTER (grounding_pass) AS DOUBLE) / count(*), 4) AS grounding_pass_rate,
               round_even(avg(grounding_score), 4) AS mean_grounding_score
        FROM joined GROUP BY system_name""",
    "autonomy": """
        SELECT system_name, total AS auto_handle_count,
               CASE WHEN total > 0 THEN valid END AS valid_resolvable_count,
               CASE WHEN total > 0 THEN total - valid END AS unsafe_auto_handled_count,
               CASE WHEN total > 0 THEN round_even(CAST(valid AS DOUBLE) / total, 4) ELSE 0.0::DOUBLE END AS autonomy_resolvability_rate
        FROM (SELECT system_name, count(*) FILTER (pred_action = 'auto_handle') AS total,
                     count(*) FILTER (pred_action = 'auto_handle' AND true_action = 'auto_handle') AS valid
              FROM joined GROUP BY system_name)""",
    "latency": """
        SELECT system_name, round_even(sum(latency_ms) / count(*), 2) AS mean_ms,
               round_even(quantile_cont(latency_ms, 0.5), 2) AS p50_ms, round_even(quantile_cont(latency_ms, 0.95), 2) AS p95_ms
        FROM joined GROUP BY system_name""",
    "report": """
        SELECT e.system_name, e.tp + e.fp + e.fn + e.tn AS sample_count, m.accuracy, m.macro_f1,
               round_even(CAST(e.tp + e.tn AS DOUBLE) / (e.tp + e.fp + e.fn + e.tn), 4) AS escalation_accuracy,
               round_even(e.prec, 4) AS escalation_precision, round_even(e.rec, 4) AS escalation_recall, round_even(e.f1, 4) AS escalation_f1,
               e.tp, e.fp, e.fn, e.tn, a.auto_handle_count, a.valid_resolvable_count, a.unsafe_auto_handled_count,
               a.autonomy_resolvability_rate, g.grounding_pass_rate, g.mean_grounding_score,
               l.mean_ms, l.p50_ms, l.p95_ms,
               round_even(0.35::DOUBLE * m.macro_f1 + 0.35::DOUBLE * round_even(e.f1, 4) + 0.3::DOUBLE * g.grounding_pass_rate, 4) AS composite_reliability
        FROM esc e JOIN macro m USING (system_name) JOIN autonomy a USING (system_name) JOIN grounded g USING (system_name) JOIN latency l USING (system_name)""",
    "judge_wide": """
        SELECT *, round_even(CAST(grounding + relevance + helpfulness + tone_fit + conciseness AS DOUBLE) / 5.0::DOUBLE, 2) AS overall_score
        FROM (SELECT example_id, 1 + example_id % 5 AS grounding, 1 + (example_id + n_chars) % 5 AS relevance,
                     CAST(4 AS BIGINT) AS helpfulness, 5 - example_id % 2 AS tone_fit, 1 + n_chars % 5 AS conciseness FROM gold)""",
    "human_wide": """
        SELECT example_id, 1 + (example_id % 5 + n_chars % 2) % 5 AS grounding, 1 + (example_id + n_chars % 3) % 5 AS relevance,
               3 + example_id % 3 AS helpfulness, 5 - example_id % 3 AS tone_fit, 1 + (n_chars + example_id % 2) % 5 AS conciseness,
               CAST(2 + example_id % 4 AS DOUBLE) + 0.5::DOUBLE AS overall FROM gold""",
    "ratings": " UNION ALL ".join(
        f"SELECT j.example_id, '{d}' AS dim, CAST(j.{jc} AS DOUBLE) AS judge, CAST(h.{d} AS DOUBLE) AS human "
        "FROM judge_wide j JOIN human_wide h USING (example_id)"
        for d, jc in [
            ("grounding", "grounding"),
            ("relevance", "relevance"),
            ("helpfulness", "helpfulness"),
            ("tone_fit", "tone_fit"),
            ("conciseness", "conciseness"),
            ("overall", "overall_score"),
        ]
    ),
    "ranked": """
        SELECT *, rank() OVER (PARTITION BY dim ORDER BY judge) + (count(*) OVER (PARTITION BY dim, judge) - 1) / 2.0::DOUBLE AS rj,
               rank() OVER (PARTITION BY dim ORDER BY human) + (count(*) OVER (PARTITION BY dim, human) - 1) / 2.0::DOUBLE AS rh
        FROM ratings""",
    "rho": """
        SELECT dim, count(*) AS n, CASE WHEN stddev_pop(rj) > 0 AND stddev_pop(rh) > 0 THEN round_even(corr(rj, rh), 4) END AS raw FROM ranked GROUP BY dim""",
    "kappas": """
        SELECT dim, CASE WHEN pe = 1 THEN 0.6::DOUBLE ELSE round_even((po - pe) / (1 - pe), 4) END AS kappa
        FROM (SELECT dim, avg(CASE WHEN (judge >= 4) = (human >= 4) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS po,
                     avg(CASE WHEN judge >= 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * avg(CASE WHEN human >= 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
                   + avg(CASE WHEN judge < 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * avg(CASE WHEN human < 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS pe
              FROM ratings GROUP BY dim)""",
    "route_in": """
        SELECT example_id, customer_text AS raw_text, gold_intent AS intent, CAST(n_chars % 101 AS DOUBLE) / 100 AS intent_confidence,
               CAST(30 + example_id % 70 AS DOUBLE) / 100 AS retrieval_similarity, example_id % 12 <> 0 AS grounding_pass,
               CAST(60 + n_chars % 41 AS DOUBLE) / 100 AS grounding_score, edge_case_category FROM gold""",
    "claims": """
        SELECT a.doc_id, concat(a.text, ' We refund $', CAST(a.n_chars % 7 AS VARCHAR)) AS reply_text,
               CASE WHEN b.doc_id IS NULL THEN '' ELSE concat(b.text, ' Past case $', CAST(b.doc_id % 7 AS VARCHAR), ' and 5 dollars') END AS evidence_text,
               CASE WHEN a.n_chars % 4 <> 0 THEN concat('{"grounding_pass": ', CASE WHEN a.n_chars % 3 = 0 THEN 'false' ELSE 'true' END,
                    ', "grounding_score": 0.', CAST(a.n_chars % 40 + 60 AS VARCHAR), '}')
                    ELSE [NULL, 'not json', '[1, 2]', '{"grounding_score": "high"}', '{"grounding_score": null}'][(a.doc_id % 5 + 1)::INT] END AS answer
        FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id - 1""",
}

def sql(body: str, **extra: str) -> str:
    """``body`` with every view it mentions put in front, each after those it reads."""
    views = {**VIEWS, **extra}
    placed: list[str] = []

    def place(text: str) -> None:
        words = set(re.findall(r"[a-z_0-9]+", text.lower()))
        for name in views:
            if name in words and name not in placed and views[name] is not text:
                place(views[name])
                if name not in placed:
                    placed.append(name)

    place(body)
    if not placed:
        return body
    heads = ",\n".join(f"{name} AS ({views[name]})" for name in placed)
    return f"WITH {heads}\n{body}"
