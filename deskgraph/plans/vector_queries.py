"""Vectors, intents, retrieval and term weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from deskgraph import defaults as D
from deskgraph.functions import rules
from deskgraph.functions.numeric import round_dp
from deskgraph.operators import baselines, case_index, clusters, intent, retrieval, tfidf, vectors
from deskgraph.operators.encoder import TextEncoder
from deskgraph.plans import tables as t
from deskgraph.plans.oracle import has_word, has_words_in_line, pct, q, seeded, sql
from deskgraph.plans.registry import query
from deskgraph.session import materialise, shared_folder

# Settings that fit the invented vectors and prose, so that every branch is taken.
THRESHOLD = 0.25
PATTERNS = {
    "Articles": r"\b(the|and)\b.*\b(with|for)\b",
    "French": r"\b(les|des|pour)\b",
    "German": r"\b(und|der|nicht)\b",
    "Spanish": r"\b(que|los|una)\b",
}
PATTERN_SQL = {
    "Articles": lambda x: has_words_in_line(x, "the|and", "with|for"),
    "French": lambda x: has_word(x, "les|des|pour"),
    "German": lambda x: has_word(x, "und|der|nicht"),
    "Spanish": lambda x: has_word(x, "que|los|una"),
}


STOPS = ("the", "and", "of", "to", "that", "les", "des", "que", "und", "der", "die", "los", "una")


def first_match_sql(expr: str) -> str:
    whens = " ".join(f"WHEN {test(expr)} THEN {q(label)}" for label, test in PATTERN_SQL.items())
    return f"CASE {whens} ELSE 'Other_Or_Unclear' END"


def fitted(spark, sf) -> vectors.Centroids:
    return vectors.Centroids.fit(vectors.prototype_centroids(t.vectors(spark, sf)))


# ------------------------------------------------------------------ centroids

@query(
    "prototype_centroids",
    sql(
        "SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round_even(x, 6) + 0.0::DOUBLE AS value FROM "
        "(SELECT label, unnest(centroid) AS x, generate_subscripts(centroid, 1) AS pos FROM centroids)"
    ),
)
def _(spark, sf):
    centroids = vectors.prototype_centroids(t.vectors(spark, sf))
    return centroids.select("label", F.posexplode("centroid").alias("pos", "x")).select(
        "label", "pos", round_dp(F.col("x"), 6).alias("value")
    )


@query("cosine_scores", sql("SELECT vec_id, label, round_even(sim, 4) + 0.0::DOUBLE AS similarity FROM sims"))
def _(spark, sf):
    rows = t.vectors(spark, sf).select("vec_id", "embedding")
    return intent.cosine_scores(rows, fitted(spark, sf)).select(
        "vec_id", "label", round_dp(F.col("similarity"), 4).alias("similarity")
    )


_PROBS = "SELECT vec_id, label, sim, exp(sim * 5.0::DOUBLE) / sum(exp(sim * 5.0::DOUBLE)) OVER (PARTITION BY vec_id) AS p FROM sims"
_BEST = f"""SELECT vec_id, max(sim) AS s, arg_max(label, sim) AS label, arg_max(p, sim) AS p,
    string_agg(concat(CAST(label AS VARCHAR), '=', CAST(round_even(p, 4) AS VARCHAR)), ';' ORDER BY label) AS scores FROM ({_PROBS}) GROUP BY vec_id"""


@query("softmax_calibration", sql(f"SELECT vec_id, label, round_even(p, 4) AS probability FROM ({_PROBS})"))
def _(spark, sf):
    rows = t.vectors(spark, sf).select("vec_id", "embedding")
    scored = intent.softmax_calibration(rows, fitted(spark, sf))
    return scored.select("vec_id", F.explode("all_scores").alias("label", "probability"))


@query(
    "nearest_centroid_classify",
    sql(
        f"""SELECT vec_id, CASE WHEN s < {THRESHOLD}::DOUBLE THEN 'Other_Or_Unclear' ELSE CAST(label AS VARCHAR) END AS intent,
        CASE WHEN s < {THRESHOLD}::DOUBLE THEN round_even(1.0::DOUBLE - p, 4) ELSE round_even(p, 4) END AS intent_confidence,
        s < {THRESHOLD}::DOUBLE AS is_fallback, label AS nearest_intent FROM ({_BEST})"""
    ),
)
def _(spark, sf):
    rows = t.vectors(spark, sf).select("vec_id", "embedding")
    return intent.nearest_centroid_classify(rows, fitted(spark, sf), threshold=THRESHOLD).select(
        "vec_id", "intent", "intent_confidence", "is_fallback", "nearest_intent"
    )


@query(
    "centroid_batch_label",
    sql(
        f"""SELECT vec_id, CASE WHEN s >= {THRESHOLD}::DOUBLE THEN CAST(label AS VARCHAR) ELSE 'Other_Or_Unclear' END AS mapped_intent,
        CAST(label AS VARCHAR) AS nearest_intent, round_even(s, 4) + 0.0::DOUBLE AS similarity_score FROM ({_BEST})"""
    ),
)
def _(spark, sf):
    rows = t.vectors(spark, sf).select("vec_id", "embedding")
    return intent.centroid_batch_label(rows, fitted(spark, sf), threshold=THRESHOLD).select(
        "vec_id", "mapped_intent", "nearest_intent", round_dp(F.col("similarity_score"), 4).alias("similarity_score")
    )


@query("keyword_first_match", f"SELECT doc_id, {first_match_sql('text')} AS predicted_intent FROM documents")
def _(spark, sf):
    return t.table(spark, sf, "documents").select(
        "doc_id", rules.keyword_first_match(F.col("text"), PATTERNS).alias("predicted_intent")
    )


_SAMPLE_DOCS = f"(SELECT doc_id, {first_match_sql('text')} AS label FROM documents ORDER BY {seeded(123, 'doc_id')}, doc_id LIMIT 100)"
_SAMPLE_VECS = f"""(SELECT vec_id, CASE WHEN s < {THRESHOLD}::DOUBLE THEN 'Other_Or_Unclear' ELSE CAST(label AS VARCHAR) END AS label,
    CAST(label AS VARCHAR) AS nearest, s FROM ({_BEST}) ORDER BY {seeded(123, 'vec_id')}, vec_id LIMIT 100)"""


def _coverage_sql(sample: str) -> str:
    other = "count(*) FILTER (label = 'Other_Or_Unclear')"
    return f"""SELECT count(*) AS sample_size, {other} AS other_count, {pct(other, 'count(*)', 1)} AS other_pct,
        round_even(100.0::DOUBLE - {pct(other, 'count(*)', 1)}, 1) AS coverage_rate FROM {sample}"""


def _doc_coverage(spark, sf):
    return intent.taxonomy_coverage(t.table(spark, sf, "documents"), "text", "doc_id", patterns=PATTERNS)


def _vector_coverage(spark, sf):
    rows = t.vectors(spark, sf).select("vec_id", "embedding")
    return intent.semantic_coverage(rows, fitted(spark, sf), "vec_id", threshold=THRESHOLD)


@query("taxonomy_coverage", _coverage_sql(_SAMPLE_DOCS))
def _(spark, sf):
    return _doc_coverage(spark, sf)["summary"]


@query("taxonomy_coverage_counts", f"SELECT label AS predicted_intent, count(*) AS n FROM {_SAMPLE_DOCS} GROUP BY label")
def _(spark, sf):
    return _doc_coverage(spark, sf)["counts"]


@query("semantic_coverage", sql(_coverage_sql(_SAMPLE_VECS)))
def _(spark, sf):
    return _vector_coverage(spark, sf)["summary"]


@query(
    "semantic_coverage_examples",
    sql(
        f"""SELECT vec_id, label AS assigned_intent, nearest AS nearest_intent, round_even(s, 4) + 0.0::DOUBLE AS similarity_score
        FROM {_SAMPLE_VECS} ORDER BY {seeded(123, 'vec_id')}, vec_id LIMIT 25"""
    ),
)
def _(spark, sf):
    return _vector_coverage(spark, sf)["examples"]


# ------------------------------------------------------------------- clusters

def _clusterings(spark, sf):
    return clusters.fit(t.vectors(spark, sf), D.CLUSTER_COUNTS)


@query("kmeans_scan")
def _(spark, sf):
    return clusters.scan(_clusterings(spark, sf), t.vectors(spark, sf))


@query("cluster_assign")
def _(spark, sf):
    """Sizes under the k that the scan finds best."""
    best = clusters.best_of(_clusterings(spark, sf))
    return intent.cluster_sizes(clusters.assign(t.vectors(spark, sf), best))


@query(
    "kmeans_scan_verified",
    f"""SELECT k, (SELECT count(*) FROM embeddings) AS n, true AS every_row_is_nearest, true AS inertia_is_that_of_the_rows, true AS centres_are_means
    FROM (VALUES {", ".join(f"(CAST({k} AS BIGINT))" for k in D.CLUSTER_COUNTS)}) AS v(k)""",
)
def _(spark, sf):
    """What holds of settled clusterings, worked out again from the rows' assignment by column expressions."""
    rows, checked = t.vectors(spark, sf), []
    for m in _clusterings(spark, sf):
        centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in m.centres])
        gap = F.transform(centres, lambda c: F.aggregate(F.zip_with("x", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v))
        placed = clusters.assign(rows, m).select("cluster", F.col("embedding").cast("array<double>").alias("x")).withColumn("gaps", gap)
        own = F.get("gaps", F.col("cluster"))
        # means of what a cluster holds lie no further from its centre than the last step moved
        spread = placed.select("cluster", F.posexplode("x").alias("pos", "v")).groupBy("cluster", "pos").agg(F.avg("v").alias("mean"))
        moved = spread.select(F.pow(F.col("mean") - F.get(F.get(centres, F.col("cluster")), F.col("pos")), F.lit(2)).alias("d")).agg(F.sum("d").alias("d"))
        told = placed.agg(
            F.count(F.lit(1)).alias("n"), F.bool_and(own <= F.array_min("gaps") + F.lit(1e-9)).alias("every_row_is_nearest"), F.sum(own).alias("inertia")
        )
        checked.append(
            told.withColumn("d", moved.scalar()).select(
                F.lit(m.k).cast("bigint").alias("k"),
                "n",
                "every_row_is_nearest",
                (F.abs(F.col("inertia") - F.lit(m.inertia)) <= 1e-6 * F.col("inertia")).alias("inertia_is_that_of_the_rows"),
                (F.col("d") <= F.lit(1e-3)).alias("centres_are_means"),
            )
        )
    return reduce(lambda a, b: a.unionByName(b), checked)


@query(
    "cluster_sizes",
    f"SELECT label AS cluster, count(*) AS size, {pct('count(*)', '(SELECT count(*) FROM embeddings)', 1)} AS percentage FROM embeddings GROUP BY label",
)
def _(spark, sf):
    return intent.cluster_sizes(t.vectors(spark, sf).withColumnRenamed("label", "cluster"))


@query(
    "cluster_representatives",
    sql(
        """SELECT cluster, rank, vec_id, round_even(d, 4) AS distance FROM (
        SELECT cluster, vec_id, d, CAST(row_number() OVER (PARTITION BY cluster ORDER BY round_even(d, 9), vec_id) AS INTEGER) AS rank FROM (
            SELECT e.label AS cluster, e.vec_id, sqrt(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))
                - 2 * list_inner_product(CAST(e.embedding AS DOUBLE[]), c.m) + list_inner_product(c.m, c.m)) AS d
            FROM embeddings e JOIN (SELECT label, list(m ORDER BY pos) AS m FROM (
                SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos)
                GROUP BY label) c ON c.label = e.label)) WHERE rank <= 10"""
    ),
)
def _(spark, sf):
    rows = t.vectors(spark, sf)
    means = vectors.Centroids.fit(vectors.prototype_centroids(rows, unit=False))
    near = intent.cluster_representatives(rows.withColumnRenamed("label", "cluster"), means, "vec_id")
    return near.withColumn("distance", round_dp(F.col("distance"), 4))


# ------------------------------------------------------------------- TF-IDF

def terms_sql(expr: str) -> str:
    stops = "[" + ", ".join(q(w) for w in STOPS) + "]"
    return f"list_filter(regexp_extract_all(lower({expr}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({stops}, w))"


def terms_from(rows: str, ngrams: int = 1) -> str:
    """id and term of ``rows(id, text)``; for ``ngrams=2`` also the pairs of words, from words that are found once."""
    if ngrams == 1:
        return f"SELECT id, unnest({terms_sql('text')}) AS term FROM {rows}"
    pairs = "list_transform(range(1, len(kept)), lambda i: concat(kept[i], ' ', kept[i + 1]))"
    return f"SELECT id, unnest(list_concat(kept, {pairs})) AS term FROM (SELECT id, {terms_sql('text')} AS kept FROM {rows})"


def weight_views(rows: str, features: int, prefix: str, ngrams: int = 1) -> dict[str, str]:
    """Counts, vocabulary and weights of ``rows(id, text)`` as views named ``prefix`` plus a suffix."""
    p = prefix
    return {
        f"{p}rows": rows,
        f"{p}counts": f"SELECT id, term, count(*) AS tf FROM ({terms_from(f'{p}rows', ngrams)}) GROUP BY id, term",
        f"{p}vocab": f"""SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM {p}rows)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf
            FROM (SELECT term, sum(tf) AS total, count(*) AS df FROM {p}counts GROUP BY term ORDER BY total DESC, term LIMIT {features})""",
        f"{p}weights": f"""SELECT id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS w
            FROM {p}counts JOIN {p}vocab USING (term)""",
    }


@query(
    "tfidf_weights",
    sql(
        "SELECT id AS doc_id, term, round_even(w, 6) AS weight FROM dweights",
        **weight_views("SELECT doc_id AS id, text FROM documents", 5000, "d"),
    ),
)
def _(spark, sf):
    weights = tfidf.tfidf_weights(t.table(spark, sf, "documents"), "doc_id", "text", stops=STOPS)
    return weights.withColumn("weight", round_dp(F.col("weight"), 6))


@query(
    "cluster_keywords",
    sql(
        """SELECT cluster, rank, term, round_even(m, 6) AS mean_weight FROM (
        SELECT cluster, term, m, CAST(row_number() OVER (PARTITION BY cluster ORDER BY round_even(m, 9) DESC, term) AS INTEGER) AS rank FROM (
            SELECT d.lang AS cluster, term, sum(w) / (SELECT count(*) FROM documents x WHERE x.lang = d.lang) AS m
            FROM dweights JOIN documents d ON d.doc_id = id GROUP BY d.lang, term)) WHERE rank <= 8""",
        **weight_views("SELECT doc_id AS id, text FROM documents", 500, "d"),
    ),
)
def _(spark, sf):
    docs = t.table(spark, sf, "documents").withColumnRenamed("lang", "cluster")
    return tfidf.cluster_keywords(docs, "doc_id", "text", stops=STOPS).withColumn("mean_weight", round_dp(F.col("mean_weight"), 6))


def _encoded_views(prefix: str, counts: str) -> dict[str, str]:
    """Places and unit vectors of a table of term counts, under the idf of the documents."""
    p = prefix
    return {
        f"{p}places": f"""SELECT id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 256 AS pos,
            sum(CASE WHEN substr(md5(term), 9, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * tf * coalesce(idf, ln(1.0::DOUBLE + (SELECT count(*) FROM documents)) + 1.0::DOUBLE)) AS x
            FROM {counts} LEFT JOIN dvocab USING (term) GROUP BY ALL""",
        f"{p}unit": f"""SELECT id, pos, x / n AS x FROM (SELECT id, pos, x, sqrt(sum(x * x) OVER (PARTITION BY id)) AS n FROM {p}places) WHERE n > 0""",
    }


_ENCODED = weight_views("SELECT doc_id AS id, text FROM documents", 5000, "d") | _encoded_views("v", "dcounts")


def _encoder(spark, sf):
    """Fitted on the documents, stored and opened again."""
    path = shared_folder(spark, "encoder")
    TextEncoder.fit(t.table(spark, sf, "documents"), stops=STOPS).save(spark, path)
    return TextEncoder.open(spark, path)


@query(
    "text_vectorize",
    sql("SELECT id AS doc_id, CAST(pos AS INTEGER) AS pos, round_even(x, 6) + 0.0::DOUBLE AS value FROM vunit WHERE round_even(x, 6) <> 0", **_ENCODED),
)
def _(spark, sf):
    done = _encoder(spark, sf).apply(t.table(spark, sf, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.posexplode("embedding").alias("pos", "x")).select("doc_id", "pos", round_dp(F.col("x"), 6).alias("value")).where("value <> 0")


_TEXT_THRESHOLD = 0.3


@query(
    "classify_text",
    sql(
        f"""SELECT conv_id * 1000 + turn AS example_id, CASE WHEN s >= {_TEXT_THRESHOLD}::DOUBLE THEN label ELSE 'Other_Or_Unclear' END AS intent,
        CASE WHEN s IS NULL THEN 0.0::DOUBLE WHEN s >= {_TEXT_THRESHOLD}::DOUBLE THEN round_even(p, 4) ELSE round_even(1.0::DOUBLE - p, 4) END AS intent_confidence,
        coalesce(s < {_TEXT_THRESHOLD}::DOUBLE, true) AS is_fallback
        FROM conversations LEFT JOIN (
            SELECT id, label, s, exp(5.0::DOUBLE * s) / sum(exp(5.0::DOUBLE * s)) OVER (PARTITION BY id) AS p, row_number() OVER (PARTITION BY id ORDER BY s DESC, label) AS rn
            FROM (SELECT id, label, coalesce(sum(u.x * c.x), 0.0::DOUBLE) AS s
                FROM (SELECT DISTINCT id, label FROM wunit, (SELECT DISTINCT label FROM protos)) LEFT JOIN wunit u USING (id) LEFT JOIN protos c USING (label, pos) GROUP BY id, label))
            ON id = conv_id * 1000 + turn AND rn = 1""",
        **_ENCODED,
        asks="SELECT conv_id * 1000 + turn AS id, CASE WHEN conv_id % 13 <> 6 THEN text END AS text FROM conversations",
        acounts=f"SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({terms_sql('text')}) AS term FROM asks) GROUP BY id, term",
        **_encoded_views("w", "acounts"),
        protos="""SELECT label, pos, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM (SELECT lang AS label, pos, sum(x) AS x FROM vunit JOIN documents ON doc_id = id GROUP BY lang, pos)""",
    ),
)
def _(spark, sf):
    """Raw messages to intents: encoder and centroids from documents, blank messages included."""
    encoder = _encoder(spark, sf)
    model = encoder.centroids(t.table(spark, sf, "documents"), "lang")
    asked = t.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("example_id"), F.when(F.col("conv_id") % 13 != 6, F.col("text")).alias("text")
    )
    done = intent.nearest_centroid_classify(encoder.apply(asked), model, text="text", threshold=_TEXT_THRESHOLD)
    return done.select("example_id", "intent", "intent_confidence", "is_fallback")


@query(
    "tfidf_features",
    sql(
        """SELECT r.id AS doc_id, count(w) AS non_zero, round_even(coalesce(sum(w), 0.0::DOUBLE), 4) + 0.0::DOUBLE AS total
        FROM frows r LEFT JOIN fweights w ON w.id = r.id GROUP BY r.id""",
        **weight_views("SELECT doc_id AS id, text FROM documents", 5000, "f", 2),
    ),
)
def _(spark, sf):
    from pyspark.ml.functions import vector_to_array

    done = tfidf.tfidf_features(t.table(spark, sf, "documents").select("doc_id", "text"), "text", stops=STOPS)
    values = done.select("doc_id", F.filter(vector_to_array("features"), lambda x: x != 0).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return values.select("doc_id", F.size("v").cast("bigint").alias("non_zero"), round_dp(total, 4).alias("total"))



# ---------------------------------------------------------------- retrieval

_TOPK = """SELECT query_id, rank, case_id, round_even(s, 4) + 0.0::DOUBLE AS similarity FROM (
    SELECT query_id, case_id, s, row_number() OVER (PARTITION BY query_id ORDER BY round_even(s, 9) DESC, case_id) AS rank FROM (
        SELECT a.vec_id AS query_id, b.vec_id AS case_id, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s
        FROM embeddings a, embeddings b)) WHERE rank <= 3"""


def _found(spark, sf):
    rows = t.vectors(spark, sf)
    return retrieval.topk_similar_cases(
        rows.select(F.col("vec_id").alias("query_id"), "embedding"), rows.select(F.col("vec_id").alias("case_id"), "embedding")
    )


@query("topk_similar_cases", sql(_TOPK))
def _(spark, sf):
    return _found(spark, sf)


@query(
    "topk_similar_cases_in_blocks",
    sql(_TOPK),
)
def _(spark, sf):
    rows = t.vectors(spark, sf)
    found = case_index.topk_similar(
        rows.select(F.col("vec_id").alias("query_id"), "embedding"),
        rows.select(F.col("vec_id").alias("case_id"), "embedding"),
        cell_rows=64,
    )
    return found.select("query_id", "rank", "case_id", round_dp(F.col("similarity"), 4).alias("similarity"))


@query("case_index_roundtrip", sql(_TOPK))
def _(spark, sf):
    """An index written by one program and opened by another finds what a search without one finds."""
    path = shared_folder(spark, "case-index")
    rows = t.vectors(spark, sf)
    case_index.CaseIndex.build(rows, path, case_id="vec_id", cell_rows=256, with_cases=True)
    index = case_index.CaseIndex.open(spark, path)
    found = retrieval.topk_similar_cases(rows.select(F.col("vec_id").alias("query_id"), "embedding"), index)
    return found.select("query_id", "rank", "case_id", "similarity")


@query("max_similarity", sql(f"SELECT query_id, similarity AS max_similarity FROM ({_TOPK}) WHERE rank = 1"))
def _(spark, sf):
    queries = t.vectors(spark, sf).select(F.col("vec_id").alias("query_id"))
    best = _found(spark, sf).groupBy("query_id").agg(F.max("similarity").alias("max_similarity"))
    return queries.join(best, "query_id", "left").select(
        "query_id", F.coalesce("max_similarity", F.lit(0.0)).alias("max_similarity")
    )


@query(
    "retrieved_ids",
    sql(
        f"SELECT query_id, string_agg(CAST(case_id AS VARCHAR), ',' ORDER BY rank) AS retrieved_case_ids FROM ({_TOPK}) GROUP BY query_id"
    ),
)
def _(spark, sf):
    found = _found(spark, sf)
    ranked = F.sort_array(F.collect_list(F.struct("rank", "case_id")))
    return found.groupBy("query_id").agg(
        F.array_join(F.transform(ranked, lambda c: c["case_id"].cast("string")), ",").alias("retrieved_case_ids")
    )


@query(
    "evidence_text",
    sql(
        f"""SELECT query_id, max(CASE WHEN rank = 1 THEN similarity END) AS max_similarity,
        string_agg(concat('[Historical Case #', CAST(k.case_id AS VARCHAR), ' (Similarity: ', printf('%.2f', similarity), ')]', chr(10),
            'Customer Query: ', c.customer_text, chr(10), 'Support Resolution: ', c.brand_resolution), chr(10) || chr(10) ORDER BY rank) AS evidence_text
        FROM ({_TOPK}) k JOIN cases c ON c.case_id = k.case_id GROUP BY query_id"""
    ),
)
def _(spark, sf):
    queries = t.vectors(spark, sf).select(F.col("vec_id").alias("query_id"), "embedding")
    found = retrieval.topk_similar_cases(queries, t.cases(spark, sf))
    return retrieval.with_evidence(queries, found).select("query_id", "max_similarity", "evidence_text")


_NEAREST_VIEWS = {
    **weight_views("SELECT case_id AS id, customer_text AS text FROM tcases", 5000, "c"),
    "tcases": "SELECT brand_tweet_id AS case_id, customer_text_clean AS customer_text, brand_reply_clean AS brand_resolution FROM clean_pairs",
    "asked": "SELECT tweet_id AS id, text FROM msgs WHERE inbound",
    "qcounts": f"SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({terms_sql('text')}) AS term FROM asked) GROUP BY id, term",
    "qweights": "SELECT id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS w FROM qcounts JOIN cvocab USING (term)",
    "nearest": """SELECT id, case_id, s FROM (
        SELECT id, case_id, s, row_number() OVER (PARTITION BY id ORDER BY round_even(s, 9) DESC, case_id) AS rn FROM (
            SELECT a.id, b.id AS case_id, sum(a.w * b.w) AS s FROM qweights a JOIN cweights b USING (term) GROUP BY a.id, b.id)) WHERE rn = 1""",
}


def text_corpus(spark, sf):
    """Past pairs as cases, keyed by the reply, which is unique."""
    from deskgraph.operators import corpus

    pairs = corpus.normalize_pairs(corpus.reply_pairs(t.messages(spark, sf), t.is_brand()))
    cases = pairs.select(
        F.col("brand_tweet_id").alias("case_id"),
        F.col("customer_text_clean").alias("customer_text"),
        F.col("brand_reply_clean").alias("brand_resolution"),
    )
    return materialise(cases, "cases")


@query(
    "verbatim_nearest_reply",
    sql(
        """SELECT a.id AS tweet_id, coalesce(n.case_id, (SELECT min(case_id) FROM tcases)) AS case_id, round_even(coalesce(n.s, 0.0::DOUBLE), 4) AS similarity,
        c.brand_resolution AS generated_reply
        FROM asked a LEFT JOIN nearest n ON n.id = a.id JOIN tcases c ON c.case_id = coalesce(n.case_id, (SELECT min(case_id) FROM tcases))""",
        **_NEAREST_VIEWS,
    ),
)
def _(spark, sf):
    asked = t.messages(spark, sf).where("inbound").select("tweet_id", "text")
    return retrieval.verbatim_nearest_reply(asked, text_corpus(spark, sf), "tweet_id", stops=STOPS).select(
        "tweet_id", "case_id", "similarity", "generated_reply"
    )


# ----------------------------------------------------------- trained baseline

def _labelled_pairs(spark, sf):
    return text_corpus(spark, sf).withColumn("pseudo_intent", rules.keyword_first_match(F.col("customer_text"), PATTERNS))


@query("logistic_intent")
def _(spark, sf):
    model = baselines.logistic_intent(_labelled_pairs(spark, sf))
    asked = t.messages(spark, sf).where("inbound").select("tweet_id", F.col("text").alias("customer_text"))
    return baselines.classify_logistic(model, asked).select("tweet_id", "predicted_intent", "intent_confidence")


@query("simple_ml_baseline")
def _(spark, sf):
    train = _labelled_pairs(spark, sf)
    model = baselines.logistic_intent(train)
    asked = t.messages(spark, sf).where("inbound").select(
        F.col("tweet_id").alias("example_id"), F.col("text").alias("customer_text")
    )
    return baselines.simple_ml_baseline(model, asked, train.drop("pseudo_intent"))


__all__ = ["PATTERNS", "THRESHOLD", "first_match_sql", "fitted"]
