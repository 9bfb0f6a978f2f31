from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deskgraph.operators import case_index, clusters, intent, retrieval, tfidf, vectors


@pytest.fixture(scope="module")
def space(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100] = x[50]  # an exact tie
    x = x.astype(np.float32)
    rows = spark.createDataFrame(
        pd.DataFrame({"id": range(700), "embedding": [v.tolist() for v in x], "label": [int(i % 4) for i in range(700)]}),
        "id long, embedding array<float>, label int",
    ).repartition(5)
    return rows, x.astype(np.float64)


def brute(x, queries, cases, k):
    out = {}
    for i in queries:
        scores = np.round(x[cases] @ x[i], 9)
        order = sorted(range(len(cases)), key=lambda j: (-scores[j], cases[j]))[:k]
        out[i] = [(cases[j], round(float(scores[j]), 6)) for j in order]
    return out


def ranked(found):
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["case_id"], round(r["similarity"], 6)))
    return {q: [(c, s) for _, c, s in sorted(v)] for q, v in got.items()}


@pytest.mark.parametrize("options", [{}, {"cell_rows": 64}, {"cell_rows": 7}])
@pytest.mark.parametrize("k", [1, 3, 5])
def test_topk_is_exact_for_any_number_of_cells(space, options, k):
    rows, x = space
    found = case_index.topk_similar(rows, rows, k, query_id="id", case_id="id", **options)
    assert ranked(found) == brute(x, range(700), list(range(700)), k)


def test_topk_with_more_k_than_cases_and_string_ids(space):
    rows, x = space
    named = rows.withColumn("id", F.concat(F.lit("q"), F.col("id").cast("string")))
    found = case_index.topk_similar(named, rows.where("id < 2"), 5, query_id="id", case_id="id")
    assert found.count() == 1400
    assert found.where("query_id = 'q0' and rank = 1").first()["case_id"] == 0


def test_empty_corpus_and_missing_vectors_find_nothing(space):
    rows, _ = space
    assert case_index.topk_similar(rows, rows.where("id < 0"), 3, query_id="id", case_id="id").count() == 0
    blank = rows.withColumn("embedding", F.when(F.col("id") > 0, F.col("embedding")))
    found = case_index.topk_similar(blank, rows, 1, query_id="id", case_id="id")
    assert found.where("query_id = 0").count() == 0 and found.count() == 699


def test_blank_query_gives_empty_evidence(space):
    rows, _ = space
    queries = rows.where("id < 3").withColumn("text", F.when(F.col("id") == 1, F.lit("  \n")).otherwise(F.lit("hi"))).withColumnRenamed("id", "query_id")
    cases = rows.select(F.col("id").alias("case_id"), "embedding", F.lit("c").alias("customer_text"), F.lit("r").alias("brand_resolution"))
    found = retrieval.topk_similar_cases(queries, cases, 2, text="text")
    got = {r["query_id"]: r for r in retrieval.with_evidence(queries, found).collect()}
    assert (got[1]["retrieved_case_ids"], got[1]["max_similarity"], got[1]["evidence_text"]) == ([], 0.0, "")
    assert got[0]["retrieved_case_ids"][0] == 0 and got[0]["max_similarity"] == 1.0
    assert got[0]["evidence_text"].startswith("[Historical Case #0 (Similarity: 1.00)]\nCustomer Query: c\nSupport Resolution: r\n\n[Historical")


def test_centroids_and_classification(space):
    rows, x = space
    model = vectors.Centroids.fit(vectors.prototype_centroids(rows))
    labels = np.arange(700) % 4
    expected = np.vstack([x[labels == c].mean(axis=0) for c in range(4)])
    expected /= np.linalg.norm(expected, axis=1, keepdims=True)
    assert np.allclose(model.values, expected)

    got = intent.nearest_centroid_classify(rows, model, threshold=0.3)
    sims = x @ expected.T
    for r in got.collect():
        powers = np.exp(5 * sims[r["id"]])
        best = sims[r["id"]].argmax()
        prob = powers[best] / powers.sum()
        low = sims[r["id"]].max() < 0.3
        assert r["intent"] == ("Other_Or_Unclear" if low else str(best))
        assert r["intent_confidence"] == pytest.approx(1 - prob if low else prob, abs=6e-5)
        assert r["is_fallback"] == low
        assert sum(r["all_scores"].values()) == pytest.approx(1.0, abs=3e-4)


def test_blank_text_or_missing_vector_falls_back(space):
    rows, _ = space
    model = vectors.Centroids.fit(vectors.prototype_centroids(rows))
    few = rows.where("id < 3").withColumn("text", F.when(F.col("id") == 0, F.lit(" \t")).otherwise(F.lit("x")))
    few = few.withColumn("embedding", F.when(F.col("id") != 1, F.col("embedding")))
    got = {r["id"]: r for r in intent.nearest_centroid_classify(few, model, text="text").collect()}
    for i in (0, 1):
        assert (got[i]["intent"], got[i]["intent_confidence"], got[i]["is_fallback"]) == ("Other_Or_Unclear", 0.0, True)
        assert set(got[i]["all_scores"].values()) == {0.0}


def test_too_many_centroids_are_refused(space):
    rows, _ = space
    with pytest.raises(ValueError):
        vectors.Centroids.fit(vectors.prototype_centroids(rows), limit=3)


def test_text_search_matches_brute_force(spark):
    texts = ["red apple pie", "green apple", "blue sky sky", "the of", "red red sky pie", "apple pie pie red"]
    corpus = spark.createDataFrame([(i, t, f"reply {i}") for i, t in enumerate(texts)], "case_id long, customer_text string, brand_resolution string")
    words = sorted({w for t in texts for w in t.split() if w not in ("the", "of")})
    df = {w: sum(w in t.split() for t in texts) for w in words}
    idf = {w: np.log((1 + len(texts)) / (1 + df[w])) + 1 for w in words}

    def vector(text):
        v = np.array([text.split().count(w) * idf[w] for w in words])
        return v / np.linalg.norm(v) if v.any() else v

    asked = ["apple red", "sky", "nothing known", "pie"]
    queries = spark.createDataFrame(list(enumerate(asked)), "q long, text string")
    got = retrieval.verbatim_nearest_reply(queries, corpus, "q", stops=["the", "of"]).collect()
    for r in got:
        scores = [round(float(vector(asked[r["q"]]) @ vector(t)), 9) for t in texts]
        best = max(range(len(texts)), key=lambda i: (scores[i], -i))
        assert (r["case_id"], r["generated_reply"]) == (best, f"reply {best}")
        assert r["similarity"] == pytest.approx(scores[best], abs=1e-4)


def test_word_pairs_and_encoder_hook(spark):
    rows = spark.createDataFrame([(1, "Red the apple PIE")], "id long, text string")
    assert {r["term"] for r in tfidf.term_counts(rows, "id", "text", ["the"], ngrams=2).collect()} == {"red", "apple", "pie", "red apple", "apple pie"}
    encoded = tfidf.text_vectorize(rows, "text", encoder=lambda s: s.map(lambda t: [float(len(t))]))
    assert encoded.first()["embedding"] == [17.0]
    hashed = tfidf.text_vectorize(spark.createDataFrame([(1, "a bb"), (2, "bb cc dd")], "id long, text string"), "text", 32)
    assert all(len(r["embedding"]) == 32 for r in hashed.collect())


def test_cluster_scan_picks_the_first_best_silhouette(space):
    rows, _ = space
    models = clusters.fit(rows, (2, 3), starts=2)
    got = clusters.scan(models, rows).collect()
    assert [r["k"] for r in got] == [2, 3] and sum(r["is_best"] for r in got) == 1
    best = max(got, key=lambda r: r["silhouette_score"])
    assert best["is_best"] or best["silhouette_score"] == next(r for r in got if r["is_best"])["silhouette_score"]


def test_all_starts_advance_in_shared_passes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.concatenate([c + 0.1 * rng.normal(size=(60, 2)) for c in ((0, 0), (5, 0), (0, 5), (5, 5))])
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<double>")
    rows = rows.union(spark.createDataFrame([(900, None), (901, [float("nan"), 0.0])], rows.schema))
    passes = []
    real = clusters._statistics
    monkeypatch.setattr(clusters, "_statistics", lambda r, models: passes.append(len(models)) or real(r, models))
    two, four = clusters.fit(rows, (2, 4), starts=6)
    assert passes[0] == passes[-1] == 12 and passes == [passes[0], *sorted(passes[1:-1], reverse=True), passes[-1]] and len(passes) < 30
    assert four.sizes.tolist() == [60.0] * 4 and four.silhouette > 0.98 > two.silhouette
    label = np.array([r["cluster"] for r in clusters.assign(rows.where("id < 900"), four).orderBy("id").collect()])
    assert sorted(np.bincount(label)) == [60] * 4 and all(len(set(label[i : i + 60])) == 1 for i in range(0, 240, 60))
    means = np.array([x[label == c].mean(0) for c in range(4)])
    assert np.allclose(four.centres, means) and four.inertia == pytest.approx(((x - means[label]) ** 2).sum())
    # silhouettes by their definition, over all pairs
    square = ((x[:, None] - x[None]) ** 2).sum(2)
    own = np.array([square[i, label == label[i]].sum() / 59 for i in range(240)])
    other = np.array([min(square[i, label == c].mean() for c in range(4) if c != label[i]) for i in range(240)])
    assert four.silhouette == pytest.approx(((other - own) / np.maximum(own, other)).mean())
    assert clusters.assign(rows, four).where("id >= 900 and cluster is not null").count() == 0
    assert clusters.fit(rows.where("id > 900"), (2,)) == []


def test_vectors_of_other_lengths_or_with_bad_values_are_left_out(spark):
    good, bad = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]], [[1.0, 2.0], [1.0, 2.0, float("nan")], [1.0, None, 0.0], None, [1.0, 0.0, float("inf")]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(good + bad)], "query_id long, embedding array<double>")
    cases = rows.withColumnRenamed("query_id", "case_id")
    model = vectors.Centroids(["a", "b"], np.eye(3)[:2])
    sims = {r["query_id"]: r["sims"] for r in vectors.centroid_products(rows, model).collect()}
    assert sims[0] == [1.0, 0.0] and sims[1] == [0.0, 1.0] and all(sims[i] is None for i in range(2, 7))
    found = case_index.topk_similar(rows, cases, 3).collect()
    assert {r["query_id"] for r in found} == {0, 1} and {r["case_id"] for r in found} == {0, 1}
    with pytest.raises(ValueError):
        vectors.matrix(pa.array([[1.0, 2.0, 3.0], [1.0]]))


def test_blocks_without_a_case_find_nothing(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(8)], "query_id long, embedding array<double>")
    cases = rows.withColumnRenamed("query_id", "case_id")
    one = sorted(map(tuple, case_index.topk_similar(rows, cases, 3).collect()))
    assert sorted(map(tuple, case_index.topk_similar(rows, cases, 3, cell_rows=1).collect())) == one


def test_one_overlong_vector_leaves_the_others_in_the_search(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0, 0.0]) for i in range(5)], "query_id long, embedding array<double>")
    cases = rows.withColumnRenamed("query_id", "case_id").union(spark.createDataFrame([(9, [9.0] * 4)], "case_id long, embedding array<double>"))
    for options in ({}, {"width": 3}, {"cell_rows": 2}):
        found = case_index.topk_similar(rows, cases, 5, **options).collect()
        assert {(r["query_id"], r["case_id"]) for r in found} == {(i, j) for i in range(5) for j in range(5)}
    mostly_other = cases.union(spark.createDataFrame([(20 + i, [1.0] * 4) for i in range(9)], "case_id long, embedding array<double>"))
    assert {r["query_id"] for r in case_index.topk_similar(rows, mostly_other, 1).collect()} == set(range(5))
    assert case_index.topk_similar(rows, cases.where("case_id = 9"), 1).count() == 0


def test_a_cases_texts_travel_once_to_their_query(spark):
    found = spark.createDataFrame(
        [(1, 2, 8, 0.5, "b", "rb"), (1, 1, 9, 0.75, "a", None), (1, 3, 7, 0.25, "c", "rc"), (2, 1, 7, 0.125, None, "rc")],
        "query_id long, rank int, case_id long, similarity double, customer_text string, brand_resolution string",
    )
    rows = retrieval.per_query(found)
    got = {r["query_id"]: r for r in rows.collect()}
    assert got[1]["retrieved_case_ids"] == [9, 8, 7] and got[1]["max_similarity"] == 0.75 and got[1]["best_resolution"] is None
    assert got[1]["evidence_text"].split("\n\n")[1] == "[Historical Case #8 (Similarity: 0.50)]\nCustomer Query: b\nSupport Resolution: rb"
    assert got[2]["best_resolution"] == "rc" and "Customer Query: null" in got[2]["evidence_text"]
    # below the shuffle no block of texts is made beside the texts
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    gathered = plan[plan.index("collect_list") :]
    assert gathered.index("lambda") < gathered.index("format_string")
