"""The text search in bounded meetings, counted words and pairs, and texts that are read once."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from deskgraph.operators import baselines, retrieval, text_index, tfidf
from deskgraph.operators.encoder import TextEncoder, place
from deskgraph.operators.text_index import TextIndex
from deskgraph.plans import run_queries
from deskgraph.session import materialise


def frame(spark, rows, words=30, name="case_id", seed=2):
    rng = np.random.default_rng(seed)
    texts = [" ".join(f"w{w}x" for w in rng.integers(0, words, int(rng.integers(1, 15)))) for _ in range(rows)]
    return spark.createDataFrame([(i, t, f"reply {i}") for i, t in enumerate(texts)], f"{name} long, customer_text string, brand_resolution string")


@pytest.mark.parametrize("terms", [60, 10**6])
def test_terms_bound_shards_and_query_blocks(spark, monkeypatch, terms):
    cases, asked = frame(spark, 150), frame(spark, 80, name="q", seed=3)
    want = sorted(map(tuple, retrieval.topk_by_text(asked, cases, 3, "q", "customer_text", stops=[]).collect()))
    monkeypatch.setattr(text_index, "MEETING_TERMS", terms)
    monkeypatch.setattr(text_index, "PIECE_BYTES", 500)
    index = TextIndex.build(cases, stops=[])
    stored = spark.read.parquet(f"{index.path}/shards")
    # a row of the index is a small piece, however long the texts are
    assert stored.selectExpr("max(length(data)) AS n").first()["n"] <= 500
    assert (index.shards > 5) == (terms == 60) and stored.select("shard").distinct().count() == index.shards
    assert sorted(map(tuple, index.search(asked, 3, "q", "customer_text").collect())) == want and len(want) > 200


def test_a_shard_is_copied_for_each_block_of_thousands_of_queries_only(spark):
    cases, asked = frame(spark, 20), spark.range(5000).selectExpr("id AS q", "concat('w', id % 30, 'x w1x') AS text")
    found = TextIndex.build(cases, stops=[]).search(asked, 1, "q")
    plan = found._jdf.queryExecution().toString()
    assert "sequence(0, 0" in plan and "sequence(0, 4" not in plan  # 5,000 queries had been five blocks, each with a copy of every shard
    assert found.count() == 5000


def test_pieces_join_to_what_was_cut(monkeypatch):
    monkeypatch.setattr(text_index, "PIECE_BYTES", 7)
    order, shard = text_index.pack(np.array([0, 2, 2, 3]), np.array([0, 2, 1]), np.array([0.6, 0.8, 1.0]), 3, block_rows=2)
    pieces = text_index.cut(shard | {"ranks": order})
    back = text_index.joined(pieces)
    assert max(map(len, pieces)) == 7 and back["ranks"].tolist() == order.tolist()
    assert all(back[n].tolist() == shard[n].tolist() for n in shard)


@pytest.mark.parametrize("ngrams", [1, 2])
def test_counted_words_and_pairs_match_plain_counts(ngrams):
    lists = [["a", "b", "a", "b"], [], None, ["b"], ["a", "b", "c"], ["c", "c", "c"]]
    total, df = Counter(), Counter()
    for row in lists:
        found = (row or []) + [f"{x} {y}" for x, y in zip(row or [], (row or [])[1:], strict=False)] * (ngrams - 1)
        total.update(found)
        df.update(set(found))
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string()))], names=["words"])
    got = [r for out in tfidf._count(iter([batch]), ngrams) for r in out.to_pylist()]
    assert {r["term"]: (r["total"], r["df"]) for r in got if r["term"]} == {t: (n, df[t]) for t, n in total.items()}
    assert [r["cases"] for r in got if r["term"] is None] == [len(lists)]


def test_training_texts_become_vectors_once(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(baselines, "materialise", lambda rows, purpose: stored.append((purpose, rows.columns)) or materialise(rows, purpose), raising=False)
    train = frame(spark, 40).selectExpr("*", "if(case_id % 2 = 0, 'en', 'fr') AS pseudo_intent")
    model = baselines.logistic_intent(train, features=20)
    assert stored == [("training-vectors", ["pseudo_intent", "_tfidf"])]
    assert baselines.classify_logistic(model, train).where("predicted_intent IN ('en', 'fr')").count() == 40


def test_encoded_texts_are_the_sums_of_their_terms(spark, monkeypatch):
    monkeypatch.setattr(tfidf, "LISTED_TERMS", 9)
    rows = frame(spark, 60).unionByName(spark.createDataFrame([(90, None, ""), (91, "", ""), (92, "the", "")], "case_id long, customer_text string, brand_resolution string"))
    encoder = TextEncoder.fit(rows, "customer_text", dimensions=16, features=20, stops=["the"])
    for r in encoder.apply(rows, "customer_text").collect():
        want = np.zeros(16)
        for term, n in Counter(w for w in (r["customer_text"] or "").split() if w != "the").items():
            at, sign = place(term, 16)
            want[at] += sign * n * encoder.idf.get(term, encoder.other)
        norm = np.sqrt((want * want).sum())
        assert r["embedding"] is None if norm == 0 else r["embedding"] == (want / norm).tolist()


def test_a_run_reads_its_texts_once_for_each_use(spark, monkeypatch):
    train = frame(spark, 60).selectExpr("case_id", "case_id AS customer_tweet_id", "customer_text", "brand_resolution", "if(case_id % 2 = 0, 'en', 'fr') AS label")
    examples = frame(spark, 4, name="n", seed=5).selectExpr("concat('gold_', n) AS example_id", "customer_text", "'standard' AS edge_case_category")
    made, counted = [], []
    vector, count_terms = TextEncoder.vector, tfidf.count_terms
    monkeypatch.setattr(TextEncoder, "vector", lambda self, text: made.append(1) or vector(self, text))
    monkeypatch.setattr(tfidf, "count_terms", lambda *a, **b: counted.append(1) or count_terms(*a, **b))
    got = run_queries.predictions(train, examples)
    assert got.count() == 12 and {r["system_name"] for r in got.select("system_name").distinct().collect()} == {"trivial_baseline", "simple_ml_baseline", "proposed_system"}
    # cases and examples; encoder with text index, and the trained baseline
    assert len(made) == 2 and len(counted) == 2


def test_only_the_terms_that_can_be_kept_are_stored(spark):
    rows = frame(spark, 50)
    whole = tfidf.count_terms(rows, "customer_text", [], 2).collect()
    got = tfidf.top_terms(rows, "customer_text", [], 2, 7, "test-terms").collect()
    want = sorted((r for r in whole if r["term"]), key=lambda r: (-r["total"], r["term"]))[:7]
    assert sorted(map(tuple, (r for r in got if r["term"]))) == sorted(map(tuple, want)) and len(whole) > 100
    assert [r["cases"] for r in got if r["term"] is None] == [50]
