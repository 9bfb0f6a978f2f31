"""The stored text encoder, versioned snapshots, the cache's write-back and telemetry of repeated runs."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deskgraph.operators import intent, tfidf
from deskgraph.operators.encoder import TextEncoder
from deskgraph.plans import message_scoring
from deskgraph.sources import writers
from deskgraph.sources.snapshots import Snapshots

TEXTS = ["red apple pie", "green apple", "blue sky sky", "the of", None, "", "red red pie"]


def plain_vector(text, idf, other, dimensions):
    out = np.zeros(dimensions)
    for term in (text or "").split():
        if term not in ("the", "of"):
            digest = hashlib.md5(term.encode()).hexdigest()
            out[int(digest[:8], 16) % dimensions] += (1 if int(digest[8], 16) < 8 else -1) * idf.get(term, other)
    return out / np.linalg.norm(out) if out.any() else None


def test_encoder_is_stored_and_applied_to_new_rows(spark, tmp_path):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    path = str(tmp_path / "encoder")
    TextEncoder.fit(rows, dimensions=16, features=4, stops=["the", "of"]).save(spark, path)
    encoder = TextEncoder.open(spark, path)
    df = {"red": 2, "apple": 2, "pie": 2, "sky": 1}  # the four most frequent terms
    idf = {term: np.log(8 / (1 + n)) + 1 for term, n in df.items()}
    assert encoder.idf == pytest.approx(idf) and encoder.other == pytest.approx(np.log(8) + 1)
    new = [*TEXTS, "never seen words", "pie pie unseen", " \n"]
    got = encoder.apply(spark.createDataFrame(list(enumerate(new)), "id long, text string")).collect()
    for r in got:
        want = plain_vector(r["text"], idf, encoder.other, 16)
        assert (r["embedding"] is None) if want is None else r["embedding"] == pytest.approx(want.tolist())


def test_raw_text_to_intent_with_blank_text(spark):
    prototypes = spark.createDataFrame([("fruit", "red apple pie"), ("fruit", "green apple"), ("sky", "blue sky"), ("sky", None)], "label string, text string")
    encoder = TextEncoder.fit(prototypes, stops=["the"])
    model = encoder.centroids(prototypes)
    asked = spark.createDataFrame([(1, "an apple pie"), (2, "sky blue sky"), (3, "  "), (4, None), (5, "wholly unrelated"), (6, "...")], "id long, text string")
    done = {r["id"]: r for r in intent.nearest_centroid_classify(encoder.apply(asked), model, text="text").collect()}
    assert (done[1]["intent"], done[2]["intent"]) == ("fruit", "sky")
    assert all((done[i]["intent"], done[i]["intent_confidence"], done[i]["is_fallback"]) == ("Other_Or_Unclear", 0.0, True) for i in (3, 4, 6))
    assert done[5]["intent"] == "Other_Or_Unclear" and done[5]["intent_confidence"] > 0


def gold(spark, n):
    return spark.createDataFrame([(i,) for i in range(n)], "example_id long")


def test_a_second_call_scores_nothing_and_new_rows_only_themselves(spark, tmp_path):
    store, asked = Snapshots(spark, str(tmp_path / "cache")), []

    def score(rows):
        asked.append(sorted(r["example_id"] for r in rows.collect()))
        return rows.select("example_id", F.concat(F.lit("p"), F.col("example_id").cast("string")).alias("predicted_intent"))

    first = message_scoring.with_cached_predictions(gold(spark, 3), store, score)
    assert {(r["example_id"], r["cached"]) for r in first.collect()} == {(i, False) for i in range(3)}
    again = message_scoring.with_cached_predictions(gold(spark, 3), store, score)
    assert {(r["example_id"], r["cached"]) for r in again.collect()} == {(i, True) for i in range(3)}
    more = message_scoring.with_cached_predictions(gold(spark, 5), store, score)
    assert {(r["example_id"], r["predicted_intent"], r["cached"]) for r in more.collect()} == {(i, f"p{i}", i < 3) for i in range(5)}
    assert asked == [[0, 1, 2], [3, 4]] and sorted(store.versions()) == [1, 2]
    assert {r["example_id"] for r in store.read().collect()} == set(range(5)) and store.read(1).count() == 3


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "cache"))
    assert store.read() is None
    store.write(gold(spark, 2).withColumn("predicted_intent", F.lit("a")))

    def breaks(rows):
        return rows.select("example_id", F.raise_error(F.lit("no model")).cast("string").alias("predicted_intent"))

    with pytest.raises(Exception, match="no model"):
        message_scoring.with_cached_predictions(gold(spark, 4), store, breaks)
    with pytest.raises(Exception, match="no model"):
        store.write(breaks(gold(spark, 4)))
    assert sorted(store.versions()) == [1] and store.read().count() == 2
    with pytest.raises(RuntimeError, match="another job"):
        store.write(gold(spark, 9).withColumn("predicted_intent", F.lit("b")), after=0)
    assert store.read().count() == 2
    # a writer that died while it made its marker blocks nobody
    (tmp_path / "cache" / "_versions" / "2").touch()
    assert store.read().count() == 2 and store.write(gold(spark, 3).withColumn("predicted_intent", F.lit("c"))) == 3
    assert store.read().count() == 3


def test_a_repeated_run_leaves_one_copy_of_its_telemetry(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = gold(spark, 4)
    for run, count in (("a", 4), ("a", 4), ("b", 2), ("a", 3)):
        writers.sink_telemetry_append(rows.limit(count), path, "2024-01-01", run)
    writers.sink_telemetry_append(rows, path, "2024-01-02", "a")
    kept = spark.read.json(path).groupBy("run_date", "run_id").count().collect()
    assert {(str(r["run_date"]), r["run_id"], r["count"]) for r in kept} == {("2024-01-01", "a", 3), ("2024-01-01", "b", 2), ("2024-01-02", "a", 4)}


def test_tasks_and_slices_for_terms_are_bounded_and_count_the_same(spark, monkeypatch):
    texts = ["red apple pie", "green apple apple", None, "", "of the", "blue red apple", "pie"]
    rows = spark.createDataFrame(list(enumerate([*texts, "pie apple"])), "id long, text string").withColumn("id", F.col("id") % 7)  # one id twice
    read = lambda: (
        sorted((r["term"] or "", r["total"], r["df"], r["cases"]) for r in tfidf.count_terms(rows, "text", ["the", "of"], 2).collect()),
        sorted(map(tuple, tfidf.tfidf_weights(rows, "id", "text", stops=["the", "of"]).collect())),
        sorted((r["id"], r["features"].toArray().tolist()) for r in tfidf.tfidf_features(rows.where("text IS NOT NULL"), "text", stops=["the", "of"]).collect()),
        sorted((r["id"], r["embedding"] or []) for r in TextEncoder.fit(rows, "text", stops=["the", "of"]).apply(rows).collect()),
    )
    whole = read()
    assert ("", 0, 0, 8) in whole[0] and ("apple", 5, 4, 0) in whole[0] and ("red apple", 2, 2, 0) in whole[0]
    assert tfidf.term_counts(rows, "id", "text", []).rdd.getNumPartitions() == 1
    for name, value in (("TASK_CHARACTERS", 20), ("COUNTED_TERMS", 3), ("LISTED_TERMS", 2)):
        monkeypatch.setattr(tfidf, name, value)
    assert tfidf.tasks(rows, "text") == 1 + sum(len(t or "") for t in [*texts, "pie apple"]) // 20
    assert tfidf.term_counts(rows, "id", "text", []).rdd.getNumPartitions() > 1
    assert [len(s) for s in tfidf.slices(pa.array([["a"], None, ["b", "c", "d"], [], ["e"]]), 2)] == [2, 1, 2]
    small = read()
    assert whole[0] == small[0]
    for a, b in zip(whole[1:], small[1:], strict=True):
        assert [r[:-1] for r in a] == [r[:-1] for r in b]
        assert all(np.allclose(x[-1], y[-1]) for x, y in zip(a, b, strict=True))
