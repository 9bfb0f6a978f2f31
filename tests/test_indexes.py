"""Stored search indexes: round trips, what they read, ties, bounds, and searches against brute force."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deskgraph.operators import case_index, retrieval, text_index
from deskgraph.operators.case_index import CaseIndex
from deskgraph.operators.text_index import TextIndex
from deskgraph.session import materialise


def clustered(rng, rows, centres, width=8, spread=0.05):
    x = rng.normal(size=(centres, width))[rng.integers(0, centres, rows)] + spread * rng.normal(size=(rows, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, name):
    return spark.createDataFrame([(i, [float(v) for v in r], f"text {i}") for i, r in enumerate(x)], f"{name} long, embedding array<double>, note string")


def brute(x, queries, k):
    scores = np.round(queries @ x.T, 9)
    return {(q, r + 1, int(i)) for q, row in enumerate(scores) for r, i in enumerate(np.lexsort((np.arange(len(x)), -row))[:k])}


def test_case_index_written_and_opened_finds_the_same_and_prunes(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = clustered(rng, 1500, 24)
    x[1400:] = x[0]  # a hundred ties in one cell
    path = str(tmp_path / "index")
    CaseIndex.build(frame(spark, x, "case_id"), path, cell_rows=50, with_cases=True)
    index = CaseIndex.open(spark, path)
    assert index.width == 8 and index.sizes.sum() == 1500 and len(index.sizes) > 10
    queries = np.concatenate([x[:40], clustered(rng, 20, 20)])
    asked = frame(spark, queries, "query_id").drop("note")
    found = {(r["query_id"], r["rank"], r["case_id"]) for r in index.search(asked, 5).collect()}
    assert found == brute(x, queries, 5)
    # a query of one cluster asks for few of the cells, and only their folders are read
    one = asked.where("query_id = 1")
    rows = one.select(F.lit(0).cast("long").alias("query_row"), "query_id", F.col("embedding").alias("_vector"))
    first = index._pairs(rows, probes=2)
    beat = index._score(first, 5).agg(F.lit(0).cast("long").alias("query_row"), F.min("similarity").alias("beat"))
    rest = index._pairs(rows.join(beat, "query_row"), probes=2, rest=True)
    assert first.count() == 2 and rest.count() < len(index.sizes) / 3
    plan = index.members([1, 2])._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan
    # with the cases beside the vectors, evidence needs the index only
    case = retrieval.topk_similar_cases(one, index, 1).first()
    assert case["note"] == f"text {case['case_id']}"


@pytest.mark.parametrize("cell_rows", [4, 1000])
def test_case_index_meets_large_cells_in_blocks(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(case_index, "BLOCK_ROWS", 8)
    x = clustered(np.random.default_rng(4), 60, 3)
    found = CaseIndex.build(frame(spark, x, "case_id"), cell_rows=cell_rows).search(frame(spark, x[:30], "query_id"), 3)
    assert {(r["query_id"], r["rank"], r["case_id"]) for r in found.collect()} == brute(x, x[:30], 3)


def test_case_index_without_usable_cases_or_with_repeated_ids(spark, tmp_path):
    nothing = frame(spark, np.eye(3), "case_id").where("case_id > 9")
    index = CaseIndex.build(nothing, str(tmp_path / "none"))
    assert CaseIndex.open(spark, index.path).search(frame(spark, np.eye(3), "query_id")).collect() == []
    odd = [(None, [1.0, 0.0]), (1, None), (2, [1.0]), (3, [float("nan"), 1.0]), (4, [0.0, 0.0]), (5, [-3.0, 4.0]), (5, [3.0, 4.0])]
    cases = spark.createDataFrame(odd, "case_id long, embedding array<double>")
    asked = spark.createDataFrame([("a", [3.0, 4.0]), ("a", [3.0, 4.0]), ("b", None), ("c", [1.0])], "query_id string, embedding array<double>")
    found = CaseIndex.build(cases).search(asked, 2).collect()
    assert sorted(tuple(r) for r in found) == [("a", 5, 7.0, 2), ("a", 5, 7.0, 2), ("a", 5, 25.0, 1), ("a", 5, 25.0, 1)]


TEXTS = ["red apple pie", "green apple", "blue sky sky", "the of", "red red sky pie", "apple pie pie red", None, "", "red apple pie"]


def test_text_index_is_reused_by_a_second_call(spark, tmp_path, monkeypatch):
    corpus = spark.createDataFrame([(i, t, f"reply {i}") for i, t in enumerate(TEXTS)], "case_id long, customer_text string, brand_resolution string")
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(["apple red", "sky", "nothing known", "pie", None])], "q long, text string")
    want = sorted(map(tuple, retrieval.verbatim_nearest_reply(queries, corpus, "q", stops=["the", "of"]).collect()))
    path = str(tmp_path / "text")
    TextIndex.build(corpus, path, stops=["the", "of"])
    monkeypatch.setattr(TextIndex, "build", None)  # no second index is built
    index = TextIndex.open(spark, path)
    for _ in range(2):
        got = retrieval.verbatim_nearest_reply(queries, corpus, "q", index=index)
        assert sorted(map(tuple, got.collect())) == want
    assert dict((r["q"], r["case_id"]) for r in got.collect()) == {0: 0, 1: 2, 2: 0, 3: 5, 4: 0}


@pytest.mark.parametrize("shard_rows", [7, 1000])
def test_text_search_over_shards_and_query_blocks_matches_brute_force(spark, shard_rows):
    rng = np.random.default_rng(6)
    words = [f"w{i}x" for i in range(40)]
    share = 1 / np.arange(1, 41)
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 12)), p=share / share.sum())) for _ in range(120)]
    cases = spark.createDataFrame(list(enumerate(texts)), "case_id long, customer_text string")
    found = TextIndex.build(cases, stops=[], features=30, shard_rows=shard_rows).search(cases.withColumnRenamed("customer_text", "text"), 4, "case_id", query_rows=16)
    totals = {w: sum(t.split().count(w) for t in texts) for w in words}
    kept = sorted(sorted(words, key=lambda w: (-totals[w], w))[:30])
    counts = np.array([[t.split().count(w) for w in kept] for t in texts], float)
    raw = counts * (np.log((1 + len(texts)) / (1 + (counts > 0).sum(0))) + 1)
    norm = np.linalg.norm(raw, axis=1, keepdims=True)
    unit = np.divide(raw, norm, out=np.zeros_like(raw), where=norm > 0)
    want = {}
    for q, row in enumerate(np.round(unit @ unit.T, 9)):
        want[q] = [(int(i), round(float(row[i]), 6)) for i in np.lexsort((np.arange(len(texts)), -row))[:4] if row[i] > 0]
    got = {q: [] for q in want}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["case_id"], round(r["similarity"], 6)))
    assert got == want


def test_text_index_without_cases_or_terms(spark):
    cases = spark.createDataFrame([(1, "the")], "case_id long, customer_text string")
    asked = spark.createDataFrame([(1, "red")], "query_id long, text string")
    for corpus in (cases, cases.where("false")):
        assert TextIndex.build(corpus, stops=["the"]).search(asked).collect() == []


@given(st.integers(1, 40), st.integers(1, 8), st.integers(1, 5), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_block_maxima_never_hide_a_case(cases, features, k, seed):
    rng = np.random.default_rng(seed)
    dense = rng.integers(0, 4, (cases, features)) * rng.choice([1.0, 0.25], (cases, features))
    sizes = (dense > 0).sum(1)
    ends, terms = np.concatenate([[0], np.cumsum(sizes)]), np.nonzero(dense)[1]
    order, shard = text_index.pack(ends, terms, dense[dense > 0], features, block_rows=3)
    query = rng.integers(0, 3, features).astype(float)
    asked = np.flatnonzero(query)
    found, score = text_index.best_cases(shard, order, asked, query[asked], k, block_rows=3)
    scores = dense @ query
    want = [i for i in np.lexsort((np.arange(cases), -scores))[:k] if scores[i] > 0]
    assert order[found].tolist() == want and score.tolist() == scores[want].tolist()


@pytest.mark.parametrize("cell_rows", [10, 40])
def test_a_search_stores_no_row_for_each_query_and_cell(spark, monkeypatch, cell_rows):
    x = np.random.default_rng(8).normal(size=(400, 8))  # evenly spread, so nearly every query wants nearly every cell
    stored = []
    monkeypatch.setattr(case_index, "materialise", lambda rows, purpose: stored.append(materialise(rows, purpose)) or stored[-1])
    monkeypatch.setattr(case_index, "BLOCK_ROWS", 50)
    index = CaseIndex.build(frame(spark, x, "case_id"), cell_rows=cell_rows)
    found = index.search(frame(spark, x, "query_id"), 3).collect()
    assert {(r["query_id"], r["rank"], r["case_id"]) for r in found} == brute(x, x, 3)
    assert max(s.count() for s in stored) <= 3 * len(x)


def test_zones_hold_small_cells_together_and_split_large_ones(monkeypatch):
    monkeypatch.setattr(case_index, "BLOCK_ROWS", 100)
    assert case_index._zones({0: 10, 2: 60, 3: 50, 4: 500, 7: 30, 8: 90}, 8) == {0: (0, 1), 2: (0, 1), 3: (1, 1), 4: (2, 6), 7: (8, 1), 8: (9, 1)}
    # memory of a part is bounded, however many rows there are
    assert case_index._parts(10**7, 64) == -(-(10**7) * 64 // case_index.BLOCK_VALUES)


@given(st.integers(1, 30), st.integers(1, 20), st.integers(1, 4), st.integers(1, 6), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_a_zone_meets_its_queries_as_brute_force_does(cases, queries, k, cells, seed):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(-2, 3, (queries, 2)).astype(float), rng.integers(-2, 3, (cases, 2)).astype(float)
    cell, ids = rng.integers(0, cells, cases), rng.permutation(cases)
    asked = [sorted(rng.choice(cells, int(rng.integers(1, cells + 1)), replace=False).tolist()) for _ in range(queries)]
    beat = [None if rng.random() < 0.5 else float(rng.integers(-2, 5)) for _ in range(queries)]
    q = pa.table({"_vector": x.tolist(), "cells": pa.array(asked, pa.list_(pa.int32())), "beat": pa.array(beat, pa.float64())})
    c = pa.table({"case_id": ids, "embedding": y.tolist(), "cell": pa.array(cell, pa.int32())})
    row, case, score = case_index._meet(q, c, k)
    for i in range(queries):
        scores = y @ x[i]
        fit = [j for j in range(cases) if cell[j] in asked[i] and (beat[i] is None or scores[j] >= beat[i])]
        want = sorted(fit, key=lambda j: (-scores[j], ids[j]))[:k]
        assert case[row == i].tolist() == want and score[row == i].tolist() == scores[want].tolist()


def test_a_meeting_holds_few_doubles_however_many_rows_meet():
    rng = np.random.default_rng(3)
    rows, cells, width = 6000, 3, 16

    def vectors():
        return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(rng.normal(size=rows * width), pa.float32()))

    every = pa.array([list(range(cells))] * rows, pa.list_(pa.int32()))
    q = pa.table({"_vector": vectors(), "cells": every, "beat": pa.nulls(rows, pa.float64())})
    for cell in (np.arange(rows) % cells, np.full(rows, 1)):  # several cells, one large cell
        c = pa.table({"case_id": rng.permutation(rows), "embedding": vectors(), "cell": pa.array(cell, pa.int32())})
        tracemalloc.start()
        row, _, _ = case_index._meet(q, c, 3)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(row) == 3 * rows and peak < 30e6  # a block of 4 million scores had taken 32 MB several times over


def test_a_run_of_a_cell_changes_no_result(monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.integers(-2, 3, (40, 3)).astype(float), rng.integers(-2, 3, (50, 3)).astype(float)
    q = pa.table({"_vector": x.tolist(), "cells": pa.array([[0, 1]] * 40, pa.list_(pa.int32())), "beat": pa.nulls(40, pa.float64())})
    c = pa.table({"case_id": rng.permutation(50), "embedding": y.tolist(), "cell": pa.array([0] * 45 + [1] * 5, pa.int32())})
    want = [part.tolist() for part in case_index._meet(q, c, 4)]
    monkeypatch.setattr(case_index, "CELL_ROWS", 7)
    assert [part.tolist() for part in case_index._meet(q, c, 4)] == want


def test_zones_of_many_cells_are_found_in_slices(spark, monkeypatch):
    zones = case_index._zones({c: 10 + c % 7 for c in range(60)}, 8)
    rows = spark.createDataFrame([(i, sorted({i % 60, (7 * i) % 60, 59})) for i in range(300)] + [(300, [])], "i int, cells array<int>")
    place = lambda: sorted(rows.select("i", case_index._by_zone(zones)("cells").alias("z")).collect())
    whole = place()
    monkeypatch.setattr(case_index, "SLICE_CELLS", 200)  # three rows a slice
    assert place() == whole and sum(len(z["cells"]) for r in whole for z in r["z"]) == rows.selectExpr("sum(size(cells)) AS n").first()["n"]
