"""Inputs at the edges that the given tables do not hold."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from deskgraph.llm import graph, mixing, neardup, packing, secrets, topk
from deskgraph.llm.common import table
from deskgraph.llm.queries import tokenizer_path
from tests.conftest import SMALL


def vectors(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("scale", [1e3, 3e5, 1e6])
def test_topk_scores_of_large_components_are_exact(spark, scale):
    x = np.random.default_rng(1).normal(size=(120, 6)) * scale
    whole = [[int(np.floor(256 * v)) for v in row] for row in x]
    got = topk.top_k(vectors(spark, x), F.col("vec_id") % 20 == 0, k=4, shard_rows=50).collect()
    want = {}
    for q in range(0, 120, 20):
        sums = [(-sum(a * b for a, b in zip(whole[q], w, strict=True)), i) for i, w in enumerate(whole) if i != q]
        want |= {(q, r): (i, -s) for r, (s, i) in enumerate(sorted(sums)[:4], 1)}
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == want


def test_topk_score_beyond_a_long_is_an_error(spark):
    with pytest.raises(Exception, match="does not fit"):
        topk.top_k(vectors(spark, np.full((3, 2), 1e8)), F.col("vec_id") == 0).collect()


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e12])
def test_nearest_neighbours_are_measured_on_the_original_doubles(spark, offset):
    x = offset + np.random.default_rng(2).normal(size=(300, 5))
    got = graph.nearest(vectors(spark, x), F.col("vec_id") % 100 == 0, k=10).collect()
    right = 0
    for q in (0, 100, 200):
        gap = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(300), gap)) if i != q][:10]
        mine = {r["vec_id"]: r["score"] for r in got if r["query_id"] == q}
        right += len(set(order) & set(mine))
        assert all(score == pytest.approx(gap[i], rel=1e-12) for i, score in mine.items())
    assert right >= 27


def words(rng, n):
    return [f"w{i}" for i in rng.integers(0, 5000, n)]


def test_near_duplicates_of_rows_without_ids(spark):
    rng = np.random.default_rng(3)
    base = words(rng, 200)
    near, far = [*base[:-2], "x1", "x2"], [*base[:-4], "x1", "x2", "y1", "y2"]
    other = " ".join(words(rng, 80))
    rows = [(None, " ".join(near)), (4, " ".join(base)), (6, " ".join(far)), (None, other), (7, other), (None, " ".join(words(rng, 50))), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(docs, 0.95, 3).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"]) == [(4, 4, True), (6, 4, False), (7, 7, True)]
    unnamed = sorted((r["component_id"] or 0, r["n_shingles"] > 0, r["kept"]) for r in got if r["doc_id"] is None)
    assert unnamed == [(0, False, True), (0, False, True), (0, True, True), (4, True, False), (7, True, False)]
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in neardup.keep_one(docs, similarity=0.95, words=3).collect())
    assert kept == sorted([(4, rows[1][1]), (7, other), (0, rows[5][1]), (0, ""), (0, "")])


def test_keep_one_judges_rows_that_share_an_id_by_their_texts(spark):
    rng = np.random.default_rng(4)
    one, two, alone = (" ".join(words(rng, 100)) for _ in range(3))
    rows = [(5, one), (9, one + " more"), (9, alone), (8, two), (8, two + " more"), (8, two)]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8, words=5).collect()
    got = sorted(map(tuple, kept))
    assert (5, one) in got and (9, alone) in got and len(got) == 3 and sum(i == 8 for i, _ in got) == 1


def test_pipeline_stages_keep_columns_with_clashing_names(spark):
    names = ["_score", "score", "secret_places", "base_places", "_sum", "_n", "_id", "_s", "_size", "_words", "_epoch", "digest", "row", "bucket", "lang_pred"]
    docs = table(spark, SMALL, "documents").select("*", *[F.lit(f"v {n}").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns[-len(names) :] == names, name
        row = docs.select(*names).first()
        assert all(row[n] == f"v {n}" for n in names), name


def test_mixed_documents_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", "x", "y"), (2, "d", "t", "x", "y")], "doc_id long, text string, source string, _sum string, _words string")
    got = mixing.mixed_documents(docs).collect()
    assert {(r["_sum"], r["_words"]) for r in got} == {("x", "y")}


def test_ordinary_words_come_from_anywhere_in_a_text(spark):
    text = " ".join(["front"] * 300 + ["behind"] * 300)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    ordinary = secrets.labelled_samples(docs, rows=1).where("not random").collect()
    assert len(ordinary) == 2 * secrets.SAMPLE_WORDS
    counts = [sum(word in r["token"].lower() for r in ordinary) for word in ("front", "behind")]
    assert min(counts) > 0.35 * len(ordinary)
    few = secrets.labelled_samples(docs, rows=1, words_each=10_000).where("not random").count()
    assert few == 1200


def test_word_cache_keeps_asked_words_over_its_generations():
    from tokenizers import Tokenizer

    encode = packing.word_encoder(tokenizer_path(), cached=40)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    for i in range(30):
        texts = [f"the same words and new{i} other{i + j},  x<|endoftext|>y" for j in range(3)]
        for text, ids in zip(texts, encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_learning_new_words_walks_no_word_that_is_kept():
    class Kept(dict):
        def __iter__(self):
            raise AssertionError("walked all the words that are kept")

    text = "Plain words, plain words! \u00dcber na\u00efve x1 (y) <w> \u4f60\u597d end. End"
    encode = packing.word_encoder(tokenizer_path(), cached=100_000)
    held = packing.worker_cache(f"encoder:{tokenizer_path()}")
    want = encode([text])
    held["older"], held["words"] = Kept(held["words"]), {}
    assert encode([text]) == want  # all from the older words
    held["older"], held["words"] = Kept({"Plain": held["words"]["Plain"]}), {}
    assert encode([text]) == want  # one of them, the others anew
    held["older"], held["words"] = {}, {}
