"""The queries on the smallest tables against their SQL, and the pipeline's stages against plain Python."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from deskgraph.llm import packing
from deskgraph.llm.common import table
from deskgraph.llm.queries import ORACLES, QUERIES
from tests.conftest import SMALL
from tests.llm.test_operators import base_spans, exact_components
from tools.check import TABLES, rows_of


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    frame = QUERIES[name](spark, SMALL)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    assert got[1]
    if name in ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        cursor = con.execute(ORACLES[name])
        assert got == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_every_operator_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_pipeline_stages_take_effect(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, SMALL, "documents")
    good = stages["quality_filter"](spark, docs, SMALL).cache()
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SMALL, "labels").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    clean = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in clean) >= 0.97 * len(clean)
    assert sum(d in kept for d, q in labels.items() if q == 0) <= 0.2 * sum(q == 0 for q in labels.values())
    single = stages["near_dedup"](spark, good, SMALL).cache()
    want, _ = exact_components([(r["doc_id"], r["text"]) for r in good.collect()], 5, 80)
    assert {r["doc_id"] for r in single.collect()} == set(want.values())
    masked = stages["secret_removal"](spark, single, SMALL).cache()
    assert masked.count() == single.count() and not any(base_spans(r["text"] or "") for r in masked.collect())
    mixed = stages["source_mixture"](spark, masked, SMALL).cache()
    words = lambda rows: sum(len((r["text"] or "").encode().split()) for r in rows)
    assert abs(words(mixed.collect()) - 1.5 * words(masked.collect())) <= 30
    for frame in (good, single, masked, mixed):
        assert frame.columns == docs.columns
    pieces = stages["packed_sequences"](spark, mixed, SMALL).collect()
    starts = Counter(r["doc_id"] for r in pieces if r["start"] == 0)
    assert starts == Counter(r["doc_id"] for r in mixed.collect())
    assert max(r["offset"] + r["length"] for r in pieces) <= packing.WINDOW


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, SMALL, name).where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
