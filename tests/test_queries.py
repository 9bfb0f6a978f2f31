"""Every registered query on the smallest tables: against its SQL, or for rows where there is none."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from deskgraph.plans import registry
from tests.conftest import SMALL
from tools.check import TABLES, rows_of

registry.load_all()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    frame = registry.QUERIES[name](spark, SMALL)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    sql = registry.ORACLES.get(name)
    if sql is None:
        assert got[1]
    else:
        cursor = con.execute(sql)
        assert got == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_entry_is_the_whole_scoring(spark):
    frame = entry.entry(spark)
    assert len(frame.columns) == 17 and frame.count() > 0


@pytest.mark.parametrize("name", ["working_set", "system_report", "scored_messages"])
def test_answers_do_not_depend_on_shuffle_partitions(spark, name):
    answers = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        frame = registry.QUERIES[name](spark, SMALL)
        answers.append(rows_of(frame.columns, [tuple(r) for r in frame.collect()]))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert answers[0] == answers[1]
