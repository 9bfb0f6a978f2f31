"""CSV with line breaks in texts: split edges anywhere, several files, odd ends, against Spark's reader of whole files."""

from __future__ import annotations

import csv
import io

import numpy as np
import pytest

from deskgraph.sources import csv_records, readers

NAMES = [f.name for f in readers.MESSAGE_SCHEMA]


@pytest.fixture
def tiny_splits(spark):
    """Splits of a few dozen bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[1], "1")

    def size(n):
        spark.conf.set(names[0], str(n))

    yield size
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def text_file(path, rows, end="\n"):
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(NAMES)
    for i, text in enumerate(rows):
        writer.writerow([i, f"c{i}", i % 2 == 0, "now", text, "", i - 1 if i else ""])
    path.write_bytes(out.getvalue().encode())


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def random_texts(seed, n):
    rng = np.random.default_rng(seed)
    bits = ["\n", "\n\n", '"', "a,b", "word ", "é", '""', "\n\"", " x"]
    return ["t" + "".join(rng.choice(bits, int(rng.integers(0, 9)))) for _ in range(n)]


@pytest.mark.parametrize("split", [17, 64, 301])
def test_splits_anywhere_give_the_rows_of_whole_files(spark, tmp_path, tiny_splits, split):
    for k in range(2):
        text_file(tmp_path / f"{k}.csv", random_texts(k, 12))
    want = rows_of(readers.scan_csv_messages(spark, str(tmp_path), multi_line=True))
    tiny_splits(split)
    found = readers.scan_csv_messages(spark, str(tmp_path))
    assert len(want) == 24 and rows_of(found) == want
    assert csv_records.lines(spark, str(tmp_path)).rdd.getNumPartitions() > 3  # one file is many tasks


def test_a_text_over_many_splits_and_one_that_never_ends(spark, tmp_path, tiny_splits):
    long = "start" + "\nline of the same text" * 40
    text_file(tmp_path / "a.csv", [long, "plain", "last\nline"])
    tiny_splits(50)
    got = {r["tweet_id"]: r["text"] for r in readers.scan_csv_messages(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {0: long, 1: "plain", 2: "last\nline"}
    body = (tmp_path / "a.csv").read_bytes().rstrip()
    (tmp_path / "b.csv").write_bytes(body[: body.rindex(b'line"')])
    got = {r["tweet_id"]: r["text"] for r in readers.scan_csv_messages(spark, str(tmp_path / "b.csv")).collect()}
    assert got[0] == long and got[2].startswith("last")


def test_carriage_returns_blank_lines_and_an_empty_file(spark, tmp_path, tiny_splits):
    text_file(tmp_path / "a.csv", ["one\r\ntwo", "three"], end="\r\n")
    with (tmp_path / "a.csv").open("ab") as file:
        file.write(b"\r\n\r\n9,c9,True,now,after blanks,,\r\n")
    (tmp_path / "empty.csv").write_bytes(b"")
    tiny_splits(40)
    got = {r["tweet_id"]: r["text"] for r in readers.scan_csv_messages(spark, str(tmp_path)).collect()}
    assert got == {0: "one\r\ntwo", 1: "three", 9: "after blanks"}


def test_files_without_breaks_take_sparks_own_reader(spark, tmp_path):
    text_file(tmp_path / "a.csv", ["plain", 'with "quotes", too'])
    assert csv_records.read_records(spark, str(tmp_path), readers.MESSAGE_SCHEMA) is None
    assert readers.scan_csv_messages(spark, str(tmp_path)).count() == 2
    assert readers.scan_csv_messages(spark, str(tmp_path), max_rows=1).count() == 1
