"""CSV whose quoted texts hold line breaks, read in splits.

A line belongs to the split it starts in.  One pass counts the quotes of every split; their running sum over the splits of a file
says whether a split starts inside a quoted text.  A second pass puts lines together into records: a record belongs to the
split it starts in, the lines that end it to a later one.  Such ends are few, two pieces for each split at most, and
only they are shuffled.

Quotes are those of RFC 4180: a field that holds a quote is quoted, and a quote in it is doubled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Splits that tasks may know the state of (some 60 bytes each): 128 TB of splits of 128 MB.
MAX_SPLITS = 1_000_000

OPTIONS = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
_SPLIT = ["file", "start"]
_PIECE = "file string, start long, place int, kind int, body string"
#: Kinds of pieces: a whole record, the end of a record of an earlier split, the beginning of one that goes on in a later split.
WHOLE, END, BEGINNING = 0, 1, 2


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their split, in file order within a task."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )


def quote_counts(spark: SparkSession, path: str) -> DataFrame:
    """Per split: file, start, quotes (their number), broken (some line holds an odd number)."""
    found = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines(spark, path).select(*_SPLIT, found.alias("n")).groupBy(*_SPLIT).agg(
        F.sum("n").alias("quotes"), F.bool_or(F.col("n") % 2 == 1).alias("broken")
    )


def pieces(spark: SparkSession, path: str, open_at: dict[str, dict[int, bool]]) -> DataFrame:
    """Whole records, and what begins or ends a record that crosses splits.  ``open_at`` says which splits start inside a text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, place, held, inside, kind = None, 0, [], False, WHOLE
        out: list[tuple] = []

        def close(last: int) -> None:
            nonlocal place, held, kind
            if held:
                out.append((*split, place, last if kind == WHOLE else kind, "\n".join(held)))
                place, held = place + 1, []
            kind = WHOLE

        for batch in batches:
            for value, file, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (file, start) != split:
                    close(BEGINNING if inside else WHOLE)
                    split, place = (file, start), 0
                    inside = open_at[file][start]  # an unknown split would mean that files changed between the passes
                    kind = END if inside else WHOLE
                held.append(value)
                inside ^= value.count('"') % 2 == 1
                if not inside:
                    close(WHOLE)
            yield _batch(out)
            out = []
        close(BEGINNING if inside else WHOLE)
        yield _batch(out)

    return lines(spark, path).mapInArrow(cut, _PIECE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "start", "place", "kind", "body"])


def read_records(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame | None:
    """Rows of CSV files whose texts hold line breaks; None if no text does, so that Spark's own reader can take the splits.

    Records without any character are skipped.  A file that ends inside a text ends that record.
    """
    counts = quote_counts(spark, path)
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    open_ = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    states = counts.select(*_SPLIT, "broken", open_.alias("open")).limit(MAX_SPLITS + 1).toArrow().to_pylist()
    if len(states) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits; raise spark.sql.files.maxPartitionBytes")
    if not any(s["broken"] for s in states):
        return None
    open_at: dict[str, dict[int, bool]] = {}
    for s in states:
        open_at.setdefault(s["file"], {})[s["start"]] = s["open"]
    found = pieces(spark, path, open_at)
    whole = found.where(F.col("kind") == WHOLE).select("body", ((F.col("start") == 0) & (F.col("place") == 0)).alias("first"))
    crossing = found.where(F.col("kind") != WHOLE)
    # an end follows the last beginning before it; a text over several splits has an end in each
    order = Window.partitionBy("file").orderBy("start", "place")
    begun = F.last(F.when(F.col("kind") == BEGINNING, F.struct("start", "place")), ignorenulls=True).over(order)
    owned = crossing.withColumn("record", begun)
    parts = F.sort_array(F.collect_list(F.struct("start", "place", "body")))
    joined = owned.groupBy("file", "record").agg(F.array_join(F.transform(parts, lambda p: p["body"]), "\n").alias("body")).select(
        "body", ((F.col("record.start") == 0) & (F.col("record.place") == 0)).alias("first")
    )
    records = whole.unionByName(joined).withColumn("body", F.regexp_replace("body", "\r$", "")).where(F.col("body") != "")
    if header:
        records = records.where(~F.col("first"))
    return records.select(F.from_csv("body", schema.simpleString()[len("struct<") : -1].replace(":", " "), OPTIONS).alias("r")).select("r.*")
