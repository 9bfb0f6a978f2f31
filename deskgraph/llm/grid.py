"""Vectors in shards: one packed row per shard, and a grid of cells where shards meet blocks of queries.

Shards are dealt by a hash of the row's id, so they are even however alike the vectors are.  A cell holds one
shard and one block of queries, both of bounded size; nothing of it is ever gathered elsewhere than in its task,
and only the best few rows of each query leave it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskgraph.llm.common import stored

QUERY_ROWS = 2048
FOUND = "query_row long, query_id long, vec_id long, score "


def usable(vector: str, zero: bool) -> Column:
    """Not null, without null, NaN or infinite components; with ``zero`` False also not all zero or empty."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    good = F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))
    return good if zero else good & F.exists(vector, lambda x: x != 0)


def matrix(lists: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of numbers as rows of a double matrix; shorter lists are filled up with zeros."""
    chunk = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = chunk.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = chunk.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = max(int(sizes.max(initial=0)), width or 0)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def shards(rows: DataFrame, build: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: dict[str, str], shard_rows: int, purpose: str) -> tuple[DataFrame, int]:
    """One stored row per shard: (shard, columns of ``schema`` as bytes).  ``build`` gets a shard's ids and vectors."""
    count = max(1, -(-rows.count() // shard_rows))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")  # the same shard whenever and wherever it is built
        made = build(table["vec_id"].to_numpy(), matrix(table["vector"]))
        columns = [pa.array([np.ascontiguousarray(made[k], dtype=t).tobytes()], pa.binary()) for k, t in schema.items()]
        return pa.Table.from_arrays([pa.array([table["shard"][0].as_py()], pa.int32()), *columns], names=["shard", *schema])

    packed = (
        rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int"))
        .groupBy("shard")
        .applyInArrow(pack, "shard int, " + ", ".join(f"{k} binary" for k in schema))
    )
    return stored(packed, purpose), count


def meet(
    index: DataFrame,
    shard_count: int,
    queries: DataFrame,
    search: Callable[[dict[str, bytes], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]],
    k: int,
    descending: bool,
    query_rows: int = QUERY_ROWS,
    score: str = "double",
) -> DataFrame:
    """The ``k`` best rows of every query: query_id, rank, vec_id, score; ties go to the smaller vec_id.

    ``search`` gets a shard's columns and a block's query ids and vectors, and returns (query number, vec_id, score)
    arrays with at least the query's k best rows of the shard; scores are of type ``score``, double or long.
    """
    kind = pa.int64() if score == "long" else pa.float64()
    queries = stored(queries.withColumn("query_row", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-queries.count() // query_rows))
    names = [c for c in index.columns if c != "shard"]

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.Table.from_arrays([pa.array([], pa.int64())] * 3 + [pa.array([], kind)], names=["query_row", "query_id", "vec_id", "score"])
        if not left.num_rows or not right.num_rows:
            return empty
        ids = right["vec_id"].to_numpy()
        number, found, scores = search({n: left[n][0].as_py() for n in names}, ids, matrix(right["vector"]))
        return pa.Table.from_arrays(
            [pa.array(right["query_row"].to_numpy()[number]), pa.array(ids[number]), pa.array(found), pa.array(scores, kind)],
            names=["query_row", "query_id", "vec_id", "score"],
        )

    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("shard", "block")
    right = (
        queries.withColumn("block", F.pmod(F.xxhash64("query_row"), F.lit(blocks)).cast("int"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shard_count - 1))))
        .groupBy("shard", "block")
    )
    found = left.cogroup(right).applyInArrow(cell, FOUND + score)
    best = Window.partitionBy("query_row").orderBy(F.desc("score") if descending else F.asc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
