"""A stored index of case vectors for exact top-k search by inner product.

Cases lie in cells, each with a centre c and a radius r, the largest distance of a case from the centre.  For a query q no case of a cell
scores above q.c + |q| r.  A search first reads the most promising cells of each query, which gives a kth score to beat; then only
the (query, cell) pairs whose bound reaches that score, so the result is exact however the cells were chosen.

On disk: ``members`` (case_id, embedding, distance) partitioned by cell, ``cells`` (one row each) and, if wanted, ``cases`` (the
other columns).  The index is built once, opened anywhere and used by any number of searches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from deskgraph.operators.skew import top_n_per_group
from deskgraph.operators.vectors import TIE_DIGITS, best_columns, common_width, matrix, usable_vector
from deskgraph.session import materialise, shared_folder

#: A cell has about so many cases, but there are never more cells than ``MAX_CELLS``; larger cells are searched in parts.
CELL_ROWS = 2048
MAX_CELLS = 1024
#: Cases and queries are dealt into ``PARTS`` parts each while these have so many rows, and a task meets one part of both.  So a vector is
#: copied ``PARTS`` times however many there are, until a part would hold more than ``BLOCK_VALUES`` values.
BLOCK_ROWS = 2048
PARTS = 8
BLOCK_VALUES = 4_194_304
#: Scores, or (query, cell) pairs, that a task holds at once in doubles.
SLICE_CELLS = 500_000
#: Vectors that are met with all centres at once.
SLICE_ROWS = 1024
#: Cells that every query reads before any bound is known.
PROBES = 2
#: Centres are fitted on about so many cases for each cell, chosen by a hash of the id; they steer speed only.
FIT_ROWS = 32


@dataclass(frozen=True)
class CaseIndex:
    """An opened index: where it lies, the length of its vectors, and the cells' centres, radii and sizes."""

    spark: SparkSession
    path: str
    width: int | None
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def build(
        corpus: DataFrame,
        path: str | None = None,
        case_id: str = "case_id",
        vector: str = "embedding",
        width: int | None = None,
        cell_rows: int = CELL_ROWS,
        with_cases: bool = False,
    ) -> "CaseIndex":
        """Write the index of ``corpus`` to ``path`` (a fresh shared folder without it) and open it.

        Vectors that are null, hold null, NaN or infinite values or are not of ``width`` values (without it the commonest length) are
        left out; a case without an id too.  ``with_cases`` keeps the other columns beside the vectors.
        """
        spark = corpus.sparkSession
        path = path or shared_folder(spark, "case-index")
        width = common_width(corpus, corpus, vector) if width is None else width
        cases = corpus.where(usable_vector(vector, width) & F.col(case_id).isNotNull() & F.lit(width is not None)).select(
            F.col(case_id).alias("case_id"), F.col(vector).alias("embedding")
        )
        rows = cases.count()
        count = min(MAX_CELLS, max(1, -(-rows // cell_rows)))
        centres = _centres(cases, rows, count, width or 0)

        def place(column: pa.Array) -> pa.Array:
            cells, distances = [np.zeros(0, np.int64)], [np.zeros(0)]
            for start in range(0, len(column), SLICE_ROWS):
                x = matrix(column.slice(start, SLICE_ROWS))
                squares = (x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)
                cells.append(squares.argmin(1))
                distances.append(np.sqrt(((x - centres[cells[-1]]) ** 2).sum(1)))
            return pa.StructArray.from_arrays([pa.array(np.concatenate(cells), pa.int32()), pa.array(np.concatenate(distances))], names=["cell", "distance"])

        place.__annotations__ = {"column": pa.Array, "return": pa.Array}
        placed = cases.withColumn("_at", arrow_udf(place, "struct<cell: int, distance: double>")("embedding")).select(
            "case_id", "embedding", F.col("_at.distance").alias("distance"), F.col("_at.cell").alias("cell")
        )
        # rows of one cell meet in few files; Spark splits the partition of a large cell
        placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/members")
        members = spark.read.schema(placed.schema).parquet(f"{path}/members")
        sizes = members.groupBy("cell").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("members"))
        centre = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)], "cell int, centre array<double>")
        # null columns keep the types of the members, also of an index without any
        types = [F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in ("case_id", "embedding")]
        cells = sizes.join(F.broadcast(centre), "cell").select("*", F.lit(width).cast("int").alias("width"), *types)
        cells.coalesce(1).write.parquet(f"{path}/cells")  # MAX_CELLS rows at most
        if with_cases:
            texts = corpus.select(F.col(case_id).alias("case_id"), *[c for c in corpus.columns if c not in (case_id, vector)])
            texts.write.option("compression", "zstd").parquet(f"{path}/cases")
        return CaseIndex.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> "CaseIndex":
        """The index that lies at ``path``; reads its cells, at most ``MAX_CELLS`` rows, and no case."""
        cells = spark.read.parquet(f"{path}/cells").select("cell", "centre", "radius", "members", "width").orderBy("cell").toArrow()
        size = int(cells["cell"].to_numpy().max(initial=-1)) + 1  # a centre that no case is nearest to has no row
        width = cells["width"][0].as_py() if size else None  # an empty index has no cell
        centres, radii, sizes = np.zeros((size, width or 0)), np.zeros(size), np.zeros(size, np.int64)
        at = cells["cell"].to_numpy()
        centres[at], radii[at], sizes[at] = matrix(cells["centre"]) if size else centres, cells["radius"].to_numpy(), cells["members"].to_numpy()
        return CaseIndex(spark, path, width, centres, radii, sizes)

    def members(self, cells: list[int] | None = None) -> DataFrame:
        """case_id, embedding and cell of all cases, or of some cells, of which only the folders are read."""
        types = self.spark.read.parquet(f"{self.path}/cells").select("case_id", "embedding", "cell").schema
        rows = self.spark.read.schema(types).parquet(f"{self.path}/members")
        return rows if cells is None else rows.where(F.col("cell").isin(cells))

    def cases(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cases")

    def search(self, queries: DataFrame, k: int = 3, query_id: str = "query_id", vector: str = "embedding", probes: int = PROBES) -> DataFrame:
        """Exact top ``k`` of every query: query_id, case_id, similarity, rank.  Ties within 1e-9 go to the lower case id.

        A query whose vector cannot be used finds nothing.
        """
        usable = queries.where(usable_vector(vector, self.width) & F.lit(self.width is not None))
        rows = usable.select(F.monotonically_increasing_id().alias("query_row"), F.col(query_id).alias("query_id"), F.col(vector).alias("_vector"))
        rows = materialise(rows.withColumn("probed", self._probed("_vector", probes)), "queries")
        found = self._score(self._asked(rows), k)
        order = [F.desc("similarity"), F.col("case_id")]
        if (self.sizes > 0).sum() > probes:
            found = materialise(top_n_per_group(found, ["query_row"], order, k, rank="_place"), "probed")
            # the score to beat: null while a query has fewer than k cases
            beaten = found.groupBy("query_row").agg(F.min(F.when(F.col("_place") == k, F.col("similarity"))).alias("beat"))
            rest = self._asked(materialise(rows.join(beaten, "query_row", "left"), "beaten"), rest=True)
            found = found.drop("_place").unionByName(self._score(rest, k))
        ranked = top_n_per_group(found, ["query_row"], order, k, rank="rank")
        return ranked.select("query_id", "case_id", "similarity", F.col("rank").cast("bigint").alias("rank"))

    def _probed(self, vector: str, probes: int):
        """The ``probes`` cells whose centres score highest."""
        centres, sizes = self.centres, self.sizes

        def first(column: pa.Array) -> pa.Array:
            out = []
            for start in range(0, len(column), SLICE_ROWS):
                x = matrix(column.slice(start, SLICE_ROWS))
                dots = np.where(sizes > 0, x @ centres.T, -np.inf) if len(centres) else np.zeros((len(x), 0))
                out += [np.array(sorted(c for c in row.tolist() if sizes[c]), np.int32) for row in np.argsort(-dots, axis=1, kind="stable")[:, :probes]]
            offsets = np.cumsum([0, *map(len, out)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *out])))

        first.__annotations__ = {"column": pa.Array, "return": pa.Array}
        return arrow_udf(first, "array<int>")(vector)

    def _asked(self, rows: DataFrame, rest: bool = False) -> DataFrame:
        """``rows`` with the cells to read for each: the probed ones, or with ``rest`` the others that can still hold a result."""
        centres, radii, sizes = self.centres, self.radii, self.sizes
        if not rest:
            return rows.withColumn("beat", F.lit(None).cast("double")).withColumn("cells", F.col("probed"))

        def choose(column: pa.Array, probed: pa.Array, beat: pa.Array) -> pa.Array:
            out = []
            for start in range(0, len(column) if len(centres) else 0, SLICE_ROWS):
                x = matrix(column.slice(start, SLICE_ROWS))
                length = np.sqrt((x * x).sum(1))[:, None]
                # rounding in products and stored scores is far below this allowance
                slack = 1e-6 * (1 + length * (np.sqrt((centres * centres).sum(1)) + radii))
                bound = x @ centres.T + length * radii + slack
                least = np.array([-np.inf if b is None else b for b in beat.slice(start, SLICE_ROWS).to_pylist()])
                wanted = (bound >= least[:, None]) & (sizes > 0)
                for row, known in zip(wanted, probed.slice(start, SLICE_ROWS).to_pylist(), strict=True):
                    row[known] = False
                    out.append(np.flatnonzero(row).astype(np.int32))
            out = out or [np.zeros(0, np.int32)] * len(column)
            offsets = np.cumsum([0, *map(len, out)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *out])))

        choose.__annotations__ = {"column": pa.Array, "probed": pa.Array, "beat": pa.Array, "return": pa.Array}
        return rows.withColumn("cells", arrow_udf(choose, "array<int>")("_vector", "probed", "beat"))

    def _pairs(self, rows: DataFrame, probes: int, rest: bool = False) -> DataFrame:
        """:meth:`_asked` with a row for each (query, cell)."""
        asked = self._asked(rows.withColumn("probed", self._probed("_vector", probes)), rest)
        return asked.select("query_row", "query_id", "_vector", "beat", F.explode("cells").alias("cell"))

    def _score(self, asked: DataFrame, k: int) -> DataFrame:
        """Of each query at most the ``k`` best cases of each zone of the cells it asks for: query_row, query_id, case_id, similarity.

        ``asked`` has ``cells`` or, one by one, ``cell``.  Only the cells asked for are read.  Cells lie together in zones and a large cell in
        several; a task meets a part of the queries with a zone, so a vector is copied once for each zone or part, not for each cell.
        """
        if "cells" not in asked.columns:
            asked = asked.withColumn("cells", F.array("cell"))
        cells = sorted(r[0] for r in asked.select("cells").mapInArrow(_distinct, "cell int").distinct().collect())  # MAX_CELLS rows at most
        members = self.members(cells)
        shape = f"query_row long, query_id {asked.schema['query_id'].dataType.simpleString()}, case_id {members.schema['case_id'].dataType.simpleString()}, similarity double"
        if not cells:
            return self.spark.createDataFrame([], shape)
        zones = _zones({c: int(self.sizes[c]) for c in cells}, self.width)
        query_parts = _parts(asked.count(), self.width)
        plan = F.broadcast(self.spark.createDataFrame([(c, first, parts) for c, (first, parts) in zones.items()], "cell int, first int, zone_parts int"))
        right = members.join(plan, "cell").withColumn("zone", (F.col("first") + F.pmod(F.xxhash64("case_id"), F.col("zone_parts"))).cast("int"))
        right = right.select("case_id", "embedding", "cell", "zone", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))).alias("qp"))
        part = F.pmod(F.xxhash64("query_row"), F.lit(query_parts)).cast("int")
        left = asked.withColumn("qp", part).select("query_row", "query_id", "_vector", "beat", "qp", F.explode(_by_zone(zones)("cells")).alias("_z"))
        left = left.select("query_row", "query_id", "_vector", "beat", "qp", "_z.zone", "_z.cells")

        def meet(q: pa.Table, c: pa.Table) -> pa.Table:
            at, case, score = _meet(q, c, k)
            ids = [q[n].combine_chunks().take(pa.array(at)) for n in ("query_row", "query_id")]
            return pa.Table.from_arrays([*ids, c["case_id"].combine_chunks().take(pa.array(case)), pa.array(score)], names=["query_row", "query_id", "case_id", "similarity"])

        # few large groups: dealt to more tasks than there are groups, so that few share one
        tasks = min(1024, 2 * query_parts * max(first + parts for first, parts in zones.values()))
        left, right = (side.repartition(tasks, "zone", "qp").groupBy("zone", "qp") for side in (left, right))
        return left.cogroup(right).applyInArrow(meet, shape)


def _parts(rows: int, width: int) -> int:
    """How many parts ``rows`` are dealt into: up to ``PARTS`` of ``BLOCK_ROWS`` rows, more only where a part would hold over ``BLOCK_VALUES`` values."""
    return max(1, min(PARTS, -(-rows // BLOCK_ROWS)), -(-rows * max(1, width) // BLOCK_VALUES))


def _zones(sizes: dict[int, int], width: int) -> dict[int, tuple[int, int]]:
    """First zone and number of zones of each cell; a zone holds several small cells or a part of a large one."""
    total, out, zone, held = sum(sizes.values()), {}, 0, 0
    most = -(-total // _parts(total, width))
    for cell, size in sizes.items():
        if held and held + size > most:
            zone, held = zone + 1, 0
        parts = max(1, -(-size // most))
        out[cell] = (zone, parts)
        zone, held = (zone + parts, 0) if parts > 1 else (zone, held + size)
    return out


def _by_zone(zones: dict[int, tuple[int, int]]):
    """A function from a list of cells to their zones, each with those of the cells that lie there."""
    cell = np.concatenate([np.full(parts, c) for c, (_, parts) in zones.items()])
    zone = np.concatenate([np.arange(first, first + parts) for first, parts in zones.values()])  # rises, as cells come in order
    begin = np.full(max(zones) + 1, 0)
    count = np.full(max(zones) + 1, 0)
    begin[list(zones)] = np.searchsorted(cell, list(zones))
    count[list(zones)] = [parts for _, parts in zones.values()]

    def place(cells: pa.Array) -> pa.Array:
        step = max(1, SLICE_CELLS // len(cell))
        parts = [some(cells.slice(start, step)) for start in range(0, len(cells), step)]
        return pa.concat_arrays(parts) if parts else some(cells)

    def some(cells: pa.Array) -> pa.Array:
        sizes, asked = cells.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), cells.flatten().to_numpy(zero_copy_only=False)
        n = count[asked]
        at = np.repeat(begin[asked] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        row = np.repeat(np.repeat(np.arange(len(sizes)), sizes), n)
        new = np.ones(len(at), bool)
        new[1:] = (row[1:] != row[:-1]) | (zone[at][1:] != zone[at][:-1])
        starts = np.flatnonzero(new)
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)), pa.int32()), pa.array(cell[at], pa.int32()))
        pairs = pa.StructArray.from_arrays([pa.array(zone[at[starts]], pa.int32()), lists], names=["zone", "cells"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[starts], np.arange(len(sizes) + 1)), pa.int32()), pairs)

    place.__annotations__ = {"cells": pa.Array, "return": pa.Array}
    return arrow_udf(place, "array<struct<zone: int, cells: array<int>>>")


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0).flatten().unique().cast(pa.int32())], names=["cell"])


def _meet(q: pa.Table, c: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``q``, rows of ``c`` and scores of the ``k`` best of each query's cells that reach its score to beat; equal scores by case id."""
    none = np.zeros(0, np.int64)
    if not q.num_rows or not c.num_rows:
        return none, none, np.zeros(0)
    by_id = pc.sort_indices(c["case_id"].combine_chunks()).to_numpy()
    cell = c["cell"].to_numpy()[by_id]
    rank = np.argsort(cell, kind="stable")  # by cell, then by id
    # doubles are made for one cell at a time
    cell, y = cell[rank], matrix(c["embedding"], None)[by_id[rank]]
    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    # a cell of many rows is met in runs of CELL_ROWS
    starts = np.concatenate([np.arange(a, b, CELL_ROWS) for a, b in pairwise([*starts.tolist(), len(cell)])])
    ends = np.append(starts[1:], len(cell))
    vectors, lists = q["_vector"].combine_chunks(), q["cells"].combine_chunks()
    beat = np.array([-np.inf if b is None else b for b in q["beat"].to_pylist()])
    out = [(none, none, np.zeros(0))]
    step = max(1, SLICE_CELLS // max(y.shape[1], int((ends - starts).max())))
    for begin in range(0, q.num_rows, step):
        x, part, least = matrix(vectors.slice(begin, step)), lists.slice(begin, step), beat[begin : begin + step].copy()
        asked = part.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(x)), part.value_lengths().to_numpy(zero_copy_only=False))
        by_cell = np.argsort(asked, kind="stable")
        asked, owner = asked[by_cell], owner[by_cell]
        held, fresh, waiting = (none, none, np.zeros(0)), [], 0
        for low, high in zip(starts, ends, strict=True):
            rows = owner[np.searchsorted(asked, cell[low]) : np.searchsorted(asked, cell[low], "right")]
            if not len(rows):
                continue
            scores = x[rows] @ y[low:high].astype(np.float64, copy=False).T
            open_rows = np.flatnonzero(least[rows] == -np.inf)  # any case counts for these
            if len(open_rows):
                block = np.round(scores[open_rows], TIE_DIGITS)
                best = best_columns(block, min(k, block.shape[1]))
                at = np.repeat(open_rows, best.shape[1])
                fresh.append((rows[at], rank[low + best.ravel()], np.take_along_axis(block, best, axis=1).ravel()))
            # scores are rounded later, so one just below the score to beat may still reach it
            limit = np.where(least[rows] == -np.inf, np.inf, least[rows] - 2 * 10.0**-TIE_DIGITS)
            at, column = np.nonzero(scores >= limit[:, None])
            fresh.append((rows[at], rank[low + column], np.round(scores[at, column], TIE_DIGITS)))
            waiting += len(at) + len(open_rows) * min(k, int(high - low))
            if waiting > 2 * k * len(x) or len(open_rows):
                held, fresh, waiting = _top([held, *fresh], k), [], 0
                full = np.flatnonzero(np.bincount(held[0], minlength=len(x)) >= k)
                if len(full):
                    last = np.searchsorted(held[0], full, "right") - 1
                    least[full] = np.maximum(least[full], held[2][last])
        row, place, score = _top([held, *fresh], k)
        out.append((row + begin, place, score))
    row, place, score = (np.concatenate(column) for column in zip(*out, strict=True))
    return row, by_id[place], score + 0.0


def _top(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` highest scores of each row, equal ones by place, ordered so."""
    row, place, score = (np.concatenate(column) for column in zip(*parts, strict=True))
    order = np.lexsort((place, -score, row))
    row, place, score = row[order], place[order], score[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], place[kept], score[kept]


def _centres(cases: DataFrame, rows: int, count: int, width: int) -> np.ndarray:
    """``count`` centres at most, from a sample by hash whose size follows ``count``, not the corpus."""
    if count == 1:
        return np.zeros((1, width))  # the one cell's radius is its longest vector
    share = max(1, rows // (count * FIT_ROWS))
    few = cases.where(F.pmod(F.xxhash64("case_id"), F.lit(share)) == 0).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    few = materialise(few, "centre-sample")
    model = KMeans(k=count, maxIter=4, seed=7, initMode="random").fit(few)
    return np.array(model.clusterCenters()).reshape(-1, width)


def topk_similar(
    queries: DataFrame,
    corpus: DataFrame | CaseIndex,
    k: int = 3,
    query_id: str = "query_id",
    case_id: str = "case_id",
    vector: str = "embedding",
    cell_rows: int = CELL_ROWS,
    width: int | None = None,
) -> DataFrame:
    """Exact inner-product top ``k`` of every query: ``query_id, case_id, similarity, rank``.

    ``corpus`` is an index, or cases of which one is built for this search.  Vectors with null, NaN or infinite values
    take no part, nor do those of another length than ``width``, without it the length of the most (query, case) pairs.
    """
    if not isinstance(corpus, CaseIndex):
        width = common_width(queries, corpus, vector) if width is None else width
        corpus = CaseIndex.build(corpus, None, case_id, vector, width, cell_rows)
    return corpus.search(queries, k, query_id, vector)

