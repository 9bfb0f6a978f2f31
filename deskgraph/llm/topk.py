"""Exact top-k by inner product with block-at-a-time pruning.

A shard's rows are put in an order that keeps like rows together and cut into ranges, the blocks.  A block has a forward
index, its rows' weights, and the largest and smallest weight of each term.  The sum over a query's terms of weight times the
block's maximum (minimum, if the query's weight is negative) bounds every score in the block.  A query goes through the
blocks from the largest bound down and stops where the bound falls below its kth score; an equal bound
is still scored, since a tie may go to a smaller id.  So the result is exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskgraph.llm import grid

SHARD_ROWS = 16_384
BLOCK_ROWS = 64
SCALE = 256
#: Weights are whole numbers held as doubles: floor(scale * x) of a double is one.
INDEX = {"ids": "<i8", "weights": "<f8", "high": "<f8", "low": "<f8"}
#: Sums of products below this are exact in doubles.
EXACT = 2.0**53


def build(ids: np.ndarray, vectors: np.ndarray, block_rows: int = BLOCK_ROWS, scale: int = SCALE) -> dict[str, np.ndarray]:
    """Integer weights, floor(scale * x), in blocks of rows that are alike, with each block's term maxima and minima."""
    weights = np.floor(scale * vectors)
    pivots = weights[:: max(1, len(weights) // 64)][:64].astype(np.float32)
    near = (weights.astype(np.float32) @ pivots.T).argmax(1) if weights.size else np.zeros(len(weights), int)
    order = np.lexsort((ids, near))
    ids, weights = ids[order], weights[order]
    starts = np.arange(0, len(ids), block_rows)
    return {"ids": ids, "weights": weights, "high": np.maximum.reduceat(weights, starts), "low": np.minimum.reduceat(weights, starts)}


def search(
    index: dict[str, bytes], query_ids: np.ndarray, queries: np.ndarray, k: int, block_rows: int = BLOCK_ROWS, scale: int = SCALE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of each query's ``k`` best rows of one shard.  All queries take their next block together."""
    ids = np.frombuffer(index["ids"], "<i8")
    weights = np.frombuffer(index["weights"], "<f8").reshape(len(ids), -1)
    blocks = -(-len(ids) // block_rows)
    high, low = (np.frombuffer(index[n], "<f8").reshape(blocks, -1) for n in ("high", "low"))
    width = max(weights.shape[1], queries.shape[1])
    fill = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
    weights, high, low = fill(weights), fill(high), fill(low)
    spare = blocks * block_rows - len(ids)
    grouped = np.pad(weights, ((0, spare), (0, 0))).reshape(blocks, block_rows, width)
    named = np.pad(ids, (0, spare)).reshape(blocks, block_rows)
    real = (np.arange(blocks * block_rows) < len(ids)).reshape(blocks, block_rows)
    query = fill(np.floor(scale * queries))
    with np.errstate(over="ignore"):
        largest = (np.abs(query) @ np.maximum(np.abs(high), np.abs(low)).max(0)).max(initial=0) if len(ids) else 0
    if not largest < EXACT:
        return search_exactly(ids, weights, query_ids, query, k)
    scores, found = np.full((len(query), k), -np.inf), np.full((len(query), k), np.iinfo(np.int64).max)
    for begin in range(0, len(query), 256):  # bounds the memory of a round
        part = slice(begin, begin + 256)
        q = query[part]
        bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        order = np.argsort(-bound, axis=1, kind="stable")
        best, name = scores[part], found[part]
        active = np.arange(len(q))
        for turn in range(blocks):
            block = order[active, turn]
            going = bound[active, block] >= best[active, -1]
            active, block = active[going], block[going]
            if not len(active):
                break
            now = (grouped[block] @ q[active][:, :, None])[:, :, 0]
            now[~real[block] | (named[block] == query_ids[part][active][:, None])] = -np.inf
            some = (now >= best[active, -1:]).any(1)
            rows = active[some]
            s, i = np.hstack([best[rows], now[some]]), np.hstack([name[rows], named[block[some]]])
            i[s == -np.inf] = np.iinfo(np.int64).max
            top = np.lexsort((i, -s), axis=1)[:, :k]
            best[rows], name[rows] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
    number, place = np.nonzero(scores > -np.inf)
    return number, found[number, place], scores[number, place].astype(np.int64)


def search_exactly(ids: np.ndarray, weights: np.ndarray, query_ids: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`search`, with sums of any size, over a shard and queries whose products doubles cannot hold.

    Sums are formed in Python's whole numbers, a query at a time, for rows whose double-precision sum may be among the best.
    """
    number, found, score = [], [], []
    order = np.argsort(ids, kind="stable")
    ids, weights = ids[order], weights[order]
    sizes = np.abs(weights)
    for i, q in enumerate(query):
        own = np.flatnonzero(ids != query_ids[i])
        about, error = weights[own] @ q, 1e-13 * (len(q) + 1) * (sizes[own] @ np.abs(q))
        if len(own) > k and np.isfinite(error).all():
            floor = np.partition(about - error, len(own) - k)[len(own) - k]  # k rows have at least this much
            own = own[about + error >= floor]
        whole = [int(v) for v in q]
        sums = [sum(a * int(w) for a, w in zip(whole, weights[r].tolist(), strict=True) if a and w) for r in own]
        for at in sorted(range(len(own)), key=lambda at: (-sums[at], ids[own[at]]))[:k]:
            if not -(1 << 63) <= sums[at] < 1 << 63:
                raise OverflowError(f"the score of vectors {query_ids[i]} and {ids[own[at]]} does not fit a 64-bit integer")
            number.append(i)
            found.append(ids[own[at]])
            score.append(sums[at])
    return np.array(number, np.int64), np.array(found, np.int64), np.array(score, np.int64)


def top_k(vectors: DataFrame, is_query, k: int = 5, shard_rows: int = SHARD_ROWS, query_rows: int = grid.QUERY_ROWS) -> DataFrame:
    """The ``k`` rows with the largest integer inner product for each query: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on them.  A query's own id is no candidate, fewer rows
    than k give fewer results.  Vectors that are null or hold null, NaN or infinite components take no part; of
    different lengths, the shorter counts as filled up with zeros.  Scores are exact, also above 2^53; one among a query's best that does
    not fit a 64-bit integer is an error.  An empty table gives no rows.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & grid.usable("embedding", zero=True)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), is_query.alias("asks")
    )
    index, count = grid.shards(rows.select("vec_id", "vector"), build, INDEX, shard_rows, "blocks")
    run = lambda shard, ids, queries: search(shard, ids, queries, k)
    best = grid.meet(index, count, rows.where("asks").select("vec_id", "vector"), run, k, descending=True, query_rows=query_rows, score="long")
    return best
