"""Approximate nearest neighbours with a robust-pruned directed graph in every shard.

Rows enter the graph in batches that grow with it.  A greedy search with a beam proposes neighbours; robust pruning takes
the nearest, drops every candidate that is nearer to it by the factor ``alpha`` than to the row itself, and goes on
with what is left, so edges stay few and point in different directions.  Edges are added both ways and
pruned again where a row has too many.  A query is searched in every shard, from the same entry rows.

Equal vectors of a shard are one row of the graph, which lists their ids, so no group of copies can fill a beam.
Distances are measured again in double precision on the original vectors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskgraph.llm import grid

SHARD_ROWS = 8_192
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 160
ENTRIES = 64
ALPHA = 1.2
BATCH = 512
EXPAND = 4
INDEX = {"ids": "<i8", "group": "<i4", "vectors": "<f8", "edges": "<i4"}


def _near(x: np.ndarray, square: np.ndarray, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distance, less the query's own square, from each q to its row numbers; -1 is infinitely far."""
    d = square[rows] - 2 * np.matmul(x[rows], q[:, :, None])[:, :, 0]
    d[rows < 0] = np.inf
    return d


def beam(x: np.ndarray, square: np.ndarray, edges: np.ndarray, entries: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy beam search of all queries at once: row numbers (-1: none) and distances, nearest first."""
    n = len(q)
    ids = np.tile(entries, (n, 1))
    d = square[entries][None] - 2 * q @ x[entries].T
    if ids.shape[1] < width:
        pad = width - ids.shape[1]
        ids, d = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1), np.pad(d, ((0, 0), (0, pad)), constant_values=np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :width]
    ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
    seen = ids < 0
    live = np.arange(n)
    while len(live):
        # the first rows of the beam that were not expanded yet
        rank = np.cumsum(~seen[live], axis=1)
        pick = ~seen[live] & (rank <= EXPAND)
        seen[live] |= pick
        which, place = np.nonzero(pick)
        slot = rank[which, place] - 1
        chosen = np.full((len(live), EXPAND), -1)
        chosen[which, slot] = ids[live][which, place]
        new = np.where(chosen[:, :, None] >= 0, edges[chosen], -1).reshape(len(live), -1)
        new = np.sort(new, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        far = _near(x, square, new, q[live])
        far[far >= d[live, -1:]] = np.inf
        keep = np.isfinite(far)
        most = int(keep.sum(1).max(initial=0))
        if most:
            front = np.argsort(~keep, axis=1, kind="stable")[:, :most]
            new, far = np.take_along_axis(new, front, 1), np.take_along_axis(far, front, 1)
            known = (new[:, :, None] == ids[live][:, None, :]).any(2)
            far[known] = np.inf
            new[~np.isfinite(far)] = -1
            all_ids, all_d = np.hstack([ids[live], new]), np.hstack([d[live], far])
            all_seen = np.hstack([seen[live], new < 0])
            order = np.argsort(all_d, axis=1, kind="stable")[:, :width]
            ids[live], d[live] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_d, order, 1)
            seen[live] = np.take_along_axis(all_seen, order, 1)
        live = live[~seen[live].all(1)]
    ids[~np.isfinite(d)] = -1
    return ids, d


def prune(x: np.ndarray, square: np.ndarray, rows: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of each row's candidates (-1: none) to at most ``degree`` diverse ones."""
    cand = np.sort(candidates, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    cand[cand == rows[:, None]] = -1
    d = _near(x, square, cand, x[rows]) + square[rows][:, None]
    order = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    vectors, alive = x[cand], cand >= 0
    out = np.full((len(rows), degree), -1, np.int32)
    every = np.arange(len(rows))
    for r in range(degree):
        first = alive.argmax(1)
        have = alive[every, first]
        if not have.any():
            break
        chosen = cand[every, first]
        out[have, r] = chosen[have]
        between = square[cand] + square[chosen][:, None] - 2 * np.matmul(vectors, x[chosen][:, :, None])[:, :, 0]
        alive &= ~((alpha * alpha * between <= d) & have[:, None])
        alive[every, first] = False
    return out


def build(ids: np.ndarray, vectors: np.ndarray, degree: int = DEGREE, width: int = BUILD_BEAM, alpha: float = ALPHA) -> dict[str, np.ndarray]:
    """The graph of one shard over its distinct vectors.  Deterministic."""
    distinct, group = np.unique(vectors, axis=0, return_inverse=True)
    n = len(distinct)
    mix = np.random.default_rng(n).permutation(n)
    place = np.empty(n, np.int64)
    place[mix] = np.arange(n)
    exact, group = distinct[mix], place[group.reshape(-1)]
    x = centred(exact, *frame(exact))
    square = (x * x).sum(1)
    edges = np.full((n, degree), -1, np.int32)
    done = min(n, 2 * degree)
    first = np.arange(done)
    edges[:done] = prune(x, square, first, np.tile(first, (done, 1)), degree, alpha)
    while done < n:
        batch = np.arange(done, min(n, done + min(BATCH, max(32, done // 2))))
        near, _ = beam(x, square, edges, np.arange(min(ENTRIES, done)), x[batch], width)
        edges[batch] = prune(x, square, batch, near, degree, alpha)
        _back(x, square, edges, batch, degree, alpha)
        done = int(batch[-1]) + 1
    return {"ids": ids, "group": group, "vectors": exact, "edges": edges}


def frame(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """Mean and largest deviation of a shard's vectors."""
    middle = vectors.mean(0) if len(vectors) else np.zeros(vectors.shape[1])
    return middle, float(np.abs(vectors - middle).max(initial=0)) or 1.0


def centred(vectors: np.ndarray, middle: np.ndarray, scale: float) -> np.ndarray:
    """Single-precision vectors in which the graph is searched: what is lost by rounding is relative to the shard's spread."""
    return ((vectors - middle) / scale).astype(np.float32)


def _back(x: np.ndarray, square: np.ndarray, edges: np.ndarray, batch: np.ndarray, degree: int, alpha: float) -> None:
    """Add the reverse of the batch's edges, pruning rows that get too many."""
    source, target = np.repeat(batch, degree), edges[batch].reshape(-1)
    source, target = source[target >= 0], target[target >= 0]
    gap = square[source] + square[target] - 2 * np.einsum("ij,ij->i", x[source], x[target])
    order = np.lexsort((gap, target))
    source, target = source[order], target[order]
    rows, begin, count = np.unique(target, return_index=True, return_counts=True)
    most = 3 * degree  # nearest first; what is beyond only leaves the graph an edge poorer
    place = np.arange(len(target)) - np.repeat(begin, count)
    fits = place < most
    new = np.full((len(rows), min(most, int(count.max(initial=0)))), -1, np.int64)
    new[np.repeat(np.arange(len(rows)), count)[fits], place[fits]] = source[fits]
    both = np.hstack([edges[rows], new])
    for low in range(0, len(rows), BATCH):
        part = slice(low, low + BATCH)
        edges[rows[part]] = prune(x, square, rows[part], both[part], degree, alpha)


def search(index: dict[str, bytes], query_ids: np.ndarray, queries: np.ndarray, k: int, width: int = SEARCH_BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, distance) of the ``k`` nearest rows that the graph of one shard finds for each query."""
    ids, group = np.frombuffer(index["ids"], "<i8"), np.frombuffer(index["group"], "<i4")
    n = int(group.max()) + 1
    exact = np.frombuffer(index["vectors"], "<f8").reshape(n, -1)
    edges = np.frombuffer(index["edges"], "<i4").reshape(n, -1)
    wide = max(exact.shape[1], queries.shape[1])
    exact, queries = np.pad(exact, ((0, 0), (0, wide - exact.shape[1]))), np.pad(queries, ((0, 0), (0, wide - queries.shape[1])))
    middle, scale = frame(exact)
    x = centred(exact, middle, scale)
    square = (x * x).sum(1)
    order = np.lexsort((ids, group))
    begin = np.searchsorted(group[order], np.arange(n + 1))
    number, found, score = [], [], []
    for low in range(0, len(queries), BATCH):
        q = queries[low : low + BATCH]
        near, _ = beam(x, square, edges, np.arange(min(ENTRIES, n)), centred(q, middle, scale), max(width, k + 1))
        near = near[:, : k + 8]
        gap = np.sqrt(((exact[near] - q[:, None]) ** 2).sum(2))
        gap[near < 0] = np.inf
        for j in range(len(q)):
            # copies of a vector are equally far: their k + 1 smallest ids are enough
            rows = [(gap[j, c], i) for c in np.flatnonzero(near[j] >= 0) for i in ids[order[begin[near[j, c]] : begin[near[j, c] + 1]][: k + 1]]]
            best = sorted(r for r in rows if r[1] != query_ids[low + j])[:k]
            number += [low + j] * len(best)
            found += [r[1] for r in best]
            score += [r[0] for r in best]
    return np.array(number, np.int64), np.array(found, np.int64), np.array(score)


def nearest(vectors: DataFrame, is_query, k: int = 10, shard_rows: int = SHARD_ROWS, width: int = SEARCH_BEAM, query_rows: int = grid.QUERY_ROWS) -> DataFrame:
    """The ``k`` nearest rows found for each query by Euclidean distance: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on them.  A query's own id is no candidate.
    Vectors that are null, zero or hold null, NaN or infinite components take no part; of different
    lengths, the shorter counts as filled up with zeros.  Every other row is in the index of its shard.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & grid.usable("embedding", zero=False)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), is_query.alias("asks")
    )
    index, count = grid.shards(rows.select("vec_id", "vector"), build, INDEX, shard_rows, "graph")
    run = lambda shard, ids, queries: search(shard, ids, queries, k, width)
    return grid.meet(index, count, rows.where("asks").select("vec_id", "vector"), run, k, descending=False, query_rows=query_rows)
