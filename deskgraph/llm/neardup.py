"""Near-duplicate groups of documents: SetSketch bands propose, likelihood sifts, full shingle sets decide.

1. A document is its set of word shingles.  Rows with equal sets are one node, so copies cost a row in one aggregate.
2. Nodes that share a band of registers meet in a bucket.  In every bucket each node is compared with one pivot: a
   number of pairs that grows with the nodes, never with the square of a bucket.
3. Pairs that pass the sketches' likelihood are confirmed on the full sets; links give components.
4. Where a bucket still holds more than one component, its nodes of different components are compared inside tasks, a large
   bucket in a grid of cells: by sketch, and what the likelihood leaves on the full sets, the likeliest first.  Only
   links leave the task, and every link that would join two components is found; those inside a component
   change nothing and are not looked for.  A pair that shares several buckets is compared in the first.

Intermediate tables are written to the cluster's shared folder.  Only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskgraph.llm.common import fresh, stored, worker_cache
from deskgraph.llm.setsketch import REGISTERS, may_reach, mix, sketches

WORDS = 3
SIMILARITY = 0.85
BAND = 5
CELL_ROWS = 2_000
PIVOTS = 8
BROADCAST_ROWS = 1_000_000
CACHED_WORDS = 200_000
_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def shingle_sets(texts: list[bytes | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle digests of UTF-8 texts; A-Z count as lower case, words end at ASCII white space."""
    import xxhash

    known = worker_cache("word-digests")
    if len(known) > CACHED_WORDS:
        known.clear()
    split = [(text or b"").translate(_UPPER).split() for text in texts]
    counts = np.array([len(own) for own in split], np.int64)
    for w in set(chain.from_iterable(split)).difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.uint64, int(counts.sum()))
    # all places at once; those that reach into the next text are not looked at
    by_size = {size: _shingles(h, size) for size in {min(words, int(n)) for n in counts if n}}
    ends = np.cumsum(counts)
    none = np.zeros(0, np.uint64)
    return [
        np.unique(by_size[min(words, n)][end - n : end - min(words, n) + 1]) if n else none
        for n, end in zip(counts.tolist(), ends.tolist(), strict=True)
    ]


def _shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Digests of every ``size`` word digests in a row; runs of other sizes get other digests."""
    total = np.full(max(0, len(h) - size + 1), size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = mix(total * np.uint64(_FACTORS[k % 5]) + h[k : len(h) - size + 1 + k])
    return total


def documents(docs: DataFrame, words: int = WORDS, text: str = "text") -> DataFrame:
    """Per row: row, doc_id, n_shingles, digest of the set (null: empty), registers, and a digest of the text (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                sets = shingle_sets(part.column(2).to_pylist(), words)
                counts = np.array([len(s) for s in sets])
                found = sketches(np.concatenate(sets), counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(counts, pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([r.tobytes() if n else None for r, n in zip(found, counts, strict=True)], pa.binary()),
                        part.column(3),
                    ],
                    names=["row", "doc_id", "n_shingles", "digest", "registers", "text_key"],
                )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), text_key(text).alias("text_key")
    )
    return stored(rows.mapInArrow(run, "row long, doc_id long, n_shingles long, digest binary, registers binary, text_key binary"), "shingled")


def text_key(text: str = "text") -> Column:
    """A digest of 128 bits that tells texts apart."""
    return F.unhex(F.md5(F.col(text).cast("binary")))


def buckets(nodes: DataFrame, band: int = BAND, pivots: int = PIVOTS) -> DataFrame:
    """(bucket, band, node, pivot) of all buckets with two nodes or more; the bands take turns among ``pivots`` orders of nodes."""
    bands = REGISTERS // band
    keys = F.array(
        *[F.struct(F.xxhash64(F.lit(b), F.substring("registers", 1 + 2 * band * b, 2 * band)).alias("bucket"), F.lit(b).alias("band")) for b in range(bands)]
    )
    spread = nodes.select("node", F.inline(keys))
    shared = (
        spread.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("node", F.col("band") % pivots).alias("h"), "node"))["node"].alias("pivot"))
        .where(F.col("n") > 1)
        .select("bucket", "pivot")
    )
    return stored(spread.join(shared, "bucket"), "buckets")


def likely(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that the likelihood of their sketches leaves."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(batch.num_rows, -1) for k in (4, 5))
            good = may_reach(a, b, batch.column(2).to_numpy(), batch.column(3).to_numpy(), similarity)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    side = lambda name: nodes.select(F.col("node").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("registers").alias(f"r_{name}"))
    near = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(similarity)
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(near)
    return both.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(sift, "a long, b long")


def sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, text: str) -> DataFrame:
    """(node, shingles), stored: the full sets of the ``wanted`` nodes, made again from whole texts."""
    chosen = stored(nodes.join(wanted, "node", "left_semi").select("node", "doc_id", "digest"), "wanted")
    ids = chosen.select("doc_id").distinct()
    # 8 bytes each: sent to the tasks while they are few, shuffled with the texts beyond that
    ids = F.broadcast(ids) if chosen.count() <= BROADCAST_ROWS else ids

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                sets = [s.tobytes() for s in shingle_sets(part.column(1).to_pylist(), words)]
                digests = [xxhash.xxh3_128_digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "digest", "shingles"])

    texts = docs.where(F.col(text).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    ids = ids.withColumnRenamed("doc_id", "wanted_id")  # null for sets that stand under no id only
    made = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi").mapInArrow(make, "doc_id long, digest binary, shingles binary")
    return stored(chosen.select("node", "digest").join(made, "digest").dropDuplicates(["node"]).select("node", "shingles"), "sets")


def alike(p: np.ndarray, q: np.ndarray, hundred: int) -> bool:
    """Whether two sorted sets share at least ``hundred`` hundredths of their union."""
    if len(p) > len(q):
        p, q = q, p
    place = np.minimum(q.searchsorted(p), len(q) - 1)
    both = int((q[place] == p).sum())
    return 100 * both >= hundred * (len(p) + len(q) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) whose full sets are at least ``similarity`` alike, stored."""
    hundred = round(similarity * 100)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (([np.frombuffer(s.as_py(), "<u8") for s in batch.column(k)]) for k in (2, 3))
            good = [alike(p, q, hundred) for p, q in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"s_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return stored(both.select("a", "b", "s_a", "s_b").mapInArrow(compare, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; the root is the smallest node that can be reached.

    Every round hooks each root to its smallest neighbour, follows the hooks once more and contracts the links, so the
    links left shrink fast, whatever the shape of the graph.
    """
    ends = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    labels = ends.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    edges = stored(ends.where(F.col("a") != F.col("b")).distinct(), "edges")
    while edges.limit(1).count():
        hook = stored(edges.groupBy(F.col("a").alias("x")).agg(F.least(F.min("b"), F.col("x")).alias("y")), "hooks")
        again = hook.select(F.col("x").alias("x2"), F.col("y").alias("y2"))
        hook = stored(hook.join(again, F.col("y") == F.col("x2"), "left").select("x", F.coalesce("y2", "y").alias("y")), "hooks")
        labels = stored(labels.join(hook, F.col("root") == F.col("x"), "left").select("node", F.coalesce("y", "root").alias("root")), "labels")
        other = hook.select(F.col("x").alias("x2"), F.col("y").alias("y2"))
        moved = edges.join(hook, F.col("a") == F.col("x")).join(other, F.col("b") == F.col("x2"))
        edges = stored(moved.select(F.col("y").alias("a"), F.col("y2").alias("b")).where(F.col("a") != F.col("b")).distinct(), "edges")
    return labels


def across(members: DataFrame, nodes: DataFrame, sets: DataFrame, labels: DataFrame, similarity: float, band: int) -> DataFrame:
    """Links (a, b) between nodes that share a bucket but no component yet; enough of them to join all that is linked.

    Only buckets with two components or more are looked at.  A bucket of more than CELL_ROWS nodes becomes a grid of cells.
    """
    hundred = round(similarity * 100)
    rows = members.select("bucket", "band", "node").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where(F.col("low") < F.col("high"))
    cuts = mixed.select("bucket", F.ceil(F.col("n") / F.lit(CELL_ROWS)).cast("int").alias("cuts"))
    own = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    dealt = (
        rows.join(cuts, "bucket")
        .withColumn("own", own)
        .select("bucket", "band", "node", "root", "own", F.inline(cells))
        .join(nodes.select("node", "n_shingles", "registers").join(sets, "node"), "node")
    )

    def cell(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node, root, size, part = (table[c].to_numpy() for c in ("node", "root", "n_shingles", "own"))
        registers = np.frombuffer(b"".join(table["registers"].to_pylist()), "<u2").reshape(len(node), -1)
        i, j, turn = table["i"][0].as_py(), table["j"][0].as_py(), table["band"][0].as_py()
        shingles = [np.frombuffer(s, "<u8") for s in table["shingles"].to_pylist()]
        joined: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := joined.get(x, x)) != x:
                joined[x] = joined.get(up, up)
                x = up
            return x

        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        links = []
        step = max(1, 4_000_000 // (max(1, len(right)) * registers.shape[1]))
        for low in range(0, len(left), step):
            x = left[low : low + step]
            open_ = (root[x][:, None] != root[right][None]) & ((x[:, None] < right[None]) | (i != j))
            open_ &= np.minimum(size[x][:, None], size[right][None]) >= similarity * np.maximum(size[x][:, None], size[right][None])
            p, q = np.nonzero(open_)
            p, q = x[p], right[q]
            same = registers[p] == registers[q]
            equal = same.sum(1)
            few = np.flatnonzero(equal >= 0.4 * registers.shape[1])  # far below what the likelihood lets pass
            p, q, same, equal = p[few], q[few], same[few], equal[few]
            bands = registers.shape[1] // band
            first = same[:, : bands * band].reshape(len(p), bands, band).all(2).argmax(1)
            good = np.flatnonzero(first == turn)
            good = good[may_reach(registers[p[good]], registers[q[good]], size[p[good]], size[q[good]], similarity)] if len(good) else good
            for k in good[np.argsort(-equal[good], kind="stable")]:
                a, b = int(p[k]), int(q[k])
                u, v = find(int(root[a])), find(int(root[b]))
                if u != v and alike(shingles[a], shingles[b], hundred):
                    joined[max(u, v)] = min(u, v)
                    links.append((int(node[a]), int(node[b])))
        ends = np.array(links, np.int64).reshape(-1, 2)
        return pa.Table.from_arrays([pa.array(ends.min(1)), pa.array(ends.max(1))], names=["a", "b"]) if len(ends) else pa.table(
            {"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())}
        )

    return stored(dealt.groupBy("bucket", "i", "j").applyInArrow(cell, "a long, b long").distinct(), "links")


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, text: str = "text", band: int = BAND
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id linked with it, at any remove), kept.

    Two documents are linked if their sets of distinct shingles of ``words`` words overlap by ``similarity`` of their union or more.  A text
    with fewer words is one shingle; null and empty texts have none and are linked with nothing.  Rows that repeat a doc_id
    are judged by their own texts.  A row without a doc_id has links like any other, is kept only where no row of its component has an
    id, and a component_id of null then.  Very long texts are whole.  An empty table gives no rows.  ``band`` registers must
    agree for two nodes to meet; fewer miss less and propose more.
    """
    rows, groups = grouped(docs, similarity, words, text, band)
    named = rows.select("doc_id", "n_shingles", "digest").join(groups.select("digest", "component_id"), "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def grouped(docs: DataFrame, similarity: float, words: int, text: str, band: int) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`documents`, and (digest, root, component_id) of all sets in components of two rows or more."""
    rows = documents(docs, words, text)
    nodes = stored(
        rows.where(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(
            F.min_by("row", F.struct("doc_id", "row")).alias("node"),
            F.min("doc_id").alias("doc_id"),
            F.any_value("n_shingles").alias("n_shingles"),
            F.any_value("registers").alias("registers"),
            F.count(F.lit(1)).alias("copies"),
        ),
        "nodes",
    )
    members = buckets(nodes, band)
    star = members.where(F.col("node") != F.col("pivot")).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    tried = stored(likely(star, nodes, similarity), "tried")
    sets = sets_of(members.select("node").distinct(), nodes, docs, words, text)
    links = confirmed(tried, sets, similarity)
    labels = components(links)
    labels = components(links.union(across(members, nodes, sets, labels, similarity, band)))
    named = nodes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.sum("copies").alias("n"))
    return rows, named.join(least.where(F.col("n") > 1), "root").select("digest", "root", "component_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, text: str = "text", band: int = BAND) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest doc_id, a row without one last.  Columns stay as they are.

    Rows are judged by their own texts, whatever ids they repeat or lack.  Of rows with the same id (or none) and the same text one
    stays; an empty or null text is like no other.
    """
    key, keep, copies, body = (fresh(name) for name in ("id", "keep", "copies", "text_key"))
    rows, groups = grouped(docs, similarity, words, text, band)
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    placed = rows.select("doc_id", "text_key", "digest").join(groups.select("digest", "root"), "digest", "left")
    first = placed.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(order).alias("first"))
    judged = placed.groupBy("doc_id", "text_key", "root").agg(F.count(F.lit(1)).alias(copies)).join(first, "root", "left")
    judged = judged.withColumn(keep, F.col("root").isNull() | F.col("first").eqNullSafe(order))
    marked = judged.where(~F.col(keep) | (F.col(copies) > 1)).select(F.col("doc_id").alias(key), F.col("text_key").alias(body), keep, copies)
    marked = stored(marked, "marked")
    if marked.count() <= BROADCAST_ROWS:
        marked = F.broadcast(marked)  # ids and digests; beyond this many they are shuffled with the documents
    own = fresh("own")
    same = F.col("doc_id").eqNullSafe(F.col(key)) & F.col(own).eqNullSafe(F.col(body))
    joined = docs.withColumn(own, text_key(text)).join(marked, same, "left")
    single = joined.where(F.col(copies).isNull()).select(*docs.columns)
    repeated = joined.where(F.col(keep) & (F.col(copies) > 1)).dropDuplicates(["doc_id", own])
    return single.unionByName(repeated.select(*docs.columns))
