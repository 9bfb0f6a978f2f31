"""Ranked lexical search over an index stratified by document length.

Two documents with the same normaliser m score alike for the same term count, so the documents of a shard are grouped into
strata of equal m.  A term's postings are kept by stratum and, within it, by falling term count: a run of postings with one
count has one impact, worked out once.  The largest count of a query's terms in a stratum bounds every score in it;
strata are visited from the largest bound down until the bound falls below the kth score (an equal one is still visited, as
a tie may go to a smaller id).  So the result is exact.

Documents never move: a task builds the shards of the documents it reads, and a search streams the stored shards past a
block of queries, keeping only each query's best.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskgraph.llm.common import stored

#: A shard holds at most so many documents, and is closed by the document that takes it to so many terms.
SHARD_DOCS = 8192
SHARD_TERMS = 500_000
#: A block of queries that meets the index at once holds about so many distinct terms.
BLOCK_TERMS = 200_000
K = 10

#: Arrays of a shard, each stored compressed: lists of lists as sizes, which take less room than starts.
INDEX = {
    "ids": "<i8", "unnamed": "|u1", "m": "<i8", "term_segments": "<i4",
    "segment_stratum": "<i4", "segment_runs": "<i4", "run_tf": "<i4", "run_postings": "<i4", "postings": "<i4", "df": "<i4",
}
SIZES = ("term_segments", "segment_runs", "run_postings")
SHAPE = "terms binary, " + ", ".join(f"{n} binary" for n in INDEX)


def _letters() -> bytes:
    """Bytes to themselves in a term (A-Z in lower case), to a space between terms."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for c in b"0123456789abcdefghijklmnopqrstuvwxyz":
        table[c] = c
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[c] = c + 32
    return bytes(table)


LETTERS = _letters()


def terms(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII letters and digits and of anything beyond ASCII, in UTF-8, only A-Z lower-cased."""
    return text.encode().translate(LETTERS).split() if text else []


def packed(values: np.ndarray | bytes, kind: str = "|u1") -> bytes:
    """Bytes of an array, compressed, after their number."""
    raw = values if isinstance(values, bytes) else np.ascontiguousarray(values, kind).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(body: pa.Buffer | bytes) -> bytes:
    view = memoryview(body)
    return pa.decompress(view[8:], int.from_bytes(view[:8], "little"), codec="zstd", asbytes=True)


def corpus_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """N, the documents with a term, and L, all terms with repeats."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(terms(t.as_py())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(n > 0 for n in sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], names=["n", "l"])

    row = docs.select(text).mapInArrow(count, "n long, l long").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    return row["n"] or 0, row["l"] or 0


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def build(ids: np.ndarray, unnamed: np.ndarray, sizes: np.ndarray, words: np.ndarray, vocabulary: int, documents: int, length: int) -> dict[str, np.ndarray]:
    """One shard from its documents' ids and term counts, and their terms by number, document after document."""
    m = 100 - 75 + (75 * sizes * documents) // length
    order = np.lexsort((ids, unnamed, m))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    strata, starts = np.unique(m[order], return_index=True)
    pair, tf = np.unique(words.astype(np.int64) * len(ids) + np.repeat(place, sizes), return_counts=True)
    term, doc = np.divmod(pair, len(ids))
    stratum = np.searchsorted(starts, doc, "right") - 1
    rows = np.lexsort((doc, -tf, stratum, term))
    term, doc, tf, stratum = term[rows], doc[rows], tf[rows], stratum[rows]
    change = lambda *keys: np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
    runs, segments = change(term, stratum, tf), change(term, stratum)
    return {
        "ids": ids[order], "unnamed": unnamed[order], "m": strata, "term_segments": np.bincount(term[segments], minlength=vocabulary),
        "segment_stratum": stratum[segments], "segment_runs": np.diff(np.append(np.searchsorted(runs, segments), len(runs))),
        "run_tf": tf[runs], "run_postings": np.diff(np.append(runs, len(tf))), "postings": doc, "df": np.bincount(term, minlength=vocabulary),
    }


def index(docs: DataFrame, documents: int, length: int, text: str = "text") -> DataFrame:
    """The stored index, a row for each shard.  Documents without a term are in none."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, words, held, total = [], [], [], {}, 0

        def close() -> pa.RecordBatch:
            named = np.array([0 if i is None else i for i in ids], np.int64)
            unnamed = np.array([i is None for i in ids], np.uint8)
            made = build(named, unnamed, np.array(sizes, np.int64), np.concatenate(words), len(held), documents, length)
            columns = [packed(b" ".join(held)), *(packed(made[n], kind) for n, kind in INDEX.items())]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=["terms", *INDEX])

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms(body.as_py())
                if not found:
                    continue
                for t in set(found).difference(held):
                    held[t] = len(held)
                ids.append(doc)
                sizes.append(len(found))
                words.append(np.fromiter(map(held.__getitem__, found), np.int32, len(found)))
                total += len(found)
                if len(ids) == SHARD_DOCS or total >= SHARD_TERMS:
                    yield close()
                    ids, sizes, words, held, total = [], [], [], {}, 0
        if ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(shards, SHAPE), "strata")


class Shard:
    """One row of the index, opened.  Only the numbers of terms that are ``wanted`` are kept."""

    def __init__(self, row: dict[str, pa.Buffer | bytes], wanted: set[bytes]):
        for name, kind in INDEX.items():
            values = np.frombuffer(unpacked(row[name]), kind)
            setattr(self, name, np.concatenate([[0], np.cumsum(values, dtype=np.int64)]) if name in SIZES else values)
        self.number = {t: i for i, t in enumerate(unpacked(row["terms"]).split(b" ")) if t in wanted}

    def search(self, asked: list[tuple[bytes, int]], best: np.ndarray) -> np.ndarray:
        """``best`` (score, unnamed, id; highest first) improved by this shard's documents.  ``asked``: terms with their weights times repeats."""
        known = [(self.number[t], w) for t, w in asked if t in self.number]
        if not known:
            return best
        term, factor = np.array(known, np.int64).T
        low = self.term_segments[term]
        count = self.term_segments[term + 1] - low
        segment, factor = spread(low, count), np.repeat(factor, count)
        stratum, first = self.segment_stratum[segment], self.segment_runs[segment]
        bound = np.zeros(len(self.m), np.int64)
        np.add.at(bound, stratum, factor * impact(self.run_tf[first].astype(np.int64), self.m[stratum]))
        order = np.argsort(-bound, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        turn = rank[stratum]
        by_turn = np.argsort(turn, kind="stable")
        turns = turn[by_turn]
        begin, step = 0, 4
        while begin < len(order):
            least = best[-1, 0]
            open_ = int(np.searchsorted(-bound[order], -max(least, 1), "right"))  # strata that can still hold a result
            end = min(begin + step, open_)
            if end <= begin:
                break
            part = by_turn[np.searchsorted(turns, begin) : np.searchsorted(turns, end)]
            best = self.score(segment[part], factor[part], best)
            begin, step = end, 2 * step
        return best

    def score(self, segment: np.ndarray, factor: np.ndarray, best: np.ndarray) -> np.ndarray:
        """``best`` with the documents of whole strata, given by their segments."""
        low = self.segment_runs[segment]
        count = self.segment_runs[segment + 1] - low
        run = spread(low, count)
        gain = np.repeat(factor, count) * impact(self.run_tf[run].astype(np.int64), np.repeat(self.m[self.segment_stratum[segment]], count))
        low = self.run_postings[run]
        count = self.run_postings[run + 1] - low
        doc, place = np.unique(self.postings[spread(low, count)], return_inverse=True)
        score = np.zeros(len(doc), np.int64)
        np.add.at(score, place, np.repeat(gain, count))
        good = score >= max(best[-1, 0], 1)
        found = np.stack([score[good], self.unnamed[doc[good]], self.ids[doc[good]]], 1)
        return top(np.concatenate([best, found]), len(best))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its size."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def top(rows: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` best of (score, unnamed, id): highest score, then smallest id, rows without an id last."""
    return rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[:k]]


def query_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Stored queries: query_row, item_id, their distinct terms and how often each occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [Counter(terms(t.as_py())) for t in batch.column(2)]
            columns = [pa.array([list(c) for c in held], pa.list_(pa.binary())), pa.array([list(c.values()) for c in held], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["query_row", "item_id", "terms", "repeats"])

    rows = items.select(F.monotonically_increasing_id().alias("query_row"), F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    return stored(rows.mapInArrow(count, f"query_row long, item_id {kind}, terms array<binary>, repeats array<long>"), "queries")


def document_frequencies(shards: DataFrame, asked: set[bytes]) -> dict[bytes, int]:
    """In how many documents each of a block's terms stands.  Reads the index's terms and counts only."""
    sent = shards.sparkSession.sparkContext.broadcast(asked)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for names, counts in zip(batch.column(0), batch.column(1), strict=True):
                df = np.frombuffer(unpacked(counts.as_buffer()), INDEX["df"])
                total.update({t: int(df[i]) for i, t in enumerate(unpacked(names.as_buffer()).split(b" ")) if t in sent.value})
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["term", "df"])

    found = shards.select("terms", "df").mapInArrow(count, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r["term"]): r["df"] for r in found.collect()}  # as many rows as the block has terms, at most


def search(shards: DataFrame, queries: DataFrame, documents: int, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Each query's ``k`` best documents: query_row, item_id, rank, doc_id, score."""
    size = queries.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_terms))
    kind = queries.schema["item_id"].dataType.simpleString()
    shape = f"query_row long, item_id {kind}, doc_id long, unnamed int, score long"
    parts = []
    for block in range(blocks):
        held = queries.where(F.pmod(F.xxhash64("query_row"), F.lit(blocks)) == block).toArrow()
        lists = [dict(zip(t, r, strict=True)) for t, r in zip(held["terms"].to_pylist(), held["repeats"].to_pylist(), strict=True)]
        df = document_frequencies(shards, {t for one in lists for t in one})
        asked = [[(t, n * w) for t, n in one.items() if t in df and (w := weight(documents, df[t]))] for one in lists]
        sent = queries.sparkSession.sparkContext.broadcast((asked, held.select(["query_row", "item_id"]).combine_chunks()))

        def best_rows(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked, names = sent.value
            best = [np.tile(np.array([0, 1, 0], np.int64), (k, 1)) for _ in asked]
            wanted = {t for one in asked for t, _ in one}
            for batch in batches:
                for i in range(batch.num_rows):
                    shard = Shard({n: batch.column(c)[i].as_buffer() for c, n in enumerate(batch.schema.names)}, wanted)
                    best = [shard.search(a, b) if a else b for a, b in zip(asked, best, strict=True)]
            rows = [b[b[:, 0] > 0] for b in best]
            number = pa.array(np.repeat(np.arange(len(rows)), [len(r) for r in rows]))
            score, unnamed, doc = np.concatenate([np.zeros((0, 3), np.int64), *rows]).T
            chosen = [names[c].combine_chunks().take(number) for c in ("query_row", "item_id")]
            columns = [*chosen, pa.array(doc, pa.int64(), mask=unnamed == 1), pa.array(unnamed, pa.int32()), pa.array(score, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["query_row", "item_id", "doc_id", "unnamed", "score"])

        parts.append(stored(shards.mapInArrow(best_rows, shape), "lexical-best"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "unnamed", "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_row", "item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Each item's ``k`` highest-scoring documents with a score above 0: item_id, rank, doc_id, score.

    Null or empty texts have no terms: such items find nothing, such documents are not found and count nowhere.  Repeated
    rows are documents, or items, of their own; a document without an id is found, after those of equal score
    that have one.  Very long texts are whole; a shard grows with its longest document.  Other columns are not read.
    Empty tables give no rows.  Item ids may be of any type.
    """
    documents, length = corpus_size(docs, text)
    shards = index(docs, documents, max(1, length), text)
    return search(shards, query_terms(items, item_id, text), documents, k).drop("query_row")


