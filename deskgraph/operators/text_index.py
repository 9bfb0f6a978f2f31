"""A stored index of case texts for exact top-k search by TF-IDF cosine, with block maxima.

Every case is a unit vector over a vocabulary fitted on the cases.  Cases are dealt into shards; in a shard, cases with the same
heaviest term stand together and are cut into blocks.  A block's postings are kept by term, each term with its largest weight in the block.
The sum of a query's weights times these maxima bounds every score in a block: blocks are visited from the largest bound down, until the
bound falls below the kth score.  So the result is exact.  A task meets one shard with one block of queries, both of bounded size; a shard
is copied once for each block of queries, and a query once for each shard.

On disk: ``shards`` (pieces of packed bytes, the first with the case ids), ``vocabulary`` (term, number, idf) and ``about`` (how texts
become terms).  The index is built once, opened anywhere and used by any number of searches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from deskgraph import defaults as D
from deskgraph.operators import tfidf
from deskgraph.operators.skew import top_n_per_group
from deskgraph.operators.vectors import TIE_DIGITS
from deskgraph.session import materialise, shared_folder

#: A task meets one shard of cases with one block of queries; both have at most about so many rows, and terms of these.
SHARD_ROWS = 65_536
QUERY_ROWS = 16_384
MEETING_TERMS = 1_000_000
#: Cases in a block, whose scores are added up at once; at most 65,536, as places in a block take two bytes.
BLOCK_ROWS = 65_536
#: Bytes of a shard in one row.
PIECE_BYTES = 1_048_576

VECTOR = "struct<indices: array<int>, values: array<double>>"
PACKED = {"postings": "<i4", "most": "<f8", "cases": "<u2", "weights": "<f8", "ranks": "<i4"}


def pack(ends: np.ndarray, terms: np.ndarray, weights: np.ndarray, features: int, block_rows: int = BLOCK_ROWS) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of a shard's cases, and its postings by block and term.  ``ends`` cut ``terms`` and ``weights`` into cases, which come by id."""
    sizes = np.diff(ends)
    heaviest = np.full(len(sizes), features)
    row = np.repeat(np.arange(len(sizes)), sizes)
    by_weight = np.lexsort((terms, -weights, row))
    filled = sizes > 0
    heaviest[filled] = terms[by_weight[ends[:-1][filled]]]
    order = np.argsort(heaviest, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    case = place[row]
    part = case // block_rows * features + terms
    at = np.argsort(part * block_rows + case % block_rows)
    parts_of_all = -(-len(order) // block_rows) * features
    postings = np.searchsorted(part[at], np.arange(parts_of_all + 1))
    most, held = np.zeros(parts_of_all), np.flatnonzero(np.diff(postings))
    if len(held):
        most[held] = np.maximum.reduceat(weights[at], postings[held])
    return order, {"postings": postings, "most": most, "cases": case[at] % block_rows, "weights": weights[at]}


def best_cases(shard: dict[str, np.ndarray], rank: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, block_rows: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``k`` best cases of a shard that share a term with the query; equal scores by ``rank``."""
    blocks = -(-len(rank) // block_rows)
    most = shard["most"].reshape(blocks, -1)
    bound = most[:, terms] @ weights
    found, score = np.zeros(0, np.int64), np.zeros(0)
    for block in np.argsort(-bound, kind="stable").tolist():
        least = score[-1] if len(score) == k else 0.0
        # scores are rounded, so a bound just below the score to beat may still reach it
        if bound[block] == 0 or bound[block] < least - 2 * 10.0**-TIE_DIGITS:
            break  # the others hold no term of the query, or nothing that counts
        part = terms + block * most.shape[1]
        ends = list(zip(shard["postings"][part].tolist(), shard["postings"][part + 1].tolist(), strict=True))
        places = np.concatenate([shard["cases"][a:b] for a, b in ends], dtype=np.int64)
        total = np.bincount(places, np.concatenate([shard["weights"][a:b] * w for (a, b), w in zip(ends, weights.tolist(), strict=True)]), block_rows)
        floor = total.max() if k == 1 else np.partition(total, -k)[-k] if k < len(total) else 0.0
        slot = np.flatnonzero(total >= max(floor, least) - 2 * 10.0**-TIE_DIGITS)
        slot = slot[total[slot] > 0]
        found, score = np.concatenate([found, slot + block * block_rows]), np.concatenate([score, np.round(total[slot], TIE_DIGITS)])
        top = np.lexsort((rank[found], -score))[:k]
        found, score = found[top], score[top]
    return found, score


def cut(arrays: dict[str, np.ndarray]) -> list[bytes]:
    """Packed arrays as pieces of ``PIECE_BYTES``; in front their lengths."""
    held = [np.ascontiguousarray(arrays[n], kind).tobytes() for n, kind in PACKED.items()]
    whole = np.array([len(h) for h in held], "<i8").tobytes() + b"".join(held)
    return [whole[i : i + PIECE_BYTES] for i in range(0, len(whole), PIECE_BYTES)]


def joined(pieces: list[bytes]) -> dict[str, np.ndarray]:
    """The arrays that :func:`cut` cut."""
    whole, head = b"".join(pieces), 8 * len(PACKED)
    ends = head + np.cumsum([0, *np.frombuffer(whole[:head], "<i8")])
    return {n: np.frombuffer(whole[ends[i] : ends[i + 1]], kind) for i, (n, kind) in enumerate(PACKED.items())}


@dataclass(frozen=True)
class TextIndex:
    """An opened index: where it lies, its vocabulary (at most ``features`` terms) and how texts become terms."""

    spark: SparkSession
    path: str
    terms: list[str]
    idf: np.ndarray
    stops: list[str]
    ngrams: int
    shards: int

    @staticmethod
    def build(
        corpus: DataFrame,
        path: str | None = None,
        case_id: str = "case_id",
        text: str = "customer_text",
        features: int = D.TFIDF_FEATURES,
        stops: Sequence[str] | None = None,
        ngrams: int = 1,
        shard_rows: int = SHARD_ROWS,
        counts: DataFrame | None = None,
    ) -> "TextIndex":
        """Write the index of ``corpus`` to ``path`` (a fresh shared folder without it) and open it.

        The vocabulary are the ``features`` most frequent terms, ties to the lower term, with smoothed idf.  ``counts`` are the
        :func:`tfidf.top_terms` of these cases, where a caller has them.
        """
        spark = corpus.sparkSession
        path = path or shared_folder(spark, "text-index")
        stops = tfidf.stop_words() if stops is None else list(stops)
        words = corpus.select(F.col(case_id).alias("case_id"), tfidf.terms(F.col(text), stops, ngrams).alias("terms"))
        counts = tfidf.top_terms(corpus, text, stops, ngrams, features, "term-counts") if counts is None else counts
        rows = counts.where(F.col("term").isNull()).agg(F.coalesce(F.sum("cases"), F.lit(0))).first()[0]
        known = counts.where(F.col("term").isNotNull()).orderBy(F.desc("total"), "term").limit(features)
        idf = F.log((F.lit(1.0) + F.lit(rows)) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
        known.select("term", "df", idf.alias("idf")).coalesce(1).write.parquet(f"{path}/vocabulary")
        held = spark.read.parquet(f"{path}/vocabulary").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]  # terms of all cases
        shards = max(1, -(-rows // shard_rows), -(-held // MEETING_TERMS))
        spark.createDataFrame([(stops, ngrams, shards)], "stops array<string>, ngrams int, shards int").coalesce(1).write.parquet(f"{path}/about")
        index = TextIndex.open(spark, path)
        size = len(index.terms)

        def shard(table: pa.Table) -> pa.Table:
            table = table.sort_by("case_id")
            vectors = table["embedding"].combine_chunks()
            ends, terms, weights = parts(vectors)
            order, made = pack(ends, terms, weights, size)
            pieces = cut(made | {"ranks": order})  # cases came by id, so the old place is the rank
            ids = table["case_id"].combine_chunks().take(pa.array(order))
            offsets = pa.array([0] + [len(ids)] * len(pieces), pa.int32())  # the first piece has them all
            numbers = [pa.array([table["shard"][0].as_py()] * len(pieces), pa.int32()), pa.array(range(len(pieces)), pa.int32())]
            return pa.Table.from_arrays([*numbers, pa.ListArray.from_arrays(offsets, ids), pa.array(pieces, pa.binary())], names=["shard", "piece", "ids", "data"])

        kind = words.schema["case_id"].dataType.simpleString()
        vectors = words.where(F.col("case_id").isNotNull()).select("case_id", index.vector(F.col("terms")).alias("embedding"))
        dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("case_id"), F.lit(shards)).cast("int"))
        dealt.groupBy("shard").applyInArrow(shard, f"shard int, piece int, ids array<{kind}>, data binary").write.parquet(f"{path}/shards")
        return index

    @staticmethod
    def open(spark: SparkSession, path: str) -> "TextIndex":
        """The index that lies at ``path``; reads its vocabulary and no case."""
        about = spark.read.parquet(f"{path}/about").first()
        known = spark.read.parquet(f"{path}/vocabulary").orderBy("term").toArrow()
        return TextIndex(spark, path, known["term"].to_pylist(), known["idf"].to_numpy(), about["stops"], about["ngrams"], about["shards"])

    def vector(self, terms):
        """A column of terms as unit vectors; null without a known term.  Rows stay where they are."""
        known, idf = pa.array(self.terms, pa.string()), self.idf

        def weigh(column: pa.Array) -> pa.Array:
            sizes, indices, values = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for part in tfidf.slices(column):
                row, term, names = tfidf.listed(part)
                number = pc.fill_null(pc.index_in(names, known), -1).to_numpy()[term]
                pairs, count = np.unique((row * len(known) + number)[number >= 0], return_counts=True)
                at = pairs % max(1, len(known))
                raw = count * idf[at]
                ends = np.searchsorted(pairs, np.arange(len(part) + 1) * len(known))
                norms = [np.sqrt((raw[a:b] * raw[a:b]).sum()) for a, b in pairwise(ends.tolist())]
                indices.append(at)
                values.append(raw / np.repeat(norms, np.diff(ends)))
                sizes.append(np.diff(ends))
            offsets = pa.array(np.cumsum(np.concatenate(sizes)), pa.int32())
            indices, values = pa.array(np.concatenate(indices), pa.int32()), pa.array(np.concatenate(values))
            lists = [pa.ListArray.from_arrays(offsets, indices), pa.ListArray.from_arrays(offsets, values)]
            return pa.StructArray.from_arrays(lists, names=["indices", "values"])

        weigh.__annotations__ = {"column": pa.Array, "return": pa.Array}
        return arrow_udf(weigh, VECTOR)(terms)

    def search(self, queries: DataFrame, k: int = 1, query_id: str = "query_id", text: str = "text", query_rows: int = QUERY_ROWS) -> DataFrame:
        """Top ``k`` cases that share a term with the query: ``query_id, case_id, similarity, rank``.  Ties within 1e-9 go to the lower case id."""
        words = tfidf.terms(F.col(text), self.stops, self.ngrams)
        asked = queries.select(F.monotonically_increasing_id().alias("query_row"), F.col(query_id).alias("query_id"), self.vector(words).alias("embedding"))
        asked = materialise(asked.where(F.size("embedding.indices") > 0), "text-queries")
        rows, held = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("embedding.indices")), F.lit(0))).first()
        blocks = max(1, -(-rows // query_rows), -(-held // MEETING_TERMS))
        shards = self.spark.read.parquet(f"{self.path}/shards")
        id_type = shards.schema["ids"].dataType.elementType.simpleString()
        shape = f"query_row long, query_id {asked.schema['query_id'].dataType.simpleString()}, case_id {id_type}, similarity double"

        def meet(one: pa.Table, q: pa.Table) -> pa.Table:
            number, places, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            if one.num_rows:
                one = one.sort_by("piece")
                shard = joined(one["data"].to_pylist())
                ends, terms, weights = parts(q["embedding"].combine_chunks())
                for i in range(q.num_rows):
                    found, score = best_cases(shard, shard["ranks"], terms[ends[i] : ends[i + 1]], weights[ends[i] : ends[i + 1]], k)
                    number.append(np.full(len(found), i))
                    places.append(found)
                    scores.append(score)
            at = pa.array(np.concatenate(number))
            ids = one["ids"].combine_chunks().flatten().take(pa.array(np.concatenate(places))) if one.num_rows else pa.array([], one.schema.field("ids").type.value_type)
            queries_found = [q[n].combine_chunks().take(at) for n in ("query_row", "query_id")]
            return pa.Table.from_arrays([*queries_found, ids, pa.array(np.concatenate(scores))], names=["query_row", "query_id", "case_id", "similarity"])

        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = shards.withColumn("block", every(blocks)).groupBy("shard", "block")
        right = asked.withColumn("block", F.pmod(F.xxhash64("query_row"), F.lit(blocks)).cast("int")).withColumn("shard", every(self.shards))
        found = left.cogroup(right.groupBy("shard", "block")).applyInArrow(meet, shape)
        ranked = top_n_per_group(found, ["query_row"], [F.desc("similarity"), F.col("case_id")], k, rank="rank")
        return ranked.select("query_id", "case_id", "similarity", F.col("rank").cast("bigint").alias("rank"))


def parts(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row ends, term numbers and weights of a struct column of ``indices`` and ``values``."""
    indices, values = vectors.field("indices"), vectors.field("values")
    ends = np.concatenate([[0], np.cumsum(np.diff(indices.offsets.to_numpy()))])
    return ends, indices.flatten().to_numpy(), values.flatten().to_numpy()
