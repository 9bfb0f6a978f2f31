"""Language of documents by n-gram filters with a bit for each language.

Learning counts, in a bounded sample of labelled documents of each language, in how many documents every n-gram of letters
stands.  A language's set are its most common n-grams, without those that another language uses much more; so an n-gram
can belong to several languages.  All sets go into one bit-sliced Bloom filter: a position holds a word of bits, one
for each language, and the words at an n-gram's positions, and-ed, are the languages that contain it.

A document's n-grams are looked up once for each different word of a batch.  How often each language's bit was set, less
the hits its filter gives by chance, decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from deskgraph.llm.common import fresh, stored

#: Learning reads at most so many documents of a language, the first by a hash of their id.
SAMPLE_ROWS = 2000
#: Sizes of n-grams; a word has a mark on either side.
SIZES = (1, 2, 3, 4)
#: At most so many n-grams of a language, each in this share of its sample or more, and as common as half of anywhere.
GRAMS = 20_000
LEAST_SHARE = 0.005
AS_COMMON = 0.5
#: The filter has so many positions, and an n-gram so many of them.  A position's words hold 63 languages each.
POSITIONS = 1 << 20
HASHES = 3
WORD_BITS = 63
#: More labels than this are an error: the filter's size is ``POSITIONS`` words for every 63.
MAX_LANGUAGES = 1024
UNKNOWN = "und"
BATCH_CHARS = 4_000_000

LETTER_RUN = re.compile(r"[^\W\d_]+")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no language may be learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words' n-grams, and the number of the word each belongs to."""
    marked = "\n" + "\n".join(words) + "\n"
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = codes == 10
    owner = np.cumsum(ends) - 1  # a mark counts to the word after it
    hashes, owners = [], []
    rolling, crossed = np.zeros(len(codes), np.uint64), np.zeros(len(codes), np.int64)
    for size in range(1, max(SIZES) + 1):
        # the n-gram that starts at i holds codes[i : i + size]; marks may stand at its ends only
        rolling = rolling[: len(codes) - size + 1] * np.uint64(0x100000001B3) + codes[size - 1 :] + np.uint64(1)
        crossed = crossed[: len(codes) - size + 1] + (ends[size - 1 :] if size > 1 else 0)
        if size in SIZES:
            inner = crossed - (ends[size - 1 :] if size > 1 else 0)
            good = (inner == 0) & ((size > 1) | ~ends[: len(inner)])
            at = np.flatnonzero(good[: len(rolling)])
            at = at[owner[at] < len(words)]
            hashes.append(mixed(rolling[at] ^ np.uint64(size)))
            owners.append(owner[at])
    return np.concatenate(hashes), np.concatenate(owners)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits spread over the whole word (the finaliser of a common 64-bit hash)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def positions(hashes: np.ndarray, turn: int) -> np.ndarray:
    return (mixed(hashes + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(POSITIONS)).astype(np.int64)


@dataclass(frozen=True)
class Filter:
    """Bit-sliced Bloom filter: ``bits[w, p]`` are the languages 63 w to 63 w + 62 that set position p.  Labels by falling count."""

    labels: list[str]
    bits: np.ndarray

    def chances(self) -> np.ndarray:
        """How likely an n-gram of no language hits each language's filter."""
        fill = [((self.bits[k // WORD_BITS] >> np.int64(k % WORD_BITS)) & 1).mean() for k in range(len(self.labels))]
        return np.array(fill, np.float64) ** HASHES

    def hits(self, hashes: np.ndarray, owners: np.ndarray, count: int) -> np.ndarray:
        """For each of ``count`` words the number of its n-grams that each language contains."""
        out = np.zeros((count, len(self.labels)), np.int64)
        spots = [positions(hashes, t) for t in range(HASHES)]
        for w, sliced in enumerate(self.bits):
            mask = sliced[spots[0]]
            for p in spots[1:]:
                mask = mask & sliced[p]
            for k in range(w * WORD_BITS, min(len(self.labels), (w + 1) * WORD_BITS)):
                out[:, k] = np.bincount(owners[(mask >> np.int64(k - w * WORD_BITS)) & 1 == 1], minlength=count)
        return out


def decide(filter_: Filter, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The language and the score of each text: the best corrected count, and its share of all languages' counts.

    Without a letter, or if no language was learnt, the language is ``und``; where no filter is hit, the commonest label.
    """
    rows = [LETTER_RUN.findall(t.lower()) if t else [] for t in texts]
    number = {w: i for i, w in enumerate(set().union(*rows))}
    hashes, owners = grams(list(number))
    hits, sizes = filter_.hits(hashes, owners, len(number)), np.bincount(owners, minlength=len(number))
    chances = filter_.chances()
    labels, scores = [], np.zeros(len(texts))
    for i, (text, row) in enumerate(zip(texts, rows, strict=True)):
        if not filter_.labels or not text or not any(map(str.isalpha, text)):
            labels.append(UNKNOWN)
            continue
        at = np.fromiter(map(number.__getitem__, row), np.int64, len(row))
        counts = np.maximum(hits[at].sum(0) - sizes[at].sum() * chances, 0) / (1 - chances)
        best = int(counts.argmax())
        labels.append(filter_.labels[best])
        scores[i] = counts[best] / counts.sum() if counts.sum() > 0 else 0.0
    return labels, scores


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, lang: str = "lang", text: str = "text") -> tuple[list[str], DataFrame]:
    """The labels from the commonest down, and the documents to learn from (label, text), stored: at most ``rows`` for each label.

    Counting reads ids and labels only.  Which documents are read depends on their ids alone.
    """
    known = docs.where(F.col(lang).isNotNull() & ~held_out()).select(
        F.col(lang).cast("string").alias("label"), "doc_id", F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)).alias("turn"), F.col(text).alias("text")
    )
    found = known.groupBy("label").count().orderBy(F.desc("count"), "label").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    spark: SparkSession = docs.sparkSession
    share = [(r["label"], min(1 << 30, int((1 << 31) * rows / r["count"]) + 1)) for r in found]
    # twice as many as needed by their hash, then exactly the first of them; the labels are few
    early = known.join(F.broadcast(spark.createDataFrame(share, "label string, below long")), "label").where(F.col("turn") < F.col("below"))
    order = Window.partitionBy("label").orderBy("turn", "doc_id")
    place = fresh("place")
    chosen = early.withColumn(place, F.row_number().over(order)).where(F.col(place) <= rows).select("label", "text")
    return [r["label"] for r in found], stored(chosen, "language-sample")


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, grams_kept: int = GRAMS, lang: str = "lang", text: str = "text") -> Filter:
    """The filter, learnt from documents with a label that are not held out, ``rows`` of each label at most."""
    labels, chosen = sample(docs, rows, lang, text)
    words = -(-len(labels) // WORD_BITS)
    bits = np.zeros((words, POSITIONS), np.int64)
    if not labels:
        return Filter([], bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In how many texts of a label each n-gram stands, by batch."""
        for batch in batches:
            by_label: dict[str, list[np.ndarray]] = {}
            for label, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = list(set(LETTER_RUN.findall((body.as_py() or "").lower())))
                by_label.setdefault(label, []).append(np.unique(grams(words)[0]) if words else np.zeros(0, np.uint64))
            for label, held in by_label.items():
                gram, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], names=["label", "gram", "n"])

    spread = chosen.repartition(F.xxhash64("text"))
    counts = spread.mapInArrow(count, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    totals = F.broadcast(chosen.groupBy("label").agg(F.count(F.lit(1)).alias("texts")))  # a row for each label
    rated = counts.join(totals, "label").withColumn("share", F.col("n") / F.col("texts")).where(F.col("share") >= LEAST_SHARE)
    highest = F.max("share").over(Window.partitionBy("gram"))  # at most a row for each label
    common = rated.withColumn("highest", highest).where(F.col("share") >= AS_COMMON * F.col("highest"))
    first = Window.partitionBy("label").orderBy(F.desc("share"), "gram")
    kept = common.withColumn("place", F.row_number().over(first)).where(F.col("place") <= grams_kept)
    number = {label: k for k, label in enumerate(labels)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            gram = batch.column(1).to_numpy().view(np.uint64)
            for turn in range(HASHES):
                columns = [k // WORD_BITS, positions(gram, turn), np.int64(1) << (k % WORD_BITS)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["word", "position", "bits"])

    placed = kept.select("label", "gram").mapInArrow(place, "word long, position long, bits long").groupBy("word", "position")
    table = placed.agg(F.bit_or("bits").alias("bits")).toArrow()  # no more rows than the filter has words
    bits[table["word"].to_numpy(), table["position"].to_numpy()] = table["bits"].to_numpy()
    return Filter(labels, bits)


def identify(docs: DataFrame, model: Filter, into: str = "lang_pred", score: str = "score", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its language and a score from 0 to 1, in place of columns of these names.

    Reads whole texts, however long, in one pass without a shuffle.  Texts that are null or have no letter are ``und``, score 0;
    so is every text if nothing was learnt.  Repeated rows are scored alike.  An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.labels, model.bits))  # as large as POSITIONS says

    def judge(column: pa.Array) -> pa.Array:
        known, low, labels, scores = Filter(*sent.value), 0, [], [np.zeros(0)]
        while low < len(column):
            part, chars = [], 0
            while low + len(part) < len(column) and len(part) < 512 and (not part or chars < BATCH_CHARS):
                part.append(column[low + len(part)].as_py())
                chars += len(part[-1] or "")
            found = decide(known, part)
            labels += found[0]
            scores.append(found[1])
            low += len(part)
        return pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(np.concatenate(scores))], names=["label", "score"])

    judge.__annotations__ = {"column": pa.Array, "return": pa.Array}
    found = fresh("found")
    rows = docs.withColumn(found, arrow_udf(judge, "struct<label: string, score: double>")(F.col(text)))
    kept = [c for c in docs.columns if c not in (into, score)]
    return rows.select(*kept, F.col(f"{found}.label").alias(into), F.col(f"{found}.score").alias(score))
