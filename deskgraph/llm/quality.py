"""Quality of documents: a linear-chain conditional random field over their lines.

Every line has features of its own and its neighbours' (lengths, shares of kinds of characters, repeated words and lines).
The field labels each line good or bad; forward and backward sums give the probability that a line is good,
and the mean of these, weighted by the lines' lengths and put through a fitted logistic curve, is the score of the document.

Labels are known for documents only, so at first every line takes its document's label; later rounds let
the lines of a bad document that look good be good, as long as its worst part stays bad.

Fitting reads at most ``SAMPLE_ROWS`` labelled documents, the first by a hash of their id.  Scoring reads every
whole text, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 3000
ROUNDS = 2
STEPS = 80
RIDGE = 1e-3
PASS_SCORE = 0.7
TEXTS_AT_A_TIME = 256

_KINDS = 9


def _byte_kinds() -> np.ndarray:
    """Byte values to kinds: lower, upper, digit, space, stop, comma, shout, sign, bar, other."""
    kinds = np.full(256, 9, np.uint8)
    for k, chars in enumerate(
        ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", ".", ",;:'\"-()", "!?", "#$%&*@^~<>=+/_", "|[]{}\\")
    ):
        for c in chars:
            kinds[ord(c)] = k
    return kinds


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, the number of lines of each text, and the lines' lengths in bytes.

    A text has one line more than line ends, so an empty text has one empty line.
    """
    kinds = _byte_kinds()
    counts = np.array([t.count("\n") + 1 for t in texts], np.int64)
    joined = "\n".join(texts).encode("utf-8", "replace")
    data = np.frombuffer(joined, np.uint8)
    ends = np.append(np.flatnonzero(data == 10), len(data))
    starts = np.append(0, ends[:-1] + 1)
    length = (ends - starts).astype(np.float64)
    share = np.zeros((len(starts), _KINDS))
    kind = kinds[data]
    running = np.zeros(len(data) + 1, np.int64)
    for k in range(_KINDS):
        np.cumsum(kind == k, out=running[1:])
        share[:, k] = (running[ends] - running[starts]) / np.maximum(length, 1)
    words, distinct, most, signed, seen = ([] for _ in range(5))
    for t in texts:
        lines = t.split("\n")
        before: dict[str, int] = {}
        for line in lines:
            ws = line.split()
            n = len(ws)
            different = set(ws)
            words.append(n)
            distinct.append(len(different) / n if n else 1.0)
            most.append(sum(map(ws[n // 2].__eq__, ws)) / n if n else 0.0)
            signed.append(sum(not w[-1].isalnum() for w in ws) / n if n else 0.0)
            seen.append(before.get(line, 0) if n > 2 else 0)
            before[line] = before.get(line, 0) + 1
    n_words = np.array(words, np.float64)
    own = np.column_stack(
        [
            np.log1p(length),
            np.log1p(n_words),
            np.minimum(length / np.maximum(n_words, 1), 40) / 10,
            np.array(distinct),
            np.array(most),
            np.array(signed),
            np.log1p(np.array(seen, np.float64)),
            share,
            np.sqrt(share),
        ]
    )
    first = np.zeros(len(starts), bool)
    first[np.cumsum(counts) - counts] = True
    before_ = np.vstack([own[:1], own[:-1]])
    before_[first] = own[first]
    last = np.zeros(len(starts), bool)
    last[np.cumsum(counts) - 1] = True
    after = np.vstack([own[1:], own[-1:]])
    after[last] = own[last]
    return np.hstack([own, before_, after, np.ones((len(starts), 1))]), counts, length


def marginals(emit: np.ndarray, counts: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward and backward over all texts at once: P(state) of each line, summed pair probabilities, log of all Z.

    ``emit`` (lines, 2) are log scores, ``step`` (2, 2) the log scores of neighbouring states.
    """
    starts = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    longest = int(counts[order[0]])
    alive = np.searchsorted(-counts[order], -np.arange(1, longest + 1), side="right")
    forward, backward = np.zeros_like(emit), np.zeros_like(emit)
    forward[starts] = emit[starts]
    for t in range(1, longest):
        rows = starts[order[: alive[t]]] + t
        prev = forward[rows - 1]
        forward[rows, 0] = np.logaddexp(prev[:, 0] + step[0, 0], prev[:, 1] + step[1, 0]) + emit[rows, 0]
        forward[rows, 1] = np.logaddexp(prev[:, 0] + step[0, 1], prev[:, 1] + step[1, 1]) + emit[rows, 1]
    for t in range(longest - 2, -1, -1):
        rows = starts[order[: alive[t + 1]]] + t
        nxt = backward[rows + 1] + emit[rows + 1]
        backward[rows, 0] = np.logaddexp(step[0, 0] + nxt[:, 0], step[0, 1] + nxt[:, 1])
        backward[rows, 1] = np.logaddexp(step[1, 0] + nxt[:, 0], step[1, 1] + nxt[:, 1])
    ends = starts + counts - 1
    total = np.logaddexp(forward[ends, 0], forward[ends, 1])
    line_total = np.repeat(total, counts)
    states = np.exp(forward + backward - line_total[:, None])
    inner = np.ones(len(emit), bool)
    inner[ends] = False
    rows = np.flatnonzero(inner)
    pairs = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            pairs[a, b] = np.exp(forward[rows, a] + step[a, b] + emit[rows + 1, b] + backward[rows + 1, b] - line_total[rows]).sum()
    return states, pairs, float(total.sum())


@dataclass(frozen=True)
class LineField:
    """Weights of the field, the scaling of its features, and the curve from mean probability to score."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    step: np.ndarray
    slope: float
    offset: float

    def good(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = (features - self.centre) / self.scale @ self.weights
        return marginals(np.column_stack([np.zeros(len(z)), z]), counts, self.step)[0][:, 1]

    def scores(self, texts: list[str]) -> np.ndarray:
        features, counts, length = line_features(texts)
        x = _log_odds(weighted_mean(self.good(features, counts), counts, length))
        return 1 / (1 + np.exp(-(self.slope * x + self.offset)))


def weighted_mean(values: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    starts = np.cumsum(counts) - counts
    weight = weight + 1e-9  # a text of empty lines has the plain mean
    return np.add.reduceat(values * weight, starts) / np.add.reduceat(weight, starts)


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _descend(gradient, start: np.ndarray, steps: int, rate: float = 0.1) -> np.ndarray:
    """Adam with a falling rate."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return x


def fit(features: np.ndarray, counts: np.ndarray, length: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, steps: int = STEPS) -> LineField:
    """Fit the field to documents with known labels; ``features`` as from ``line_features``.  Deterministic."""
    centre, scale = features.mean(0), features.std(0)
    flat = scale < 1e-9
    centre[flat], scale[flat] = 0.0, 1.0
    x = (features - centre) / scale
    label = np.repeat(labels.astype(float), counts)
    balance = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    weight = np.repeat(balance / counts, counts)  # each document counts alike, each label half
    starts = np.cumsum(counts) - counts
    inner = np.ones(len(x), bool)
    inner[starts + counts - 1] = False
    rows = np.flatnonzero(inner)
    target, theta = label.copy(), np.zeros(x.shape[1] + 4)
    for turn in range(rounds):

        def gradient(th: np.ndarray, target: np.ndarray = target) -> np.ndarray:
            step = th[-4:].reshape(2, 2)
            z = x @ th[:-4]
            states, pairs, _ = marginals(np.column_stack([np.zeros(len(z)), z]), counts, step)
            emit = x.T @ (weight * (states[:, 1] - target)) / len(counts)
            seen = np.zeros((2, 2))
            a, b = (target[rows] > 0.5).astype(int), (target[rows + 1] > 0.5).astype(int)
            np.add.at(seen, (a, b), 1.0)
            return np.concatenate([emit + RIDGE * th[:-4], ((pairs - seen) / len(x)).ravel() + RIDGE * th[-4:]])

        theta = _descend(gradient, theta, steps)
        z = x @ theta[:-4]
        good = marginals(np.column_stack([np.zeros(len(z)), z]), counts, theta[-4:].reshape(2, 2))[0][:, 1]
        worst = np.repeat(np.minimum.reduceat(good, starts), counts)
        target = np.where(label > 0.5, 1.0, ((good > 0.5) & (good > worst)).astype(float))
    mean = _log_odds(weighted_mean(good, counts, length))

    def curve(th: np.ndarray) -> np.ndarray:
        miss = 1 / (1 + np.exp(-(th[0] * mean + th[1]))) - labels
        return np.array([(miss * mean).mean() + 1e-3 * th[0], miss.mean()])

    slope, offset = _descend(curve, np.array([1.0, 0.0]), 400)
    return LineField(centre, scale, theta[:-4], theta[-4:].reshape(2, 2), float(max(slope, 1e-3)), float(offset))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LineField:
    """Fit on at most ``sample_rows`` labelled rows that are not held out, the first by a hash of their id.

    The features are taken in Spark tasks; what reaches the driver is bounded by ``sample_rows`` texts.
    Without any labelled row every document scores about one half.
    """
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("label"))
        .orderBy(F.md5(F.col("doc_id").cast("string")))
        .limit(sample_rows)
    )
    # bounded by sample_rows ids
    sample = docs.select("doc_id", F.col("text").alias("text")).join(F.broadcast(chosen), "doc_id").select("label", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS_AT_A_TIME):
                part = batch.slice(low, TEXTS_AT_A_TIME)
                features, counts, length = line_features([t or "" for t in part.column(1).to_pylist()])
                ends = np.cumsum(counts)
                packed = [(features[e - n : e].astype("<f4").tobytes(), length[e - n : e].astype("<f4").tobytes()) for e, n in zip(ends, counts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int32()), pa.array(counts), pa.array([p[0] for p in packed]), pa.array([p[1] for p in packed])],
                    names=["label", "lines", "features", "length"],
                )

    rows = sample.mapInArrow(extract, "label int, lines long, features binary, length binary").collect()
    if not rows:
        return LineField(np.zeros(1), np.ones(1), np.zeros(1), np.zeros((2, 2)), 1e-3, 0.0)
    rows.sort(key=lambda r: (r["label"], r["lines"], bytes(r["features"])))
    counts = np.array([r["lines"] for r in rows])
    features = np.frombuffer(b"".join(r["features"] for r in rows), "<f4").astype(np.float64).reshape(counts.sum(), -1)
    length = np.frombuffer(b"".join(r["length"] for r in rows), "<f4").astype(np.float64)
    return fit(features, counts, length, np.array([r["label"] for r in rows]))


def score(docs: DataFrame, field: LineField, text: str = "text", into: str = "quality_score") -> DataFrame:
    """``docs`` with the score of each whole text.  Null texts are empty and get the score of an empty line."""
    blank = len(field.weights) == 1

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            out = []
            for low in range(0, len(batch), TEXTS_AT_A_TIME):
                part = [t or "" for t in batch.slice(low, TEXTS_AT_A_TIME).to_pylist()]
                out.append(np.full(len(part), 0.5) if blank else field.scores(part))
            yield pa.array(np.concatenate(out) if out else np.zeros(0))

    from pyspark.sql.pandas.functions import arrow_udf

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(into, arrow_udf(run, "double")(F.col(text)))
