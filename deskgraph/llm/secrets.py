"""Find secrets in texts: fixed patterns, and character Markov models of random strings and identifiers.

Everything is DataFrame expressions.  A text is split at a pattern, which gives the gaps between the
matches; running sums over the lengths of gaps and matches are the places in code points.

The model is a pair of first-order character chains over classes of characters.  One is trained on random
strings, the other on ordinary words and identifiers, both given as labelled samples; a token is a secret if
its mean log-likelihood ratio per character passes a threshold.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskgraph.llm.common import fresh, text_of

# The three base patterns, in the order in which kinds at one place are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST_VALUE = 6

#: Tokens that the model judges.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_-"
THRESHOLD = 1.2
LEAST_DISTINCT = 8
SAMPLE_ROWS = 4000
#: Of each sampled document the model learns so many words, those first by a hash, from anywhere in the text.
SAMPLE_WORDS = 200
#: Columns that a scan adds.
PLACES = ("base_places", "markov_places", "secret_places")
SMOOTHING = 0.5


def _places(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Array of (start, kind number, end) of the leftmost non-overlapping matches that ``keep`` accepts."""
    number = KINDS.index(kind)
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,text:string>>").alias("spans"))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.char_length(g).alias("gap"), m.alias("m")))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + F.char_length(pair["m"])
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), pair["m"].alias("text"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    spans = F.aggregate(pairs, begin, step, lambda state: state["spans"])
    if keep is not None:
        spans = F.filter(spans, lambda s: keep(s["text"]))
    bare = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.when(F.rlike(text, F.lit(pattern)), bare).otherwise(F.array().cast(bare_type()))


def bare_type() -> str:
    return "array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class MarkovModel:
    """Log-likelihood ratios, random over ordinary, of each step between two characters; row-wise by ALPHABET."""

    ratios: tuple[float, ...]
    first: tuple[float, ...]

    def score(self, token: Column) -> Column:
        """Mean log-likelihood ratio per character of a token over ALPHABET."""
        chars = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
        chars = F.filter(chars, lambda n: n > 0)
        table = F.array(*[F.lit(float(x)) for x in self.ratios])
        start = F.array(*[F.lit(float(x)) for x in self.first])
        size = len(ALPHABET)
        begin = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))

        def step(state: Column, n: Column) -> Column:
            add = F.when(state["last"] == 0, F.element_at(start, n)).otherwise(F.element_at(table, (state["last"] - 1) * size + n))
            return F.struct(n.alias("last"), (state["sum"] + add).alias("sum"))

        return F.aggregate(chars, begin, step, lambda s: s["sum"]) / F.greatest(F.size(chars), F.lit(1))


def labelled_samples(docs: DataFrame, rows: int = SAMPLE_ROWS, words_each: int = SAMPLE_WORDS) -> DataFrame:
    """(token, random): strings made from digests, and plain words of at most ``rows`` documents, ``words_each`` of each.

    Random strings are hexadecimal, base 64 and upper-case digests of numbers, so their labels are sure.
    Ordinary tokens are words of 4 letters or more, also doubled with an underscore, hyphen, slash or capitals in between,
    in upper case or with a digit, as identifiers and paths are.  A document's words are chosen by a hash over the whole
    text.  ``rows`` and ``words_each`` bound what the fit reads; scoring reads everything.
    """
    spark = docs.sparkSession
    n = F.col("id").cast("string")
    digest = F.sha2(n, 256)
    random = spark.range(rows).select(
        F.explode(
            F.array(
                F.substring(digest, 1, 40),
                F.regexp_replace(F.base64(F.unhex(digest)), "=", ""),
                F.upper(F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(n, F.lit("-")), 256))), "[=+/]", ""), 1, 24)),
                F.lower(F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(n, F.lit("+")), 256))), "[=+/]", ""), 1, 24)),
            )
        ).alias("token"),
        F.lit(True).alias("random"),
    )
    words = F.regexp_extract_all(text_of(), F.lit(r"(?<![A-Za-z0-9])[A-Za-z]{4,}(?![A-Za-z0-9])"), F.lit(0))
    forms = lambda w: F.array(
        F.concat(w, F.lit("_"), w), F.concat(F.initcap(w), F.initcap(w)), F.upper(w), F.concat(w, F.lit("/"), w), F.concat(w, F.lit("-"), w), F.concat(w, F.lit("2"))
    )
    by_hash = F.sort_array(F.transform(words, lambda w, i: F.struct(F.xxhash64(w, i).alias("h"), w.alias("w"))))
    words = F.transform(F.slice(by_hash, 1, words_each), lambda s: s["w"])
    plain = F.transform(words, lambda w, i: F.element_at(forms(w), i % 6 + 1))
    # the first ids by a hash: a bounded list, so a bounded broadcast, and no text is gathered
    chosen = docs.select("doc_id").distinct().orderBy(F.md5(F.col("doc_id").cast("string"))).limit(rows)
    ordinary = docs.join(F.broadcast(chosen), "doc_id").select(F.explode(F.concat(words, plain)).alias("token"), F.lit(False).alias("random"))
    return random.unionByName(ordinary)


def train(samples: DataFrame, smoothing: float = SMOOTHING) -> MarkovModel:
    """Count steps between characters per label.  The result has one row per pair of characters and label, whatever the input."""
    chars = F.filter(F.transform(F.split("token", ""), lambda c: F.instr(F.lit(ALPHABET), c)), lambda n: n > 0)
    steps = F.zip_with(
        F.concat(F.array(F.lit(0)), F.slice("_c", F.lit(1), F.greatest(F.size("_c") - 1, F.lit(0)))), "_c", lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    )
    rows = (
        samples.withColumn("_c", chars)
        .where(F.size("_c") > 0)
        .select("random", F.explode(steps).alias("s"))
        .groupBy("random", "s.a", "s.b")
        .count()
        .collect()
    )
    import math

    size = len(ALPHABET)
    counts = {True: [[smoothing] * size for _ in range(size + 1)], False: [[smoothing] * size for _ in range(size + 1)]}
    for r in rows:
        counts[r["random"]][r["a"]][r["b"] - 1] += r["count"]
    ratio = [
        [math.log(p / sum(yes)) - math.log(q / sum(no)) for p, q in zip(yes, no, strict=True)]
        for yes, no in zip(counts[True], counts[False], strict=True)
    ]
    return MarkovModel(ratios=tuple(x for row in ratio[1:] for x in row), first=tuple(ratio[0]))


def scan(docs: DataFrame, model: MarkovModel, threshold: float = THRESHOLD, text: str = "text", names: tuple[str, str, str] = PLACES) -> DataFrame:
    """``docs`` with three more columns, in place of any of these ``names``: base, model's and all places, arrays of (start, kind, end).

    Null texts are empty and hold nothing.  Texts are read whole, however long.  Places are code points, ends exclusive, sorted by start, then kind
    as in KINDS.  A token of the model that lies inside a base span adds nothing new and is left out.
    """
    t = fresh("text")
    value = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_VALUE
    # rules and fillers repeat few characters, which 20 random ones hardly do
    likely = lambda m: (F.size(F.array_distinct(F.split(m, ""))) >= LEAST_DISTINCT) & (model.score(m) >= threshold)
    base = F.array_sort(
        F.concat(
            _places(F.col(t), ASSIGN, "assign", value),
            F.when(F.contains(F.col(t), F.lit("AKIA")), _places(F.col(t), ACCESS, "access")).otherwise(F.array().cast(bare_type())),
            _places(F.col(t), HEX, "hex"),
        )
    )
    bases, markov, secret = names
    inside = lambda s: F.exists(F.col(bases), lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    return (
        docs.withColumn(t, text_of(text))
        .withColumn(bases, base)
        .withColumn(markov, F.filter(_places(F.col(t), TOKEN, "markov", likely), lambda s: ~inside(s)))
        .withColumn(secret, F.array_sort(F.concat(bases, markov)))
        .drop(t)
    )


def spelled(places: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            F.col(places), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def count_of(places: str, kind: str) -> Column:
    return F.size(F.filter(F.col(places), lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redacted(found: DataFrame, text: str = "text", mask: str = "[SECRET]", places: str = PLACES[2]) -> DataFrame:
    """The texts of ``scan`` with every span of ``places`` replaced by ``mask``; overlapping spans are masked once."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(F.col(text), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        masked = F.when(s["start"] >= state["at"], F.concat(state["out"], gap, F.lit(mask))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), masked.alias("out"))

    new = F.aggregate(
        places, begin, step, lambda s: F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, F.char_length(F.col(text))))
    )
    return found.withColumn(text, F.when(F.size(places) > 0, new).otherwise(F.col(text)))


def fitted(spark: SparkSession, docs: DataFrame) -> MarkovModel:
    return train(labelled_samples(docs))
