"""Mix sources to target weights by hash-random order and distributed prefix sums.

1. Every document gets a hash-random key, the MD5 of a seed and its id, and a size in words.
2. A source's rows are cut into ranges of the key, of equal width and about ``range_rows`` rows each
   (the keys are uniform), so a source that holds a third of all rows is sorted by many tasks.
3. Each range's word total is summed; a running sum over these few totals gives the offset of a range,
   a running sum inside the range the offset of a document.
4. A source with target t and size s gives every document floor(t / s) times and, of the next
   epoch, the first round(t) mod s words: whole documents, and a part of the one at the cut.

No source, range or document is ever gathered in the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskgraph.llm.common import SPACE_WORD, fresh, stored, text_of

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MOST_EPOCHS = 2.0
SEED = "mix-1"
RANGE_ROWS = 2_000


def order_key(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))


def source_targets(
    totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST_EPOCHS
) -> DataFrame:
    """One row per source, with its ``source_size``, gets its ``target``.

    Sources in code-point order, null last, take ``weights`` in turn and share ``budget`` times all words.
    No target exceeds ``most`` times its source: what is over is shared again by weight among the rest
    until none is above.  That ends where every target is min(most * size, level * weight), so the
    level is found from running sums in the order of most * size / weight.  Sources are few; the windows
    without partition see one row for each.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    number = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number + 1).cast("int"))
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rated = totals.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(most))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.sum("source_size").over(everyone) * F.lit(budget) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    ) / (F.sum("_w").over(everyone) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    return (
        rated.withColumn("_level", level)
        .withColumn("_place", F.row_number().over(by_ratio))
        .withColumn("_fits", F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_place")))
        .withColumn("_final", F.min_by("_level", "_fits").over(everyone))  # the first that fits
        .select(*totals.columns, F.least("_cap", F.coalesce(F.col("_final") * F.col("_w"), F.col("_cap"))).alias("target"))
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET,
    most: float = MOST_EPOCHS,
    seed: str = SEED,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source, source_size, target, taken.

    Null texts have size 0 and are taken 0 words; a null source is a source of its own, the last;
    repeated ids are rows of their own, ordered by size where their keys tie.  An empty table gives none.
    """
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_k")  # plain equality also for null
    sized = stored(
        docs.select("doc_id", "source", name, F.regexp_count(text_of(), F.lit(SPACE_WORD)).cast("long").alias("size")), "mix-sizes"
    )
    totals = sized.groupBy("_k").agg(
        F.min("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")
    )
    targets = source_targets(totals, weights, budget, most)
    plan = targets.select("_k", "source_size", "target", F.ceil(F.col("_rows") / F.lit(range_rows)).alias("_ranges"))
    share = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    keyed = (
        sized.withColumn("_key", order_key(seed=seed))
        .join(plan, "_k")
        .withColumn("_range", F.floor(share * F.col("_ranges") / F.lit(2**32)).cast("long"))
        .repartition("_k", "_range")  # else the windows would run on the join's partitions, a whole source in one
    )
    before = Window.partitionBy("_k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("_k", "_range")
        .agg(F.sum("size").alias("_words"))
        .select("_k", "_range", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_k", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        keyed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, ["_k", "_range"])
        .withColumn("_before", F.col("_inside") + F.col("_offset"))
    )
    goal = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = goal - whole * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("_before")))
    return placed.select("doc_id", "size", "source", "source_size", "target", (whole * F.col("size") + part).alias("taken"))


def mixed_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix as documents: each taken as often as its source's epochs say, with the columns of ``docs``.

    A document at a source's cut appears once more with only the words that are taken, so every
    source has exactly its words.  Documents without words take up none of the budget and stay as they are.
    Rows that repeat an id, its source and its size share what they take.
    """
    id_, s_, size_, sum_, n_, words_, epoch_ = (fresh(name) for name in ("id", "source", "size", "sum", "n", "words", "epoch"))
    taken = mix(docs, **options).groupBy(F.col("doc_id").alias(id_), F.col("source").alias(s_), F.col("size").alias(size_)).agg(
        F.sum("taken").alias(sum_), F.count(F.lit(1)).alias(n_)
    )
    columns = [F.col(c) for c in docs.columns]
    sized = docs.withColumn(words_, F.regexp_count(text_of(text), F.lit(SPACE_WORD)).cast("long"))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(s_)) & (F.col(words_) == F.col(size_))
    joined = sized.join(taken, same)
    share = F.floor(F.col(sum_) / F.col(n_)).cast("long")
    epochs = F.when(F.col(words_) == 0, F.lit(1)).otherwise(F.ceil(share / F.col(words_)).cast("int"))
    left = share - F.col(epoch_) * F.col(words_)
    words = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*" + SPACE_WORD), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), left.cast("int")), "")
    spread = joined.where(epochs > 0).withColumn(epoch_, F.explode(F.sequence(F.lit(0), epochs - 1)))
    partial = (F.col(words_) > 0) & (left < F.col(words_))
    result = spread.withColumn(text, F.when(partial, cut).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        result = result.withColumn("n_chars", F.when(partial, F.char_length(text).cast("long")).otherwise(F.col("n_chars")))
    return result.select(*columns)
