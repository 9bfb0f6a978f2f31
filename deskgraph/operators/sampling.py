"""Seeded order, samples and exact-fraction splits that need no global sort.

A seed turns into an order of rows through ``md5(seed:id)``: the same in any engine
and for any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskgraph import defaults as D
from deskgraph.operators.skew import top_n_per_group


def seeded_key(seed: int, row_id: str | Column) -> Column:
    column = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat(F.lit(f"{seed}:"), column.cast("string")).cast("binary"))


def seeded_top(rows: DataFrame, n: int, seed: int, row_id: str) -> DataFrame:
    """First ``n`` rows in seeded order of a table that is itself small, such as a sample or a gold set."""
    return rows.orderBy(seeded_key(seed, row_id), F.col(row_id)).limit(n)


def seeded_sample(rows: DataFrame, n: int, seed: int, row_id: str) -> DataFrame:
    """``n`` rows in seeded order, all rows if there are fewer.

    A plain top-n would send up to ``n`` whole rows of every task to one task.  Here a first
    pass over the ids finds the key of the ``n``-th row, and only rows up to it are read whole.
    """
    return seeded_top(take_seeded(rows, n, seed, row_id), n, seed, row_id)


def seeded_cut(rows: DataFrame, seed: int, row_id: str, size: Column, digits: int = 4) -> DataFrame:
    """One row: the largest seeded key among the first ``size`` rows (null if ``size`` is 0).

    ``size`` is an expression over ``total``, the number of rows.  A histogram over the
    leading hex digits finds the bucket that holds the cut; only that bucket (one part
    in 16^digits) is ranked row by row.
    """
    keyed = rows.select(seeded_key(seed, row_id).alias("_key")).withColumn(
        "_bucket", F.substring("_key", 1, digits)
    )
    histogram = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))
    running = histogram.withColumn(
        "through", F.sum("n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("total", F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    cut = running.withColumn("size", size).where(
        (F.col("through") >= F.col("size")) & (F.col("through") - F.col("n") < F.col("size"))
    ).select("_bucket", (F.col("size") - F.col("through") + F.col("n")).alias("needed"))
    ranked = keyed.join(cut, "_bucket").withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy("_key"))
    )
    return ranked.where(F.col("_rank") == F.col("needed")).agg(F.max("_key").alias("cut"))


def take_seeded(rows: DataFrame, n: int, seed: int, row_id: str) -> DataFrame:
    """The rows of :func:`seeded_sample` without gathering them in one task; ids must be unique."""
    cut = seeded_cut(rows, seed, row_id, F.least(F.lit(n).cast("bigint"), F.col("total")))
    return rows.where(seeded_key(seed, row_id) <= cut.scalar())


def holdout_split(
    rows: DataFrame,
    row_id: str,
    share: float = D.RETRIEVAL_SHARE,
    seed: int = D.SPLIT_SEED,
    exact: bool = True,
    first: str = D.RETRIEVAL_POOL,
    second: str = D.EVAL_POOL,
) -> DataFrame:
    """Add ``split``: the first ``floor(share * n)`` rows in seeded order go to ``first``.

    ``exact=False`` compares the hash with ``share`` instead: one pass, no histogram,
    and a share that is only close to the asked one.
    """
    key = seeded_key(seed, row_id)
    if exact:
        cut = seeded_cut(rows, seed, row_id, F.floor(F.col("total") * F.lit(share)))
        inside = F.coalesce(key <= cut.scalar(), F.lit(False))
    else:
        inside = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") < F.lit(int(share * 2**32))
    return rows.withColumn("split", F.when(inside, F.lit(first)).otherwise(F.lit(second)))


def split_filter(rows: DataFrame, split: str) -> DataFrame:
    """One pool only.  On a table stored by split this prunes to its folder."""
    return rows.where(F.col("split") == split)


def quota_sample(
    rows: DataFrame, group: str, quotas: dict[str, int], seed: int, row_id: str
) -> DataFrame:
    """Up to ``quotas[g]`` rows of every group ``g`` in seeded order; groups without a quota are left out."""
    from deskgraph.functions.rules import lookup

    quota = lookup(F.col(group), {g: str(q) for g, q in quotas.items()}).cast("int")
    kept = rows.where(F.col(group).isin(*quotas))
    ranked = top_n_per_group(
        kept, [group], [seeded_key(seed, row_id), F.col(row_id)], max(quotas.values()), rank="_rank"
    )
    return ranked.where(F.col("_rank") <= quota).drop("_rank")
