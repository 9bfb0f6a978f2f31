"""Building blocks that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64
HOT_ROWS = 100_000
HOT_SHARE = 0.002
#: Bits of the map that :func:`may_match` spreads keys over: 4 MB, however many keys there are.
KEY_BITS = 1 << 25


def hot_keys(
    rows: DataFrame, key: str, share: float = HOT_SHARE, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Hashes and counts of all keys with more than ``hot_rows`` rows and ``share`` of all ``rows``.

    There are at most ``1 / share`` such keys, so none is left out.

    One pass with a frequent-item sketch, whose size does not grow with the data.  The result
    only steers how rows are spread, so neither sketch error nor a hash collision can
    change a join.
    """
    limit = math.ceil(1 / share)
    sketch = rows.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("_h")).agg(
        F.expr(f"approx_top_k(_h, {limit}, {limit * 64})").alias("top"),
        F.count(F.lit(1)).alias("total"),
    )
    return (
        sketch.select(F.explode("top").alias("entry"), "total")
        .where(F.col("entry.count") > F.greatest(F.lit(hot_rows), F.col("total") * F.lit(share)))
        .select(F.col("entry.item").alias("_h"), F.col("entry.count").alias("_n"))
    )


def join_to_unique(
    rows: DataFrame,
    unique: DataFrame,
    key: str,
    spread_by: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    share: float = HOT_SHARE,
) -> DataFrame:
    """Equi-join many ``rows`` to a side with one row per ``key``.

    A hot key's rows are spread by a hash of ``spread_by`` over as many salts as it takes to have about
    ``hot_rows`` in each, and the one matching row is copied to each; every other key joins as usual.  The hot
    keys come in as one map of at most ``1 / share`` hashes, computed once.
    """
    salts = F.ceil(F.col("_n") / F.lit(max(1, hot_rows))).cast("int")
    hot = hot_keys(rows, key, share, hot_rows).agg(F.map_from_entries(F.collect_list(F.struct("_h", salts)))).scalar()
    wide = F.coalesce(F.try_element_at(hot, F.xxhash64(key)), F.lit(1))
    own = F.when(F.col(key).isNull(), F.lit(SALTS)).otherwise(wide)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), own).cast("int"))
    copies = unique.withColumn("_salt", F.explode(F.sequence(F.lit(0), wide - 1)))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def may_match(rows: DataFrame, key: str, wanted: DataFrame, bits: int = KEY_BITS) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in the one column of ``wanted``, before a shuffle of wide rows.

    The keys asked for set bits of a map of fixed size, which goes to every task.  No row that has a match is lost; a few others stay, so
    a join has to follow.  Many more keys than ``bits`` leave all rows there.
    """

    def place(value: Column) -> Column:
        return F.pmod(F.xxhash64(value.cast(rows.schema[key].dataType)), F.lit(bits)) + 1

    asked = place(F.col(wanted.columns[0]))
    spots = wanted.select(F.bitmap_bucket_number(asked).alias("_bucket"), F.bitmap_bit_position(asked).alias("_bit"))
    maps = spots.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    own = place(F.col(key))
    bit = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substring("_map", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = rows.withColumn("_bucket", F.bitmap_bucket_number(own)).join(F.broadcast(maps), "_bucket")
    return held.where(byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0).select(*rows.columns)


def top_n_per_group(
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str | None = None,
    spread_by: Sequence[str] | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """First ``n`` rows of every group, exact for groups of any size.

    With ``spread_by`` the cut is made inside ``salts`` slices of each group first,
    so the final window sees at most ``salts * n`` rows of a group.  Without it the
    planner's own partial top-n does that job, which it does for small ``n``.
    """
    if spread_by:
        salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts))
        slice_window = Window.partitionBy(*group, "_salt").orderBy(*order)
        rows = (
            rows.withColumn("_salt", salt)
            .withColumn("_rank", F.row_number().over(slice_window))
            .where(F.col("_rank") <= n)
            .drop("_salt", "_rank")
        )
    window = Window.partitionBy(*group).orderBy(*order)
    name = rank or "_rank"
    kept = rows.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
    return kept if rank else kept.drop(name)
