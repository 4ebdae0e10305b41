"""Order as data: counts along an order without a window over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places in one block.
BLOCK = 65_536


def running_count(df: DataFrame, parts: list[str], order: str, flag: Column, name: str, block: int = BLOCK) -> DataFrame:
    """df with the number of flagged rows up to and with each row, along whole-number places.

    Rows are counted within blocks of places, and only the blocks' totals are summed along the order, so no task holds a part whole.
    """
    return carried_count(in_blocks(df, parts, order, block), parts, order, flag, name).drop("_block")


def in_blocks(df: DataFrame, parts: list[str], order: str, block: int = BLOCK) -> DataFrame:
    """df dealt out by blocks of places, numbered in _block. What carries over block borders is summed up in one small row a block.

    All that follows reads this one exchange: windows and sums over (parts, _block) need no other, and equal exchanges run once. Rows without a
    part or place have no block and go here, as a filter that joins put below one use alone would make the exchanges differ.
    """
    known = F.lit(True)
    for c in (*parts, order):
        known = known & F.col(c).isNotNull()
    return df.where(known).withColumn("_block", F.floor(F.col(order) / block)).repartition(*parts, "_block")


def beside(dealt: DataFrame, parts: list[str], order: str, value: str) -> DataFrame:
    """dealt (from in_blocks) with _prev and _next, the values of the rows before and after, also across blocks; value isn't null.

    What comes from other blocks is broadcast: at most two rows for each block's number of places, as parts of one block have none.
    """
    keys = [*parts, "_block"]
    ends = dealt.groupBy(*keys).agg(F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last"))
    blocks = Window.partitionBy(*parts).orderBy("_block")
    carried = ends.select(*keys, F.lag("_last").over(blocks).alias("_before"), F.lead("_first").over(blocks).alias("_behind")).where("_before is not null or _behind is not null")
    inside = Window.partitionBy(*keys).orderBy(order)
    own = dealt.withColumn("_prev", F.lag(value).over(inside)).withColumn("_next", F.lead(value).over(inside)).join(F.broadcast(carried), keys, "left")
    return own.withColumn("_prev", F.coalesce("_prev", "_before")).withColumn("_next", F.coalesce("_next", "_behind")).drop("_before", "_behind")


def carried_count(dealt: DataFrame, parts: list[str], order: str, flag: Column, name: str) -> DataFrame:
    """dealt (from in_blocks) with the number of flagged rows up to and with each row of a part.

    What earlier blocks have is broadcast, a row for each block that has such: none of parts of one block.
    """
    keys = [*parts, "_block"]
    marked = dealt.withColumn("_flag", F.coalesce(flag, F.lit(False)).cast("bigint"))
    within = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = marked.withColumn("_within", F.sum("_flag").over(within))
    before = Window.partitionBy(*parts).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = marked.groupBy(*keys).agg(F.sum("_flag").alias("_total"))
    starts = totals.select(*keys, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start")).where("_start > 0")
    return counted.join(F.broadcast(starts), keys, "left").withColumn(name, F.coalesce("_start", F.lit(0)) + F.col("_within")).drop("_flag", "_within", "_start")


def next_filled(dealt: DataFrame, parts: list[str], order: str, value: Column, name: str) -> DataFrame:
    """dealt (from in_blocks) with the next value of a later row that isn't null, also of a later block."""
    keys = [*parts, "_block"]
    marked = dealt.withColumn("_value", value)
    firsts = marked.groupBy(*keys).agg(F.min_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_first"))
    later = lambda w: w.rowsBetween(1, Window.unboundedFollowing)
    blocks, inside = Window.partitionBy(*parts).orderBy("_block"), Window.partitionBy(*keys).orderBy(order)
    carried = firsts.select(*keys, F.first("_first", ignorenulls=True).over(later(blocks)).alias("_behind"))
    own = marked.withColumn("_own", F.first("_value", ignorenulls=True).over(later(inside))).join(carried, keys)
    return own.withColumn(name, F.coalesce("_own", "_behind")).drop("_value", "_own", "_behind")


def numbered(df: DataFrame, part: str, order: str, name: str, block: int = BLOCK) -> DataFrame:
    """df with each row's number from 0, by part and then by order, whose places differ within a part. Rows are counted in blocks of places, and only sizes are summed beyond."""
    inside = carried_count(in_blocks(df, [part], order, block), [part], order, F.lit(True), "_nth").drop("_block")
    sizes = df.groupBy(F.col(part).alias("_of")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_of", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return inside.join(starts, F.col(part) == F.col("_of")).withColumn(name, F.col("_start") + F.col("_nth") - 1).drop("_of", "_nth", "_start")
