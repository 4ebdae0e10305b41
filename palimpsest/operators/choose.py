"""Choosing rows: best k of a group with forced ones, strided samples, context windows; and counts of what was chosen."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.scratch import kept

#: Values that a task's summary keeps.
CAPACITY = 100_000
#: Bytes of values up to which those that may be among the most common are broadcast.
MAX_BROADCAST = 64 << 20


def topk_forced(rows: DataFrame, parts: list[str], score: str, tie: str, k: int, forced: Column) -> DataFrame:
    """The k best rows of each group by score, ties by the least `tie`, then forced rows that aren't among them; with their rank.

    The k best are cut before the shuffle (a window's group limit), the forced rows come by a filter of their own, and only both are ranked.
    """
    best = Window.partitionBy(*parts).orderBy(F.col(score).desc(), F.col(tie))
    top = rows.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= k).drop("_rn").withColumn("_late", F.lit(0))
    more = rows.where(forced).join(top.select(*parts, tie), [*parts, tie], "left_anti").withColumn("_late", F.lit(1)).select(top.columns)
    order = Window.partitionBy(*parts).orderBy("_late", F.col(score).desc(), F.col(tie))
    return top.unionByName(more).withColumn("rank", F.row_number().over(order)).drop("_late")


def strided(count: Column, samples: int, forced: list[int]) -> Column:
    """Numbers below count in steps of max(1, count // samples), with the forced ones that are below it, ascending and once each."""
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(count / samples).cast("bigint"))
    steps = F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1, step)).otherwise(F.array().cast("array<bigint>"))
    known = F.filter(F.array(*[F.lit(x).cast("bigint") for x in forced]).cast("array<bigint>"), lambda x: x < count)
    return F.array_sort(F.array_union(steps, known))


def context(place: Column, count: Column, before: int, after: int) -> Column:
    """(first, stop) of the window from `before` places in front of a place to `after` behind it, cut at the ends."""
    first = F.greatest(F.lit(0).cast("bigint"), place - before)
    return F.struct(first.cast("bigint").alias("first"), F.least(count, place + after + 1).cast("bigint").alias("stop"))


def most_common(rows: DataFrame, value: str, order: str, n: int | None = None) -> DataFrame:
    """(value, n, first): counts, largest first, ties by first place."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    ranked = counted.orderBy(F.desc("n"), "first")
    return ranked.limit(n) if n is not None else ranked


def _summaries(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """Frequent values of a task: (value, n, first, error). A value stands at least n times and at most n + error; one that isn't named, at most error.

    From twice the capacity on, all counts are lowered by the largest count that doesn't fit, and values without a count go; error sums these steps.
    """
    table, error, waiting = None, 0, 0
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        together = pa.concat_tables(([table] if table is not None else []) + held)
        return together.group_by("value").aggregate([("n", "sum"), ("first", "min")]).rename_columns(["value", "n", "first"])

    for batch in batches:
        some = pa.table({"value": batch.column(0), "first": batch.column(1), "n": pa.repeat(pa.scalar(1, pa.int64()), batch.num_rows)})
        held.append(some.group_by("value").aggregate([("n", "sum"), ("first", "min")]).rename_columns(["value", "n", "first"]))
        waiting += held[-1].num_rows
        if waiting < capacity:
            continue
        table, held, waiting = merged(), [], 0
        if table.num_rows >= 2 * capacity:
            step = pc.array_sort_indices(table["n"], order="descending")[capacity].as_py()
            cut = table["n"][step].as_py()
            error += cut
            table = table.set_column(1, "n", pc.subtract(table["n"], cut)).filter(pc.greater(table["n"], cut))
    if held:
        table = merged()
    if table is None:
        return
    yield from table.append_column("error", pa.repeat(pa.scalar(error, pa.int64()), table.num_rows)).append_column("lead", pa.array([i == 0 for i in range(table.num_rows)], pa.bool_())).to_batches()
    if not table.num_rows and error:
        blank = [pa.nulls(1, f.type) for f in table.schema]
        yield pa.RecordBatch.from_arrays([*blank, pa.array([error], pa.int64()), pa.array([True])], [*table.schema.names, "error", "lead"])


def top_counts(rows: DataFrame, value: str, order: str, n: int, capacity: int = CAPACITY) -> DataFrame:
    """The n most common values as (value, n, first), exactly, largest first, ties by first place and then by value; null values don't count.

    For values of any number: tasks summarise their rows in bounded memory, so `capacity` values a task are shuffled at most. Where no task left
    any out, the sums are the counts. Else only values whose upper bound reaches the n-th best lower bound are counted again, in a second pass that
    shuffles these alone. If that bound doesn't exceed what unnamed values may have, so that summaries can't tell, all values are counted.
    """
    shape = rows.select(value, order).schema
    kinds = [f.dataType.simpleString() for f in shape]
    read = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("value"), F.col(order).alias("first"))
    made = read.mapInArrow(lambda b: _summaries(b, capacity), f"value {kinds[0]}, n bigint, first {kinds[1]}, error bigint, lead boolean")
    summed = made.groupBy("value").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum(F.when(F.col("lead"), F.col("error"))).alias("error"))
    summary, _ = kept(summed)
    error = summary.agg(F.coalesce(F.sum("error"), F.lit(0))).first()[0]
    named = summary.where("value is not null").select("value", "n", "first")
    if error:
        least = [r["n"] for r in named.select("n").orderBy(F.desc("n")).limit(n).collect()]
        sure = len(least) == n and least[-1] > error
        chosen = read
        if sure:
            among = named.where(F.col("n") + error >= least[-1]).select("value")
            # Left to itself, the join would shuffle all rows before it knows how few values these are.
            held = among.agg(F.coalesce(F.sum(F.octet_length(F.col("value").cast("string")) + 32), F.lit(0))).first()[0]
            chosen = read.join(F.broadcast(among) if held <= MAX_BROADCAST else among, "value", "left_semi")
        named = chosen.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))
    return named.select(F.col("value").alias(value), "n", "first").orderBy(F.desc("n"), "first", value).limit(n)


def ratio(part: Column, whole: Column) -> Column:
    """Rounded half to even at six digits; 0.0 of nothing."""
    return F.coalesce(F.bround(F.try_divide(part.cast("double"), whole.cast("double")), 6), F.lit(0.0))


def touched(counts: list[tuple[str, Column]], always: int = 0) -> Column:
    """A map of counters without those that are 0, but for the first `always` ones."""
    entries = [(F.lit(name), value.cast("bigint")) for name, value in counts]
    whole = F.create_map(*[x for e in entries for x in e])
    kept = [name for name, _ in counts[:always]]
    return F.map_filter(whole, lambda k, v: (v > 0) | k.isin(kept) if kept else v > 0)
