"""Positional join: runs of rows without a match are filled from a second sequence, if the rows around fit exactly one place there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.order import running_count


def positional_fill(rows: DataFrame, other: DataFrame, parts: list[str], other_parts: list[str] | None = None) -> DataFrame:
    """(parts, ord, other_ord) for the rows that are filled. rows: parts, ord, key, found; other: parts, ord, key; places count from 0 without gaps.

    An island is a longest run of rows that aren't found. With its length n, and the keys of the found rows before and after it, it
    fits where the other sequence has these keys n + 1 places apart. One fit fills row i with i places after the first key; no fit or several, and
    islands at an end, fill nothing. All steps are sums over blocks and joins by key or place.

    Fits are counted for each different (first key, n, next key), not for each island: a place of the other sequence is met once for each length that
    islands behind its key have, so frequent keys make at most places times different lengths rows.
    """
    other_parts = parts if other_parts is None else other_parts
    missing, bounded = bounded_islands(rows, parts)
    triple = [*other_parts, "first_key", "n", "next_key"]
    index = pairs_of(bounded, other, other_parts).groupBy(*triple).agg(F.count(F.lit(1)).alias("_fits"), F.min("a_ord").alias("a_ord")).where("_fits = 1")
    one = bounded.join(index, triple).select(*parts, "_grp", "start", "a_ord")
    return missing.select(*parts, "_grp", "ord").join(one, [*parts, "_grp"]).select(*parts, "ord", (F.col("a_ord") + 1 + F.col("ord") - F.col("start")).alias("other_ord"))


def bounded_islands(rows: DataFrame, parts: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows that aren't found, numbered by island, and the islands between two found rows: start, n, first_key, next_key."""
    counted = running_count(rows, parts, "ord", F.col("found"), "_grp")
    missing = counted.where(~F.col("found"))
    islands = missing.groupBy(*parts, "_grp").agg(F.min("ord").alias("start"), F.count(F.lit(1)).alias("n"))
    ends = rows.where("found").select(*parts, F.col("ord").alias("_at"), F.col("key").alias("_key"))
    bounded = islands.join(ends.withColumnRenamed("_key", "first_key").withColumn("start", F.col("_at") + 1).drop("_at"), [*parts, "start"])
    bounded = bounded.withColumn("_at", F.col("start") + F.col("n")).join(ends.withColumnRenamed("_key", "next_key"), [*parts, "_at"]).drop("_at")

    return missing, bounded


def pairs_of(bounded: DataFrame, other: DataFrame, other_parts: list[str]) -> DataFrame:
    """Places n + 1 apart for each length n that an island behind the first one's key has: first_key, n, next_key, a_ord."""
    lengths = bounded.select(*other_parts, "first_key", "n").distinct()
    a = other.select(*other_parts, F.col("ord").alias("a_ord"), F.col("key").alias("first_key"))
    b = other.select(*other_parts, F.col("ord").alias("b_ord"), F.col("key").alias("next_key"))
    return a.join(lengths, [*other_parts, "first_key"]).withColumn("b_ord", F.col("a_ord") + F.col("n") + 1).join(b, [*other_parts, "b_ord"])
