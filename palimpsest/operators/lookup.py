"""Lookups with at most one row for a key, and cascades of joins against them. A join never multiplies rows."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that meet its row in one task.
SPREAD = 1_000
#: Bytes of keys up to which they are broadcast.
MAX_BROADCAST = 64 << 20
#: Words of 64 bits by which more keys are sieved; they are broadcast, some 50 MB.
SIEVE = 1 << 20


def unique_or_none(rows: DataFrame, key: str, value: str, raw: str, order: list[str]) -> DataFrame:
    """(key, first, variants, raw_variants, distinct): each key's first row in order; usable where all its rows agree in `value`, that is distinct = 1."""
    place = F.struct(*order)
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.min_by(F.struct(*rows.columns), place).alias("first"), F.count(F.lit(1)).alias("variants"),
        F.count_distinct(raw).alias("raw_variants"), F.count_distinct(value).alias("distinct"),
    )


def last_of(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, row): the key's last row in order; later ones overwrite."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("row"))


class Step(NamedTuple):
    method: str
    key: Column
    lookup: DataFrame  # (key, row)


def cascade(rows: DataFrame, steps: list[Step]) -> DataFrame:
    """rows with row and method of the first step that finds its key, else nulls. A null key finds nothing.

    Lookups hold a key once, so each step is one left join; small lookups are broadcast by size, others are sort-merged.
    """
    # Rows without a key would all meet in one task, so they are dealt out by what they hold. The lookups' number 0 isn't a literal, which no join keeps as a key.
    held = [f.name for f in rows.schema if not re.search("map<|variant", f.dataType.simpleString())]
    out = rows
    found, methods = [], []
    for k, step in enumerate(steps):
        lookup = step.lookup.select(F.col("key").alias(f"_k{k}"), F.col("row").alias(f"_r{k}"), F.pmod(F.xxhash64("key"), F.lit(1)).alias(f"_e{k}"))
        keyed = out.withColumn(f"_key{k}", step.key).withColumn(f"_d{k}", F.when(F.col(f"_key{k}").isNull(), F.xxhash64(*held)).otherwise(F.lit(0).cast("bigint")))
        out = keyed.join(lookup, (F.col(f"_key{k}") == F.col(f"_k{k}")) & (F.col(f"_d{k}") == F.col(f"_e{k}")), "left")
        found.append(F.col(f"_r{k}"))
        methods.append(F.when(F.col(f"_r{k}").isNotNull(), F.lit(step.method)))
    spare = [f"{c}{k}" for k in range(len(steps)) for c in ("_key", "_k", "_r", "_d", "_e")]
    return out.withColumn("row", F.coalesce(*found)).withColumn("method", F.coalesce(*methods)).drop(*spare)


def frequent(rows: DataFrame, key: str, spread: int = SPREAD) -> DataFrame:
    """(_key, _copies) of the keys that more than `spread` rows have: at most a row for each `spread` rows."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > spread).select("_key", F.ceil(F.col("_n") / spread).cast("bigint").alias("_copies"))


def fetched(rows: DataFrame, key: str, table: DataFrame, often: DataFrame, row_id: list[str]) -> DataFrame:
    """rows with the row of table that has their key, which table holds once; nulls without one. often: frequent(rows, key), which is broadcast.

    No task gets all rows of a key: rows without a key are dealt out by row_id, and the table's row of a frequent key is there once for some rows.
    """
    copies = F.coalesce(F.col("_copies"), F.lit(1).cast("bigint"))
    number = F.xxhash64(*row_id)
    dealt = rows.join(F.broadcast(often), F.col(key) == F.col("_key"), "left").withColumn("_deal", F.when(F.col(key).isNull(), number).otherwise(F.pmod(number, copies))).drop("_key", "_copies")
    copied = table.join(F.broadcast(often), F.col(key) == F.col("_key"), "left").withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1))).drop("_key", "_copies")
    return dealt.join(copied, [key, "_deal"], "left").drop("_deal")


class Look(NamedTuple):
    """How entries are found by a key. rule "only": by keys that one entry has, "last": by the last entry of a key, "agree": by the first one of keys whose
    entries have one `value`. before: only entries that hold it count; after: the chosen entry must hold it."""

    key: Column
    rule: str = "only"
    before: Column | None = None
    after: Column | None = None
    value: Column | None = None


def key_bits(key: Column) -> tuple[Column, Column]:
    """128 bits of a key, as texts of any length are too much to sort and shuffle by. Two of n keys share them with probability n**2 / 2**129."""
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def stacked(rows: DataFrame, keys: list[Column], columns: list[Column]) -> DataFrame:
    """(step, k1, k2, *columns): a row for each key that isn't null; step is the key's number. All keys are made in one pass over the rows."""
    made = [F.when(k.isNotNull(), F.struct(F.lit(n).alias("step"), *[b.alias(f"k{i}") for i, b in enumerate(key_bits(k), 1)])) for n, k in enumerate(keys)]
    return rows.select(F.explode(F.filter(F.array(*made), F.isnotnull)).alias("_x"), *columns).select("_x.*", "*").drop("_x")


def hashed(looks: list[Look], entries: DataFrame, order: list[str]) -> DataFrame:
    """entries as their places and, for each look's number n, its key's bits _a and _b (null where the entry doesn't count for it), _h (whether the entry may be chosen) and _v
    (bits of its value). As a table, it makes keys once for all that reads them, and has no texts."""
    columns = []
    for n, look in enumerate(looks):
        counted = look.key.isNotNull() if look.before is None else look.key.isNotNull() & look.before
        holds = F.lit(True) if look.after is None else F.coalesce(look.after, F.lit(False))
        value = F.lit(None).cast("bigint") if look.value is None else F.when(look.value.isNotNull(), F.xxhash64(look.value))
        columns += [*[F.when(counted, k).alias(f"_{c}{n}") for c, k in zip("ab", key_bits(look.key), strict=True)], holds.alias(f"_h{n}"), value.alias(f"_v{n}")]
    return entries.select(*order, *columns)


def key_rows(looks: list[Look], entries: DataFrame, order: list[str]) -> DataFrame:
    """(place, step, k1, k2, holds, value): a row for each look (its number as step) and entry that counts for it. place: a struct of `order`. entries may come from `hashed`."""
    made = entries if "_a0" in entries.columns else hashed(looks, entries, order)
    parts = [F.when(F.col(f"_a{n}").isNotNull(), F.struct(F.lit(n).alias("step"), *[F.col(f"_{c}{n}").alias(name) for c, name in (("a", "k1"), ("b", "k2"), ("h", "holds"), ("v", "value"))])) for n in range(len(looks))]
    return made.select(F.struct(*order).alias("place"), F.explode_outer(F.array(*parts)).alias("_x")).where("_x is not null").select("place", "_x.*")


def _grouped(looks: list[Look], rows: DataFrame) -> DataFrame:
    """keys_of from key_rows. What no one asks for isn't summed up: without the entries all sums are whole numbers, which need no sort."""
    row = F.struct("place", "holds")
    ends = [F.max(row).alias("last")] if any(look.rule == "last" for look in looks) else []
    grouped = rows.groupBy("step", "k1", "k2").agg(F.min(row).alias("first"), *ends, F.count(F.lit(1)).alias("variants"), F.min("value").alias("least"), F.max("value").alias("most"))
    chosen, usable = F.lit(None), F.lit(False)
    for n, look in enumerate(looks):
        of = F.col("step") == n
        row = F.col("last") if look.rule == "last" else F.col("first")
        rule = F.col("variants") == 1 if look.rule == "only" else F.col("least") == F.col("most") if look.rule == "agree" else F.lit(True)
        chosen, usable = F.when(of, row).otherwise(chosen), F.when(of, rule & row["holds"]).otherwise(usable)
    agree = F.coalesce(F.col("least") == F.col("most"), F.lit(False))
    return grouped.select("step", "k1", "k2", chosen["place"].alias("entry"), "variants", agree.alias("agree"), F.coalesce(usable, F.lit(False)).alias("usable"))


def keys_of(looks: list[Look], entries: DataFrame, order: list[str]) -> DataFrame:
    """(step, k1, k2, entry, variants, agree, usable): for each look (its number as step) and key the chosen entry's place, a struct of `order`, whether all
    its entries have one value, and whether it finds its entry. One aggregate for all looks."""
    return _grouped(looks, key_rows(looks, entries, order))


def sieved(rows: DataFrame, keys: DataFrame, on: list[str], words: int = SIEVE) -> DataFrame:
    """The rows whose key may be among keys: all whose key is, and of the others about one in 64 * words / (number of keys). Keys are bits of words, at most a row each, which are broadcast."""
    bits = F.xxhash64(*on)
    at = [F.pmod(F.shiftright(bits, 6), F.lit(words)).alias("_word"), bits.bitwiseAND(F.lit(63)).cast("int").alias("_bit")]
    held = keys.select(*at).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_held"))
    return rows.select("*", *at).join(F.broadcast(held), "_word").where(F.expr("getbit(_held, _bit)") == 1).drop("_word", "_bit", "_held")


def among(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key is among keys, a table that has some more than once. Up to MAX_BROADCAST bytes of them are broadcast, so the rows stay where they are;
    of more, rows that pass a sieve are shuffled and hashed in the tasks, but not sorted."""
    fits = keys.count() * (16 + 16 * len(on)) <= MAX_BROADCAST
    named = keys.select(*on).distinct()
    # A semi join would be put below the sieve, so beyond the broadcast it is an inner one with different keys.
    return rows.join(F.broadcast(named), on, "left_semi") if fits else sieved(rows, keys, on).join(named.hint("shuffle_hash"), on).select(*rows.columns)


def usable_among(looks: list[Look], entries: DataFrame, order: list[str], wanted: DataFrame) -> DataFrame:
    """found_by of the keys of `wanted`, a table from wanted_by. Other keys' rows are left out before places are compared."""
    rows = among(key_rows(looks, entries, order), wanted.select(F.col("_look").alias("step"), "k1", "k2"), ["step", "k1", "k2"])
    return _grouped(looks, rows).where("usable").drop("agree", "usable")


def found_by(looks: list[Look], entries: DataFrame, order: list[str]) -> DataFrame:
    """(step, k1, k2, entry, variants) of the usable keys."""
    return keys_of(looks, entries, order).where("usable").drop("agree", "usable")


def match(rows: DataFrame, row_id: list[str], steps: list[tuple[str, Column, int]], looks: list[Look], entries: DataFrame, order: list[str]) -> DataFrame:
    """met, of entries found by looks: one aggregate and one join serve all steps, whatever their number."""
    return met(rows, row_id, steps, found_by(looks, entries, order))


def met(rows: DataFrame, row_id: list[str], steps: list[tuple[str, Column, int]], found: DataFrame) -> DataFrame:
    """(row_id, method, entry, variants) for the rows of which some step finds an entry: the first such step's. steps: method, the row's key, the look's number.

    All keys are made in one pass. row_id names a row; found: from found_by.
    """
    return first_hits(wanted_by(rows, row_id, steps), row_id, [m for m, *_ in steps], found)


def wanted_by(rows: DataFrame, row_id: list[str], steps: list[tuple[str, Column, int]]) -> DataFrame:
    """(step, k1, k2, row_id, _look): the keys that rows seek."""
    return stacked(rows, [k for _, k, _ in steps], [F.col(c) for c in row_id]).withColumn("_look", F.array(*[F.lit(look) for *_, look in steps])[F.col("step")])


def first_hits(wanted: DataFrame, row_id: list[str], methods: list[str], found: DataFrame) -> DataFrame:
    """met from wanted_by's rows."""
    hits = wanted.join(found.withColumnRenamed("step", "_look"), ["_look", "k1", "k2"]).groupBy(*row_id).agg(F.min(F.struct("step", "entry", "variants")).alias("_hit"))
    return hits.select(*row_id, F.array(*[F.lit(m) for m in methods])[F.col("_hit.step")].alias("method"), F.col("_hit.entry").alias("entry"), F.col("_hit.variants").alias("variants"))
