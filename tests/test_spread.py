"""Rows of one key, and rows without a key, don't meet in one task."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.lookup import Step, cascade, fetched, frequent
from palimpsest.operators.order import beside, carried_count, in_blocks
from palimpsest.operators.segment import bracket_entries, headline_entries, headline_fields
from palimpsest.plans.restore import Rules, apply_rules


@pytest.fixture
def shuffled(spark):
    """Joins whose sides are shuffled by their keys, in 8 partitions that stay as they are."""
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def largest(df) -> int:
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_rows_that_no_rule_names_stay_dealt_out(shuffled):
    made = shuffled.range(20).select(F.lit("f").alias("file"), F.col("id").alias("ord"), *[F.concat(F.lit("h"), "id").alias(c) for c in ("headword_line", "headword_line_mapped")], *[F.lit("b").alias(c) for c in ("body_raw", "body_mapped", "body_readable")])
    entries = headline_fields(made)
    shape = F.lit(None).cast(entries.select(F.struct(*entries.columns).alias("x")).schema["x"].dataType)
    rows = shuffled.range(0, 800, 1, 8).select(
        "id", F.when(F.col("id") == 5, "made").otherwise("none").alias("header_key"), F.when(F.col("id") == 7, "a clue").otherwise("nothing").alias("body_key"), shape.alias("row"),
        F.lit(None).cast("string").alias("method"), F.lit(False).alias("restored"),
    )
    got = apply_rules(rows, entries, Rules([(["clue"], "h3", "by_clue")], [("made", "line", "body", "by_header")]))
    assert sorted((r["id"], r["method"], r["h"]) for r in got.where("method is not null").select("id", "method", F.col("row.headword_line").alias("h")).collect()) == [(5, "by_header", "line"), (7, "by_clue", "h3")]
    assert got.count() == 800
    assert largest(got) < 300


def test_a_cascade_deals_out_rows_without_a_key(shuffled):
    lookup = shuffled.createDataFrame([("k1", "one"), ("k2", "two")], "key string, row string")
    rows = shuffled.range(800).select("id", F.when(F.col("id") < 2, F.concat(F.lit("k"), F.col("id") + 1)).alias("k"))
    got = cascade(rows, [Step("m", F.col("k"), lookup)])
    assert sorted((r["id"], r["row"], r["method"]) for r in got.where("row is not null").collect()) == [(0, "one", "m"), (1, "two", "m")]
    assert got.count() == 800
    assert largest(got) < 300


def test_rows_of_a_frequent_entry_are_fetched_by_many_tasks(shuffled):
    table = shuffled.range(5).select(F.col("id").alias("entry"), F.concat(F.lit("e"), "id").alias("row"))
    rows = shuffled.range(900).select("id", F.when(F.col("id") < 400, 3).when(F.col("id") < 405, F.col("id") - 400).cast("bigint").alias("entry"))
    got = fetched(rows, "entry", table, frequent(rows, "entry", spread=10), ["id"])
    assert {(r["id"], r["row"]) for r in got.collect()} == {(i, "e3" if i < 400 else f"e{i - 400}" if i < 405 else None) for i in range(900)}
    assert got.count() == 900
    assert largest(got) < 300


def test_lines_are_read_and_judged_once(shuffled):
    """What carries over block borders joins no rows by shuffles, and entries come from a table of judged lines."""
    lines = shuffled.createDataFrame([("f", i, x, True) for i, x in enumerate(["あ【亜】", "〈n〉 one", "い", "（two）", "x［tei [hA121]］", "body"])], "file string, ord bigint, line string, ended boolean")
    dealt = in_blocks(lines, ["file"], "ord", 2)
    for df in (beside(dealt, ["file"], "ord", "line"), carried_count(dealt, ["file"], "ord", F.col("ord") == 2, "n")):
        assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    heads, brackets = headline_entries(lines, {}, 2), bracket_entries(lines, {}, 2)
    for df in (heads, brackets):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Scan ExistingRDD" not in plan
    assert [(r["headword_line"], r["body_raw"]) for r in heads.orderBy("ord").collect()] == [("あ【亜】", "〈n〉 one"), ("い", "（two）\nx［tei [hA121]］\nbody")]
    assert [(r["headword"], r["body_raw"]) for r in brackets.collect()] == [("x", "body")]
