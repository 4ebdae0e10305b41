"""Whole texts are cut into entries where they are, and lookups compare the places of sought keys alone."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import lookup, segment
from palimpsest.operators.lookup import Look, keys_of, usable_among, wanted_by
from palimpsest.operators.segment import bracket_entries
from palimpsest.plans.restore import restore_pronunciations
from palimpsest.sources.readers import lines_of
from palimpsest.sources.scratch import kept
from tests.test_few_places import drafts_of

PIECES = ["x", "word", " ", "　", "\t", "\x0b", " ", "\n", "\n", "\r", "\r\n", "［", "］", "]", "[", "［[hA121]］", "a［ai [hA121]］\n", "\nb［[hA126] ］\n", "［　］", "c［d］", "$1\\"]


def whole(df):
    return sorted(tuple(r) for r in df.collect())


def test_whole_texts_are_cut_as_their_lines_are(spark):
    rng = random.Random(11)
    fixed = ["", None, "\n", "\r\n", "a［[hA121]］", "a［[hA121]］\n", "lost\na［[hA121]］\nb［[hA121]］\n\n\n", "a［[hA121]］\rx\r\ny\r", " ［[hA121]］\nbody", "a［[hA121]］\n" * 3 + "b［[hA121]］", "　［x］\n［[hA121]］\n"]
    made = fixed + ["".join(rng.choices(PIECES, k=rng.randrange(1, 40))) for _ in range(200)]
    texts = spark.createDataFrame([(f"f{i}", x) for i, x in enumerate(made)] + [(None, "a［[hA121]］\nb")], "file string, text string")
    got, by_line = whole(bracket_entries(texts, {"hA121": "ə"})), whole(bracket_entries(lines_of(texts, ends=""), {"hA121": "ə"}, 3))
    assert got == by_line
    assert len(got) > 50
    assert "Exchange" not in segment._bracket_texts(texts)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [-1, 1 << 20])
def test_sought_keys_find_what_all_keys_do(spark, monkeypatch, most):
    monkeypatch.setattr(lookup, "MAX_BROADCAST", most)
    rng = random.Random(7)
    entries = spark.createDataFrame([(f"f{rng.randrange(3)}", i, rng.choice(["a", "b", "c", None, "d", f"n{i}"]), rng.choice(["e", f"m{i}", None]), rng.choice(["p", "q"]) if i % 3 else "p") for i in range(90)], "file string, ord bigint, k string, m string, v string")
    order = ["file", "ord"]
    looks = [Look(F.col("k"), "agree", value=F.col("v")), Look(F.col("m"), "last", after=F.col("v") == "p"), Look(F.col("k"), before=F.col("v") == "q")]
    rows, _ = kept(spark.createDataFrame([("d", i, x) for i, x in enumerate(["a", "a", "b", "n4", "m5", "e", None, "none", *[f"n{i}" for i in range(0, 90, 2)]])], "file string, ord bigint, w string"))
    wanted, _ = kept(wanted_by(rows, order, [("one", F.col("w"), 0), ("two", F.col("w"), 1), ("three", F.col("w"), 2)]))
    every = keys_of(looks, entries, order).where("usable").drop("agree", "usable").join(wanted.select(F.col("_look").alias("step"), "k1", "k2").distinct(), ["step", "k1", "k2"])
    got = whole(usable_among(looks, entries, order, wanted))
    assert got == whole(every)
    assert len(got) > 5
    # Figures of all keys need no places, and so no sort.
    assert "SortAggregate" not in keys_of(looks, entries, order).groupBy("step").agg(F.count_if("agree"), F.sum("variants"))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [-1, 1 << 20])
def test_texts_restore_as_lines_do_and_lines_are_made_when_read(spark, monkeypatch, most):
    monkeypatch.setattr(lookup, "MAX_BROADCAST", most)
    dump = "".join(f"w{i}［[hA121]{i}］\nbody [hA121] [zA423] {i}\n" for i in range(40)) + "w3［[hA121]other］\nelse\nw4［[hA121]4］\nlater"
    texts = spark.createDataFrame([("f", dump), ("e", "w9［[hA121]9］\nfirst")], "file string, text string")
    drafts = drafts_of(spark, ["w1", "w1", "W2", "w3", "w4", "w9", "ｗ７", None])
    one, two = (restore_pronunciations(drafts, x, {"hA121": "ə"}, "mine") for x in (texts, lines_of(texts, ends="")))
    rows = [tuple(r) for r in one.rows.select("id", "method", "row.body_readable", "line").orderBy("ord").collect()]
    assert rows == [tuple(r) for r in two.rows.select("id", "method", "row.body_readable", "line").orderBy("ord").collect()]
    assert [(m, b) for _, m, b, _ in rows] == [
        ("headword_exact", "body ə [zA423] 1"), ("headword_exact", "body ə [zA423] 1"), ("headword_normalized", "body ə [zA423] 2"), (None, None), ("headword_exact", "body ə [zA423] 4"),
        ("headword_exact", "first"), ("headword_normalized", "body ə [zA423] 7"), (None, None),
    ]
    assert whole(one.index) == whole(two.index)
    assert str(one.report.collect()) == str(two.report.collect())
    # The tables of the restoration have no lines; what reads none makes none.
    assert not any("line" in spark.read.parquet(path).columns for path in one.tables)
    assert "edit_json" not in one.index._jdf.queryExecution().executedPlan().toString()


def test_head_lines_are_the_same_by_the_quick_pattern(spark):
    rng = random.Random(19)
    lines = ["".join(rng.choices(["a", " ", "　", "\t", "[", "]", "［", "］", "(", "é", "$1"], k=rng.randrange(0, 9))) + "］" * rng.randrange(2) for _ in range(5000)]
    marked = lambda pattern, parts: F.regexp_replace("x", pattern, parts)
    slow, quick = F.split(marked(segment._HEAD, "\n$1\n$2"), "\n"), F.split(marked(segment._HEAD_QUICK, "\n$1$3\n$2$4"), "\n")
    rows = spark.createDataFrame([(x,) for x in lines], "x string").select("x", *[F.transform(c, segment.t.strip).alias(n) for c, n in ((slow, "slow"), (quick, "quick"))]).collect()
    assert [r for r in rows if r["slow"] != r["quick"]] == []
    assert sum(len(r["slow"]) == 3 for r in rows) > 100


def test_keys_are_made_once_and_kept_without_texts(spark):
    texts = spark.createDataFrame([("f", "w1［[hA121]］\nbody\nW1［[hA121]x］\nbody\n")], "file string, text string")
    got = restore_pronunciations(drafts_of(spark, ["w1", "none"]), texts, {}, "mine")
    kinds = dict(spark.read.parquet(got.tables[0]).dtypes)
    assert [c for c, kind in kinds.items() if kind == "string"] == ["file"]
    figures = got.report.first()["lookup"]
    assert (figures["exact_keys"], figures["normalized_keys"], figures["ambiguous_normalized_keys"]) == (2, 1, 1)


def test_too_many_keys_to_broadcast_are_sieved_before_the_shuffle(spark, monkeypatch):
    rows = spark.range(20_000).select(F.col("id").alias("n"), F.xxhash64("id").alias("k"))
    keys, _ = kept(rows.where("n % 100 = 3").select("k").union(rows.where("n = 3").select("k")))
    monkeypatch.setattr(lookup, "MAX_BROADCAST", -1)
    got = lookup.among(rows, keys, ["k"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ShuffledHashJoin") < plan.index("getbit")  # what stands later in a plan runs before
    assert sorted(r["n"] for r in got.select("n").collect()) == list(range(3, 20_000, 100))
    passed = {r["n"] for r in lookup.sieved(rows, keys, ["k"], words=512).select("n").collect()}
    assert passed >= set(range(3, 20_000, 100)) and len(passed) < 600
    # One word has all keys: the sieve lets rows through, and none is lost.
    assert {r["n"] for r in lookup.sieved(rows, keys, ["k"], words=1).select("n").collect()} >= set(range(3, 20_000, 100))
