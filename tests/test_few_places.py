"""Restorations shuffle places, not bodies; only entries that are fetched are cleaned."""

from __future__ import annotations

import random
import re
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as t
from palimpsest.operators import lookup, segment
from palimpsest.operators.segment import bracket_entries
from palimpsest.plans.restore import restore_pronunciations
from palimpsest.sources.readers import lines_of


def drafts_of(spark, words):
    return spark.createDataFrame([("d", i, str(i), w, None, "mine", "{}") for i, w in enumerate(words)], "file string, ord bigint, id string, headword string, orthography string, s string, _raw string").select(
        "file", "ord", "id", "headword", "orthography", F.struct(F.col("s").alias("source_id")).alias("source"), F.struct(F.lit("1").alias("block_guess"), F.lit("2").alias("byte_offset_guess")).alias("location"),
        F.struct(F.lit("n").alias("normalized")).alias("body"), "_raw",
    )


def test_only_fetched_bodies_are_cleaned_and_lookups_hold_places(spark, monkeypatch):
    cleaned, grouped = [], []
    real_fields, real_keys = segment.bracket_fields, lookup.keys_of
    monkeypatch.setattr("palimpsest.plans.restore.bracket_fields", lambda raw, *a: cleaned.append(raw) or real_fields(raw, *a))
    monkeypatch.setattr("palimpsest.plans.restore.keys_of", lambda looks, entries, order: grouped.append(entries) or real_keys(looks, entries, order))
    dump = "".join(f"w{i}［[hA121]{i}］\nbody {i}\n" for i in range(50)) + "w3［[hA121]other］\nelse\nw4［[hA121]4］\nlater"
    got = restore_pronunciations(drafts_of(spark, ["w1", "w1", "W2", "w3", "w4", None]), lines_of(spark.createDataFrame([("f", dump)], "file string, text string"), ends=""), {}, "mine")
    assert [(r["id"], r["method"], r["b"]) for r in got.rows.select("id", "method", F.col("row.body_readable").alias("b")).orderBy("ord").collect()] == [
        ("0", "headword_exact", "body 1"), ("1", "headword_exact", "body 1"), ("2", "headword_normalized", "body 2"), ("3", None, None), ("4", "headword_exact", "body 4"), ("5", None, None)
    ]
    assert not [c for c in grouped[0].columns if c.startswith("body")]
    assert sorted(r["headword"] for r in cleaned[-1].collect()) == ["w1", "w2", "w4"]
    assert got.entries.count() == 52 and got.report.first()["lookup"].asDict() == {
        "old_rows": 52, "exact_keys": 50, "normalized_keys": 50, "exact_lookup_keys": 49, "normalized_lookup_keys": 49, "ambiguous_exact_keys": 1, "ambiguous_normalized_keys": 1,
    }


def test_entries_need_one_exchange_of_lines(spark):
    lines = spark.createDataFrame([("f", i, x, True) for i, x in enumerate(["lost", "x［tei [hA121]］", "a", "", "b", "y［[hA121]］"])], "file string, ord bigint, line string, ended boolean")
    for block in (1, 2, 3, 100):
        assert [(r["headword"], r["body_raw"]) for r in bracket_entries(lines, {}, block).orderBy("ord").collect()] == [("x", "a\n\nb"), ("y", "")]
    # Lines are together in the table already; what is collected from it are the pieces at borders.
    plan = bracket_entries(lines, {}, 2)._jdf.queryExecution().executedPlan().toString()
    assert "struct(o, _block" in plan and "struct(o, ord" not in plan


def test_nfkc_and_white_space_are_those_of_python(spark):
    rng = random.Random(3)
    signs = [c for c in map(chr, range(0x20, 0x3400)) if unicodedata.category(c) != "Cn"] + ["가", "각", "豈", "ｶﾞ", "が", "á", "한", "\U0001d400", "𠮷", "￥"]
    texts = ["", "plain", None, *signs, *["".join(rng.choices(signs, k=4)) for _ in range(5000)]]
    got = t.nfkc.func(pa.array(texts, pa.string())).to_pylist()
    assert got == [None if x is None else unicodedata.normalize("NFKC", x) for x in texts]
    spaced = ["a b", "a  b", "a\tb", "a \t b", "　", " a ", "a b c"]
    assert [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(spaced)], "i int, x string").orderBy("i").select(t.one_space(F.col("x"))).collect()] == [re.sub(r"\s+", " ", x) for x in spaced]


@pytest.mark.parametrize("values", [["ə", "<b>", "ɪ"], ["", "zA4", "["], ["$1\\", "]", "hA1"]])
def test_few_tokens_map_as_many_do(spark, values, monkeypatch):
    rng = random.Random(5)
    tokens = dict(zip(["hA121", "zA4ff", "zA4FF"], values, strict=True))
    pieces = ["[hA121]", "[zA4ff]", "[zA4FF]", "[hA1", "21]", "[", "]", "x", "[hA999]", "[abcde]", "[z"]
    texts = ["".join(rng.choices(pieces, k=7)) for _ in range(500)]
    once = [re.sub(r"\[([zh]A[0-9A-Fa-f]{3})\]", lambda m: tokens.get(m[1], m[0]), x) for x in texts]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").orderBy("i")
    assert [r[0] for r in df.select(t.map_tokens(F.col("x"), tokens)).collect()] == once
    monkeypatch.setattr(t, "_FEW", -1)
    assert [r[0] for r in df.select(t.map_tokens(F.col("x"), tokens)).collect()] == once
