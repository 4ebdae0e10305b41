import hashlib
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.llm.fill_middle import GRAMMARS, Sentinels, fill_middle, restored, units

TOKENS = {
    "words": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+",
    "lines": r"[^\n]*\n|[^\n]+",
    "code": r"\w+|\s+|[^\w\s]",
    "characters": r"(?s:.)",
}
TEXTS = [
    None, "", " ", "\n\n", "one", " two words ", "a\tb\x0bc\x0cd\re\n", "x" * 300_000, "w " * 50_000, "naïve text here", "💡 lamp 💡💡 end", "<P> marked", "a <S>", "<M>",
    "half < P> <P", "<P", "repeat repeat", "def f(x):\n    return x + 1  # done\n", "\n".join(f"line {i}" for i in range(50)),
]


def plain(doc_id, text, marks=("<P>", "<S>", "<M>"), grammar="words"):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    pieces = re.findall(TOKENS[grammar], text)
    n = len(pieces)
    if not text or any(m in text for m in marks) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(pieces[:a]), "".join(pieces[a:b]), "".join(pieces[b:])
    p, s, m = marks
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


@pytest.mark.parametrize("grammar", sorted(GRAMMARS))
def test_units_are_those_of_a_plain_scan(spark, grammar):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    for r in df.select("text", units(F.col("text"), grammar).alias("u")).collect():
        assert r["u"] == re.findall(TOKENS[grammar], r["text"] or ""), r["text"]


def test_each_text_beside_a_plain_version(spark):
    rows = [(7 * i + j if j else None, t, "x", i) for i, t in enumerate(TEXTS) for j in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, units string, n int")
    made = fill_middle(df, keep=["units", "text"]).select("*", restored(F.col("output"), F.col("form")).alias("back"))
    got = [(r["id"], r["text"] or "", r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made.collect()]
    want = [(i, t or "", *plain(i, t)) for i, t, _, _ in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}
    assert all(r["back"] == (r["text"] or "") for r in made.collect())


def test_rates_marks_and_no_rows(spark):
    df = spark.createDataFrame([(i, "a b c d e f") for i in range(50)], "doc_id int, text string")
    marks = Sentinels("[pre]", "[suf]", "[mid]")
    made = fill_middle(df, rate=100, spm_rate=0, marks=marks)
    assert {r["form"] for r in made.collect()} == {"psm"}
    assert made.where(restored(F.col("output"), F.col("form"), marks) != "a b c d e f").count() == 0
    assert {r["form"] for r in fill_middle(df, rate=0).collect()} == {"plain"}
    assert fill_middle(df.where("false")).count() == 0
    for bad in (Sentinels("", "a", "b"), Sentinels("aba", "x", "y"), Sentinels("ab", "bc", "x"), Sentinels("abc", "b", "x")):
        with pytest.raises(ValueError):
            fill_middle(df, marks=bad)


def test_no_exchange_and_no_python(spark):
    plan = fill_middle(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
