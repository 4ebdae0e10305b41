from __future__ import annotations

import random

from palimpsest.operators.islands import bounded_islands, pairs_of, positional_fill
from palimpsest.operators.order import running_count
from pyspark.sql import functions as F


def expected(rows, other):
    """Walks each run of rows without a match; rows: (key, found)."""
    out, i = {}, 0
    while i < len(rows):
        j = i
        while j < len(rows) and not rows[j][1]:
            j += 1
        if j > i and i > 0 and j < len(rows):
            gap = j - i + 1
            fits = [p for p in range(len(other) - gap) if other[p] == rows[i - 1][0] and other[p + gap] == rows[j][0]]
            if len(fits) == 1:
                out |= {i + k: fits[0] + 1 + k for k in range(j - i)}
        i = max(j, i + 1)
    return out


def test_islands_are_filled_where_one_place_fits(spark):
    rng = random.Random(3)
    rows, other, want = [], [], {}
    for part in range(60):
        own = [(rng.choice("abcde"), rng.random() < 0.6) for _ in range(rng.randint(0, 14))]
        second = [rng.choice("abcde") for _ in range(rng.randint(0, 14))]
        rows += [(part, i, k, f) for i, (k, f) in enumerate(own)]
        other += [(part, i, k) for i, k in enumerate(second)]
        want |= {(part, i): p for i, p in expected(own, second).items()}
    a = spark.createDataFrame(rows, "part int, ord bigint, key string, found boolean").repartition(5)
    b = spark.createDataFrame(other, "part int, ord bigint, key string").repartition(3)
    got = {(r["part"], r["ord"]): r["other_ord"] for r in positional_fill(a, b, ["part"]).collect()}
    assert got == want
    assert want


def test_one_key_on_all_rows(spark):
    """Islands of few lengths between rows of one key: rows in between grow with places times lengths, not with islands times places."""
    n = 3000
    rows = spark.range(n).select(F.lit(0).alias("part"), F.col("id").alias("ord"), F.lit("k").alias("key"), (F.col("id") % 4 == 0).alias("found"))
    other = rows.select("part", "ord", "key")
    assert positional_fill(rows, other, ["part"]).count() == 0
    _, bounded = bounded_islands(rows, ["part"])
    assert bounded.count() == n // 4 - 1
    assert pairs_of(bounded, other, ["part"]).count() == n - 4  # all islands have three rows


def test_running_count_over_blocks(spark):
    rng = random.Random(4)
    rows = [(p, i, rng.random() < 0.3 or None) for p in (0, 1) for i in range(100)]
    df = spark.createDataFrame(rows, "p int, i bigint, f boolean").repartition(7)
    got = {(r["p"], r["i"]): r["n"] for r in running_count(df, ["p"], "i", F.col("f"), "n", block=9).collect()}
    for p in (0, 1):
        total = 0
        for q, i, f in rows:
            if q == p:
                total += bool(f)
                assert got[(p, i)] == total
