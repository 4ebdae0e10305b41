"""Exact most common values from summaries of bounded size, beside a plain count."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pytest

from palimpsest.operators.choose import _summaries, top_counts


def plain_top(rows, n):
    counts, first = Counter(), {}
    for value, place in rows:
        if value is not None:
            counts[value] += 1
            first[value] = min(place, first.get(value, place))
    return sorted(((v, c, first[v]) for v, c in counts.items()), key=lambda x: (-x[1], x[2], x[0]))[:n]


def words_of(kind, rng):
    if kind == "skewed":
        return [f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(12_000)]
    if kind == "flat":  # bounds overlap, so all values are counted
        return [f"w{rng.randrange(2000)}" for _ in range(8_000)]
    if kind == "hot":
        return [("hot" if rng.random() < 0.4 else f"w{rng.randrange(10**6)}") for _ in range(8_000)] + [None] * 20
    if kind == "different":
        return [f"w{k:06d}" for k in range(3_000)]
    return []


@pytest.mark.parametrize("kind", ["skewed", "flat", "hot", "different", "none"])
def test_top_counts_are_exact(spark, kind):
    words = words_of(kind, random.Random(kind))
    rows = [(w, k // 2) for k, w in enumerate(words)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "word string, place bigint, n string").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        for capacity in (40, 100_000):
            for n in (1, 10):
                assert [tuple(r) for r in top_counts(df, "word", "place", n, capacity).collect()] == plain_top(rows, n), (capacity, n)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_summaries_are_bounded_and_their_bounds_hold():
    rng = random.Random(8)
    words = words_of("skewed", rng) + words_of("different", rng)
    rng.shuffle(words)
    batches = [pa.RecordBatch.from_arrays([pa.array(words[k : k + 500]), pa.array(range(k, k + 500), pa.int64())], ["value", "first"]) for k in range(0, len(words), 500)]
    got = pa.Table.from_batches(_summaries(iter(batches), 100))
    true, error = Counter(words), got["error"][0].as_py()
    named = dict(zip(got["value"].to_pylist(), got["n"].to_pylist(), strict=True))
    assert error > 0 and got.num_rows < 200 + 600 and sum(got["lead"].to_pylist()) == 1
    assert all(named.get(w, 0) <= c <= named.get(w, 0) + error for w, c in true.items())
    assert list(_summaries(iter([]), 100)) == []
