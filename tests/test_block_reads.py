"""Blocks of small files share tasks, are read and decoded once, and need no Python for their previews."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from palimpsest.functions import blocks
from palimpsest.functions import text as t
from palimpsest.plans.extract import block_samples
from palimpsest.sources.block_ranges import SHARED_BYTES, BlockReader, read_ranges


def test_small_files_share_partitions(tmp_path):
    names = [f"f{i}" for i in range(200)]
    for k, name in enumerate(names):
        (tmp_path / name).write_bytes(bytes([k]) * 3000)
    options = {"files": json.dumps([[n, f"file://{tmp_path}/{n}"] for n in names]), "sizes": "[512, 1024]", "known": "[]", "samples": "400"}
    reader = BlockReader(options)
    parts = reader.partitions()
    assert 1 < len(parts) < 20
    got = [(x["source_id"], x["block_size"], x["block"], x["chunk"]) for p in parts for batch in reader.read(p) for x in batch.to_pylist()]
    assert got == [(n, size, b, bytes([k]) * size) for k, n in enumerate(names) for size in (512, 1024) for b in range(3000 // size)]
    assert SHARED_BYTES >= 1 << 20


def test_previews_of_decoded_text_need_no_python(spark):
    every = bytes(x for a in range(0x21, 0x7F) for b in range(0x21, 0x7F) for x in (a, b)) + b"\x1fA \x1f\n\x80\x00" + bytes(range(256))
    read = blocks.with_decoded(spark.createDataFrame([(bytearray(every),), (bytearray(b"!-!-$,!+!+"),), (bytearray(b""),), (None,)], "chunk binary"))
    both = read.select(blocks.preview(F.col("text")).alias("own"), t.preview(F.col("text")).alias("general"))
    assert [r["own"] for r in both.collect()] == [r["general"] for r in both.collect()]
    assert "Python" not in read.select(blocks.preview(F.col("text")))._jdf.queryExecution().executedPlan().toString()


def test_sampled_blocks_are_read_once(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"\x24\x22" * 5000)
    got = block_samples(read_ranges(spark, [("a", f"file://{tmp_path}/a")], [512], [3], samples=400), [3])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "block_ranges" not in plan and "Python" not in plan  # what is read and decoded is a table by then
    assert got.count() == 19
