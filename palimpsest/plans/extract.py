"""Trial extraction from block files: sampled blocks decoded and scored, the best of each file and size, and windows around known blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import fixed
from palimpsest.functions import text as t
from palimpsest.functions.blocks import control_counts, preview, with_decoded
from palimpsest.operators.choose import context, strided, topk_forced
from palimpsest.sources.block_ranges import read_ranges
from palimpsest.sources.scratch import kept as as_table
from palimpsest.sources.sinks import write_html, write_jsonl, write_tsv

SAMPLES, KEPT, LEAST_SCORE = 400, 40, 80
BEFORE, AFTER = 2, 5
SHOWN, SHOWN_WINDOW, HEX_BYTES = 3000, 12000, 128


def _sized(files: DataFrame, sizes: list[int]) -> DataFrame:
    sized = files.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("block_size"))
    return sized.withColumn("_blocks", F.floor(F.length("content") / F.col("block_size")).cast("bigint"))


def cut_samples(files: DataFrame, sizes: list[int] | None = None, known: list[int] | None = None) -> DataFrame:
    """The sampled blocks of files that are values (source_id, source, content), as read_ranges gives them."""
    known = fixed.KNOWN_BLOCKS if known is None else known
    blocks = _sized(files, sizes or fixed.BLOCK_SIZES).withColumn("block", F.explode(strided(F.col("_blocks"), SAMPLES, known)))
    chunk = F.expr("substring(content, cast(block * block_size + 1 as int), block_size)")
    return blocks.select("source_id", "source", "block_size", "block", F.col("block").alias("first"), (F.col("block") + 1).alias("stop"), chunk.alias("chunk"))


def cut_windows(files: DataFrame, sizes: list[int] | None = None, known: list[int] | None = None, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """The windows around the known blocks of files that are values, as read_ranges gives them."""
    known = fixed.KNOWN_BLOCKS if known is None else known
    placed = _sized(files, sizes or fixed.BLOCK_SIZES).withColumn("block", F.explode(F.array(*[F.lit(k).cast("bigint") for k in known]))).where("block < _blocks")
    places = placed.withColumn("_w", context(F.col("block"), F.col("_blocks"), before, after)).select("*", "_w.first", "_w.stop")
    chunk = F.expr("substring(content, cast(first * block_size + 1 as int), cast((stop - first) * block_size as int))")
    return places.select("source_id", "source", "block_size", "block", "first", "stop", chunk.alias("chunk"))


def _decoded(chunks: DataFrame) -> DataFrame:
    """Adds text, normalised preview, control counts and the chunk's offset. The blocks are dealt out first, as reading takes less than decoding."""
    dealt = chunks.withColumn("offset", F.col("first") * F.col("block_size")).repartition("source_id", "block_size", "block")
    return with_decoded(dealt).withColumn("normalized", preview(F.col("text"))).withColumn("control_codes", control_counts(F.col("codes"), F.col("counts")))


def block_samples(blocks: DataFrame, known: list[int] | None = None, kept: int = KEPT) -> DataFrame:
    """Of sampled blocks (read_ranges, cut_samples) those that score well or are known: the best `kept` of each file and size, then the known ones."""
    known = fixed.KNOWN_BLOCKS if known is None else known
    forced = F.col("block").isin(known)
    scored = _decoded(blocks).withColumn("score", t.script_score(F.col("normalized")))
    # Written, as the choice reads it several times: blocks are read and decoded once. Only what is shown of them stays.
    shown = scored.select("source_id", "source", "block_size", "block", "offset", "score", F.substring("text", 1, SHOWN).alias("text"), F.substring("normalized", 1, SHOWN).alias("normalized"), "control_codes", F.substring("chunk", 1, HEX_BYTES).alias("chunk"))
    scored = as_table(shown)[0].where((F.col("score") > LEAST_SCORE) | forced)
    best = topk_forced(scored, ["source_id", "block_size"], "score", "block", kept, forced)
    return best.select(
        F.concat_ws(":", "source_id", "block_size", "block").alias("id"), "source", "source_id", "block_size", "block", t.hex_number(F.col("block")).alias("block_hex"), "offset", "score", "rank",
        F.substring("text", 1, SHOWN).alias("decoded_with_controls"), F.substring("normalized", 1, SHOWN).alias("normalized_preview"), "control_codes",
        t.hex_bytes(F.substring("chunk", 1, HEX_BYTES)).alias("raw_hex_first_128"),
    )


def known_windows(windows: DataFrame) -> DataFrame:
    """The blocks around each known block (read_ranges, cut_windows) as one text; known blocks that a file doesn't have have no window."""
    return _decoded(windows).select(
        F.concat(F.concat_ws(":", "source_id", "block_size", "block"), F.lit(":window")).alias("id"), "source", "source_id", "block_size", F.col("block").alias("known_block"),
        t.hex_number(F.col("block")).alias("known_block_hex"), F.col("first").alias("window_start_block"), (F.col("stop") - 1).alias("window_end_block"), "offset",
        F.substring("text", 1, SHOWN_WINDOW).alias("decoded_with_controls"), F.substring("normalized", 1, SHOWN_WINDOW).alias("normalized_preview"), "control_codes",
    )


def control_totals(samples: DataFrame) -> DataFrame:
    """(code, count) over all samples, largest first; ties by where the code first came."""
    place = F.struct("source_id", "block_size", "rank", "_p")
    rows = samples.select("source_id", "block_size", "rank", F.posexplode(F.map_entries("control_codes")).alias("_p", "_e"))
    return rows.groupBy(F.col("_e.key").alias("code")).agg(F.sum("_e.value").alias("count"), F.min(place).alias("first")).orderBy(F.desc("count"), "first")


def export_blocks(spark: SparkSession, source_root: str, out_root: str, sources: list[tuple[str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Reads the block files, and writes samples, windows, control totals and two HTML pages. Sources keep the catalogue's order."""
    named = sources or fixed.BLOCK_SOURCES
    names = [n for n, _ in named]
    files = [(n, f"{source_root.rstrip('/')}/{path}") for n, path in named]
    asked = {"sizes": fixed.BLOCK_SIZES, "known": fixed.KNOWN_BLOCKS}
    blocks, around = read_ranges(spark, files, samples=SAMPLES, **asked), read_ranges(spark, files, window=(BEFORE, AFTER), **asked)
    place = F.array_position(F.array(*map(F.lit, names)), F.col("source_id"))
    samples, windows = block_samples(blocks).persist(), known_windows(around).persist()
    try:
        write_jsonl(samples, f"{out_root}/raw_block_samples.jsonl", [place, F.col("block_size"), F.col("rank")])
        write_jsonl(windows, f"{out_root}/focused_known_windows.jsonl", [place, F.col("block_size"), F.col("known_block")])
        write_tsv(control_totals(samples), f"{out_root}/control_codes.tsv", ["code", "count"], [F.desc("count"), F.col("first")])
        facts = F.concat(F.lit("score="), F.col("score").cast("string"), F.lit(" offset="), F.col("offset").cast("string"), F.lit(" block_hex="), "block_hex")
        texts = [("As text", "normalized_preview"), ("With its controls", "decoded_with_controls")]
        write_html(samples, f"{out_root}/preview.html", "Decoded blocks", "The best sampled blocks of each file and block size; nothing is written back.", "id", facts, texts, [F.col("source_id"), F.col("block_size"), F.col("rank")], 80)
        where = F.concat(F.lit("offset="), F.col("offset").cast("string"), F.lit(" blocks="), F.col("window_start_block").cast("string"), F.lit(".."), F.col("window_end_block").cast("string"))
        write_html(windows, f"{out_root}/focused_known_windows.html", "Around the known blocks", "Each known block with its neighbours, decoded as one text.", "id", where, texts, [place, F.col("block_size"), F.col("known_block")])
    finally:
        samples.unpersist()
        windows.unpersist()
    return samples, windows
