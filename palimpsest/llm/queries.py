"""The registered queries of this subpackage and the DuckDB SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import oracles
from palimpsest.llm.decontaminate import decontaminate
from palimpsest.llm.fill_middle import fill_middle, restored
from palimpsest.llm.language_model import score_texts
from palimpsest.llm.line_dedup import dedup_lines
from palimpsest.llm.nearest import nearest
from palimpsest.llm.ngram_join import jaccard_components
from palimpsest.llm.packing import pack
from palimpsest.llm.pii import find_pii
from palimpsest.llm.quality_model import score_quality
from palimpsest.llm.quality_rules import clean_lines
from palimpsest.llm.storage import shared_dir
from palimpsest.llm.timestamps import normalise_times
from palimpsest.llm.url_filter import filter_urls
from palimpsest.llm.warc import read_warc, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public tokenizer of the packing contract, from the package that every machine has."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_warc(_table(spark, sf_dir, "pages"), path)
    records = read_warc(spark, path, with_payload=False).where("gap is null")
    ids = [F.col(c).cast("long").alias(name) for c, name in (("record_id", "page_id"), ("refers_to", "refers_to"))]
    return records.select(ids[0], "payload_bytes", "payload_digest", "record_type", ids[1])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(_table(spark, sf_dir, "documents"), with_text=False).withColumnRenamed("id", "doc_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the host of their URL."""
    return dedup_lines(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), text_col="html", url_col="url")


def line_dedup_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, which have no URL, by their source."""
    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), with_text=False)
    return found.withColumnRenamed("id", "doc_id")


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle(_table(spark, sf_dir, "documents"))
    digests = [F.sha2(c.cast("binary"), 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return made.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_times(_table(spark, sf_dir, "stamps")).select(F.col("id").alias("stamp_id"), "utc_us", "rule", "ambiguous")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_salvage": op1_warc_salvage,
    "op2_pii": op2_pii,
    "op3_quality_model": op3_quality_model,
    "op4_pack": op4_pack,
    "op5_ngram_join": op5_ngram_join,
    "op6_quality_rules": op6_quality_rules,
    "op7_line_dedup": op7_line_dedup,
    "op8_language_model": op8_language_model,
    "op9_url_filter": op9_url_filter,
    "op10_decontaminate": op10_decontaminate,
    "op11_nearest": op11_nearest,
    "op12_fill_middle": op12_fill_middle,
    "op13_timestamps": op13_timestamps,
    "line_dedup_by_source": line_dedup_by_source,
}
ORACLES: dict[str, str] = {
    "op1_warc_salvage": oracles.WARC,
    "op5_ngram_join": oracles.NGRAM_JOIN,
    "op6_quality_rules": oracles.QUALITY_RULES,
    "op7_line_dedup": oracles.LINE_DEDUP_BY_HOST,
    "line_dedup_by_source": oracles.LINE_DEDUP,
    "op9_url_filter": oracles.URL_FILTER,
    "op10_decontaminate": oracles.DECONTAMINATE,
    "op12_fill_middle": oracles.FILL_MIDDLE,
    "op13_timestamps": oracles.TIMESTAMPS,
}
