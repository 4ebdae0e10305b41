"""From raw documents to packed training sequences: quality rules, line dedup, near-duplicates, decontamination, packing.

Each stage works on all rows its predecessor kept; run() writes each stage's rows as Parquet in the shared folder and reads them
again. All but the last return the columns of documents, others that it may have included, with n_chars (if it has it) of the text as it then is. Null ids and texts, empty texts
and repeated rows are treated as the operators state; the near-duplicate stage keeps rows, not ids.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BooleanType

from palimpsest.llm.decontaminate import decontaminate
from palimpsest.llm.keyfilter import key_filter
from palimpsest.llm.line_dedup import dedup_lines
from palimpsest.llm.ngram_join import jaccard_components
from palimpsest.llm.packing import pack
from palimpsest.llm.quality_rules import clean_lines
from palimpsest.llm.queries import tokenizer_path
from palimpsest.llm.storage import written


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars anew where the table has such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that lose too much, or fail the base limits, go."""
    return _measured(clean_lines(docs, keep_columns=True))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on too large a share of their source's documents go."""
    return _measured(dedup_lines(docs, site_col="source", with_counts=False))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one with the least id stays; of such rows the first by a hash of all columns.

    Rows of null or empty texts link with nothing and all stay. A null id comes after all others. Texts aren't shuffled but for the rows
    that go: a filter of the keys that go lets the others pass, and what it holds is joined with the keys. Rows travel as a
    struct, so their columns may have any names.
    """
    # Written, so that a row's key is the same in every reading.
    keyed = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("key")))
    order = F.struct(F.col("doc.doc_id").isNull().alias("no_id"), F.col("doc.doc_id").alias("id"), F.xxhash64("doc").alias("hash"), "key")
    found = jaccard_components(keyed.select(order.alias("order"), F.col("doc.text").alias("text")), id_col="order", components_only=True)
    goes = written(found.where("id <> component_id").select(F.col("id.key").alias("gone")))
    held = spark.sparkContext.broadcast(key_filter(goes))

    @arrow_udf(BooleanType())
    def may_go(key: pa.Array) -> pa.Array:
        return pa.array(held.value.has(np.asarray(key)))

    marked = keyed.withColumn("may_go", may_go("key"))
    checked = marked.where("may_go").join(goes, F.col("key") == F.col("gone"), "left_anti")
    return marked.where("not may_go").select("doc").union(checked.select("doc")).select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with too large a share of benchmark words go; from others the benchmark's spans are cut."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _measured(decontaminate(docs, benchmark, keep_columns=True))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences."""
    return pack(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Tokenizing and packing have no SQL; tests hold run() against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
