"""Scans that carry what the later steps need: the file, and each line's place in it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import fixed
from palimpsest.functions import text as t

TOKEN_MAP = "status string, scope string, warning string, derived_from string, tokens map<string,struct<value:string,kind:string,confidence:string,evidence:array<string>>>"


#: What ends a line of a dump's bytes, besides 0A: none of these is ever the second byte of a character.
_BYTE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e"


def read_dump(spark: SparkSession, path: str, ends: str = fixed.LINE_ENDS) -> DataFrame:
    """(file, ord, line, ended): the lines of CP932 files of any size; ended: whether a line end follows.

    Files are split at byte 0A, which is never part of a character, and decoded line by line in the tasks of the scan, whose own order gives a line's
    place in its split. Sums over the splits, one row each, make places in the file; no row is shuffled. Lines end at "\\n", "\\r" or both, and
    at `ends` ("": at these alone). What isn't CP932 becomes U+FFFD as Python's codec does it. A line end at a file's end begins no further line; an
    empty file has no lines. A stretch without byte 0A is one row of the scan, which may have 2 GB.
    """
    meta = F.col("_metadata")
    rows = spark.read.text(path, lineSep="\n").select(meta["file_path"].alias("file"), meta["file_block_start"].alias("at"), meta["file_size"].alias("size"), F.col("value").cast("binary").alias("raw"))
    inner = [c for c in _BYTE_ENDS if c == "\r" or re.match(f"[{ends}]", c)] if ends else ["\r"]
    kinds = "".join(f"\\x{ord(c):02X}" for c in inner)
    one_byte = F.regexp_replace(F.decode("raw", "ISO-8859-1"), "\r\\z", "")
    splits = rows.groupBy("file", "at").agg(
        F.sum(F.regexp_count(one_byte, F.lit(f"[{kinds}]")) + 1).alias("n"), F.sum(F.length("raw") + 1).alias("bytes"), F.max("size").alias("size"),
    )
    by_file = Window.partitionBy("file")
    along = by_file.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # A scan leaves out a byte order mark, which is three signs here (a file of it alone has no lines). One byte more than the file has: its last line has no end.
    more = F.sum("bytes").over(by_file) - F.col("size")
    starts = splits.select("file", "at", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"), F.sum("n").over(by_file).alias("total"), F.pmod(more, F.lit(3)).alias("open"), (more < 0).alias("cut_mark"))
    pattern = re.compile(f"[{''.join(inner)}]")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, k = None, 0
        for batch in batches:
            files, ats, raws = (c.to_pylist() for c in batch.columns)
            out = []
            for file, at, raw in zip(files, ats, raws, strict=True):
                if (file, at) != split:
                    split, k = (file, at), 0
                text = raw.decode("cp932", errors="replace")
                closed = text.endswith("\r")
                parts = pattern.split(text[:-1] if closed else text)
                out += [{"file": file, "at": at, "k": k + i, "line": x, "closed": i < len(parts) - 1 or closed, "inner": i > 0} for i, x in enumerate(parts)]
                k += len(parts)
            yield pa.RecordBatch.from_pylist(out, schema=_DECODED)

    lines = rows.select("file", "at", "raw").mapInArrow(decoded, "file string, at bigint, k bigint, line string, closed boolean, inner boolean")
    placed = lines.join(starts, ["file", "at"]).withColumn("ord", F.col("before") + F.col("k"))
    last = (F.col("ord") == F.col("total") - 1) & (F.col("open") == 1)
    line = F.when(F.col("cut_mark") & (F.col("ord") == 0), F.concat(F.lit(_MARK), "line")).otherwise(F.col("line"))
    # Of a file without 0A at its end, what follows another line end there is no line.
    return placed.where(~(last & F.col("inner") & ~F.col("closed") & (F.col("line") == ""))).select("file", "ord", line.alias("line"), (~last | F.col("closed")).alias("ended"))


_MARK = bytes.fromhex("EFBBBF").decode("cp932", errors="replace")
_DECODED = pa.schema([("file", pa.string()), ("at", pa.int64()), ("k", pa.int64()), ("line", pa.string()), ("closed", pa.bool_()), ("inner", pa.bool_())])


def lines_of(texts: DataFrame, ends: str = fixed.LINE_ENDS) -> DataFrame:
    """(file, ord, line, ended): the lines of texts that are values, (file, text), in their order, from 0; ends as in read_dump.

    A line end at the end of a text begins no further line. Null and empty texts have no lines.
    """
    whole = texts.where(F.length("text") > 0).select("file", t.one_end(F.col("text"), ends).alias("text"))
    closed = F.endswith("text", F.lit("\n"))
    cut = whole.select("file", closed.alias("closed"), F.split(F.when(closed, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text")), "\n", -1).alias("cut"))
    # An outer generator: for others Spark puts the whole expression, made of the text, into a filter of the scan as well.
    lines = cut.select("file", "closed", F.size("cut").alias("n"), F.posexplode_outer("cut").alias("ord", "line"))
    return lines.select("file", "ord", "line", (F.col("closed") | (F.col("ord") < F.col("n") - 1)).alias("ended"))


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, line) of UTF-8 text of any size. Files are split; places come from the splits' own order, by sums over blocks."""
    placed = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line")
    )
    within = placed.withColumn("_row", F.row_number().over(Window.partitionBy("file", "_at").orderBy("_id")))
    sizes = placed.groupBy("file", "_at").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return within.join(starts, ["file", "_at"]).select("file", (F.col("_before") + F.col("_row") - 1).alias("ord"), "line")


def read_drafts(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with their place: file, ord, _raw (the line) and the fields of the schema. A blank or malformed line is an error."""
    lines = read_text_lines(spark, path)
    checked = F.when(F.trim("line") == "", F.raise_error(F.concat(F.lit("blank line "), F.col("ord")))).otherwise(F.col("line"))
    parsed = lines.select("file", "ord", F.col("line").alias("_raw"), F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("_row"))
    return parsed.select("file", "ord", "_raw", "_row.*")


def read_token_rows(spark: SparkSession, path: str) -> DataFrame:
    """(token, value, kind, confidence, evidence) of a token map."""
    return spark.read.schema(TOKEN_MAP).json(path, multiLine=True).select(F.explode("tokens").alias("token", "_x")).select("token", "_x.*")


def read_token_map(spark: SparkSession, path: str) -> dict[str, str]:
    """Token values by token. A map is a literal of the plans that use it: some hundred tokens, and an error above 65,536."""
    rows = read_token_rows(spark, path).select("token", "value").limit(65_537).collect()
    if len(rows) > 65_536:
        raise ValueError("a token map has at most 65,536 tokens")
    return {r["token"]: r["value"] for r in rows}
