"""Drafts as a stream: each new file of JSON lines is matched to a fixed dump and written as it comes. Matching keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.functions.fixed import DEFAULT_SOURCE
from palimpsest.plans.restore import PRONUNCIATION_DRAFT, match_pronunciations


def stream_pronunciations(
    spark: SparkSession, drafts: str, entries: DataFrame, out: str, checkpoint: str, source_id: str = DEFAULT_SOURCE, source_name: str = "old-text"
) -> StreamingQuery:
    """Starts a query that takes what is there, and ends: run it again for more, or give the writer another trigger.

    entries: a dump's index, as a table. Positional matching needs a draft's neighbours, so it isn't for streams.
    """
    lines = spark.readStream.text(drafts)
    parsed = lines.select(F.col("value").alias("_raw"), F.from_json("value", PRONUNCIATION_DRAFT, {"mode": "FAILFAST"}).alias("_row")).select("_raw", "_row.*")
    rows = match_pronunciations(parsed, entries, source_id, source_name)
    writer = rows.select(F.col("line").alias("value")).writeStream.format("text").outputMode("append")
    return writer.option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
