"""Site-relative line frequency: lines that stand on too large a share of their site's pages are dropped.

All of it is DataFrame code. Each page sends a hash of each of its different lines once, counted by (site, line) with partial
sums before the shuffle, so a hot site or line costs one row for each task. What passes the ratio is short: the lines of a page
divided by the ratio bound how many lines a site can lose, whatever its number of pages. That list meets the pages by site:
a broadcast if Spark finds it small, else a sort-merge join whose hot sites AQE splits, as neither side needs its site in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.storage import written


def _line_hash(line: Column) -> Column:
    """By the line without spaces and tabs around it; null for lines without a word."""
    trimmed = F.btrim(line, F.lit(" \t\r\x0b\x0c"))
    return F.when(trimmed != "", F.xxhash64(trimmed))


def host_of(url: Column) -> Column:
    """What stands between the first "://" and the next "/", "?", "#" or the end, with A-Z in lower case; null without "://"."""
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.when(url.contains("://"), F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def dedup_lines(
    docs: DataFrame, text_col: str = "text", site_col: str = "source", url_col: str | None = None, max_percent: int = 5, with_counts: bool = True
) -> DataFrame:
    """The rows and columns of docs with the text cut, and, with_counts, n_lines and n_dropped (lines with a word; those dropped).

    A site is the host of url_col where that is given, else the value of site_col. A line goes if it stands on more than max_percent
    hundredths of its site's rows, and on two at least, as a line of one page repeats nothing; all its places
    go. Lines are compared without white space around them. Blank lines stay. Rows of a null site form a site; a null text has no
    lines, stays null, and counts as a page. Repeated rows are pages of their own. An empty table gives an empty result. Columns
    named n_lines or n_dropped in docs are replaced if with_counts.
    """
    columns = [c for c in docs.columns if not (with_counts and c in ("n_lines", "n_dropped"))]
    site = host_of(F.col(url_col)) if url_col else F.col(site_col)
    # The rows travel as one struct, so that their names can't clash with those used here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), site.alias("_site"), F.col(text_col).cast("string").alias("_text"))
    lines = F.transform(F.split(F.coalesce("_text", F.lit("")), "\n", -1), _line_hash)
    seen = rows.select("_site", F.explode(F.array_distinct(F.filter(lines, F.isnotnull))).alias("_line"))
    pages = rows.groupBy(F.col("_site").alias("_of")).agg(F.count(F.lit(1)).alias("_pages"))
    common = seen.groupBy("_site", "_line").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    common = common.join(pages, F.col("_site").eqNullSafe(F.col("_of"))).where(F.col("_n") * 100 > F.col("_pages") * max_percent)
    # Written first, so that its size is known when the join is planned and texts aren't shuffled for nothing.
    lists = written(common.groupBy(F.col("_site").alias("_where")).agg(F.collect_list("_line").alias("_drop")))
    joined = rows.join(lists, F.col("_site").eqNullSafe(F.col("_where")), "left")

    split = F.split("_text", "\n", -1)
    # What a page shares with its site's list is found by hash once; the lines are then held against that short array.
    mine = F.array_intersect(F.transform(split, _line_hash), F.col("_drop"))
    listed = joined.withColumn("_mine", F.when(F.col("_drop").isNotNull(), mine))
    cut = listed.withColumn("_stays", F.when(F.size("_mine") > 0, F.filter(split, lambda x: ~F.coalesce(F.array_contains("_mine", _line_hash(x)), F.lit(False)))))
    text = F.when(F.col("_stays").isNull(), F.col("_text")).otherwise(F.array_join("_stays", "\n"))
    out = [(text if c == text_col else F.col("_row")[c]).alias(c) for c in columns]
    if with_counts:
        n_of = lambda parts: F.coalesce(F.size(F.filter(parts, lambda x: _line_hash(x).isNotNull())).cast("long"), F.lit(0).cast("long"))
        n_lines = F.when(F.col("_text").isNull(), F.lit(0).cast("long")).otherwise(n_of(split))
        n_kept = F.when(F.col("_stays").isNull(), n_lines).otherwise(n_of(F.col("_stays")))
        out += [n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped")]
    return cut.select(*out)
