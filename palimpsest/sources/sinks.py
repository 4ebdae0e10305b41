"""Sinks. Rows are sorted and written by many tasks, and the parts are then joined, in their order, to the one file that a reader of the export expects.

No row passes the driver: file systems that can concatenate files do that; on a local or shared one tasks copy the parts, each to its own range of
the new file, whose offsets are sums of the parts' sizes. The new file takes the old one's place when it is whole, in one step.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import escape_html


def _copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies files (part) to their ranges (at) of a file (target). A task that runs again writes the same bytes to the same place."""
    for batch in batches:
        for row in batch.to_pylist():
            with open(row["part"], "rb") as part, open(row["target"], "r+b") as target:
                target.seek(row["at"])
                while data := part.read(1 << 20):
                    target.write(data)
        yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})


def _joined(spark, fs, parts: list, target) -> None:
    """One file from parts, in their order."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    if fs.getUri().getScheme() == "file":
        plain = lambda path: path.toUri().getPath()
        rows, at = [], 0
        for status in parts:
            rows.append((plain(status.getPath()), plain(target), at))
            at += status.getLen()
        fs.getRaw().create(target, True).close()
        copies = spark.createDataFrame(rows, "part string, target string, at bigint").repartition(min(len(rows), 64))
        copies.mapInArrow(_copied, "n bigint").agg(F.sum("n")).collect()
        return
    paths = [status.getPath() for status in parts]
    fs.rename(paths[0], target)
    try:
        if paths[1:]:
            rest = gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(paths) - 1)
            for k, path in enumerate(paths[1:]):
                rest[k] = path
            fs.concat(target, rest)
    except Exception as e:
        if "UnsupportedOperationException" not in str(e):
            raise
        # Stores that neither concatenate nor write ranges: the parts pass the driver as streams of bytes.
        whole = jvm.org.apache.hadoop.fs.Path(f"{target}.whole")
        out = fs.create(whole, True)
        try:
            for path in [target, *paths[1:]]:
                part = fs.open(path)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                finally:
                    part.close()
        finally:
            out.close()
        fs.delete(target, False)
        fs.rename(whole, target)


def _file(rows: DataFrame, value: Column, path: str, order: list[Column] | None, head: str = "") -> None:
    """One text file of `head` and a line for each row, in place of what is there, which stays until the new one is whole."""
    spark = rows.sparkSession
    jvm = spark._jvm
    fs_path = jvm.org.apache.hadoop.fs.Path
    parts, target = f"{path}.{uuid.uuid4().hex}", fs_path(path)
    conf = spark._jsc.hadoopConfiguration()
    fs = target.getFileSystem(conf)
    folder, new = fs_path(parts), fs_path(f"{parts}.new")
    try:
        (rows.orderBy(*order) if order else rows).select(value.alias("value")).write.option("lineSep", "\n").text(parts)
        first = fs_path(folder, "head")
        out = fs.create(first, True)
        out.write(bytearray(head.encode()))
        out.close()
        found = sorted((s for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda s: s.getPath().getName())
        _joined(spark, fs, [fs.getFileStatus(first), *found], new)
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        whole = fs.makeQualified(target)
        if fs.getUri().getScheme() == "file":  # sums of the old file's bytes, which the new one doesn't have
            fs.getRaw().delete(fs.getChecksumFile(whole), False)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), conf).rename(fs.makeQualified(new), whole, options)
    finally:
        fs.delete(folder, True)
        fs.delete(new, False)


def write_jsonl(df: DataFrame, path: str, order: list[Column] | None = None, raw: str | None = None) -> None:
    """A JSON object a line, nulls kept; raw: the column that has the finished lines instead."""
    fields = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    _file(df, F.col(raw) if raw else fields, path, order)


def write_tsv(df: DataFrame, path: str, columns: list[str], order: list[Column]) -> None:
    """A header line and the rows in order."""
    _file(df, F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]), path, order, "\t".join(columns) + "\n")


def write_report(report: DataFrame, path: str) -> None:
    """A one-row table as an indented JSON document."""
    _file(report, F.to_json(F.struct(*report.columns), {"pretty": "true", "ignoreNullFields": "false"}), path, None)


_STYLE = """
:root { color-scheme: light dark; font: 1rem/1.5 sans-serif }
main { display: grid; gap: 2rem; max-width: 70rem; margin: 2rem auto; padding: 0 1rem }
section { border: thin solid currentColor; border-radius: .4rem; padding: 0 1rem 1rem }
pre { white-space: break-spaces; border-left: .2rem solid currentColor; padding-left: .8rem }
small { opacity: .7 }
"""


def write_html(df: DataFrame, path: str, title: str, note: str, heading: str, facts: Column, sections: list[tuple[str, str]], order: list[Column], limit: int | None = None) -> None:
    """A page with a section for each row: its heading, its facts and its texts, escaped."""
    head = f'<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>{_STYLE}</style></head>\n<body><main>\n<header><h1>{title}</h1>{note}</header>\n'
    parts = [F.lit("<section><h2>"), escape_html(F.col(heading)), F.lit("</h2><small>"), escape_html(facts), F.lit("</small>")]
    for name, column in sections:
        parts += [F.lit(f"<h3>{name}</h3><pre>"), escape_html(F.col(column)), F.lit("</pre>")]
    rows = df.orderBy(*order).limit(limit) if limit else df
    _file(rows, F.concat(*parts, F.lit("</section>")), path, order, head)
