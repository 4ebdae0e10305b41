"""Command line: python -m palimpsest blocks|pronunciations|headlines --source-root ... --out-root ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from palimpsest.functions.fixed import DEFAULT_SOURCE
from palimpsest.plans.extract import export_blocks
from palimpsest.plans.restore import export_headlines, export_pronunciations


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="palimpsest")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("blocks", "pronunciations", "headlines"):
        sub = commands.add_parser(name)
        sub.add_argument("--source-root", required=True)
        sub.add_argument("--out-root", required=True)
        if name != "blocks":
            sub.add_argument("--map-path")
            sub.add_argument("--old-text-path")
            sub.add_argument("--profile-path")
        if name == "pronunciations":
            sub.add_argument("--raw-path")
            sub.add_argument("--source-id", default=DEFAULT_SOURCE)
        if name == "headlines":
            sub.add_argument("--draft-path")
            sub.add_argument("--rules-path")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("palimpsest").getOrCreate()
    if given.command == "blocks":
        samples, windows = export_blocks(spark, given.source_root, given.out_root)
        print(f"wrote {samples.count()} samples and {windows.count()} windows to {given.out_root}")
    elif given.command == "pronunciations":
        got = export_pronunciations(spark, given.source_root, given.out_root, given.raw_path, given.map_path, given.old_text_path, given.source_id, given.profile_path)
        _say(got.report)
    else:
        _say(export_headlines(spark, given.source_root, given.out_root, given.draft_path, given.map_path, given.old_text_path, given.rules_path, given.profile_path).report)


def _say(report) -> None:
    row = report.select("merge_counts", "coverage").first()
    print(" ".join(f"{k}={v}" for k, v in row["merge_counts"].items()), " ".join(f"{k}={v:.2%}" for k, v in row["coverage"].asDict().items()))


if __name__ == "__main__":
    main()
