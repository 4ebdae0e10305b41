"""The previews' query has the rows of its SQL for empty, null, short and long texts."""

from __future__ import annotations

from palimpsest.plans import catalogue, formats  # noqa: F401
from tests.comparing import same

TEXTS = ["", None, "x", "é", " ", "\n \n", "y" * 127, "z" * 128, "a" * 127 + "é", "the the the  the\tend \t\n"]


def test_texts_without_bytes_are_shown_as_in_sql(spark, tmp_path):
    spark.createDataFrame([*enumerate(TEXTS), (70_000, "")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES["b_hex_preview"](spark, str(tmp_path))
    assert [r["bytes"] for r in got.where("doc_id in (0, 70000)").collect()] == [".", "."]
    same(got, catalogue.ORACLES["b_hex_preview"], str(tmp_path))
