import pytest

from palimpsest.llm import queries
from tests.comparing import same
from tests.llm.test_cleaning import EDGES, FORMS, MENUS, PROSE, SENTENCE


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    same(queries.QUERIES[name](spark, folder), queries.ORACLES[name], folder)


def test_sql_of_unusual_urls(spark, tmp_path):
    urls = [u for u, _ in FORMS] + [None, "", "x", "://", "http://x.org\n/a/../B%2ejpg", "http://u@h:1/..%2f../%2E%2e/x", "http://x.org/.%2e", "http://x.org?/../a.jpg"]
    spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").write.parquet(str(tmp_path / "pages.parquet"))
    same(queries.QUERIES["op9_url_filter"](spark, str(tmp_path)), queries.ORACLES["op9_url_filter"], str(tmp_path))


def test_sql_of_lines_in_other_scripts(spark, tmp_path):
    groups = [x for x, _ in EDGES] + MENUS + PROSE
    texts = ["\n".join(x) for g in groups for x in (g, [SENTENCE, *g], [*g, SENTENCE], [SENTENCE, *g, SENTENCE + "."])]
    texts += ["un deux trois quatre cinq six sept huit neuf dix onze " + x for x in ("fermé", "слово»", "จบ", "文。", "है", "É", "٣")] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    same(queries.QUERIES["op6_quality_rules"](spark, str(tmp_path)), queries.ORACLES["op6_quality_rules"], str(tmp_path))
