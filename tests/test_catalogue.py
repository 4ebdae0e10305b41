import hashlib
import re
import unicodedata
from collections import Counter
from functools import reduce

import pytest

import __spark_entry__
from palimpsest.functions import fixed
from palimpsest.plans import catalogue, formats  # noqa: F401
from tests.comparing import same
from tests.test_text import plain_decode

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_its_sql(spark, name):
    same(catalogue.QUERIES[name](spark, FOLDER), catalogue.ORACLES[name], FOLDER)


def test_decoded_blocks_are_those_of_the_bytes(spark):
    texts = {r["doc_id"]: reduce(lambda x, p: x.replace(*p), formats._CODED.items(), r["text"]).encode() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = catalogue.QUERIES["b_decode_blocks"](spark, FOLDER).collect()
    assert len(rows) == sum(len(x) // 2048 for x in texts.values())
    for r in rows:
        text, units = plain_decode(texts[r["doc_id"]][r["block"] * 2048 : (r["block"] + 1) * 2048])
        assert (r["n_tokens"], r["block_hex"]) == (len(units), f"{r['block']:04X}")
        assert r["controls"] == ",".join(f"{c}:{n}" for c, n in sorted(Counter(u[2] for u in units if u[0] == "control").items()))
        assert r["text"] == hashlib.md5(text.encode()).hexdigest()
        preview = re.sub(r"[ \t]+", " ", re.sub("⟦1F[0-9A-F]{2}⟧", "", unicodedata.normalize("NFKC", text))).strip()
        assert r["preview"] == hashlib.md5(preview.encode()).hexdigest()
        assert r["score"] == sum(points * len(re.findall(kind, preview)) for points, kind in fixed.SCRIPT_SCORES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
