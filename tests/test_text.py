from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import blocks, fixed
from palimpsest.functions import text as t
from palimpsest.operators.choose import context, ratio, strided

TOKENS = {"hA121": "ə", "hA123": "æ", "hA126": "ɪ", "hA12E": "ʃ", "hA13E": "æ", "zA423": "<subentry>", "zA425": "<label>", "zA426": "</label>", "zA427": "<sense-group>", "zA42D": "<usage>", "zA42F": "<derived>", "zA44E": "゜", "zA42E": "⇔"}


def one(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} {'binary' if isinstance(v, bytes) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in enumerate(values)))
    return df.select(expr(*[F.col(c) for c in df.columns]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "given", "expected"),
    [
        (lambda c: t.map_tokens(c, TOKENS), "C[hA13E]sar [hA1ff] [zA423][hA121]", "Cæsar [hA1ff] <subentry>ə"),
        (lambda c: t.map_tokens(c, TOKENS), "[zA4[hA121]1]", "[zA4ə1]"),
        (lambda c: t.map_tokens(c, TOKENS), "", ""),
        (lambda c: t.map_tokens(c, {"hA121": "$1\\"}), "a[hA121]b", "a$1\\b"),
        (lambda c: t.map_tokens(c, {}), "a[hA121]", "a[hA121]"),
        (t.token_list, "[zA427][hA121][zA427] [hA12]", "hA121,zA427"),
        (t.clean_pronunciation, " neiʃn  aut juː ", "neɪʃən aʊt ju:"),
        (t.clean_pronunciation, "ʃna", "ʃna"),
        (t.clean_body, "a<subentry>b <label>名</label>\tc<usage>d<sense-group><derived>e", "a\n\nb 〔名〕 c〔語法〕d\n\n〔派生〕e"),
        (t.clean_body, "<label>x\ny</label>", "<label>x\ny</label>"),
        (t.clean_body, "ＡＢ\x0bc d", "AB\nc\nd"),
        (t.headword_key, " ＦＯＯ‐−bar　 Baz- ", "foo-bar baz"),
        (t.headword_key, "a�]b�^c", "a-b-c"),
        (t.text_key, "　ｱ　\n b\x1f", "ア b"),
        (t.fix_header, "[zA423] はん【[zA42E]】", "はん【頒】"),
        (t.fix_header, "[zA423][zA423]x", "[zA423]x"),
        (t.head_part, "あ・い【x】【y】", "あ・い"),
        (t.signature, " a(b) 。、,c― d ", "ab。、cd"),
        (t.signature, "   ", ""),
        (lambda c: t.orthography_line(c)["orthography"], "【x】 rest ", "【x】"),
        (lambda c: t.orthography_line(c)["rest"], "【x】 rest ", "rest"),
        (lambda c: t.orthography_line(c)["orthography"], "【x", None),
        (lambda c: t.header_parts(c)["headword"], "【頒布】", "頒布"),
        (lambda c: t.header_parts(c)["orthography"], "【頒布】", None),
        (lambda c: t.header_parts(c)["headword"], "はん【頒】布", "はん"),
        (lambda c: t.header_parts(c)["orthography"], "はん【頒】布", "頒"),
        (t.escape_html, "<a href='x'>&\"", "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;"),
        (t.script_score, "あ亜・Ａz【】�1", 3 + 3 + 3 + 1 + 1 + 4 - 10),
        (t.script_score, "", 0),
        (t.preview, "⟦1F0F⟧Ａ \t b⟦1f⟧", "A b⟦1f⟧"),
    ],
)
def test_text_functions(spark, f, given, expected):
    assert one(spark, f, given) == expected


def test_null_texts_stay_null(spark):
    df = spark.createDataFrame([(None,)], "c0 string")
    for f in (t.clean_pronunciation, t.clean_body, t.headword_key, t.text_key, t.fix_header, t.signature, t.preview, t.escape_html, lambda c: t.map_tokens(c, TOKENS)):
        assert df.select(f(F.col("c0")).alias("x")).first()["x"] is None


def test_bytes_and_numbers(spark):
    assert one(spark, t.hex_bytes, b"\x00\xabz") == "00 ab 7a"
    assert one(spark, t.hex_number, 15) == "000F"
    assert one(spark, t.hex_number, 0x12345) == "12345"
    assert one(spark, ratio, 1, 0) == 0.0
    assert one(spark, ratio, 2, 3) == 0.666667


def test_white_space_is_that_of_the_formats(spark):
    signs = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c,) for c in signs], "c string")
    wrapped = F.concat(F.lit("x"), "c", F.lit("y"))
    made = df.select("c", t.strip(F.col("c")).alias("stripped"), t.one_space(wrapped).alias("spaced"), t.one_end(wrapped).alias("ended"), t.one_end(wrapped, "").alias("bare"))
    for r in made.collect():
        blank = re.match(f"[{fixed.SPACE}]", r["c"]) is not None
        assert r["stripped"] == ("" if blank else r["c"]) and r["spaced"] == ("x y" if blank else f"x{r['c']}y"), hex(ord(r["c"]))
        assert r["ended"] == (re.sub(f"[\r{fixed.LINE_ENDS}]", "\n", f"x{r['c']}y")) and r["bare"] == re.sub("\r", "\n", f"x{r['c']}y"), hex(ord(r["c"]))
    assert one(spark, t.one_end, "a\r\r\n\nb\u2028\x1dc") == "a\n\n\nb\n\nc"


def test_strided_and_context(spark):
    assert one(spark, lambda n: strided(n, 400, [15, 12596]), 0) == []
    assert one(spark, lambda n: strided(n, 400, [15, 12596]), 3) == [0, 1, 2]
    got = one(spark, lambda n: strided(n, 400, [15, 12596]), 20_000)
    assert got == sorted({*range(0, 20_000, 50), 15, 12596})
    assert tuple(one(spark, lambda p, n: context(p, n, 2, 5), 1, 4)) == (0, 4)
    assert tuple(one(spark, lambda p, n: context(p, n, 2, 5), 15, 40)) == (13, 21)


UNIT = re.compile(rb"\x1f(?P<control>.)|(?P<filler>\x00)|(?P<end>[\n\r])|(?P<jis0208>[\x21-\x7e]{2})|(?P<ascii>[\x20-\x7e])|(?P<byte>.)", re.DOTALL)


def plain_decode(data):
    """(text, units) of a block, unit by unit."""
    shown, units = [], []
    for m in UNIT.finditer(data):
        kind, name = m.lastgroup, m[0].hex().upper()
        if kind in ("filler", "end"):
            shown.append("\n" * (kind == "end"))
            continue
        text = None
        if kind == "control":
            shown.append("\n" if m[0][1:] in b"\n\r" else f"⟦{name}⟧")
        elif kind == "byte":
            shown.append(" ")
        else:
            text = m[0].decode() if kind == "ascii" else bytes(x | 0x80 for x in m[0]).decode("euc_jp", errors="replace")[0]
            shown.append(text)
        units.append((kind, m.start(), name if kind == "control" else None, None if kind == "control" else name, text))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", "".join(shown))).strip(), units


def test_decode(spark):
    rng = random.Random(5)
    signs = [b"\x24\x22", b"\x1f", b"\x1f\x0a", b"\x1f\x41", b"\x00", b"A", b" ", b"\t", b"\x80", b"\x0d", b"\n", b"\n\n\n", b"\x29\x21", b"\x7e\x7e", b"\xff", b"ab", b"\x1f\x1f"]
    blocks_ = [b"\x24\x22\x1f\x0a\x1f\x41\x00A\x80\x0d\n\n\nB\x1f", b"\x29\x21", b"", None, b"\x1f", b"\x1f\x1f\x1f", b"ABC"]
    blocks_ += [b"".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(500)] + [rng.randbytes(600) for _ in range(20)]
    df = spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in enumerate(blocks_)], "i int, x binary").repartition(2)
    made = blocks.with_decoded(df, "x").withColumn("u", blocks.block_units(F.col("x"))).withColumn("c", blocks.control_counts(F.col("codes"), F.col("counts")))
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    got = made.orderBy("i").collect()
    for r, x in zip(got, blocks_, strict=True):
        if x is None:
            assert r.text is None and r.codes is None and r.n_units is None and r.u is None
            continue
        text, units = plain_decode(x)
        assert (r.text, r.n_units) == (text, len(units)), x
        assert [tuple(u) for u in r.u] == units, x
        counts = Counter(u[2] for u in units if u[0] == "control")
        assert list(zip(r.codes, r.counts, strict=True)) == list(counts.items()) and r.c == counts, x
    assert got[0].text == "あ\n⟦1F41⟧A \n\nB"


def test_edits_keep_what_they_do_not_name(spark):
    changes = t.edits(("set", "a.b", "x"), ("default_from", "h.first", "h.now"), ("set", "h.now", F.lit(None).cast("string")), ("append", "notes", F.lit("n")), ("set", "list", F.array(F.lit("q"))))
    df = spark.createDataFrame([('{"z":[1,{"k":null}],"h":{"now":"あ"},"notes":["m"]}',), (None,)], "raw string")
    got = [r[0] for r in df.select(t.edit_json("raw", changes)).collect()]
    assert got == ['{"z": [1, {"k": null}], "h": {"now": null, "first": "あ"}, "notes": ["m", "n"], "a": {"b": "x"}, "list": ["q"]}', None]
    assert df.select(t.edit_json("raw", F.lit(None).cast("string"))).first()[0].startswith('{"z":[1')
