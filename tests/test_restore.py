"""Both restorations on small files, end to end: the values are worked out by hand from the formats' rules."""

from __future__ import annotations

import json
import random
import re
from glob import glob

import pytest
from pyspark.sql import functions as F

from palimpsest.__main__ import main
from palimpsest.functions import fixed
from palimpsest.operators.segment import bracket_entries, headline_entries
from palimpsest.plans.extract import block_samples, cut_samples, cut_windows, export_blocks, known_windows
from palimpsest.plans.restore import HEADLINE_DRAFT, export_headlines, export_pronunciations, restore_headlines
from palimpsest.sources.block_ranges import BlockReader, read_ranges
from palimpsest.sources.readers import lines_of, read_drafts, read_dump, read_text_lines
from palimpsest.sources.sinks import write_tsv
from palimpsest.streaming.enrich import stream_pronunciations

MAP = {"hA121": "ə", "hA126": "ɪ", "hA13E": "æ", "zA423": "<subentry>", "zA42E": "⇔"}
SPOKEN = """junk before
able［[hA121]bl］
body a [zA423]more
 second  line

Bay-leaf［bei [hA126]］
bay body [hA1FF]
n[hA13E]x［[hA121]］
swallowed
plain［abc］
dropped body
dup［[hA121]］
d1
dup［[hA121] ］
d2
two［[hA121]］
t1
two［[hA126]］
t2
foo［x］bar［y[hA126]］\r
foobar
last［[hA121]］"""
MINE = {"source_id": "crcen_START_2048", "page": 3}
DRAFTS = [
    {"id": "1", "headword": "able", "source": MINE, "location": {"block_guess": 1, "byte_offset_guess": 2}, "body": {"normalized": "n1"}, "notes": ["x"], "extra": {"k": [1, None]}},
    {"id": "2", "headword": "able", "source": {"source_id": "other"}, "location": {}, "body": {"normalized": "n2"}},
    {"id": "3", "headword": "BAY‐LEAF", "source": MINE, "location": {"block_guess": 1, "byte_offset_guess": 2}, "body": {"normalized": "n3"}, "orthography": None},
    {"id": "4", "headword": "zzz", "orthography": "Dup ", "source": MINE, "location": {"block_guess": 1, "byte_offset_guess": 2}, "body": {"normalized": "n4"}},
    {"id": "5", "headword": "two", "source": MINE, "location": {}, "body": {"normalized": "n5"}},
]


def lines(path):
    """Lines of an export, which is one file, or of a stream's folder."""
    out = []
    for part in sorted(glob(f"{path}/part-*")) or [path]:
        with open(part, encoding="utf-8", newline="") as f:
            out += f.read().split("\n")[:-1]
    return out


def rows(path):
    return [json.loads(x) for x in lines(path)]


@pytest.fixture
def files(tmp_path):
    (tmp_path / "omiyage_02.txt").write_bytes(SPOKEN.encode("cp932", errors="replace"))
    (tmp_path / "entries_raw.jsonl").write_text("".join(json.dumps(d, ensure_ascii=False) + "\n" for d in DRAFTS), encoding="utf-8")
    tokens = {k: {"value": v, "kind": "k", "confidence": "high", "evidence": ["e"]} for k, v in MAP.items()}
    (tmp_path / "symbol_map_solved_initial.json").write_text(json.dumps({"status": "s", "scope": "x", "tokens": tokens}, indent=1, ensure_ascii=False), encoding="utf-8")
    return tmp_path


def test_pronunciations(spark, files):
    root = f"file://{files}"
    export_pronunciations(spark, root, root)
    index = rows(files / "old_text_pron_index.jsonl")
    assert [(r["headword"], r["pronunciation_raw"], r["pronunciation_normalized"], r["body_raw"]) for r in index] == [
        ("able", "[hA121]bl", "əbl", "body a [zA423]more\n second  line"),
        ("Bay-leaf", "bei [hA126]", "beɪ ɪ", "bay body [hA1FF]\nn[hA13E]x［[hA121]］\nswallowed"),
        ("dup", "[hA121]", "ə", "d1"),
        ("dup", "[hA121]", "ə", "d2"),
        ("two", "[hA121]", "ə", "t1"),
        ("two", "[hA126]", "ɪ", "t2"),
        ("foo［x］bar", "y[hA126]", "yɪ", "foobar"),
    ]
    assert index[0]["body_readable"] == "body a\n\nmore\nsecond line"
    assert (index[1]["body_unresolved_count"], index[1]["body_unresolved_tokens"]) == ("1", "hA1FF")

    out = rows(files / "entries_pron_enriched.jsonl")
    assert [r["id"] for r in out] == ["1", "2", "3", "4", "5"]
    assert out[1] == DRAFTS[1] and out[4] == DRAFTS[4]
    assert lines(files / "entries_pron_enriched.jsonl")[1] == json.dumps(DRAFTS[1], ensure_ascii=False)
    first = out[0]
    assert list(first) == ["id", "headword", "source", "location", "body", "notes", "extra", "pronunciation", "status"]
    assert first["extra"] == {"k": [1, None]} and first["status"] == {"pronunciation": "verified"}
    assert first["pronunciation"] == {"raw": "[hA121]bl", "normalized": "əbl", "confidence": "verified", "source": "omiyage_02.txt", "match_method": "headword_exact"}
    assert first["notes"] == ["x", "pronunciation_restored_from_old_text:headword_exact", "body_restored_from_old_text:headword_exact"]
    assert first["body"]["restored_old_text_readable"] == "body a\n\nmore\nsecond line"
    methods = [r.get("pronunciation", {}).get("match_method") for r in out]
    assert methods == ["headword_exact", None, "headword_normalized", "orthography_normalized", None]
    assert out[3]["body"]["restored_old_text_raw"] == "d1"

    verified = rows(files / "entries_pron_verified_index.jsonl")
    assert [r["id"] for r in verified] == ["1", "3", "4"] and verified[1]["body_unresolved_count"] == 1 and verified[1]["orthography"] is None
    assert [r["pronunciation"] for r in rows(files / "entries_pron_enriched_sample.jsonl")] == ["əbl", "beɪ ɪ", "ə"]
    report = json.loads("\n".join(lines(files / "entries_pron_enriched_report.json")))
    assert report["lookup"] == {"old_rows": 7, "exact_keys": 5, "normalized_keys": 5, "exact_lookup_keys": 4, "normalized_lookup_keys": 4, "ambiguous_exact_keys": 1, "ambiguous_normalized_keys": 1}
    assert report["merge_counts"] == {
        "total_entries": 5, "filtered_entries": 4, "verified_matches": 3, "headword_exact": 1, "headword_normalized": 1, "orthography_normalized": 1,
        "restored_body_total": 3, "restored_body_unresolved_tokens": 1, "unmatched_filtered": 1,
    }
    assert report["coverage"] == {"verified_ratio": 0.75} and report["restored_body"]["top_unresolved_tokens"] == {"hA1FF": 1}


def test_drafts_as_a_stream(spark, files):
    root = f"file://{files}"
    entries = bracket_entries(read_dump(spark, f"{root}/omiyage_02.txt", ends=""), MAP)
    (files / "in").mkdir()
    (files / "entries_raw.jsonl").rename(files / "in" / "a.jsonl")
    for expected in (5, 6):
        query = stream_pronunciations(spark, f"{root}/in", entries, f"{root}/out", f"{root}/check")
        query.awaitTermination(120)
        got = rows(files / "out")
        assert len(got) == expected
        (files / "in" / "b.jsonl").write_text(json.dumps(DRAFTS[0]) + "\n", encoding="utf-8")
    assert sorted(str(r.get("pronunciation", {}).get("match_method")) for r in got) == ["None", "None", "headword_exact", "headword_exact", "headword_normalized", "orthography_normalized"]


HEADLINES = """[ID=1]
あい【愛】
〈名〉one [hA1FF]

↓いえ
【家】すまい
〈名〉two
【絵】えの本文
〈名〉three
うみ
〈名〉sea
plain end
[ID=2]
と・る【捕る】
〈動〉take
かお【顔】
〈名〉face
くち【口】
〈名〉mouth
けむり【煙】
〈名〉smoke [zA42E]
はん【[zA42E]】
〈名〉last
"""


def draft(i, header, body="", **more):
    return {"id": i, "headword": "h", "orthography": None, "header": {"normalized": header, "k": 1}, "canonical": {"body": body}, **more}


def test_headlines(spark, files):
    (files / "test_dic.txt").write_bytes(HEADLINES.encode("cp932", errors="replace"))
    drafts = [
        draft("exact", "あい【愛】"),
        draft("part", "うみ【海】"),
        draft("signature", "zz", "〈名〉three えの本文"),
        draft("before", "かお【顔】"),
        draft("place", "xx", "nothing"),
        draft("after", "けむり【煙】"),
        draft("clue", "yy", "つかまえる。「とんぼを―」 皮算用"),
        draft("split", "ひとたまりも―ない わずかの間も、もちこたえられない。"),
        draft("alone", "ひらべった・い"),
        draft("none", "ww", "none"),
    ]
    (files / "entries_master_kokugo_draft.jsonl").write_text("".join(json.dumps(d, ensure_ascii=False) + "\n" for d in drafts), encoding="utf-8")
    root = f"file://{files}"
    export_headlines(spark, root, root)
    index = rows(files / "kokugo_old_text_index.jsonl")
    assert [(r["headword_line"], r["body_raw"]) for r in index] == [
        ("あい【愛】", "〈名〉one [hA1FF]"),
        ("↓いえ【家】", "すまい\n〈名〉two"),
        ("【絵】", "えの本文\n〈名〉three"),
        ("うみ", "〈名〉sea"),
        ("plain end", "[ID=2]"),
        ("と・る【捕る】", "〈動〉take"),
        ("かお【顔】", "〈名〉face"),
        ("くち【口】", "〈名〉mouth"),
        ("けむり【煙】", "〈名〉smoke [zA42E]"),
        ("はん【頒】", "〈名〉last"),
    ]
    assert index[8]["body_mapped"] == "〈名〉smoke ⇔" and index[0]["body_signature"] == "名onehA1FF"
    out = rows(files / "entries_master_kokugo_restored.jsonl")
    methods = {r["id"]: r["canonical"].get("body_match_method") for r in out}
    assert methods == {
        "exact": "header_normalized_exact", "part": "head_part_unique", "signature": None, "clue": "body_clue_known", "before": "header_normalized_exact",
        "place": "positional_window_unique", "after": "header_normalized_exact", "split": "inline_source_line_split", "alone": "head_only_source_line", "none": None,
    }
    by = {r["id"]: r for r in out}
    assert by["none"] == drafts[-1]
    assert by["place"]["headword"] == "くち" and by["place"]["orthography"] == "口" and by["place"]["canonical"]["body_source"] == "old-text"
    assert by["place"]["header"] == {"normalized": "くち【口】", "k": 1, "extracted_normalized": "xx", "restored_test_dic_mapped": "くち【口】", "restored_test_dic_normalized": "くち【口】"}
    assert by["exact"]["canonical"]["review_ready"] is False and by["exact"]["canonical"]["body_unresolved_tokens"] == ["hA1FF"]
    assert by["alone"]["master_status"] == {"body_restored_from_old_text": True, "ready_for_review": False}
    assert by["split"]["canonical"]["body"] == "わずかの間も、もちこたえられない。" and by["split"]["notes"] == ["body_restored_from_old_text:inline_source_line_split"]
    restored = rows(files / "entries_master_kokugo_restored_index.jsonl")
    assert [r["review_ready"] for r in restored] == [False, True, None, True, True, True, True, True, False, None]
    report = json.loads("\n".join(lines(files / "entries_master_kokugo_restored_report.json")))
    assert report["old_rows"] == 10 and report["coverage"] == {"restored_ratio": 0.8}
    assert report["merge_counts"] == {
        "total_entries": 10, "restored_matches": 8, "unmatched_entries": 2, "restored_unresolved_tokens": 1, "match_method:header_normalized_exact": 3,
        "match_method:head_part_unique": 1, "match_method:body_clue_known": 1, "match_method:positional_window_unique": 1,
        "match_method:inline_source_line_split": 1, "match_method:head_only_source_line": 1,
    }


def test_signatures_and_flags(spark, files):
    """A lone entry's body finds a draft; an entry that begins with a bracket doesn't; a flagged draft counts as it is."""
    (files / "d.txt").write_bytes("あ\n〈名〉same body\nい\n〈名〉other, body\n【う】\n〈名〉third\n".encode("cp932"))
    drafts = [draft("a", "q1", "〈名〉 same、body".replace("、", ",")), draft("b", "q2", "third"), draft("c", "q3", "", master_status={"body_restored_from_old_text": True})]
    (files / "d.jsonl").write_text("".join(json.dumps(d) + "\n" for d in drafts), encoding="utf-8")
    root = f"file://{files}"
    got = restore_headlines(read_drafts(spark, f"{root}/d.jsonl", HEADLINE_DRAFT), read_dump(spark, f"{root}/d.txt"), MAP)
    found = {r["id"]: (r["method"], r["restored"]) for r in got.rows.collect()}
    assert found == {"a": ("body_signature_unique", True), "b": (None, False), "c": (None, True)}
    assert got.report.first()["merge_counts"]["match_method:unknown"] == 1


def test_readers(spark, files):
    text = "".join(f"line {i}\n" for i in range(50_000))
    (files / "big.txt").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = read_text_lines(spark, f"file://{files}/big.txt")
        assert spark.read.text(f"file://{files}/big.txt").rdd.getNumPartitions() > 1
        assert {r["ord"]: r["line"] for r in got.collect()} == {i: f"line {i}" for i in range(50_000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (files / "cp.txt").write_bytes("あ".encode("cp932") + b"\r\nb\r\x81\xffc\n")
    dump = read_dump(spark, f"file://{files}/cp.txt")
    assert [r["line"] for r in dump.orderBy("ord").collect()] == ["あ", "b", b"\x81\xffc".decode("cp932", errors="replace")]
    (files / "blank.jsonl").write_text('{"id":"1"}\n\n{"id":"2"}\n')
    with pytest.raises(Exception, match="blank line"):
        read_drafts(spark, f"file://{files}/blank.jsonl", "id string").collect()


def test_dumps_are_read_alike_at_every_cut(spark, tmp_path):
    """Lines of files of all kinds of ends and damage, in splits of a few bytes, beside those of the whole file's text."""
    rng, bits = random.Random(5), [b"a", b"\x82\xa0", b"\r", b"\n", b"\r\n", b"\x81", b"\xff", b"\x0b", b"\x1c", b"\xf0", b"\xb1", b"\x80", b" ", b"\xef\xbb\xbf"]
    contents = [b"", b"\n", b"a", b"a\r", b"a\r\n", b"a\x0b", b"a\x0b\n", b"\x81\n\x40", b"\r\r\n\n", b"\x1c", b"\xef\xbb\xbfa\nb", b"x\n\x81"]
    contents += [b"".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(40)]
    for k, data in enumerate(contents):
        (tmp_path / f"{k:03}.txt").write_bytes(data)
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for cut in ("7", "128m"):
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            for ends, more in ((fixed.LINE_ENDS, "\x0b\x0c\x1c\x1d\x1e"), ("", "")):
                got = {}
                for r in read_dump(spark, f"file://{tmp_path}", ends).orderBy("file", "ord").collect():
                    lines = got.setdefault(int(r["file"][-7:-4]), [])
                    assert r["ord"] == len(lines)
                    lines.append((r["line"], r["ended"]))
                for k, data in enumerate(contents):
                    text = re.sub("\r\n?", "\n", data.decode("cp932", errors="replace"))
                    parts = re.split(f"[\n{more}]", text) if text else []
                    want = [(x, i < len(parts) - 1) for i, x in enumerate(parts)]
                    assert got.get(k, []) == (want[:-1] if want and want[-1][0] == "" else want), (cut, data)
        finally:
            for c, v in before.items():
                spark.conf.set(c, v)


@pytest.mark.parametrize("block", [1, 3, 5, 65_536])
def test_entries_are_the_same_in_blocks_of_any_size(spark, block):
    texts = spark.createDataFrame([("a", SPOKEN), ("b", "\n\n" + SPOKEN), ("c", None), ("d", "")], "file string, text string")
    whole = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    lines = lines_of(texts, ends="")
    assert whole(bracket_entries(lines, MAP, block)) == whole(bracket_entries(lines, MAP, 1000))
    gaps = HEADLINES.replace("\n", "\n\n\n\n")
    dumps = spark.createDataFrame([("a", HEADLINES), ("b", gaps), ("c", "↓x\n\n\n\n【y】z\n〈n〉\n↑q\n\n\n【r】\n\n"), ("d", "[ID=1]\n【x】\ny")], "file string, text string")
    small, large = (whole(headline_entries(lines_of(dumps), MAP, n)) for n in (block, 1000))
    assert small == large and len(small) > 20
    plan = headline_entries(lines_of(dumps), MAP, block)._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"windowspecdefinition\((.*?)\)", plan)
    assert windows and all("_block" in w for w in windows)


def test_blocks(spark, files):
    page = ("\x24\x22" * 40).encode() + b"\x1f\x41" + b"\x1f\x0a" + b"\x00" * 10
    for name, size in (("START", 512 * 30 + 100), ("KOKUGO/START", 700), ("CRCEN/START", 0)):
        (files / name).parent.mkdir(exist_ok=True)
        (files / name).write_bytes((page * 400)[:size])
    root = f"file://{files}"
    export_blocks(spark, root, root)
    samples = rows(files / "raw_block_samples.jsonl")
    assert {(r["source_id"], r["block_size"]) for r in samples} == {("root_START", 512), ("root_START", 1024), ("root_START", 2048), ("kokugo_START", 512)}
    assert [r["rank"] for r in samples if r["block_size"] == 512 and r["source_id"] == "root_START"] == list(range(1, 31))
    first = next(r for r in samples if r["block_size"] == 512 and r["block"] == 0)
    assert first["raw_hex_first_128"].startswith("24 22 24") and first["block_hex"] == "0000" and first["control_codes"]["1F41"] == first["control_codes"]["1F0A"]
    windows = rows(files / "focused_known_windows.jsonl")
    assert [(w["id"], w["window_start_block"], w["window_end_block"], w["offset"]) for w in windows] == [("root_START:512:15:window", 13, 20, 13 * 512)]
    assert not [p for p in files.iterdir() if p.name.count(".") > 1 and not p.name.startswith(".")]  # parts are gone
    export_blocks(spark, root, root)  # again, over what is there
    assert rows(files / "raw_block_samples.jsonl") == samples
    table = [x.split("\t") for x in lines(files / "control_codes.tsv")]
    assert table[0] == ["code", "count"] and {c for c, _ in table[1:]} == {"1F41", "1F0A"}
    html = "\n".join(lines(files / "preview.html"))
    assert html.startswith("<!doctype html>") and html.count("<section>") == len(samples)


def test_a_failed_export_leaves_the_old_file(spark, tmp_path):
    path = f"file://{tmp_path}/out.tsv"
    rows = spark.range(1000).repartition(7)
    write_tsv(rows, path, ["id"], [F.col("id")])
    before = (tmp_path / "out.tsv").read_bytes()
    assert before == b"id\n" + b"".join(b"%d\n" % i for i in range(1000))
    bad = rows.withColumn("id", F.when(F.col("id") == 900, F.raise_error(F.lit("broken"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken"):
        write_tsv(bad, path, ["id"], [F.col("id")])
    assert (tmp_path / "out.tsv").read_bytes() == before and [p.name for p in tmp_path.iterdir()] == ["out.tsv"]
    write_tsv(rows.where("id < 3"), path, ["id"], [F.desc("id")])
    assert (tmp_path / "out.tsv").read_bytes() == b"id\n2\n1\n0\n" and spark.read.text(path).count() == 4
    write_tsv(rows.where("false"), path, ["id"], [F.desc("id")])
    assert (tmp_path / "out.tsv").read_bytes() == b"id\n"


def test_only_sampled_blocks_of_a_large_file_are_read(spark, tmp_path):
    """A sparse file of 3 GB, and the same rows from a small file read in ranges and as one value."""
    size, n = 2048, 3 * (1 << 30) // 2048
    step, known = n // 400, [5, n - 1, n + 7]
    with open(tmp_path / "large", "wb") as f:
        for b in (step, 5, n - 1):
            f.seek(b * size)
            f.write(b"\x24\x22" * (size // 2))
        f.truncate(n * size + 100)
    reader = BlockReader({"files": json.dumps([["a", f"file://{tmp_path}/large"]]), "sizes": f"[{size}]", "known": json.dumps(known), "samples": "400"})
    parts = reader.partitions()
    chunks = [x for p in parts for batch in reader.read(p) for x in batch.to_pylist()]
    assert sum(len(x["chunk"]) for x in chunks) == len(chunks) * size
    assert [x["block"] for x in chunks] == sorted({*range(0, n, step), 5, n - 1})
    assert [x["block"] for x in chunks if any(x["chunk"])] == [5, step, n - 1]
    read = read_ranges(spark, [("a", f"file://{tmp_path}/large")], [size], known, samples=400)
    got = block_samples(read, known).orderBy("rank").select("block", "score").collect()
    assert [tuple(r) for r in got] == [(5, 3072), (step, 3072), (n - 1, 3072)]
    around = known_windows(read_ranges(spark, [("a", f"file://{tmp_path}/large")], [size], known, window=(2, 5)))
    assert [tuple(r) for r in around.select("window_start_block", "window_end_block").orderBy("offset").collect()] == [(3, 10), (n - 3, n - 1)]

    data = random.Random(1).randbytes(300_000)
    (tmp_path / "small").write_bytes(data)
    files = spark.createDataFrame([("s", f"file://{tmp_path}/small", bytearray(data))], "source_id string, source string, content binary")
    ranged = [("s", f"file://{tmp_path}/small")]
    for cut, one in ((cut_samples(files, [512, 700], [2, 9]), read_ranges(spark, ranged, [512, 700], [2, 9], samples=400)), (cut_windows(files, [512], [0, 9]), read_ranges(spark, ranged, [512], [0, 9], window=(2, 5)))):
        assert sorted(cut.collect(), key=repr) == sorted(one.collect(), key=repr)
    with pytest.raises(Exception, match="large2"):
        read_ranges(spark, [("a", f"file://{tmp_path}/large2")], [512], [], samples=4).collect()


def test_best_blocks_keep_known_ones(spark):
    content = b"".join((b"\x24\x22" * 256 if i != 3 else b"\x00" * 512) for i in range(60))
    files = spark.createDataFrame([("s", "p", bytearray(content))], "source_id string, source string, content binary")
    got = block_samples(cut_samples(files, [512], [3, 59, 900]), [3, 59, 900], kept=40).orderBy("rank").collect()
    assert [r["block"] for r in got] == [b for b in range(41) if b != 3] + [59, 3]
    assert [r["rank"] for r in got] == list(range(1, 43))
    assert known_windows(cut_windows(files, [512], [59, 900])).select("window_start_block", "window_end_block").collect() == [(57, 59)]


def test_rules_as_data(spark, files):
    (files / "d.txt").write_bytes("あ\n〈名〉one\nい\n〈名〉two\nう\n〈名〉three\n".encode("cp932"))
    drafts = [draft("a", "q1", "has alpha and beta"), draft("b", "made"), draft("c", "q3", "alpha only")]
    (files / "entries_master_kokugo_draft.jsonl").write_text("".join(json.dumps(d) + "\n" for d in drafts), encoding="utf-8")
    rules = {"clues": [{"all": ["alpha", "beta"], "header": "い", "method": "by_clue"}], "headers": [{"header": "made", "line": "え【絵】", "body": "text", "method": "by_header"}]}
    (files / "rules.json").write_text(json.dumps(rules, indent=1), encoding="utf-8")
    root = f"file://{files}"
    main(["headlines", "--source-root", root, "--out-root", root, "--old-text-path", f"{root}/d.txt", "--rules-path", f"{root}/rules.json"])
    got = {r["id"]: r["canonical"] for r in rows(files / "entries_master_kokugo_restored.jsonl")}
    assert (got["a"]["body_match_method"], got["a"]["body"]) == ("by_clue", "〈名〉two")
    assert (got["b"]["body_match_method"], got["b"]["body"], got["b"]["orthography"]) == ("by_header", "text", "絵")
    assert "body_match_method" not in got["c"]
    # Again over its own output: what was restored counts as found and keeps its first header.
    (files / "entries_master_kokugo_restored.jsonl").rename(files / "again.jsonl")
    main(["headlines", "--source-root", root, "--out-root", root, "--draft-path", f"{root}/again.jsonl", "--old-text-path", f"{root}/d.txt", "--rules-path", f"{root}/rules.json"])
    second = rows(files / "entries_master_kokugo_restored.jsonl")
    assert [r["header"].get("extracted_normalized") for r in second] == ["q1", "made", None]
    assert json.loads((files / "entries_master_kokugo_restored_report.json").read_text())["coverage"] == {"restored_ratio": 0.666667}


def test_commands_write_their_files(spark, files, capsys):
    root = f"file://{files}"
    main(["pronunciations", "--source-root", root, "--out-root", root, "--source-id", "other"])
    assert json.loads((files / "entries_pron_enriched_report.json").read_text())["merge_counts"]["filtered_entries"] == 1
    for name in ("START", "KOKUGO/START", "CRCEN/START"):
        (files / name).parent.mkdir(exist_ok=True)
        (files / name).write_bytes(b"\x24\x22" * 600)
    main(["blocks", "--source-root", root, "--out-root", f"{root}/out"])
    assert {p.name for p in (files / "out").iterdir() if not p.name.startswith(".")} == {"raw_block_samples.jsonl", "focused_known_windows.jsonl", "control_codes.tsv", "preview.html", "focused_known_windows.html"}
    assert "wrote 9 samples" in capsys.readouterr().out


def test_a_second_dictionary_by_its_profile(spark, files):
    """Other tokens, marks, rewrites and rules, without a change of code."""
    profile = {
        "token": "<([a-z]+[0-9]+)>", "pronunciation": [["x+", "ks"]], "body_markup": {"##": "; "}, "body_starts": ["*"], "reading_marks": ["^"], "id_line": "ID:", "head_prefix": "%",
        "header_literals": {"bad head": "good head"}, "signature": 6, "prefix_signature": 3, "pronunciation_methods": ["headword_normalized"], "clues": [[["alpha", "beta"], "good head", "clue"]], "headers": [],
    }
    (files / "profile.json").write_text(json.dumps(profile), encoding="utf-8")
    tokens = {k: {"value": v} for k, v in {"t1": "ə", "t22": "ɪ"}.items()}
    (files / "map.json").write_text(json.dumps({"tokens": tokens}), encoding="utf-8")
    (files / "d.txt").write_bytes("Able［<t1>xx<t9>］\na##b <t22>\nplain［[hA121]］\nc".encode("cp932"))
    root = f"file://{files}"
    common = ["--source-root", root, "--out-root", root, "--map-path", f"{root}/map.json", "--profile-path", f"{root}/profile.json", "--old-text-path"]
    main(["pronunciations", *common, f"{root}/d.txt"])
    index = rows(files / "old_text_pron_index.jsonl")
    assert [(r["headword"], r["pronunciation_normalized"], r["body_readable"]) for r in index] == [("Able", "əks<t9>", "a; b ɪ")]
    assert [r.get("pronunciation", {}).get("match_method") for r in rows(files / "entries_pron_enriched.jsonl")] == ["headword_normalized", None, None, None, None]

    (files / "h.txt").write_bytes("%bad head\n* one <t22> two\nother\n* three\nID: 7\n* four\n".encode("cp932"))
    drafts = [draft("a", "good head"), draft("b", "q", "alpha beta"), draft("c", "q", "* threeXX"), draft("d", "none")]
    (files / "entries_master_kokugo_draft.jsonl").write_text("".join(json.dumps(d) + "\n" for d in drafts), encoding="utf-8")
    main(["headlines", *common, f"{root}/h.txt"])
    index = rows(files / "kokugo_old_text_index.jsonl")
    assert [(r["headword_line"], r["body_readable"], r["body_signature"]) for r in index] == [("good head", "* one ɪ two", "*oneɪt"), ("other", "* three\nID: 7\n* four", "*three")]
    got = {r["id"]: r["canonical"].get("body_match_method") for r in rows(files / "entries_master_kokugo_restored.jsonl")}
    assert got == {"a": "header_normalized_exact", "b": "clue", "c": "body_signature_unique", "d": None}
    (files / "profile.json").write_text('{"tokens": "x"}')
    with pytest.raises(ValueError, match="tokens"):
        main(["headlines", *common, f"{root}/h.txt"])
