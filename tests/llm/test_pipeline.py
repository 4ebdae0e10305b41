"""The pipeline's stages on a small table, beside plain Python, and the entry without this subpackage."""

from __future__ import annotations

import random
import re
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from tests.llm.test_cleaning import contaminated, plain_judge
from tests.llm.test_ngram_join import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def site_lines(rows):
    pages, seen = {}, {}
    for _, text, source in rows:
        pages[source] = pages.get(source, 0) + 1
        for line in {x.strip(" \t\r\x0b\x0c") for x in (text or "").split("\n")} - {""}:
            seen[source, line] = seen.get((source, line), 0) + 1
    drop = {k for k, n in seen.items() if n > 1 and 100 * n > 5 * pages[k[0]]}
    return [(i, "\n".join(x for x in t.split("\n") if (s, x.strip(" \t\r\x0b\x0c")) not in drop), s) for i, t, s in rows]


def test_stages_beside_plain_python(spark, tmp_path):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice([f"w{k}" for k in range(300)]) for _ in range(n))
    items = [(k, say(25)) for k in range(4)]
    rows = []
    for i in range(60):
        lines = [say(rng.randint(12, 40)) + "." for _ in range(rng.randint(1, 4))]
        if i % 3 == 0:
            lines.insert(0, "Shared boilerplate line of the site.")
        if i % 10 == 1:
            lines.append(f"own{i} {items[i % 4][1]}.")
        if i % 10 == 2:
            lines += [say(900) + ".", f"own{i} {items[i % 4][1]}."]
        if i % 7 == 3:
            lines = ["a | b | c | d | e"] * 5
        rows.append((i, "\n".join(lines), f"s{i % 2}"))
    rows += [(100 + i, rows[i][1] + " tail." * (i % 2), "s0") for i in range(10)] + [(200, None, "s0"), (201, "", None), (None, say(30) + ".", "s1")]
    docs = spark.createDataFrame([(i, t, None, s, None if t is None else len(t)) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    folder = f"file://{tmp_path}"
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")

    want, at, got = [(i, t, s) for i, t, s in rows], [], spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "quality_rules":
            judged = [(i, plain_judge(t), source) for i, t, source in want]
            want = [(i, clean, source) for i, (kept, clean), source in judged if kept]
        elif name == "line_dedup":
            want = site_lines(want)
        elif name == "near_duplicates":
            least = brute([(i, t) for i, t, _ in want])
            want = [r for r, (i, _, c) in zip(want, least, strict=True) if i == c]
        else:
            judged = [(r, contaminated(r[1], items)) for r in want]
            clean = [(r, j) for r, j in judged if not j[4]]
            assert any(j[1] for _, j in clean) and len(clean) < len(judged)
            want = [r for r, j in clean if not j[1]]
            cut = {r[0] for r, j in clean if j[1]}
        got = stage(spark, got, folder)
        assert got.columns == COLUMNS
        out = got.collect()
        assert all(r.n_chars == len(r.text) for r in out)
        if name == "decontamination":
            assert {r.doc_id for r in out} == {r[0] for r in want} | cut
            assert not any(contaminated(r.text, items)[1] for r in out)
            out = [r for r in out if r.doc_id not in cut]
        assert sorted(((r.doc_id, r.text, r.source) for r in out), key=repr) == sorted(want, key=repr), name
        at.append(len(out))
        got = spark.createDataFrame(got.collect(), got.schema).repartition(2)
    assert at == sorted(at, reverse=True) and at[0] < len(rows) and at[2] < at[1]
    pieces = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in got.collect()}


def test_one_row_of_each_group_stays(spark):
    say = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(1, say("a")), (1, say("a")), (1, say("b")), (2, say("b")), (2, say("c")), (None, say("d")), (None, say("d")), (None, say("a")), (3, None), (3, ""), (3, "")]
    docs = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == COLUMNS
    want = [(1, say("a")), (1, say("b")), (2, say("c")), (None, say("d")), (3, None), (3, ""), (3, "")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_columns_of_any_name_pass_the_filtering_stages(spark, tmp_path):
    names = ["key", "doc", "order", "gone", "may_go", "n_lines", "n_dropped", "_row", "cls", "id"]
    fields = "doc_id bigint, text string, source string, " + ", ".join(f"`{n}` string" for n in names)
    text = " ".join(f"word{k}" for k in range(40)) + "."
    docs = spark.createDataFrame([(i, text if i < 2 else text.replace("word", "other"), f"s{i}", *[f"{n}{i}" for n in names]) for i in range(3)], fields)
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.dtypes == [("doc_id", "bigint"), ("text", "string"), ("source", "string"), *((n, "string") for n in names)]
    got = docs.collect()
    assert {r.doc_id for r in got} == {0, 2} and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)


def test_entry_without_this_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[2]
    for name in ("__spark_entry__.py", "palimpsest"):
        (tmp_path / name).symlink_to(root / name) if name.endswith(".py") else None
    (tmp_path / "palimpsest").mkdir()
    for part in (root / "palimpsest").iterdir():
        if part.name != "llm":
            (tmp_path / "palimpsest" / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(re.match('op[0-9]|pipeline', k) for k in q); assert set(e.oracle_sql()) <= set(q)"
    got = subprocess.run([sys.executable, "-B", "-c", "import re\n" + code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr[-2000:]
    for f in (root / "palimpsest").rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"palimpsest\.llm", f.read_text()), f
