"""Line rules, line dedup, decontamination and URL rules on small tables with every odd case."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import string
import time
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate as decontaminating
from palimpsest.llm import quality_rules as q
from palimpsest.llm import words as W
from palimpsest.llm.decontaminate import decontaminate
from palimpsest.llm.line_dedup import dedup_lines
from palimpsest.llm.url_filter import BLOCK_GLOBS, SITE_RULES, compile_globs, filter_urls, matches


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def counts(text):
    w, lines = split(text), (text or "").split("\n")
    seen, repeated = set(), 0
    for line in lines:
        if split(line):
            repeated += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(again)


TEXTS = [None, "", " \n\n", "a", "one two three. " * 5, "\n".join(["same line here ok."] * 3 + ["é ü 漢字 🎉 x."]), "a | b | c | d\nPlain words follow here and go on.", "x### y$$$ z%%% w&&&", "word " * 30_000, "THE!! END!! IS!! NEAR!!\nall fine.", "p\x0bq\x1cr s"]


def test_counts_of_texts():
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice(["a", "b", "c.", "\n", "#"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    got = []
    for s in W.slices(pa.array(texts, pa.string()), most=700):
        j = q.judge(s, q.Rules())
        got += list(zip(*(j.counts[c].tolist() for c in q.COUNTS), strict=True))
    assert got == [counts(t) for t in texts]


def test_line_rules(spark):
    prose = "The quick brown fox jumps over the lazy dog near the old river bank today."
    text = "\n".join([prose, "Home | About | News | Contact | Help", "", "buy$$$ now### cheap$$$ pills***", "spam spam spam spam spam spam spam spam spam spam", "WOW!! GREAT!! DEAL!! NOW!!", "All rights reserved.", prose, "word " * 13])
    rows = [(1, text, "x"), (2, prose, "x"), (3, "a | b | c | d | e | f\n" + "short prose here with ten words or more to go on.", "x"), (4, None, "x"), (5, "", None), (None, prose, "x"), (2, prose, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept string")
    by = {r.id: r for r in q.clean_lines(docs).collect()}
    assert by[1].clean_text == prose + "\n" and by[1].n_lines_removed == 7
    assert (by[1].kept, by[2].kept, by[3].kept, by[4].kept, by[5].base_failed, by[None].kept) == (False, True, True, False, True, True)
    assert by[2].clean_text == prose and by[4].clean_text is None and by[5].clean_text == ""
    kept = q.clean_lines(docs, keep_columns=True)
    assert kept.columns == docs.columns
    assert sorted((repr(r.doc_id), r.text) for r in kept.collect()) == [("2", prose), ("2", prose), ("3", "short prose here with ten words or more to go on."), ("None", prose)]
    assert q.clean_lines(docs.where("false")).count() == 0


def closing(c):
    return c in ".!?:;\"')" or c > "\x7f" and unicodedata.category(c)[0] not in "LMN"


def plain_lines(text):
    """(line, fails, word characters) of each line, rule by rule."""
    out, seen = [], set()
    lines = (text or "").split("\n")
    link, size = {}, {}
    worded, menu = [k for k, line in enumerate(lines) if split(line)], set()
    said = [k for k in worded if closing(split(lines[k])[-1][-1]) and (len(split(lines[k])) > 4 or sum(map(len, split(lines[k]))) >= 20)]
    for k in worded:
        w = split(lines[k])
        size[k] = len(w)
        if w[0][0] in string.digits and len(w) > 1:
            size[k] = max(4, len(w))
        elif "\u3040" <= w[0][0] <= "\u30ff" or "\u3400" <= w[0][0] <= "\u9fff" or "\uf900" <= w[0][0] <= "\ufaff":
            size[k] = max(len(w), (sum(map(len, w)) + 1) // 2)
        kind = unicodedata.category(w[0][0])
        small = kind in ("Ll", "Lo", "Lm") or kind[0] == "M" or kind[0] == "N" and w[0][0] > "\x7f"
        link[k] = size[k] <= 4 and not closing(w[-1][-1]) and (not small or bool(said) and not said[0] <= k <= said[-1])
    for same, group in itertools.groupby(worded, key=lambda k: link[k]):
        group = list(group)
        if same and len(group) >= 3 and sum(size[k] for k in group) <= 2 * len(group):
            menu |= set(group)
    for k, line in enumerate(lines):
        w = split(line)
        chars = sum(map(len, w))
        fails = False
        if w:
            n, tail = len(w), w[-1][-1]
            fails = (
                100 * len(re.findall(r"[#*$%&|<>]", line)) > 10 * chars or n >= 4 and 100 * line.count("!") > 60 * n or n >= 4 and 100 * sum(x in ["|", "/", ">", "»", "›", "·", "•"] for x in w) >= 20 * n
                or n >= 10 and 100 * (n - len(set(w))) >= 80 * n or n >= 12 and (tail < "\x80" and tail not in ".!?:;\"')" or tail > "\x7f" and unicodedata.category(tail) in ("Ll", "Lu", "Lt")) or line in seen or k in menu
                or any(p in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line) for p in q.PHRASES)
            )
            seen.add(line)
        out.append((line, fails, chars))
    return out


def plain_judge(text):
    """(kept, clean text)."""
    n_words, chars, _, _, again = counts(text)
    lines = plain_lines(text)
    lost = sum(c for _, fails, c in lines if fails)
    kept = n_words >= 10 and 100 * again <= 20 * n_words and 100 * lost <= 50 * chars
    return kept, None if text is None else "\n".join(x for x, fails, _ in lines if not fails)


def test_lines_by_plain_rules(spark):
    rng = random.Random(11)
    parts = ["Home", "About us", "a", "word", "The end.", "buy$$", "x|y", "|", "/", "»", "•", "WOW!", "go!!", "漢字", "é", "首页", "関東地方の", "2", "50 g", "Я", "слово", "।", "。", "ाक", "٣", "ǅ", "ⅷ", "🎉", "Accept cookies", "privacy policy", "spam", "spam", "\n", "\n", "\n\n", ".", "\x1c", "\t"]
    texts = [t for t in TEXTS if t is None or len(t) < 5000] + [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 45))) for _ in range(1500)]
    texts += ["\n".join(rng.choice(["A sentence of many words stands here for all to read.", "Home", "News today", "lower case", "End here.", "", "Новости", "цены и акции", "联系我们", "五月的花开", "2 cups flour", "من نحن", "Ça a été fermé", "Длинное предложение из пяти слов здесь."]) for _ in range(rng.randint(1, 12))) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {r.id: (r.kept, r.clean_text) for r in q.clean_lines(docs).collect()}
    for i, text in enumerate(texts):
        assert got[i] == plain_judge(text), text
    assert 0 < sum(k for k, _ in got.values()) < len(texts)


MENUS = [
    ["Home", "About us", "Products", "Contact", "Login", "Back to top"],
    ["Start", "", "News", "", "Sport"],
    ["2023", "2024", "Next page"],
    ["Home › Books › Old maps"],
    ["Menu • Search • Help"],
    ["#tags /a/", "More Like This", "Share"],
]
PROSE = [
    ["She said no.", "He left.", "They met again."],
    ["Dear Ann", "thank you for the letter", "it came today"],
    ["Title of the piece", "It was a cold night on the river.", "Second part", "Nobody spoke."],
    ["first", "second", "third", "fourth"],
    ["漢字の文", "次の文", "終わり"],
    ["Either this and/or that is what we have here."],
]


def test_menus_fail_and_prose_does_not():
    for lines, bad in [(m, True) for m in MENUS] + [(p, False) for p in PROSE]:
        text = "\n".join(["A full sentence stands here to begin with.", *lines, "Another full sentence ends the whole text."])
        for s in W.slices(pa.array(["A b\nC d", text, "E f"])):
            got = q.judge(s, q.Rules())
            own = got.line_fails[got.line_bounds[1] : got.line_bounds[2]].tolist()
        assert own == [False, *(bad and bool(x) for x in lines), False], lines
        assert not got.line_fails[: got.line_bounds[1]].any() and not got.line_fails[got.line_bounds[2] :].any()


SENTENCE = "A full sentence stands here to begin with."
#: Lines around a sentence, and whether they go.
EDGES = [
    (["Главная", "О нас", "Новости", "Контакты"], True),
    (["首页", "关于我们", "产品中心", "联系我们"], True),
    (["home", "about us", "products", "contact"], True),
    (["الرئيسية", "من نحن", "اتصل بنا"], True),
    (["The Moon Is Rising", "Over Quiet Hills", "And Rivers Of Silver", "Sing Me To Sleep"], False),
    (["200 g Flour", "2 Eggs", "1 cup Milk", "Salt", "Butter"], False),
    (["床前明月光", "疑是地上霜", "举头望明月"], False),
    (["roses are red", "violets are blue", "sugar is sweet"], False),
]


def test_menus_of_other_scripts_and_places():
    for lines, bad in EDGES:
        for text, own in [([*lines, SENTENCE], slice(0, -1)), ([SENTENCE, *lines], slice(1, None))]:
            fails = q.judge(next(W.slices(pa.array(["\n".join(text)]))), q.Rules()).line_fails.tolist()
            assert fails[own] == [bad] * len(lines) and sum(fails) == bad * len(lines), lines
    capital = EDGES[0][0]
    for lines, bad in [(capital, True), *((x, False) for x, _ in EDGES[1:4])]:
        fails = q.judge(next(W.slices(pa.array(["\n".join([SENTENCE, *lines, "Another sentence ends the whole text."])]))), q.Rules()).line_fails
        assert fails.sum() == bad * len(lines), lines
    for poem in (EDGES[4][0], EDGES[5][0], EDGES[6][0], EDGES[7][0]):
        assert not q.judge(next(W.slices(pa.array(["\n".join(poem)]))), q.Rules()).line_fails.any()


def test_long_lines_without_a_mark():
    words = "un deux trois quatre cinq six sept huit neuf dix onze "
    for end, bad in [("fermé", True), ("fermé.", False), ("слово", True), ("слово»", False), ("end", True), ("จบ", False), ("文。", False), ("है", False), ("ABCÉ", True)]:
        assert q.judge(next(W.slices(pa.array([words + end]))), q.Rules()).line_fails.tolist() == [bad], end


def test_site_lines(spark):
    rows = [(i, "s", f"  menu \nown {i}\n\nrare") for i in range(20)] + [(100 + i, "t", f"menu\n{i}") for i in range(2)]
    rows += [(200, None, "menu\nx"), (201, "s", None), (202, "s", ""), (203, "s", "menu\nmenu"), (None, "s", "menu\nnull id")]
    docs = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], "doc_id bigint, source string, text string, _site string, _drop int, n_lines int")
    for limit in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        got = {r.doc_id: r for r in dedup_lines(docs).collect()}
        assert got[0].text == "own 0\n" and (got[0].n_lines, got[0].n_dropped) == (3, 2)
        assert got[100].text == "0" and got[200].text == "menu\nx" and got[201].text is None and got[202].text == ""
        assert got[203].text == "" and got[203].n_dropped == 2 and got[None].text == "null id"
        assert len(got) == len(rows) and got[0]._site == "a" and got[0]._drop == 1
    assert dedup_lines(docs.where("false")).count() == 0
    bare = dedup_lines(docs, with_counts=False)
    assert bare.columns == docs.columns and {r.n_lines for r in bare.collect()} == {2}


def test_sites_by_host(spark):
    rows = [(f"https://A.example/{i}?x", "menu\nown") for i in range(1)] + [("http://a.example", "menu\nmine"), ("ftp://b.example#x", "menu\nalone"), ("nothing", "menu\n1"), (None, "menu\n2")]
    docs = spark.createDataFrame([(u, t, k) for k, (u, t) in enumerate(rows)], "url string, text string, k int")
    assert [r.text for r in dedup_lines(docs, url_col="url").orderBy("k").collect()] == ["own", "mine", "menu\nalone", "1", "2"]


def norm(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def contaminated(text, items, window=13):
    w, hit, found = norm(text), set(), []
    for key, item in items:
        own = norm(item)
        size = min(window, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        places = [i for i in range(len(w) - size + 1) if tuple(w[i : i + size]) in windows] if own else []
        hit |= {i + k for i in places for k in range(size)}
        if places:
            found.append(key)
    found = set(found)
    names = ",".join(sorted(str(k) for k in found if k is not None))
    return len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_time_of_repeated_words_grows_as_their_number():
    def took(n):
        automaton = decontaminating.build(["i"], decontaminating.item_words(["a " * n]))
        number = np.zeros(n, int).tolist()
        began = time.process_time()
        spans, items = decontaminating.walk(automaton, number, 13)
        assert items == {0} and spans[-1] == (n - 13, n) and len(spans) == n - 12
        return time.process_time() - began

    small, large = min(took(4_000) for _ in range(2)), took(16_000)
    assert large < 8 * small + 0.1


def test_contamination_by_brute_force(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(["ab", "c", "D", "é1", "x-y"]) for _ in range(n))
    items = [(i, say(rng.randint(1, 30))) for i in range(12)] + [(20, "Short item"), (21, ""), (22, None), (23, "!?"), (20, "Short item"), (None, "no id item"), (24, "c")]
    rows = [(i, say(rng.randint(0, 200))) for i in range(40)]
    rows += [(100, "pre " * 30 + items[0][1] + " post" * 400), (101, None), (102, ""), (103, "short, ITEM!"), (104, " ".join(t or "" for _, t in items)), (None, "no-ID item"), (105, "z " * 100_000 + "short item")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id bigint, text string, n_hit string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for most in (0, 200_000):
        got = {r.id: r for r in decontaminate(docs, bench, broadcast_words=most).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == contaminated(t, items), (i, t)
        assert got[105].clean_text.rstrip() == ("z " * 100_000).rstrip() and got[101].clean_text is None
        kept = decontaminate(docs, bench, keep_columns=True, broadcast_words=most)
        assert kept.dtypes == docs.dtypes
        assert {(r.doc_id, r.n_hit) for r in kept.collect()} == {(i, "k") for i, t in rows if not contaminated(t, items)[4]}
    for most in (-1, 0):
        assert not any(r.contaminated for r in decontaminate(docs, bench.where("false"), broadcast_words=most).collect())


UNRESERVED = string.ascii_letters + string.digits + "-._~"
FORMS = [
    ("http://x.org/A.JPG", "x.org/a.jpg"), ("http://x.org/a%2Ejpg", "x.org/a.jpg"), ("http://u:p@Ads.x.com:8080/", "ads.x.com/"), ("http://a@b@x.org.", "x.org/"),
    ("http://x.org/a/./b/../c", "x.org/a/c"), ("http://x.org/../../a/..", "x.org/"), ("http://x.org/a/%2e%2E/b/.", "x.org/b/"), ("http://x.org/a%2fb%2561", "x.org/a%2fb%2561"),
    ("http://x.org//a/...", "x.org//a/..."), ("http://%41ds.x.org:/%zz%", "ads.x.org/%zz%"), ("http://x.org/.", "x.org/"), ("http://x.org/a/../", "x.org/"), ("http://[::1]:80/", "[::1]/"),
]


def plain_form(host, path):
    for code in UNRESERVED:
        for hexed in {f"%{ord(code):02x}", f"%{ord(code):02X}"}:
            host, path = host.replace(hexed, "\0" + code), path.replace(hexed, "\0" + code)
    host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.replace("\0", "")) for x in (host, path))
    host = host.split("@")[-1]
    while host and host.rstrip("0123456789") != host and ":" in host and host.rstrip("0123456789").endswith(":"):
        host = host.rstrip("0123456789")
    host = host.removesuffix(":").rstrip(".")
    path = path or "/"
    while "/./" in path:
        path = path.replace("/./", "/", 1)
    path = path[:-1] if path.endswith("/.") else path
    while m := re.search(r"/\.\.(/|\Z)", path):
        path = path[: max(path.rfind("/", 0, m.start()), 0)] + "/" + path[m.end() :]
    return host, path


def test_canonical_form_for_globs(spark):
    rows = [(i, u) for i, (u, _) in enumerate(FORMS)]
    got = {r.id: r for r in filter_urls(spark.createDataFrame(rows, "page_id int, url string")).collect()}
    assert [got[i].canonical for i in range(len(FORMS))] == [form for _, form in FORMS]
    assert [got[i].n_globs for i in range(3)] == [1, 1, 1] and [(got[i].rule, got[i].verdict) for i in range(3)] == [("org/", "allow"), ("org/", "allow"), (None, "block")]


def test_window_that_very_many_items_share(spark):
    shared = " ".join(f"s{k}" for k in range(13))
    n = 100_000
    items = spark.range(n).select(F.col("id").alias("item_id"), F.concat(F.lit(shared + " own"), "id").alias("text")).union(spark.createDataFrame([(n, "quite another one")], "item_id bigint, text string"))
    texts = [f"before {shared} after {k}" for k in range(300)] + [f"x {shared} own7", "here is quite another one", f"{shared} quite another one", "nothing of it"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r.id: r for r in decontaminate(docs, items, broadcast_words=0).collect()}
    digest = lambda ids: hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
    all_of_them = digest(range(n))
    assert len(got) == len(texts) and all((got[k].n_hit, got[k].n_items, got[k].items_sha256) == (13, n, all_of_them) for k in range(300))
    assert (got[300].n_hit, got[300].n_items, got[300].items_sha256, got[300].clean_text) == (14, n, all_of_them, "x ")
    assert (got[301].n_hit, got[301].items_sha256) == (3, digest([n]))
    assert (got[302].n_hit, got[302].n_items, got[302].items_sha256) == (16, n + 1, digest(range(n + 1)))
    assert (got[303].n_hit, got[303].n_items, got[303].items_sha256) == (0, 0, digest([]))


def test_url_rules_by_brute_force(spark):
    rng = random.Random(3)
    hosts = ["example.org", "a.example.org", "xexample.org", "ORG", "org", "b.com", "com", "spam-farm.example.net", "m.casino-x.de", "ads.x.y", "x.ads", "ünï.org", "", "u@ads.x.com:80", "a:b@Ads.org.", "x:", "%61ds.x.y"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12", "/fr/x", "/de/", "/a.exe", "/A.EXE", "/x/wp-admin/y", "/x#y.exe", "/x?y=/es/", "/漢.zip", "/A%2eJPG", "/x/./wp-admin/../WP-admin/y", "/a/..", "/%2e/%41%zz%2f", "/" + "long" * 5000]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "a://b://c.org/es/", "http://org\n/es/", "HTTP://EXAMPLE.org/es/"]
    rng.shuffle(urls)
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    regex = [re.compile("(?s)" + "#".join(("[^#]*" if k == 0 else ".*").join(re.escape(x) for x in part.split("*")) for k, part in enumerate(g.split("#")))) for g in BLOCK_GLOBS]
    for r in filter_urls(pages).collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[r.id] or "")
        host, path = (m[1], m[2]) if m else ("", "")
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(h + p, v) for h, p, v in SITE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, "block" if any(x.fullmatch(".%s#%s" % plain_form(host, path)) for x in regex) else "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict), urls[r.id]
        assert r.canonical == "".join(plain_form(host, path)), urls[r.id]
    assert filter_urls(pages.where("false")).count() == 0


def test_shift_and_over_many_words():
    rng = random.Random(4)
    globs = ["".join(rng.choice("ab*?") for _ in range(rng.randint(0, 5))) + "#" + "".join(rng.choice("ab*?#".replace("#", "")) for _ in range(rng.randint(0, 5))) for _ in range(60)]
    regex = [re.compile("(?s)" + "".join((".*" if "#" in g[:k] else "[^#]*") if c == "*" else "[^#]" if c == "?" else re.escape(c) for k, c in enumerate(g))) for g in globs]
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) + "#" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(300)] + ["#", ""]
    automaton = compile_globs(globs)
    assert automaton.words > 2
    got = matches(automaton, texts)
    for i, t in enumerate(texts):
        assert got[i].tolist() == [x.fullmatch(t) is not None for x in regex], t
