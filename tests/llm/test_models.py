"""The language model against plain counting, and the quality model on held-out labels."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from palimpsest.llm.language_model import score_texts
from palimpsest.llm import quality_model as qm
from palimpsest.llm import words as W
from palimpsest.llm.quality_model import fit, score_quality

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def is_held(key):
    return key is not None and zlib.crc32(str(key).encode()) % 7 == 2


class Plain:
    """The model by whole tables of counts."""

    def __init__(self, train, mass):
        self.mass = mass
        self.one, self.two, self.three = Counter(w for t in train for w in t), Counter(), Counter()
        self.after, self.after_two = Counter(), Counter()
        for t in train:
            s = ["<begin>", *t]
            for u, v in zip(s, s[1:]):
                self.two[u, v] += 1
                self.after[u] += 1
            for u, v, w in zip(s, s[1:], s[2:]):
                self.three[u, v, w] += 1
                self.after_two[u, v] += 1
        self.whole = sum(self.one.values()) + len(self.one) + 1

    def p1(self, w):
        return (self.one[w] + 1) / self.whole

    def p2(self, w, v):
        return (self.two[v, w] + self.mass[0] * self.p1(w)) / (self.after[v] + self.mass[0])

    def p3(self, w, u, v):
        return (self.three[u, v, w] + self.mass[1] * self.p2(w, v)) / (self.after_two[u, v] + self.mass[1])

    def score(self, t):
        s = ["<begin>", *t]
        return math.log10(self.p2(s[1], s[0])) + sum(math.log10(self.p3(w, u, v)) for u, v, w in zip(s, s[1:], s[2:]))


def plain_model(rows, mass):
    """(held, tokens, known, N, base, score) for each row."""
    tokens = [tokens_of(t) for _, t in rows]
    held = [is_held(i) for i, _ in rows]
    model = Plain([t for t, h in zip(tokens, held, strict=True) if not h], mass)
    return [(h, len(t), sum(model.one[w] > 0 for w in t), sum(model.one.values()), sum(math.log10(model.p1(w)) for w in t), model.score(t)) for t, h in zip(tokens, held, strict=True)]


def test_scores_by_plain_counting(spark):
    rng = random.Random(3)
    texts = ["the cat sat on the mat", "the cat sat", "The DOG sat on the log", None, "", "unseen zebra words", "a " * 3000, "é é é ü", "the cat sat on the mat"]
    rows = [(i, texts[i % len(texts)]) for i in range(60)] + [(None, "the cat"), (3, "again the cat"), (3, "again the cat")]
    rows += [(100 + i, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 30)))) for i in range(40)]
    docs = spark.createDataFrame([(i, t, 0.5, "c") for i, t in rows], "doc_id bigint, text string, score double, chunk string").repartition(3)
    want = sorted((*x[:4], round(x[4], 6), round(x[5], 6)) for x in plain_model(rows, (4.0, 1.5)))
    assert any(w[0] for w in want)
    for chunk in (2_000_000, 50):
        got = sorted(((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in score_texts(docs, mass=(4.0, 1.5), chunk_tokens=chunk).collect()))
        assert [g[:4] for g in got] == [w[:4] for w in want]
        assert np.allclose([g[4:] for g in got], [w[4:] for w in want], atol=1e-4)


def test_model_weights_sum_to_one(spark):
    """After each context, the probabilities of all words, the end and one unseen word in the place of all unseen ones sum to one."""
    rows = [(i, "a b a c b a d e a b") for i in range(30) if not is_held(i)] + [(50, "c a b"), (51, "e")]
    vocabulary = ["a", "b", "c", "d", "e", "never"]
    contexts = ["", "a", "b", "a b", "b a", "never", "a never", "never a", "e d", "a b a"]
    keys = iter(k for k in range(1000, 9000) if is_held(k))
    probe = [(next(keys), c, f"{c} {w}") for c in contexts for w in vocabulary]
    ends = [(next(keys), c, c) for c in contexts]
    docs = spark.createDataFrame([(i, t) for i, t in rows] + [(i, t) for i, _, t in probe + ends], "doc_id bigint, text string")
    got = {r.id: r for r in score_texts(docs, mass=(2.0, 0.7)).collect()}
    model = Plain([tokens_of(t) for _, t in rows], (2.0, 0.7))
    for c in contexts:
        # A text's score without its last step, the end.
        def until(key, text):
            s = ["<begin>", *tokens_of(text)]
            last = model.p3(None, s[-3], s[-2]) if len(s) > 2 else model.p2(None, s[-2])
            return 10 ** (got[key].score - math.log10(last))

        prefix = next(until(k, t) for k, x, t in ends if x == c)
        after = sum(until(k, t) for k, x, t in probe if x == c) + 10 ** next(got[k].score for k, x, _ in ends if x == c)
        assert math.isclose(after, prefix, rel_tol=1e-6), c


def test_chain_of_failure_arcs_gains_on_words_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in score_texts(docs).collect() if r.held_out]
    n = sum(r.n_tokens for r in rows)
    assert (sum(r.score for r in rows) - sum(r.base_score for r in rows)) / n > 0.2


def test_model_without_texts(spark):
    assert score_texts(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = score_quality(docs, labels).withColumnRenamed("id", "doc_id").join(labels, "doc_id")
    rows = got.where("held_out").collect()
    right = np.mean([r.predicted == r.quality for r in rows])
    assert len(rows) > 60 and right > 0.95
    # Other labels of held-out rows change nothing.
    flipped = labels.selectExpr("doc_id", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2 then 1 - quality else quality end as quality")
    again = {r.id: r.score for r in score_quality(docs, flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)


def test_quality_of_odd_rows(spark):
    rows = [(1, "good plain words here"), (2, None), (3, ""), (None, "x"), (1, "good plain words here"), (4, "w " * 50_000)]
    docs = spark.createDataFrame([(i, t, 1.0, "k") for i, t in rows], "doc_id bigint, text string, score double, x string")
    for labels in ([], [(1, 1), (4, 1)], [(1, 1), (2, 0), (3, None), (None, 1), (4, 0), (5, 1), (99, 0)]):
        table = spark.createDataFrame(labels, "doc_id bigint, quality int")
        got = score_quality(docs, table).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert score_quality(docs.where("false"), spark.createDataFrame([], "doc_id bigint, quality int")).count() == 0


def test_temperature_and_one_class():
    rng = np.random.Generator(np.random.PCG64(1))
    x = rng.normal(size=(1500, 5))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rng.random(1500) < p).astype(float)
    score = fit(x, y).score(x)
    for low in (0.0, 0.25, 0.5, 0.75):
        part = (score >= low) & (score < low + 0.25)
        assert abs(score[part].mean() - y[part].mean()) < 0.1
    assert np.allclose(fit(x[:10], np.ones(10)).score(x[:3]), 11 / 12)


def shape_of(word, before):
    signs = []
    for byte in word.encode():
        sign = 0x61 if 0x61 <= byte <= 0x7A or byte >= 0x80 else 0x41 if 0x41 <= byte <= 0x5A else 0x30 if 0x30 <= byte <= 0x39 else byte
        if not signs or signs[-1] != sign:
            signs.append(sign)
    return bytes(signs).decode(), word == before


ODD = ["The cat, the CAT sat 12 times.", "", None, " ", "a a A b", "é ü漢字 x1y2 --!! --!!", "one", "the cat sat on the mat. " * 4]


def test_vectors_and_pools_by_plain_counting(spark):
    """Each row's vector is the sum of its neighbours' index vectors, and a text's pool the mean of its words' vectors."""
    rows_of: dict[tuple, int] = {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in ODD]
    for s in W.slices(pa.array(ODD, pa.string())):
        shapes, own, bounds = qm.tokens(s)
        assert bounds.tolist() == np.cumsum([0, *map(len, split)]).tolist()
    at = 0
    named = []
    for w in split:
        text = []
        for k, word in enumerate(w):
            names = (("shape", *shape_of(word, w[k - 1] if k else None)), ("word", word.translate(LOWER)))
            for name, row in zip(names, (shapes[at], own[at]), strict=True):
                assert rows_of.setdefault(name, int(row)) == row
            text.append(names)
            at += 1
        named.append(text)
    assert len(set(rows_of.values())) == len(rows_of)
    places, signs = qm.index_vectors()
    assert all(len(set(p)) == qm.NONZERO for p in places[:500].tolist())
    index = np.zeros((qm.ROWS, qm.DIM))
    index[np.arange(qm.ROWS)[:, None], places] = signs
    want = np.zeros((qm.ROWS, qm.DIM))
    for text in named:
        for k, pair in enumerate(text):
            shape, word = (rows_of[x] for x in pair)
            want[shape] += index[word]
            want[word] += index[shape]
            for j in (k - 1, k + 1):
                if 0 <= j < len(text):
                    want[shape] += index[rows_of[text[j][0]]]
                    want[word] += index[rows_of[text[j][1]]]
    want /= np.linalg.norm(want, axis=1, keepdims=True) + qm.RARE
    got = qm.word_vectors(spark.createDataFrame([(t,) for t in ODD], "text string").repartition(3))
    assert np.allclose(got, want, atol=1e-6)
    for s in W.slices(pa.array(ODD, pa.string())):
        pooled = qm.pooled(s, got)
    for row, text in zip(pooled, named, strict=True):
        parts = []
        for kind in (0, 1):
            mean = np.mean([got[rows_of[x[kind]]] for x in text], axis=0) if text else np.zeros(qm.DIM)
            parts += [*mean, np.linalg.norm(mean)]
        assert np.allclose(row, [*parts, math.log1p(len(text)) / 10], atol=1e-5)
