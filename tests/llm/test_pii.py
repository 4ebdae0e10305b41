from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import pii


def plain_base(text):
    """The base patterns as they are stated."""
    out = []
    out += [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
        if 14 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0:
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["@", ".", "-", " ", "+", "(", ")", "a", "b.c", "0", "4111 1111 1111 1111", "4111111111111111", "1.2.3.4", "255", "256", "+1 (651) 555-8500", "x@y.zz", "é", "\n", "５"]), max_size=14).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


def test_base_time_is_linear():
    def took(text):
        began = time.process_time()
        pii.base_spans(text)
        return time.process_time() - began

    for make in (lambda n: "1" * n, lambda n: "a" * n + "@", lambda n: "1." * (n // 2), lambda n: "+1" + " " * n, lambda n: "@a" * (n // 2), lambda n: "a@b.c " * (n // 6)):
        small, large = (min(took(make(n)) for _ in range(3)) for n in (50_000, 400_000))
        assert large < 40 * small + 0.05  # 8 times the text; a quadratic pattern takes 64 times as long


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.lists(st.tuples(st.integers(0, 4), st.integers(1, 5)), min_size=1, max_size=3), st.randoms(use_true_random=False))
def test_best_labelling_and_marginals(n, raw, rng):
    kinds = len(pii.KINDS)
    spans = sorted({(i, min(n, i + d)) for i, d in raw if i < n})
    if not spans:
        return
    scores = np.array([[rng.uniform(-2, 2) for _ in pii.KINDS] for _ in spans])
    moves = np.array([[rng.uniform(-1, 1) for _ in pii.KINDS] for _ in range(kinds + 1)])
    worlds = {}
    for size in range(len(spans) + 1):
        for pick in itertools.combinations(range(len(spans)), size):
            if all(spans[a][1] <= spans[b][0] for a, b in itertools.pairwise(pick)):
                for types in itertools.product(range(kinds), repeat=size):
                    worlds[tuple(zip(pick, types, strict=True))] = sum(scores[k, t] for k, t in zip(pick, types, strict=True)) + sum(moves[a, b] for a, b in itertools.pairwise([kinds, *types]))
    best = pii.viterbi(n, spans, scores, moves)
    assert np.isclose(worlds[tuple(best)], max(worlds.values()))
    total = sum(map(math.exp, worlds.values()))
    share, moved = np.zeros(scores.shape), np.zeros(moves.shape)
    for world, weight in worlds.items():
        for k, t in world:
            share[k, t] += math.exp(weight) / total
        for a, b in itertools.pairwise([kinds, *(t for _, t in world)]):
            moved[a, b] += math.exp(weight) / total
    # Beside another region, which changes nothing.
    got, counts = pii.Lattice([spans, [(0, 1)], spans]).marginals(np.concatenate([scores, [[-50.0] * kinds], scores]), moves)
    assert np.allclose(got[: len(spans)], share) and np.allclose(got[len(spans) + 1 :], share) and np.allclose(counts, 2 * moved)


def measured(lines, weights):
    hits = wrong = missed = 0
    for text, gold in lines:
        found = set(pii.field_spans(text, weights))
        hits, wrong, missed = hits + len(found & set(gold)), wrong + len(found - set(gold)), missed + len(set(gold) - found)
    return hits / (hits + wrong), hits / (hits + missed)


def test_field_finds_held_back_lines():
    weights = pii.trained()
    assert min(measured(pii.examples(300, seed=77), weights)) > 0.95
    assert pii.find("Plain words, version 3 of 2024-01-02, 12:30, 1,234,567 and page 12 of 300.", weights) == ([], [])
    assert pii.find("In 1999 and 2004 some 300 people; see 12 34 56 or 3.14159 at 10:20:30.", weights) == ([], [])


#: Spans that match none of the usual forms, and that no training line writes in this way.
UNUSUAL = [
    ("tel 06.12.34.56.78 now", "06.12.34.56.78", "phone"),
    ("phone: 06-12-34-56-78, ask", "06-12-34-56-78", "phone"),
    ("call 030/1234567 today", "030/1234567", "phone"),
    ("her ssn is 123.45.6789 she said", "123.45.6789", "ssn"),
    ("social security 987 65 4321 there", "987 65 4321", "ssn"),
    ("host 2001:db8:1::8a2e:370 is up", "2001:db8:1::8a2e:370", "ip"),
    ("server fe80::1ff:fe23:4567:890a here", "fe80::1ff:fe23:4567:890a", "ip"),
    ('key = "aB3/dE5+gH7iJ9kL1mN3oP5qR7==" end', "aB3/dE5+gH7iJ9kL1mN3oP5qR7==", "secret"),
]


def test_field_finds_spans_of_no_usual_form():
    weights = pii.trained()
    right = 0
    for text, span, kind in UNUSUAL:
        assert not any(f.fullmatch(span) for f in pii._FORMS.values()), span
        at = text.index(span)
        right += pii.field_spans(text, weights) == [(at, at + len(span), kind)]
    assert right >= 7


def test_entities_are_found_at_every_offset():
    weights = pii.trained()
    for fill in ("12 ", "a "):
        for shift in range(0, 300, 1 if fill == "12 " else 7):
            text = fill * shift + "call (651) 555-8500 now"
            at = text.index("(651)")
            assert (at, at + 14, "phone") in pii.field_spans(text, weights), (fill, shift)


def dense(kind, n, seed=1):
    """n rows of text that is mostly numbers."""
    rng = random.Random(seed)
    number = lambda: str(rng.randrange(10 ** rng.randint(2, 4)))
    make = {
        "csv": lambda: ",".join(number() for _ in range(12)),
        "table": lambda: " ".join(number() for _ in range(12)),
        "log": lambda: f"2024-0{rng.randint(1, 9)}-{rng.randint(10, 28)} {rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}.{number()} INFO worker {number()} took {number()} ms",
        "prose": lambda: "Plain words that hold no number at all, and one line like any other. " + (number() if rng.random() < 0.2 else ""),
    }
    return "\n".join(make[kind]() for _ in range(n))


def test_numbers_alone_are_no_accounts_and_few_cards():
    weights = pii.trained()
    for kind in ("csv", "table", "log"):
        for seed in range(3):
            text = dense(kind, 90, seed)
            added = [(text[a:b], k) for a, b, k in pii.field_spans(text, weights)]
            assert not [x for x in added if x[1] == "iban"], kind
            assert not [x for x in added if x[1] == "card"], (kind, added)
    assert [k for *_, k in pii.field_spans("card 4111 1111 1111 1111 and 4111-1111-1111-1111", weights)] == ["card", "card"]


def test_time_on_numbers():
    """Lines of numbers cost a bounded multiple of ordinary text."""
    weights = pii.trained()

    def took(kind):
        text = dense(kind, 400)
        began = time.process_time()
        pii.find(text, weights)
        return (time.process_time() - began) / len(text) * 1e9

    seconds = {kind: min(took(kind) for _ in range(2)) for kind in ("csv", "table", "log", "prose")}
    assert seconds["csv"] < 6_000 and seconds["log"] < 20_000 and seconds["table"] < 30_000, seconds


def test_long_regions_are_not_cut():
    weights = pii.trained()
    line = "call (651) 555-8500, "
    for shift in range(12):
        text = "a " * shift + line * 60
        want = {(m.start(), m.end(), "phone") for m in re.finditer(r"\(651\) 555-8500", text)}
        assert set(pii.field_spans(text, weights)) == want


def test_rows_of_all_kinds(spark):
    texts = [None, "", "mail a.b@c.de or 1.2.3.4", 'token = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e"', "é a@b.cc é +1 (651) 555-8500", "x" * 3_000 + " q@r.st"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, "a@b.cc", "z"), (2, texts[2], "z")], "doc_id bigint, text string, id string")
    rows = pii.find_pii(docs, with_text=True).collect()
    assert len(rows) == 8
    by = {r.id: r for r in rows}
    for i, t in enumerate(texts):
        base = plain_base(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert by[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [by[i].n_email, by[i].n_ip, by[i].n_card, by[i].n_phone] == [sum(k == x for *_, k in base) for x in pii.BASE]
        assert set(filter(None, joined.split(","))) <= set(by[i].spans.split(","))
    assert by[2].redacted_text == "mail <EMAIL> or <IP>" and by[3].redacted_text == 'token = "<SECRET>"' and by[0].redacted_text is None
    assert pii.find_pii(docs.where("false")).count() == 0
