from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest

from palimpsest.llm.components import connected
from palimpsest.llm import ngram_join
from palimpsest.llm.keyfilter import key_filter
from palimpsest.llm.ngram_join import _POSTING, Linker, Trie, _anchored, _Labels, jaccard_components, needed


def roots(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def grams(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, percent=80):
    sets = [grams(t) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = roots(len(rows), links)
    return [(rows[i][0], len(sets[i]), min((rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None), default=None)) for i in range(len(rows))]


def near_copies(rng, families, copies, words=60, edits=3):
    out = []
    vocabulary = [f"w{k}" for k in range(400)]
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, words))]
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                k = rng.randrange(len(own))
                own[k : k + rng.randint(0, 1)] = [rng.choice(vocabulary) for _ in range(rng.randint(0, 2))]
            out.append(" ".join(own))
    return out


def test_trie_links_what_all_pairs_link():
    rng = random.Random(1)
    for _ in range(200):
        base = [rng.sample(range(200), rng.randint(1, 40)) for _ in range(4)]
        sets = []
        for _ in range(rng.randint(2, 25)):
            own = set(rng.choice(base))
            for _ in range(rng.randint(0, 6)):
                own.symmetric_difference_update({rng.choice(sorted(own)) if own and rng.random() < 0.5 else rng.randrange(200)})
            sets.append(np.array(sorted(own or {5}), np.uint64))
        truth = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))]
        assert sorted((min(x, y), max(x, y)) for y, found in Trie(sets).walk(80) for x in found.tolist()) == truth


def test_every_linked_pair_shares_enough_of_its_prefixes():
    rng = random.Random(2)
    for _ in range(300):
        x = set(rng.sample(range(10_000), rng.randint(1, 120)))
        y = set(x)
        for _ in range(rng.randint(0, max(1, len(x) // 6))):
            y.symmetric_difference_update({rng.choice(sorted(x)) if rng.random() < 0.5 else rng.randrange(10_000)})
        if not y or 100 * len(x & y) < 80 * len(x | y):
            continue
        prefix = []
        least = []
        for s in (x, y):
            length, t = needed(np.array([len(s)]), 80)
            prefix.append(set(sorted(s)[: int(length[0])]))
            least.append(int(t[0]))
        assert len(prefix[0] & prefix[1]) >= max(least)


def test_anchors_hold_every_fitting_pair():
    rng = random.Random(3)
    table = np.zeros(400, _POSTING)
    sizes = {c: rng.randint(1, 60) for c in range(40)}
    table["gram"] = [rng.randrange(60) for _ in table]
    table["cls"] = [rng.randrange(40) for _ in table]
    table["n"] = [sizes[int(c)] for c in table["cls"]]
    table = np.unique(table)
    groups: dict[int, set[int]] = {}
    for a, c, _, _ in _anchored(table, 80).tolist():
        groups.setdefault(a, set()).add(c)
    for g in range(60):
        own = sorted(set(table["cls"][table["gram"] == g].tolist()))
        for x, y in itertools.combinations(own, 2):
            if 100 * min(sizes[x], sizes[y]) >= 80 * max(sizes[x], sizes[y]):
                assert any({x, y} <= m for m in groups.values())


@pytest.mark.parametrize("group_sets", [512, 3])
def test_components_by_brute_force(spark, group_sets):
    rng = random.Random(4)
    texts = near_copies(rng, 25, 9)
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, " \t"), (1003, "one"), (1004, "ONE"), (1005, texts[0].upper()), (None, texts[0]), (None, "lonely words here"), (7, texts[7]), (7, texts[7])]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, n int, cls string").repartition(4)
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in jaccard_components(docs, group_sets=group_sets).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_stars_find_components(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(60)]
    links = chain + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(200, 200), (300, 301), (301, 300)]
    want = roots(302, links)
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def links(sets):
    return [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))]


@pytest.mark.parametrize("walk_bytes", [1 << 25, 500])
def test_trie_reports_every_pair_once(monkeypatch, walk_bytes):
    monkeypatch.setattr(ngram_join, "WALK_BYTES", walk_bytes)
    rng = random.Random(6)
    for _ in range(60):
        base = rng.sample(range(200), 40)
        sets = []
        for _ in range(rng.randint(2, 25)):
            own = set(base)
            for _ in range(rng.randint(0, 6)):
                own.symmetric_difference_update({rng.randrange(200)})
            sets.append(np.array(sorted(own), np.uint64))
        truth = links(sets)
        assert sorted((min(x, y), max(x, y)) for y, found in Trie(sets).walk(80) for x in found.tolist()) == truth
        cut = len(sets) // 2
        across = sorted((x, y + cut) for y, found in Trie(sets[cut:]).walk(80, sets[:cut]) for x in found.tolist()) if cut else []
        assert across == [(i, j) for i, j in truth if i < cut <= j]
        names = np.arange(len(sets)) + 100
        linker = Linker(5, names, np.ones(len(sets), np.int64), None, np.arange(len(sets)))
        at = _Labels(linker, np.arange(len(sets)))
        for y, found in Trie(sets).walk(80, None, at, at):
            linker.add(y, found)
        assert roots(len(sets), linker.joins) == roots(len(sets), truth) and len(linker.joins) == len(sets) - len(set(roots(len(sets), truth)))


def test_a_pair_counts_at_the_least_common_anchor():
    linker = Linker(7, np.array([1, 2, 3]), np.array([1, 10, 100]), [np.array([4, 7]), np.array([4, 7, 9]), np.array([5, 7])], np.arange(3))
    linker.add(2, np.array([0, 1]))
    linker.add(1, np.array([0]))
    assert linker.links.tolist() == [100, 100, 11]


def test_key_filter_holds_all_its_keys(spark):
    rng = np.random.Generator(np.random.PCG64(1))
    keys = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, 5000))
    table = spark.createDataFrame([(int(k),) for k in keys], "k bigint").repartition(3)
    strangers = np.setdiff1d(rng.integers(-(1 << 63), (1 << 63) - 1, 20_000), keys)
    for block_bits in (1 << 25, 1 << 12):
        made = key_filter(table, block_bits)
        assert made.has(keys).all() and made.has(strangers).mean() < 0.05
    full = key_filter(table, 1 << 10, 1 << 11)
    assert full.blocks.size == 256 and full.has(keys).all()
    assert not key_filter(table.limit(0)).has(keys).any()


@pytest.mark.parametrize("group_sets", [512, 3])
def test_links_by_brute_force(spark, group_sets):
    rng = random.Random(7)
    base = [f"w{k}" for k in range(80)]
    copies = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(0, 80, 4)]  # different copies; many pairs of them link
    texts = [*copies, copies[0], copies[0].upper(), *near_copies(rng, 10, 6), None, "", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    sets = [grams(t) for t in texts]
    want = [sum(i != j and bool(a) and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    got = jaccard_components(docs, group_sets=group_sets).orderBy("id").collect()
    assert [r.n_links for r in got] == want and max(want) >= 19
    equal = [min(j for j, b in enumerate(sets) if a == b) if a else i for i, a in enumerate(sets)]
    assert [r.class_id for r in got] == equal
    few = jaccard_components(docs, group_sets=group_sets, components_only=True).orderBy("id").collect()
    assert [(r.id, r.component_id, r.class_id) for r in few] == [(r.id, r.component_id, r.class_id) for r in got] and "n_links" not in few[0]
