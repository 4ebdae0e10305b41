from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa

from palimpsest.llm import packing
from palimpsest.llm import words as W
from palimpsest.llm.queries import tokenizer_path


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    texts = ["", " ", "It's we'll 'tis don''t I'M", "ÀÉß×÷ µm² x³ ½", "a b c\x1cd", "<|endoftext|> x<|endoftext|>", "é ｆｕｌｌ ﬁ 漢字 🎉👩‍👩‍👧", "12345 3.14 $%&!! __ -- a_b", "\tx\r\ny\x0bz\x0c", "İstanbul ΣΑΣ", "a" * 3000]
    encoder = packing.Encoder(tokenizer_path())
    for t in [texts, texts * 2]:
        ids, bounds = [], [0]
        for s in W.slices(pa.array(t)):
            got, b = encoder.encode(s)
            ids += got.tolist()
            bounds += (b[1:] + bounds[-1]).tolist()
        for k, text in enumerate(t):
            assert ids[bounds[k] : bounds[k + 1]] == whole.encode(text, add_special_tokens=False).ids, text


def test_ids_of_random_texts_are_the_tokenizers():
    from tokenizers import Tokenizer

    whole, rng = Tokenizer.from_file(tokenizer_path()), random.Random(8)
    signs = [*"aZbé×÷ßÿÀÞªµ²¼09'<|>.,-_/ \t\n", "'s", "'LL", "the", "<|", "ing ", "é", "Ω", "ǅ", "漢", "\x7f", "\xad", "\x85", "\xa0"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    encoder = packing.Encoder(tokenizer_path())
    for s in W.slices(pa.array(texts), most=20_000):
        ids, bounds = encoder.encode(s)
        for k in range(s.last - s.first):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == whole.encode(texts[s.first + k], add_special_tokens=False).ids, texts[s.first + k]


def test_each_piece_goes_where_squares_grow_least():
    rng = random.Random(2)
    for cost in (0, 2, 50):
        packer = packing.Packer(window=16, cut_cost=cost)
        for k in range(400):
            size = rng.randint(1, 15)
            before = packer.levels.copy()
            now = int((before[:16] ** 2).sum())
            choices = []
            for level in [0, *np.flatnonzero(before).tolist()]:
                after = before.copy()
                after[level] -= level > 0
                over = level + size - 16
                after[over if over > 0 else level + size] += over != 0
                choices.append(int((after[1:16] ** 2).sum()) - now + cost * (over > 0))
            assert packer.choose(size)[1] == min(choices)
            placed = list(packer.add((k, size), np.zeros(size, np.uint32)))
            assert packer.n_open == packer.levels.sum() and not any(p[4].size > 16 for p in placed)


def test_long_pieces_stay_in_few_windows():
    """No two of these share a window, so only cuts can fill them; each is placed by squares, whatever their number."""
    rng = random.Random(4)
    packer, sizes, most, sequences = packing.Packer(), [rng.randint(2100, 4000) for _ in range(30_000)], 0, {}
    for k, n in enumerate(sizes):
        for sequence, _, _, _, ids in packer.add((k, n), np.zeros(n, np.uint8)):
            sequences[sequence] = sequences.get(sequence, 0) + len(ids)
        most = max(most, packer.n_open)
    for sequence, _, _, _, ids in packer.finish():
        sequences[sequence] = sequences.get(sequence, 0) + len(ids)
    assert most < 5000 and sum(sequences.values()) == sum(sizes)
    assert len(sequences) * 4096 - sum(sizes) < 4096


def check(pieces, ids_of, window):
    """Every id once, sequences laid without gaps, sums right."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p[0], []).append(p)
        by_sequence.setdefault(p[5], []).append(p)
    for key, ids in ids_of.items():
        at = 0
        for _, start, length, crc, total, *_ in sorted(by_doc[key], key=lambda p: p[1]):
            assert start == at and total == len(ids)
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p[6]):
            assert p[6] == at
            at += p[2]
        assert at <= window
    return len(by_sequence)


def test_pieces_cover_all_ids(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice(["ab", "cd", "Ef", "1", "--"]) for _ in range(rng.choice([0, 1, 3, 50, 700]))) for i in range(60)} | {100: None, 101: "", 102: "x " * 9000}
    docs = spark.createDataFrame([(i, t, 5) for i, t in texts.items()], "doc_id bigint, text string, offset int").repartition(3)
    ids_of = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    for window, cost in ((4096, 8), (64, 0)):
        rows = [tuple(r) for r in packing.pack(docs, tokenizer_path(), window=window, cut_cost=cost).collect()]
        n = check(rows, ids_of, window)
        total = sum(map(len, ids_of.values()))
        assert n * window - total <= 3 * window  # each task pads one window
    assert packing.pack(docs.where("false"), tokenizer_path()).count() == 0


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "c"), (1, "c")], "doc_id bigint, text string")
    rows = packing.pack(docs, tokenizer_path()).collect()
    assert sorted((r.id is None, r.length) for r in rows) == [(False, 2), (False, 2), (True, 3)]
