"""Sum-of-squares online packing of token sequences into fixed windows.

Each task packs the documents it reads, in their order. A level array counts the partially filled windows at each fill level.
A document's tokens go where the sum of the squared counts grows least: on top of a window at some level, into a new one, or cut,
with the first part filling a window up and the rest placed anew. A cut counts as `cut_cost` squares, so documents stay whole
while levels are spread out, and no level gathers many windows: a level that has some is cheaper to fill up than to add to. Of equal
places the one without a cut goes first, then the fullest. Documents longer than a window fill whole windows first. At the task's end the least filled
windows are emptied into the others by the same rule, so a task pads one window: less than 4,096 ids, of some 30 million in a
task of 128 MB. What shares a window depends on how rows are dealt to tasks; a task that runs again gives the same rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import words as W

WINDOW = 4096
END_ID = 2
#: What a cut counts for, beside the squares.
CUT_COST = 8
PIECES = "id {}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
#: Pre-tokens and words known to an encoder before it starts anew.
CACHED = 400_000


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


_PLAIN = _bytes((0x21, 0x7E))
_KIND = np.zeros(256, np.uint8)  # of lower-cased bytes: 1 letters, 2 digits, 0 others
_KIND[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[0x30:0x3A] = 2


class Encoder:
    """Ids of texts by a tokenizer whose pre-tokens never span white space, with each different pre-token encoded once.

    Words of printable ASCII and Latin-1 letters are cut into pre-tokens here, for a whole slice of texts at once, and each different pre-token
    goes to the tokenizer's BPE model; words with an apostrophe are cut by its own pattern; all other words, and those that may
    hold a special token, go through the whole tokenizer.
    """

    # The tokenizer's fixed split pattern, narrowed to the characters of simple words.
    _PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
    _SIMPLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    _SALT = np.uint64(0x5DEECE66D5DEECE6)

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[int, list[int]] = {}
        # Byte-level BPE's fixed alphabet: printable Latin-1 stands for itself, the other bytes for U+0100 on.
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.byte_chars = dict(zip((b for b in range(256) if b not in plain), map(chr, range(256, 512)), strict=False))

    def _part(self, part: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(part.decode() if part.isascii() else part.decode("latin-1").translate(self.byte_chars))]

    def word(self, word: str) -> list[int]:
        if self._SIMPLE.fullmatch(word) and "<|" not in word:
            return [i for p in self._PRE.findall(word.lower()) for i in self._part(p.encode())]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    @staticmethod
    def parts(texts: W.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes, begins and ends of the parts, and which of them are pre-tokens; the others are whole words."""
        data = texts.data
        w = W.words(texts, W.NOT_SPACE)
        # A Latin-1 letter is C3 and one byte more, but not 97 or B7, the signs of multiplication and division.
        after = np.empty_like(data)
        after[:-1], after[-1:] = data[1:], 0
        leads = data == 0xC3
        pair = leads & (after != 0x97) & (after != 0xB7)
        second = np.concatenate([[False], pair[:-1]])
        odd = ~(_PLAIN[data] | pair | second) | (data == 0x27) | ((data == 0x3C) & (after == 0x7C))
        low = data + (((data >= 0x41) & (data <= 0x5A)) | (second & (data >= 0x80) & (data <= 0x9E))).astype(np.uint8) * np.uint8(0x20)
        seen = np.concatenate([[0], np.cumsum(odd)])
        simple = seen[w.ends] == seen[w.starts]
        inside = np.zeros(len(data) + 1, np.int8)
        inside[w.starts[simple]] = 1
        np.subtract.at(inside, w.ends[simple], 1)
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        kind = _KIND[low]
        begins = np.zeros(len(data), bool)
        begins[1:] = inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
        begins[w.starts] = True
        starts = np.flatnonzero(begins)
        of = np.cumsum(begins)[w.starts] - 1  # each word's first part
        word = np.repeat(np.arange(len(w.starts)), np.diff(np.append(of, len(starts))))
        ends = np.minimum(np.append(starts[1:], len(data)), w.ends[word])
        return low, starts, ends, simple[word]

    def encode(self, texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and where each row's begin."""
        if not len(texts.data):
            return np.zeros(0, np.uint32), np.zeros(len(texts.offsets), np.int64)
        low, starts, ends, simple = self.parts(texts)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts.offsets), np.int64)
        if len(self.known) > CACHED:
            self.known.clear()
        hashes = W.spans_hash(low, starts, ends)
        if not simple.all():
            hashes[~simple] = W.spans_hash(texts.data, starts[~simple], ends[~simple]) ^ self._SALT
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        raw, lowered, known = texts.data.tobytes(), low.tobytes(), self.known
        got = []
        for h, a, z, pre in zip(distinct.tolist(), starts[first].tolist(), ends[first].tolist(), simple[first].tolist(), strict=True):
            ids = known.get(h)
            if ids is None:
                ids = known[h] = self._part(lowered[a:z]) if pre else self.word(raw[a:z].decode())
            got.append(ids)
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum()))
        begins = np.cumsum(sizes) - sizes
        count = sizes[back]
        at = np.cumsum(count)
        ids = flat[np.repeat(begins[back] - (at - count), count) + np.arange(at[-1])]
        return ids, np.concatenate([[0], at])[np.searchsorted(starts, texts.offsets)]


class Packer:
    """The open windows of one task. A piece is (row, start, ids); placed pieces leave as (sequence, offset, row, start, ids)."""

    def __init__(self, window: int = WINDOW, cut_cost: int = CUT_COST, first_sequence: int = 0) -> None:
        self.window, self.cut_cost, self.next_sequence = window, cut_cost, first_sequence
        #: level array: partially filled windows at each fill
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = {}
        self.n_open = 0

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for row, start, ids in pieces:
            yield self.next_sequence, offset, row, start, ids
            offset += len(ids)
        self.next_sequence += 1

    def choose(self, size: int, may_open: bool = True) -> tuple[int, int]:
        """(level, growth of the squares with what a cut costs) of the best place for a piece; level 0 is a new window. A level above window - size means a cut."""
        n, w = self.levels, self.window
        best, grows = 0, int(2 * n[size] + 1) if may_open or not self.n_open else 1 << 62
        # On top of a window: 2n+1 at the level that gains one, 1-2n at the one that loses it; full windows don't count.
        at = np.flatnonzero(n[: w - size + 1])
        if len(at):
            gains = np.where(at + size < w, 2 * n[at + size] + 1, 0) - 2 * n[at] + 1
            k = len(at) - 1 - int(np.argmin(gains[::-1]))
            if gains[k] <= grows:
                best, grows = int(at[k]), int(gains[k])
        # Filling a window up: the level loses one, and the rest is a window of its own.
        at = np.flatnonzero(n[w - size + 1 :]) + (w - size + 1)
        if len(at):
            gains = 2 * (n[at + size - w] - n[at]) + 2 + self.cut_cost
            k = len(at) - 1 - int(np.argmin(gains[::-1]))
            if gains[k] < grows:
                best, grows = int(at[k]), int(gains[k])
        return best, grows

    def _take(self, level: int) -> list[tuple]:
        self.levels[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _place(self, row: tuple, start: int, ids: np.ndarray, may_open: bool = True) -> Iterator[tuple]:
        while len(ids):
            level, _ = self.choose(len(ids), may_open)
            pieces = self._take(level) if level else []
            part, ids = ids[: self.window - level], ids[self.window - level :]
            pieces.append((row, start, part))
            start += len(part)
            if (full := level + len(part)) == self.window:
                yield from self._close(pieces)
                continue
            self.levels[full] += 1
            self.open.setdefault(full, []).append(pieces)
            self.n_open += 1

    def add(self, row: tuple, ids: np.ndarray) -> Iterator[tuple]:
        whole = len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            yield from self._close([(row, start, ids[start : start + self.window])])
        yield from self._place(row, whole, ids[whole:])

    def finish(self) -> Iterator[tuple]:
        """Empties the least filled window into the others, by the same squares but without new windows, until one is left, which is padded."""
        while self.n_open > 1:
            for row, start, ids in self._take(int(np.flatnonzero(self.levels)[0])):
                yield from self._place(row, start, ids, may_open=False)
        for level in np.flatnonzero(self.levels).tolist():
            yield from self._close(self._take(level))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, cut_cost: int = CUT_COST) -> DataFrame:
    """Pieces of all rows: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A row's ids are those of its text, then end_id, so null and empty texts have one; each id is in one piece. Sequences hold at
    most `window` ids, laid from 0 without gaps. Repeated rows are packed each by itself; null ids are kept; other columns are not
    read; an empty table gives no pieces. A sequence's number is the task's number times 2**40 and a count.
    """
    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = read.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        context = TaskContext.get()
        packer = Packer(window, cut_cost, (context.partitionId() if context else 0) << 40)
        placed: list[tuple] = []
        id_type = None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*placed, strict=True))
            out = pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            placed.clear()
            return out

        def put(pieces: Iterator[tuple]) -> None:
            for sequence, offset, (key, tokens), start, ids in pieces:
                placed.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, sequence, offset))

        for batch in batches:
            id_type = batch.column(0).type
            for texts in W.slices(batch.column(1)):
                ids, bounds = encoder.encode(texts)
                for i, key in enumerate(batch.column(0).slice(texts.first, texts.last - texts.first).to_pylist()):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id))
                    put(packer.add((key, len(own)), own))
                if placed:
                    yield flush()
        put(packer.finish())
        if placed:
            yield flush()

    return read.mapInArrow(run, PIECES.format(kind))
