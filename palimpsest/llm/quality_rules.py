"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text is rejected.

Punctuation: too many symbols or exclamation marks, or a long line that doesn't end like a sentence. Navigation: words with separators
between them, or a run of short lines that end without a mark, blank lines aside. Boilerplate: lines that the text has had, lines of few
different words, and fixed phrases.

Letters and marks are told by Unicode's categories. A menu's lines hold two words at most on the average, so verses stay, and a line that begins with a
number and goes on counts as a long one, so lists of quantities stay. Lines that begin like titles are a menu anywhere; those that begin with
a small letter or with one of a script without capitals only before a text's first sentence or behind its last. Two characters of Chinese or
Japanese count as a word there. A long line may end with a letter of a script without capitals, as some of these have no marks between sentences.

All counts come from whole slices of a batch at once: a byte table marks words, symbols and letters, running sums give the
counts of each line and document, and hashes of words, five-word windows and lines find what repeats.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import words as W


class Rules(NamedTuple):
    """Limits in hundredths, compared as whole numbers. Line rules fail a line; max_lost rejects the document."""

    #: symbols for each word character
    max_symbols: int = 10
    #: words of a line from which its shares of marks and bars count
    min_words: int = 4
    #: exclamation marks, and words that are a separator, for each word
    max_marks: int = 60
    max_bars: int = 20
    #: words of a menu's line at most, and such lines after each other from which they are a menu
    max_menu_words: int = 4
    min_menu_lines: int = 3
    #: their words on the average; word characters from which a line of so few words may be a sentence
    mean_menu_words: int = 200
    min_sentence_chars: int = 20
    #: words of a line from which too few different words make it boilerplate
    min_varied: int = 10
    max_same: int = 80
    #: words of a line from which it must end like a sentence
    min_sentence: int = 12
    #: word characters that failing lines may hold
    max_lost: int = 50
    #: base limits of a document
    min_doc_words: int = 10
    max_repeat: int = 20


SYMBOLS = "#*$%&|<>"
ENDS = ".!?:;\"')"
#: Signs that stand between links.
SEPARATORS = ["|", "/", ">", "»", "›", "·", "•"]
#: Fixed phrases of pages' furniture, in lower case.
PHRASES = [
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "click here to", "skip to content", "share on facebook", "subscribe to our newsletter",
]

#: First and last characters of the scripts that are written without spaces and with characters for words or syllables.
DENSE = [("\u3040", "\u30ff"), ("\u3400", "\u9fff"), ("\uf900", "\ufaff")]

#: Kinds of a line's first and last character.
_OTHER, _CLOSING, _SMALL, _CAPITAL, _BARE, _SIGN, _DIGIT = range(7)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_separators = next(W.slices(pa.array([" ".join(SEPARATORS)])))
_SEPARATORS = W.spans_hash(_separators.data, *W.words(_separators, W.NOT_SPACE)[:2])
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _running(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])


def _kind(point: int) -> int:
    c = chr(point)
    category = unicodedata.category(c)
    if c in ENDS:
        return _CLOSING
    if category in ("Ll", "Lu", "Lt", "Lo"):
        return {"Ll": _SMALL, "Lo": _BARE}.get(category, _CAPITAL)
    if point < 0x80:
        return _DIGIT if c.isdigit() else _OTHER
    return _SIGN if category[0] in "LMN" else _CLOSING


def _points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the characters that begin at these places."""
    lead, *rest = (data[np.minimum(at + k, len(data) - 1)].astype(np.int64) for k in range(4))
    a, b, c = (x & 0x3F for x in rest)
    wide = (lead & 7) << 18 | a << 12 | b << 6 | c
    return np.select([lead < 0x80, lead < 0xE0, lead < 0xF0], [lead, (lead & 0x1F) << 6 | a, (lead & 0xF) << 12 | a << 6 | b], np.minimum(wide, 0x10FFFF))


def _kinds(points: np.ndarray) -> np.ndarray:
    different, back = np.unique(points, return_inverse=True)
    return np.array([_kind(int(x)) for x in different], np.uint8)[back]


class Judged(NamedTuple):
    counts: dict[str, np.ndarray]
    base_failed: np.ndarray
    kept: np.ndarray
    lost_chars: np.ndarray
    line_starts: np.ndarray
    line_ends: np.ndarray
    line_bounds: np.ndarray
    line_fails: np.ndarray


def judge(texts: W.Texts, rules: Rules) -> Judged:
    data, offsets = texts.data, texts.offsets
    w = W.words(texts, W.NOT_SPACE)
    hashes = W.spans_hash(data, w.starts, w.ends)
    # Lines: each row is cut at "\n", and has one line more than it has of those.
    breaks = np.flatnonzero(data == 0x0A)
    per_row = np.diff(np.searchsorted(breaks, offsets)) + 1
    line_bounds = np.concatenate([[0], np.cumsum(per_row)])
    starts, ends = np.empty(line_bounds[-1], np.int64), np.empty(line_bounds[-1], np.int64)
    first, last = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    first[line_bounds[:-1]], last[line_bounds[1:] - 1] = True, True
    starts[first], ends[last] = offsets[:-1], offsets[1:]
    starts[~first], ends[~last] = breaks + 1, breaks
    line_words = np.searchsorted(w.starts, np.concatenate([starts, offsets[-1:]]))
    n_words = np.diff(line_words)

    chars = _running(W.NOT_SPACE[data] & ((data & 0xC0) != 0x80))
    symbols, marks = _running(_SYMBOL[data]), _running(data == 0x21)
    bars = _running(np.isin(hashes, _SEPARATORS))
    line_chars = chars[ends] - chars[starts]
    n_symbols, n_marks = symbols[ends] - symbols[starts], marks[ends] - marks[starts]
    n_bars = bars[line_words[1:]] - bars[line_words[:-1]]
    _, distinct = W.distinct_sorted(hashes, line_words)
    n_distinct = np.diff(distinct)
    has = n_words > 0
    worded = np.flatnonzero(has)
    last_char = w.ends[line_words[1:][has] - 1] - 1
    for _ in range(3):
        last_char -= (data[last_char] & 0xC0) == 0x80
    begins = _points(data, w.starts[line_words[:-1][has]])
    head, tail = _kinds(begins), _kinds(_points(data, last_char))
    ended = np.zeros(len(starts), bool)
    ended[worded] = np.isin(tail, (_CLOSING, _BARE, _SIGN)) | (n_words[worded] < rules.min_sentence)

    # Menus: the lines with words that follow each other and look like links, counted in runs.
    words, held = n_words[worded], line_chars[worded]
    dense = np.zeros(len(worded), bool)
    for low, high in DENSE:
        dense |= (begins >= ord(low)) & (begins <= ord(high))
    length = np.where((head == _DIGIT) & (words > 1), np.maximum(words, rules.max_menu_words), np.where(dense, np.maximum(words, (held + 1) // 2), words))
    line_row = np.repeat(np.arange(len(per_row)), per_row)[worded]
    place = np.arange(len(worded))
    said = np.flatnonzero((tail == _CLOSING) & ((words > rules.max_menu_words) | (held >= rules.min_sentence_chars)))
    first_said, last_said = np.full(len(per_row), -1), np.full(len(per_row), len(worded))
    first_said[line_row[said[::-1]]], last_said[line_row[said]] = said[::-1], said
    outside = (place < first_said[line_row]) | (place > last_said[line_row])
    link = (length <= rules.max_menu_words) & (tail != _CLOSING) & (outside | ~np.isin(head, (_SMALL, _BARE, _SIGN)))
    run = np.cumsum(np.concatenate([[True], (link[1:] != link[:-1]) | (line_row[1:] != line_row[:-1])])) if len(worded) else np.zeros(0, np.int64)
    lines_of = np.bincount(run)
    menu = np.zeros(len(starts), bool)
    menu[worded] = link & (lines_of >= rules.min_menu_lines)[run] & (100 * np.bincount(run, length) <= rules.mean_menu_words * lines_of)[run]

    # Lines with a word that equal an earlier line of their row.
    row = np.repeat(np.arange(len(per_row)), per_row)
    line_hash = W.spans_hash(data, starts, ends)
    order = np.lexsort((np.arange(len(row)), line_hash, row))
    repeated = np.zeros(len(row), bool)
    repeated[order[1:]] = (line_hash[order[1:]] == line_hash[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    repeated &= has

    furniture = np.zeros(len(starts), bool)
    lowered = _LOWER[data].tobytes()
    for phrase in PHRASES:
        at = lowered.find(phrase.encode())
        while at >= 0:
            line = int(np.searchsorted(starts, at, "right")) - 1
            if at + len(phrase) <= ends[line]:
                furniture[line] = True
            at = lowered.find(phrase.encode(), at + 1)

    enough = n_words >= rules.min_words
    fails = (
        (100 * n_symbols > rules.max_symbols * line_chars)
        | (enough & (100 * n_marks > rules.max_marks * n_words))
        | (enough & (100 * n_bars >= rules.max_bars * n_words))
        | ((n_words >= rules.min_varied) & (100 * (n_words - n_distinct) >= rules.max_same * n_words))
        | ~ended
        | menu
        | repeated
        | furniture
    ) & has

    # Five-word windows that occur again in their row mark their words.
    grams, gram_bounds = W.ngrams(hashes, w.bounds, 5)
    gram_row = np.repeat(np.arange(len(gram_bounds) - 1), np.diff(gram_bounds))
    order = np.lexsort((grams, gram_row))
    same = (grams[order[1:]] == grams[order[:-1]]) & (gram_row[order[1:]] == gram_row[order[:-1]])
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    begins = w.bounds[:-1][gram_row[twice]] + np.flatnonzero(twice) - gram_bounds[:-1][gram_row[twice]]
    delta = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(delta, begins, 1)
    np.add.at(delta, begins + 5, -1)
    again = _running(np.cumsum(delta[:-1]) > 0)

    by_row = lambda running: running[offsets[1:]] - running[offsets[:-1]]
    sum_lines = lambda v: (t := _running(v))[line_bounds[1:]] - t[line_bounds[:-1]]
    counts = {
        "n_words": np.diff(w.bounds), "word_chars": by_row(chars), "n_symbols": by_row(symbols),
        "n_dup_lines": sum_lines(repeated), "n_repeat_words": again[w.bounds[1:]] - again[w.bounds[:-1]],
    }
    base_failed = (counts["n_words"] < rules.min_doc_words) | (100 * counts["n_repeat_words"] > rules.max_repeat * counts["n_words"])
    lost = sum_lines(np.where(fails, line_chars, 0))
    kept = ~base_failed & (100 * lost <= rules.max_lost * counts["word_chars"])
    return Judged(counts, base_failed, kept, lost, starts, ends, line_bounds, fails)


def clean_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules | None = None, keep_columns: bool = False, with_text: bool = True
) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_removed, lost_chars, base_failed, kept, clean_text.

    kept is false if the base limits fail, or if failing lines hold more than max_lost hundredths of the word characters.
    clean_text has the other lines, in order; blank lines stay. Null and empty texts have no words, so they fail the base limits,
    and their clean_text is as given. Of equal lines in a text the first stays. Repeated rows are judged one by one.
    keep_columns: instead, the input's rows and columns for kept rows, with the clean text in place of the text.
    """
    rules = rules or Rules()
    if keep_columns:
        read, at, out = docs, docs.columns.index(text_col), docs.schema
    else:
        read, at = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")), 1
        kind = read.schema["_id"].dataType.simpleString()
        out = f"id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", n_lines_removed bigint, lost_chars bigint, base_failed boolean, kept boolean" + ", clean_text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in W.slices(batch.column(at)):
                n = texts.last - texts.first
                part = batch.slice(texts.first, n)
                got = judge(texts, rules)
                fails = np.add.reduceat(got.line_fails.astype(np.int64), got.line_bounds[:-1])
                column = part.column(at)
                if keep_columns or with_text:
                    clean = column.to_pylist()
                    for i in np.flatnonzero((fails > 0) & got.kept if keep_columns else fails > 0):
                        a, z = got.line_bounds[i], got.line_bounds[i + 1]
                        good = a + np.flatnonzero(~got.line_fails[a:z])
                        clean[i] = b"\n".join(texts.data[got.line_starts[k] : got.line_ends[k]].tobytes() for k in good).decode()
                    column = pa.array(clean, column.type)
                if keep_columns:
                    columns = [column if k == at else part.column(k) for k in range(part.num_columns)]
                    yield pa.RecordBatch.from_arrays(columns, part.schema.names).filter(pa.array(got.kept))
                    continue
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(got.counts[c].astype(np.int64)) for c in COUNTS), pa.array(fails), pa.array(got.lost_chars.astype(np.int64)), pa.array(got.base_failed), pa.array(got.kept)] + [column] * with_text,
                    ["id", *COUNTS, "n_lines_removed", "lost_chars", "base_failed", "kept"] + ["clean_text"] * with_text,
                )

    return read.mapInArrow(run, out)
