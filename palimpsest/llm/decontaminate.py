"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

The items' words become numbers, and one suffix automaton holds all items, kept apart by numbers of their own. Documents are
streamed through it: each word moves to the state of the longest text that ends there and stands in some item. A match of
at least a window's length marks its words as hit, and the states on the way name the items. Words that no item has break
every match, so only runs of known words are walked; they are found for a whole slice of texts at once.

Scale. An automaton takes about 0.75 KB a word, in each Python worker, so items of up to BROADCAST_WORDS words in all are broadcast as one. More items
are never in one place. Their different windows are a table, each with its words and with a hash of the set of items that have it; the hashes of
windows make a filter of bounded size, and a document gets, by an exact join, the windows that it shares, in an automaton of their own. So what
a document gets is bounded by its own words, however many items share a window. Other documents are not shuffled. The items' names are looked
up once for each different combination of sets that documents have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BooleanType, StructType

from palimpsest.llm import words as W
from palimpsest.llm.keyfilter import key_filter
from palimpsest.llm.storage import written

WINDOW = 13
#: Words of all test items up to which they are broadcast: some 150 MB in a worker.
BROADCAST_WORDS = 200_000


class Automaton(NamedTuple):
    #: word hashes in ascending order; a word's number is its place
    vocabulary: np.ndarray
    next: list[dict[int, int]]
    link: list[int]
    length: list[int]
    #: for states that hold windows: (size, items) of the windows of each size, largest first
    items: list[tuple[tuple[int, tuple[int, ...]], ...]]
    #: of each state itself or the nearest one on its failure path that holds windows; 0 if none does
    holder: list[int]
    names: list[str | None]
    shortest: int


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for t in W.slices(pa.array(texts, pa.large_string())):
        w = W.words(t, W.ALNUM)
        h = W.spans_hash(t.data, w.starts, w.ends, lower=True)
        out += [h[w.bounds[i] : w.bounds[i + 1]] for i in range(len(w.bounds) - 1)]
    return out


def build(names: list[str | None], hashes: list[np.ndarray], window: int = WINDOW) -> Automaton:
    """The automaton of all items with words; equal items share states and keep all their names."""
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
    nexts: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    owners: list[dict[int, set[int]]] = [{}]

    def clone_of(q: int, p: int, c: int) -> int:
        nexts.append(dict(nexts[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        owners.append({})
        new = len(nexts) - 1
        link[q] = new
        while p >= 0 and nexts[p].get(c) == q:
            nexts[p][c] = new
            p = link[p]
        return new

    def extend(last: int, c: int) -> int:
        q = nexts[last].get(c)
        if q is not None:
            return q if length[q] == length[last] + 1 else clone_of(q, last, c)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        owners.append({})
        new, p = len(nexts) - 1, last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            link[new] = q if length[q] == length[p] + 1 else clone_of(q, p, c)
        return new

    kept = [i for i, h in enumerate(hashes) if len(h)]
    numbers = {i: np.searchsorted(vocabulary, hashes[i]).tolist() for i in kept}
    for i in kept:
        last = 0
        for c in numbers[i]:
            last = extend(last, c)
    for i in kept:
        # Windows of the item: the state of each, cut back to the state that holds the text of that length.
        size = min(window, len(numbers[i]))
        at = 0
        for k, c in enumerate(numbers[i]):
            at = nexts[at][c]
            while length[link[at]] >= size:
                at = link[at]
            if k + 1 >= size:
                owners[at].setdefault(size, set()).add(i)
    held = [tuple((size, tuple(sorted(o[size]))) for size in sorted(o, reverse=True)) for o in owners]
    holder = [0] * len(nexts)
    for at in sorted(range(1, len(nexts)), key=length.__getitem__):  # a failure arc leads to a shorter text
        holder[at] = at if held[at] else holder[link[at]]
    return Automaton(vocabulary, nexts, link, length, held, holder, names, min((len(numbers[i]) for i in kept), default=window))


def walk(automaton: Automaton, numbers: list[int], window: int) -> tuple[list[tuple[int, int]], set[int]]:
    """Hit spans of a run of known words, end exclusive, and the items whose windows occur in it.

    At each word only states that hold windows are looked at, and as these have at most `window` words each, they are that many at most.
    """
    nexts, link, length, items, holder = automaton.next, automaton.link, automaton.length, automaton.items, automaton.holder
    least = min(window, automaton.shortest)
    state, matched = 0, 0
    spans: list[tuple[int, int]] = []
    occurred: set[tuple[int, int]] = set()  # a window that many items share is looked up once
    for k, c in enumerate(numbers):
        while state and c not in nexts[state]:
            state = link[state]
            matched = length[state]
        if c in nexts[state]:
            state, matched = nexts[state][c], matched + 1
        if matched < least:
            continue
        # The texts that end here, from the longest: a window's text lies in this state or on its failure path.
        longest, at = 0, holder[state]
        reach = matched if at == state else length[at]
        while at:
            for place, (size, _) in enumerate(items[at]):
                if size <= reach:
                    occurred.add((at, place))
                    longest = max(longest, size)
            at = holder[link[at]]
            reach = length[at]
        if longest:
            spans.append((k + 1 - longest, k + 1))
    return spans, {i for at, place in occurred for i in items[at][place][1]}


def _hits(automaton: Automaton, w: W.Words, h: np.ndarray, window: int) -> tuple[np.ndarray, dict[int, set[int]]]:
    """Which words of a slice (with hashes h) are hit, and each row's found items."""
    hit = np.zeros(len(w.starts), bool)
    found: dict[int, set[int]] = {}
    if not len(automaton.vocabulary) or not len(w.starts):
        return hit, found
    number = np.minimum(np.searchsorted(automaton.vocabulary, h), len(automaton.vocabulary) - 1)
    known = automaton.vocabulary[number] == h
    # Runs of known words within a row.
    edge = np.zeros(len(known), bool)
    edge[w.bounds[:-1][w.bounds[:-1] < len(known)]] = True
    begins = np.flatnonzero(known & (edge | ~np.concatenate([[False], known[:-1]])))
    ends = np.flatnonzero(known & np.concatenate([edge[1:] | ~known[1:], [True]])) + 1
    rows = np.searchsorted(w.bounds, begins, "right") - 1
    for b, e, row in zip(begins.tolist(), ends.tolist(), rows.tolist(), strict=True):
        if e - b >= min(window, automaton.shortest):
            spans, items = walk(automaton, number[b:e].tolist(), window)
            for x, y in spans:
                hit[b + x : b + y] = True
            if items:
                found.setdefault(row, set()).update(items)
    return hit, found


def _cut(text: str, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> str:
    """The text without its hit spans, each from its first hit word to the end of its last."""
    if not hit.any():
        return text
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    raw, parts, at = data.tobytes(), [], 0
    for a, b in edges.reshape(-1, 2):
        parts.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*parts, raw[at:]]).decode()


def _hashed(texts: W.Texts) -> tuple[W.Words, np.ndarray]:
    w = W.words(texts, W.ALNUM)
    return w, W.spans_hash(texts.data, w.starts, w.ends, lower=True)


def n_words(table: DataFrame, text_col: str) -> int:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(W.words(t, W.ALNUM).starts) for t in W.slices(batch.column(0)))], pa.int64())], ["n"])

    return table.select(F.col(text_col).cast("string")).mapInArrow(count, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class Output(NamedTuple):
    """What judged rows look like: the input's columns without contaminated rows, or figures with or without the clean text."""

    keep_columns: bool
    with_text: bool
    window: int
    coverage: tuple[int, int]

    def rows(self, part: pa.RecordBatch, column: pa.Array, texts: W.Texts, w: W.Words, hit: np.ndarray, found: dict[int, set[str | None]]) -> pa.RecordBatch:
        """part: the slice's rows, of which the first column is the id unless columns are kept; column: their texts."""
        n = len(w.bounds) - 1
        total = np.concatenate([[0], np.cumsum(hit)])
        words, n_hit = np.diff(w.bounds), total[w.bounds[1:]] - total[w.bounds[:-1]]
        if (self.with_text or self.keep_columns) and n_hit.any():
            clean = column.to_pylist()
            for i in np.flatnonzero(n_hit):
                a, z, o = w.bounds[i], w.bounds[i + 1], texts.offsets[i]
                clean[i] = _cut(clean[i], texts.data[o : texts.offsets[i + 1]], w.starts[a:z] - o, w.ends[a:z] - o, hit[a:z])
            column = pa.array(clean, column.type)
        contaminated = (n_hit > 0) & (self.coverage[1] * n_hit >= self.coverage[0] * words)
        if self.keep_columns:
            at = part.schema.names.index("_text")
            columns = [column if k == at else part.column(k) for k in range(part.num_columns)]
            return pa.RecordBatch.from_arrays(columns, part.schema.names).filter(pa.array(~contaminated))
        names = [",".join(sorted(x for x in found.get(i, ()) if x is not None)) for i in range(n)]
        columns = [
            part.column(0), pa.array(words.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array([len(found.get(i, ())) for i in range(n)], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in names], pa.string()), pa.array(contaminated), *([column] if self.with_text else []),
        ]
        return pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", *(["clean_text"] if self.with_text else [])])


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    coverage: tuple[int, int] = (1, 20),
    broadcast_words: int = BROADCAST_WORDS,
    with_text: bool = True,
    keep_columns: bool = False,
) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated, clean_text.

    A word is hit if it lies in an occurrence of a window of `window` words of an item; an item of fewer words is one window.
    contaminated: n_hit > 0 and n_hit/n_words reaches the coverage. clean_text (if with_text) lacks the hit spans.
    Null texts have no words, and a null clean_text; items without words or with a null text are never found; a null item id
    counts as an item but not in items_sha256. Items that share an id count once, equal items of other ids each. Repeated documents are judged one by one; an empty
    table of items leaves every document clean. Items of more than broadcast_words words in all meet documents by joins, with the same result.
    keep_columns: instead, the rows and columns of docs without the contaminated rows, and with the clean text in place of the text.
    """
    # The text's column has a name of its own in the Python steps, and the others go by place.
    columns = [F.col(f"`{c}`").cast("string").alias("_text") if c == text_col else F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    read = docs.select(*columns) if keep_columns else docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = read.schema[0].dataType.simpleString()
    out: StructType | str = read.schema if keep_columns else f"id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean" + ", clean_text string" * with_text
    output = Output(keep_columns, with_text, window, coverage)
    items = benchmark.select(F.col(item_id_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("item_text")).where("item_text is not null")
    judged = _by_broadcast(read, items, output, out) if n_words(items, "item_text") <= broadcast_words else _by_joins(read, items, output, out)
    return judged.toDF(*docs.columns) if keep_columns else judged


def _by_broadcast(read: DataFrame, items: DataFrame, output: Output, out: StructType | str) -> DataFrame:
    rows = items.collect()  # of checked size
    automaton = read.sparkSession.sparkContext.broadcast(build([r["item"] for r in rows], item_words([r["item_text"] for r in rows]), output.window))
    at = read.columns.index("_text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in W.slices(batch.column(at)):
                part = batch.slice(texts.first, texts.last - texts.first)
                w, h = _hashed(texts)
                hit, found = _hits(automaton.value, w, h, output.window)
                yield output.rows(part, part.column(at), texts, w, hit, {i: {automaton.value.names[k] for k in which} for i, which in found.items()})

    return read.mapInArrow(judge, out)


def _windows(w: W.Words, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of a size, which depend on the size, and where each row's begin."""
    grams, bounds = W.ngrams(h, w.bounds, size)
    return W.mix(grams + np.uint64(size)).view(np.int64), bounds


def _by_joins(read: DataFrame, items: DataFrame, output: Output, out: StructType | str) -> DataFrame:
    spark, window = read.sparkSession, output.window
    # Written, so that a row's key is the same in every reading.
    keyed = written(read.select(F.struct(*read.columns).alias("doc"), F.monotonically_increasing_id().alias("key")))

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in W.slices(batch.column(1)):
                w, h = _hashed(texts)
                own = np.minimum(np.diff(w.bounds), window)
                for size in np.unique(own[own > 0]).tolist():
                    grams, bounds = _windows(w, h, size)
                    row = np.repeat(np.arange(len(own)), np.diff(bounds))
                    mine = np.flatnonzero(own[row] == size)
                    begins = w.bounds[:-1][row[mine]] + mine - bounds[:-1][row[mine]]
                    words = np.ascontiguousarray(h[begins[:, None] + np.arange(size)]).reshape(-1).view(np.uint8)
                    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * size), len(mine), [None, pa.py_buffer(words)])
                    yield pa.RecordBatch.from_arrays([pa.array(grams[mine]), fixed.cast(pa.binary()), batch.column(0).take(pa.array(texts.first + row[mine]))], ["gram", "words", "item"])

    shown = written(items.select("item", "item_text").mapInArrow(of_items, "gram bigint, words binary, item string").distinct())
    # A set of items is told by two hashes of its members, which are summed without order before they are shuffled.
    member = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), F.col("item").isNull(), F.coalesce("item", F.lit(""))))
    windows = written(shown.groupBy("gram", "words").agg(F.concat_ws(":", member(1), member(2)).alias("set")))
    a_window = windows.groupBy("set").agg(F.min(F.struct("gram", "words")).alias("w")).select("set", "w.gram", "w.words")
    members = shown.join(a_window, ["gram", "words"]).select("set", "item")
    sizes = [r["size"] for r in windows.select((F.length("words") / 8).cast("int").alias("size")).distinct().collect()]  # window at most
    known = spark.sparkContext.broadcast(key_filter(windows.select("gram").distinct()))

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column(0))
            for texts in W.slices(batch.column(1)):
                w, h = _hashed(texts)
                for size in sizes:
                    found, bounds = _windows(w, h, size)
                    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                    passes = known.value.has(found)
                    pair = np.unique(np.stack([row[passes], found[passes]], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[texts.first + pair[:, 0]]), pa.array(pair[:, 1])], ["key", "gram"])

    met = keyed.select("key", F.col("doc._text").alias("t")).mapInArrow(of_docs, "key bigint, gram bigint").join(windows, "gram")
    lists = written(met.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("words", "set"))).alias("shared")))
    listed = spark.sparkContext.broadcast(key_filter(lists.select("key")))

    @arrow_udf(BooleanType())
    def may_hit(key: pa.Array) -> pa.Array:
        return pa.array(listed.value.has(np.asarray(key)))

    marked = keyed.withColumn("may_hit", may_hit("key"))
    fields = read.columns
    at = fields.index("_text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[list, Automaton] | None = None
        for batch in batches:
            docs = pa.RecordBatch.from_arrays(batch.column(0).flatten(), fields)
            for texts in W.slices(docs.column(at), most=1):  # one text after the other
                part = docs.slice(texts.first, texts.last - texts.first)
                w, h = _hashed(texts)
                hit, sets = np.zeros(len(w.starts), bool), []
                own = batch.column(1)[texts.first].as_py() or []
                if own:
                    if last is None or last[0] != own:  # copies of a passage often follow each other
                        last = own, build([x["set"] for x in own], [np.frombuffer(x["words"], np.uint64) for x in own], window)
                    hit, which = _hits(last[1], w, h, window)
                    sets = sorted({last[1].names[k] for some in which.values() for k in some})
                rows = output.rows(part, part.column(at), texts, w, hit, {})
                if not output.keep_columns:
                    rows = rows.append_column("combination", pa.array([hashlib.sha256(",".join(sets).encode()).hexdigest()])).append_column("sets", pa.array([sets], pa.list_(pa.string())))
                yield rows

    judged = out if output.keep_columns else f"{out}, combination string, sets array<string>"
    nothing = F.lit(None).cast(lists.schema["shared"].dataType).alias("shared")
    clean = marked.where("not may_hit").select("doc", nothing)
    some = marked.where("may_hit").join(lists, "key", "left").select("doc", "shared")
    if output.keep_columns:
        return clean.union(some).mapInArrow(judge, judged)
    hits = written(some.mapInArrow(judge, judged))
    combinations = hits.groupBy("combination").agg(F.any_value("sets").alias("sets")).select("combination", F.explode("sets").alias("set"))
    named = combinations.join(members, "set").select("combination", "item").distinct()
    digest = F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("item"))), 256)
    figures = named.groupBy("combination").agg(F.count(F.lit(1)).alias("_n"), digest.alias("_sha"))
    full = hits.join(figures, "combination", "left").withColumn("n_items", F.coalesce("_n", "n_items")).withColumn("items_sha256", F.coalesce("_sha", "items_sha256"))
    columns = [c for c in hits.columns if c not in ("combination", "sets")]
    return clean.mapInArrow(judge, judged).select(columns).union(full.select(columns))
