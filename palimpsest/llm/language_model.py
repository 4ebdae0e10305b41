"""Language-model scoring with a weighted backoff automaton over word n-grams of up to three words.

Model. The empty state has an arc for each word, weighted by the add-one unigram model p1. Words and bigrams of the training texts are
states too, and so is a text's begin; their arcs are the bigrams and trigrams seen after them, weighted p2(w|v) = (c(vw) + m2 p1(w)) / (c(v) + m2)
and p3(w|uv) = (c(uvw) + m3 p2(w|v)) / (c(uv) + m3). A word that a state has no arc for takes its failure arc to the next shorter context, from (uv) to
(v) to the empty state, weighted m / (c + m). So the weights of all words after a state sum to one. No word is left out or shares a class.

Scale. The model grows with the corpus and is never in one place. Documents are cut into chunks of bounded size. A chunk sends its
different n-grams, as sorted hashes, with its training counts, to buckets by hash, and gets back the counts over all training
texts in the order in which it asked: the part of the automaton that its texts can reach. Then one left-to-right walk, all texts of a chunk in
step, carries each text's state and adds up log-probabilities. Hot n-grams cost a bucket one entry for each chunk. A chunk is one row,
which is shuffled once, to its answers.
Hashes of words have 64 bits, those of bigrams and trigrams 56: of n different ones, a share of about n / 2**56 has the count of two.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import words as W
from palimpsest.llm.ngram_join import group_rows
from palimpsest.llm.storage import discard, written

CHUNK_TOKENS = 1_000_000
#: Weights of the shorter context's model after a word and after two.
MASS = (100.0, 20.0)
ORDERS = 3
KEY_BITS = (64, 56, 56)
#: Buckets for each chunk, and most tasks of a shuffle.
BUCKETS, MAX_TASKS = 0.5, 8192
#: Hashes of what isn't a word: the end and the begin.
END, BEGIN = (np.uint64(x) for x in (0xE0D1E0D1E0D1E0D1, 0xBE617BE617BE6170))


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers with their equal bytes side by side, compressed; a head of 4 bytes has their number."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(values).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: pa.Scalar, kind: str) -> np.ndarray:
    raw, size = memoryview(data.as_buffer()), np.dtype(kind).itemsize
    planes = pa.decompress(raw[4:], int.from_bytes(raw[:4], "little") * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(data: pa.Scalar) -> np.ndarray:
    return np.cumsum(_unpacked(data, "<u8"), dtype=np.uint64)


class Chunk(NamedTuple):
    """Texts of a chunk: hashes of its different tokens, each position's token, where texts begin, which of them train."""

    names: np.ndarray
    tokens: np.ndarray
    bounds: np.ndarray
    train: np.ndarray

    @classmethod
    def of_row(cls, row: pa.Table) -> Chunk:
        sizes = _unpacked(row.column("sizes")[0], "<i8")
        held = _unpacked(row.column("held")[0], "<i1").astype(bool)
        return cls(_unpack_sorted(row.column("vocabulary")[0]), _unpacked(row.column("tokens")[0], "<i4"), np.concatenate([[0], np.cumsum(sizes)]), ~held)


class Grams(NamedTuple):
    """A chunk's different n-grams of one order, ascending by key: a position of each, and each position's n-gram (-1 where a text has none)."""

    keys: np.ndarray
    at: np.ndarray
    number: np.ndarray


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in ascending order, a place of each, and the number of the key at each place."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return ranked[new], order[new], number


def grams(chunk: Chunk) -> list[Grams]:
    """Words, bigrams (with the begin as a word) and trigrams (from a text's second word on)."""
    own = chunk.names[chunk.tokens]
    first = chunk.bounds[:-1]
    words = np.empty(len(chunk.names), np.int64)
    words[chunk.tokens] = np.arange(len(own))
    out = [Grams(chunk.names, words, chunk.tokens)]
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[first] = BEGIN
    two = W.mix(W.mix(before) + own)
    out.append(Grams(*_numbered(two >> np.uint64(64 - KEY_BITS[1]))))
    before[1:] = two[:-1]
    del two
    inner = np.ones(len(own), bool)
    inner[first] = False
    place = np.flatnonzero(inner)
    three = W.mix(W.mix(before[place]) + own[place])
    del before, own, inner
    keys, at, some = _numbered(three >> np.uint64(64 - KEY_BITS[2]))
    number = np.full(len(chunk.tokens), -1, np.int32)
    number[place] = some
    out.append(Grams(keys, place[at], number))
    return out


def _asked(chunk: int, order: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket, in order of the ascending keys."""
    bucket = ((keys >> np.uint64(KEY_BITS[order] - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    parts = [(k, a, z) for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]
    n = len(parts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k for k, _, _ in parts], pa.int32()), pa.array([order] * n, pa.int32()), pa.array([chunk] * n, pa.int64()),
            pa.array([_pack_sorted(keys[a:z]) for _, a, z in parts], pa.binary()), pa.array([_packed(counts[a:z].astype("<u4")) for _, a, z in parts], pa.binary()),
        ],
        ["bucket", "order", "chunk", "keys", "counts"],
    )


def _ask(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = pa.Table.from_batches([batch.slice(k, 1)])
            chunk = Chunk.of_row(row)
            train = np.repeat(chunk.train, np.diff(chunk.bounds))
            for order, g in enumerate(grams(chunk)):
                counted = g.number[train & (g.number >= 0)]
                yield _asked(row.column("chunk")[0].as_py(), order, g.keys, np.bincount(counted, minlength=len(g.keys)), buckets)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over all chunks for each row of a bucket's order, in the order of its keys; for words a row of chunk -1 with all tokens and all different ones."""
    for group in group_rows(batches, 2):
        chunks, keys = group.column("chunk").to_pylist(), [_unpack_sorted(x) for x in group.column("keys")]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        known, back = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        total = np.bincount(back, np.concatenate([_unpacked(x, "<u4") for x in group.column("counts")]), len(known)).astype("<i8")
        data = [_packed(total[part]) for part in np.split(back, cuts)]
        bucket, order = group.column("bucket")[0].as_py(), group.column("order")[0].as_py()
        if order == 0:
            chunks.append(-1)
            data.append(_packed(np.array([total.sum(), (total > 0).sum()], "<i8")))
        n = len(chunks)
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([order] * n, pa.int32()), pa.array([bucket] * n, pa.int32()), pa.array(data, pa.binary())], ["chunk", "order", "bucket", "data"])


class Automaton(NamedTuple):
    """arcs: by order, the log-weight of each n-gram's arc, NaN where training lacks it. failure: of word states (the begin last) and bigram states."""

    arcs: list[np.ndarray]
    failure: list[np.ndarray]
    found: list[Grams]

    def walk(self, chunk: Chunk) -> np.ndarray:
        """Log-probability of each text: all texts move by one word at a time. A state is a context's length, and the n-gram that was read last."""
        one, two, three = self.arcs
        words, pairs, triples = (g.number for g in self.found)
        lengths = np.diff(chunk.bounds)
        order = np.argsort(-lengths, kind="stable")
        at, ranked = chunk.bounds[:-1][order], -lengths[order]
        context = np.ones(len(order), np.int8)
        state = np.full(len(order), len(chunk.names))  # at the begin
        score = np.zeros(len(order))
        for step in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(ranked, -step, "left"))
            place = at[:live] + step
            word, pair = words[place], pairs[place]
            weight = np.zeros(live)
            todo = np.ones(live, bool)
            long = np.flatnonzero(context[:live] == 2)
            if len(long):
                arc = three[triples[place[long]]]
                missing = np.isnan(arc)
                weight[long] = np.where(missing, self.failure[1][state[long]], arc)
                todo[long] = missing
                state[long] = words[place[long] - 1]  # where the failure arc leads
            arc = two[pair]
            missing = np.isnan(arc)
            failed = np.where(context[:live] > 0, self.failure[0][state[:live]], 0.0) + one[word]
            weight += np.where(todo, np.where(missing, failed, arc), 0.0)
            score[:live] += weight
            context[:live] = np.where(~missing, 2, 1)
            state[:live] = np.where(~missing, pair, word)
        out = np.empty(len(order))
        out[order] = score
        return out


def automaton(chunk: Chunk, found: list[Grams], totals: list[np.ndarray], tokens: int, types: int, texts: int, mass: tuple[float, float]) -> Automaton:
    """The part of the model that a chunk's texts can reach. totals: training counts of its n-grams by order; tokens, types, texts: of all training texts."""
    begins = np.zeros(len(chunk.tokens), bool)
    begins[chunk.bounds[:-1]] = True
    words, pairs = found[0].number, found[1].number
    p1 = (totals[0] + 1) / (tokens + types + 1)
    after_word = np.append(totals[0], texts).astype(float)
    at = found[1].at
    context = after_word[np.where(begins[at], len(chunk.names), words[at - 1])]
    p2 = (totals[1] + mass[0] * p1[words[at]]) / (context + mass[0])
    at = found[2].at
    p3 = (totals[2] + mass[1] * p2[pairs[at]]) / (totals[1][pairs[at - 1]] + mass[1])
    arcs = [np.log10(p1), *(np.where(t > 0, np.log10(p), np.nan) for t, p in ((totals[1], p2), (totals[2], p3)))]
    return Automaton(arcs, [np.log10(m / (c + m)) for m, c in zip(mass, (after_word, totals[1]), strict=True)], found)


def score_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mass: tuple[float, float] = MASS, held_out: tuple[int, int] = (7, 2), chunk_tokens: int = CHUNK_TOKENS
) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are runs of other than space and \\t-\\r, with A-Z in lower case, then one end. Rows whose CRC-32 of the id's text leaves
    held_out[1] by held_out[0] lend no counts; a null id is not held out. base_score: sum of log10((c+1)/(N+V+1)); score: the
    automaton's log10 probability of the text. Null and empty texts have the end alone. Repeated rows count each. Without training texts
    all words are unseen. An empty table gives no rows; other columns are not read.
    """
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(held_out[0])) == held_out[1], F.lit(False))
    read = docs.select(F.col(id_col).alias("_id"), held.alias("held"), F.col(text_col).cast("string").alias("_text"))
    kind = read.schema["_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        chunk = (context.partitionId() if context else 0) << 24
        ids: list[pa.Array] = []
        helds: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            vocabulary, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            held = np.concatenate(helds)
            key = pa.concat_arrays(ids)
            blobs = (_packed(held.astype("<i1")), _packed(np.concatenate(sizes).astype("<i8")), _pack_sorted(vocabulary), _packed(tokens.astype("<i4")))
            return pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.array([int((~held).sum())], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), key), *(pa.array([b], pa.binary()) for b in blobs)],
                ["chunk", "texts", "ids", "held", "sizes", "vocabulary", "tokens"],
            )

        for batch in batches:
            for texts in W.slices(batch.column(2)):
                w = W.words(texts, W.NOT_SPACE)
                n = len(w.bounds) - 1
                ids.append(batch.column(0).slice(texts.first, n))
                helds.append(np.asarray(batch.column(1).slice(texts.first, n).to_numpy(zero_copy_only=False), bool))
                hashes.append(np.insert(W.spans_hash(texts.data, w.starts, w.ends, lower=True), w.bounds[1:], END))
                sizes.append(np.diff(w.bounds) + 1)
                if sum(map(len, hashes)) >= chunk_tokens:
                    yield close()
                    chunk += 1
                    for held_list in (ids, helds, hashes, sizes):
                        held_list.clear()
        if ids:
            yield close()

    # Rows of some megabytes: the writer looks at its memory after each.
    checks = {"parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
    table = written(read.mapInArrow(cut, f"chunk bigint, texts bigint, ids array<{kind}>, held binary, sizes binary, vocabulary binary, tokens binary"), **checks)
    chunks, texts = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("texts"), F.lit(0))).first()
    buckets = max(8, int(chunks * BUCKETS))
    asked = table.drop("texts", "ids").mapInArrow(lambda b: _ask(b, buckets), "bucket int, order int, chunk bigint, keys binary, counts binary")
    dealt = asked.repartition(min(buckets, MAX_TASKS), "bucket").sortWithinPartitions("bucket", "order")
    answers = written(dealt.mapInArrow(_answer, "chunk bigint, order int, bucket int, data binary"))
    tokens = types = 0
    for r in answers.where("chunk = -1").select("data").toLocalIterator():
        some = _unpacked(pa.scalar(bytes(r["data"]), pa.binary()), "<i8")
        tokens, types = tokens + int(some[0]), types + int(some[1])

    blank = [F.lit(None).cast(table.schema[c].dataType).alias(c) for c in ("ids", "held", "sizes", "vocabulary", "tokens")]
    whole = table.select("chunk", F.lit(ORDERS).alias("order"), F.lit(0).alias("bucket"), F.lit(None).cast("binary").alias("data"), "ids", "held", "sizes", "vocabulary", "tokens")
    parts = whole.union(answers.where("chunk >= 0").select("chunk", "order", "bucket", "data", *blank))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in group_rows(batches, 1):
            rank = np.asarray(group.column("order"))
            row = group.slice(group.num_rows - 1)
            chunk = Chunk.of_row(row)
            totals = [np.concatenate([np.zeros(0, np.int64), *(_unpacked(group.column("data")[int(k)], "<i8") for k in np.flatnonzero(rank == order))]) for order in range(ORDERS)]
            model = automaton(chunk, grams(chunk), totals, tokens, types, texts, mass)
            base = np.log10((totals[0] + 1) / (tokens + types + 1))[chunk.tokens]
            sums = lambda x: pa.array(np.add.reduceat(x, chunk.bounds[:-1]))  # noqa: B023, E731
            n = len(chunk.train)
            yield pa.RecordBatch.from_arrays(
                [row.column("ids").combine_chunks().flatten(), pa.array(~chunk.train), pa.array(np.diff(chunk.bounds)), sums((totals[0] > 0)[chunk.tokens].astype(np.int64)), pa.array(np.full(n, tokens)), sums(base), pa.array(model.walk(chunk))],
                ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    out = f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return parts.repartition(max(1, min(chunks, MAX_TASKS)), "chunk").sortWithinPartitions("chunk", "order", "bucket").mapInArrow(walk, out)
