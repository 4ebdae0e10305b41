"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with a calibrated temperature.

A token is a word's shape (letters, capitals and digits each as one sign, punctuation as it is, runs as one) with a mark if the
word repeats the one before it, or the lower-cased word. Shapes and words are hashed to rows of their own, whose number is a parameter. Each row has a
sparse random index vector; its word vector is the sum of the index vectors of the neighbours of all its occurrences in
the whole corpus. These sums are whole numbers of a fixed size, added up block by block in two steps, and don't depend on the order of tasks.
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
from palimpsest.llm.storage import written

#: Rows of shapes and of words: far more than frequent words, so that only rare ones share a row. Numbers of a vector; those that aren't 0 in an index vector.
SHAPE_ROWS, WORD_ROWS, DIM, NONZERO = 1 << 13, 1 << 16, 48, 6
ROWS = SHAPE_ROWS + WORD_ROWS
#: Added to the length of a row's sum before the sum is divided by it: what was seen a few times only says little.
RARE = 30.0
#: Blocks in which sums meet, and groups of tasks in which each block is summed first.
_BLOCKS, _FAN = 16, 64
#: The most labelled rows that the network is fitted on, taken by a hash of their ids.
MAX_LABELLED = 20_000
THRESHOLD = 0.7

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 0x61
_SHAPE[0x41:0x5B] = 0x41
_SHAPE[0x30:0x3A] = 0x30


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each row the places of its numbers that aren't 0, all different, and these numbers, 1 or -1."""
    rng = np.random.Generator(np.random.PCG64(7))
    places = np.argsort(rng.random((ROWS, DIM)), axis=1)[:, :NONZERO]
    return places, rng.choice(np.array([-1, 1]), (ROWS, NONZERO))


def tokens(texts: W.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word's shape, row of each word, and where each text's words begin."""
    w = W.words(texts, W.NOT_SPACE)
    if not len(w.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), w.bounds
    exact = W.spans_hash(texts.data, w.starts, w.ends)
    lowered = W.spans_hash(texts.data, w.starts, w.ends, lower=True)
    shape = _SHAPE[texts.data]
    keep = W.NOT_SPACE[texts.data]
    begins = np.zeros(len(shape), bool)
    begins[w.starts] = True
    keep[1:] &= (shape[1:] != shape[:-1]) | begins[1:]
    place = np.concatenate([[0], np.cumsum(keep)])
    shapes = W.spans_hash(shape[keep], place[w.starts], place[w.ends])
    again = np.zeros(len(exact), bool)
    again[1:] = exact[1:] == exact[:-1]
    again[w.bounds[:-1][w.bounds[:-1] < len(again)]] = False
    return (W.mix(shapes + again) % np.uint64(SHAPE_ROWS)).astype(np.int64), (lowered % np.uint64(WORD_ROWS)).astype(np.int64) + SHAPE_ROWS, w.bounds


def contexts(texts: W.Texts, index: tuple[np.ndarray, np.ndarray], out: np.ndarray) -> None:
    """Adds the neighbours' index vectors to the rows of out: words beside each other, shapes beside each other, and a word and its shape."""
    shapes, own, bounds = tokens(texts)
    inner = np.ones(max(len(shapes) - 1, 0), bool)
    cuts = bounds[1:-1]
    inner[cuts[(cuts > 0) & (cuts < len(shapes))] - 1] = False
    keys = [shapes * ROWS + own, own * ROWS + shapes]
    for left, right in ((shapes[:-1], shapes[1:]), (own[:-1], own[1:])):
        a, b = left[inner], right[inner]
        keys += [a * ROWS + b, b * ROWS + a]
    pair, n = np.unique(np.concatenate(keys), return_counts=True)
    a, b = pair // ROWS, pair % ROWS
    places, signs = index
    flat = out.reshape(-1)
    for j in range(NONZERO):
        np.add.at(flat, a * DIM + places[b, j], n * signs[b, j])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The table of word vectors over all rows: ROWS x DIM numbers, whatever the size of the corpus. Their length is below one, and small for rare rows."""
    size = ROWS // _BLOCKS * DIM

    def packed(block: int, group: int, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([group], pa.int32()), pa.array([pa.compress(sums.tobytes(), codec="zstd", asbytes=True)], pa.binary())], ["block", "fan", "sums"])

    def unpacked(x: pa.Scalar) -> np.ndarray:
        return np.frombuffer(pa.decompress(x.as_buffer(), size * 8, codec="zstd", asbytes=True), np.int64)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        group = (context.partitionId() if context else 0) % _FAN
        index, total = index_vectors(), np.zeros((ROWS, DIM), np.int64)
        for batch in batches:
            for texts in W.slices(batch.column(0)):
                contexts(texts, index, total)
        for k, part in enumerate(total.reshape(_BLOCKS, size)):
            if part.any():
                yield packed(k, group, part)

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, group = np.zeros(size, np.int64), key[1].as_py() if len(key) > 1 else 0
        for batch in batches:
            for x in batch.column("sums"):
                total += unpacked(x)
        yield packed(key[0].as_py(), group, total)

    fields = "block int, fan int, sums binary"
    parts = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(partial, fields)
    blocks = parts.groupBy("block", "fan").applyInArrow(add, fields).groupBy("block").applyInArrow(add, fields).collect()  # of fixed size
    table = np.zeros((_BLOCKS, size))
    for b in blocks:
        table[b["block"]] = unpacked(pa.scalar(bytes(b["sums"]), pa.binary()))
    table = table.reshape(ROWS, DIM)
    return (table / (np.linalg.norm(table, axis=1, keepdims=True) + RARE)).astype(np.float32)


def pooled(texts: W.Texts, vectors: np.ndarray) -> np.ndarray:
    """Per text: mean vectors of its shapes and of its words, the means' lengths, and the logarithm of its words."""
    shapes, own, bounds = tokens(texts)
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    parts = []
    for ids in (shapes, own):
        key, count = np.unique(row * ROWS + ids, return_counts=True)
        sums = np.zeros((len(n), DIM))
        if len(key):
            r = key // ROWS
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            sums[r[first]] = np.add.reduceat(count[:, None] * vectors[key % ROWS], first, axis=0)
        mean = sums / np.maximum(n, 1)[:, None]
        parts += [mean, np.linalg.norm(mean, axis=1, keepdims=True)]
    return np.hstack([*parts, np.log1p(n)[:, None] / 10]).astype(np.float32)


class Network(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, decay: float = 1e-3) -> Network:
    """Adam on the log loss of four fifths of the rows; the temperature has the least loss on the fifth that training doesn't see.

    Without rows of both classes the score is the smoothed share of label 1.
    """
    d = x.shape[1]
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    rng = np.random.Generator(np.random.PCG64(11))
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-3
    z = (x - mean) / scale
    params = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(used), max(1, len(used) // 128)):
            xb, yb = z[batch], y[batch]
            h = np.maximum(xb @ params[0] + params[1], 0)
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
            g = (p - yb) / len(batch)
            gh = np.outer(g, params[2]) * (h > 0)
            grads = [xb.T @ gh + decay * params[0], gh.sum(axis=0), h.T @ g + decay * params[2], np.array([g.sum()])]
            t += 1
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                params[k] = params[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, params[0], params[1], params[2], float(params[3][0]), 1.0)
    if not len(held):
        return net
    logits, target = net.logit(x[held]), y[held]
    loss = lambda heat: float(np.mean(np.logaddexp(0, logits / heat) - target * logits / heat))
    return net._replace(temperature=min(np.geomspace(0.25, 8, 61).tolist(), key=loss))


def held_out(id_col: str) -> F.Column:  # type: ignore[name-defined]
    """Rows that lend no label: the remainder by 4 of the CRC-32 of the id's text is 2. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD,
) -> DataFrame:
    """Per row: id, held_out, score, predicted. Word vectors use all texts; labels come from rows that aren't held out.

    At most max_labelled labels are used, those with the smallest hash of their id. Null labels and null ids lend none; a
    repeated id lends its rows again. Null and empty texts have a zero vector and are scored like others. Without labels, or with
    one class only, all scores are the smoothed share of label 1. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = read.schema["_id"].dataType.simpleString()
    vectors = spark.sparkContext.broadcast(word_vectors(read, "_text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in W.slices(batch.column(1)):
                x = pooled(texts, vectors.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, texts.last - texts.first), pa.array([r.tobytes() for r in x], pa.binary())], ["_id", "x"])

    table = written(read.mapInArrow(features, f"_id {kind}, x binary"))
    known = labels.select(F.col(id_col).alias("_key"), F.col(label_col).cast("int").alias("_y")).where("_key is not null and _y is not null").where(~held_out("_key"))
    known = known.orderBy(F.xxhash64("_key"), "_key", "_y").limit(max_labelled)
    rows = table.join(F.broadcast(known), F.col("_id") == F.col("_key")).select("_id", "_y", "x").orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_labelled).collect()
    width = 2 * DIM + 3
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(-1, width).astype(float)
    net = spark.sparkContext.broadcast(fit(x, np.array([r["_y"] for r in rows], float)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(v.as_py() for v in batch.column(1)), np.float32).reshape(-1, width).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.value.score(x), pa.float64())], ["id", "score"])

    scored = table.select("_id", "x").mapInArrow(score, f"id {kind}, score double")
    return scored.select("id", held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
