"""N-gram Jaccard self-join with prefix trees.

Plan. Every document becomes the set of its n-gram hashes, in one global order: those with the rarest words first, as words are counted over
all documents in a table of fixed size. No n-gram is more frequent than its rarest word, so what many documents share, or share by chance, stands
last. Equal sets are one class, and only classes go on.
1. Two sets that reach the threshold share at least T n-grams of their prefixes, as these are longer than needed for one by a share of
   the set (an l-prefix). Prefixes are dealt out by n-gram in packed arrays, once for each class and task. An n-gram of several classes
   of fitting sizes ties them to the least of them, their anchor.
2. A class whose tied n-grams are fewer than T has no partner and goes. It also leaves its weakest anchors, as long as they tie fewer than
   half of T of its n-grams: a pair loses fewer than T in all, so it still has a common anchor. Each anchor's classes are a group. Only
   classes in groups have their full sets made, found in another pass by a key filter and then by an exact join.
3. Each group's sets are stored in a trie over the order. Sets walk it in blocks, each with a running overlap that all sets below a
   node share; a set leaves a subtree when the overlap so far and what remains on both sides can't reach the threshold. A group above a
   size is dealt out in blocks, the sets of one walking the trie of another.
4. A pair of linked classes belongs to the least anchor that both have. There it counts for both, so links are counted, not listed:
   a task returns one count for each class, and of the pairs only links enough to connect what it found.
   For components alone, subtrees whose sets are already linked with the walkers are left, and a group of more than some sets first
   compares small blocks with themselves and with the first one; only sets outside its largest component then walk all of it. So a
   group of near copies costs as many steps as it has sets.
5. Links make components by stars. Rows get their class's component and links.
Hashes have 59 bits beside the order's 5. Two of a document's n-grams meet by chance with a probability below 2**-40, and two of n sets share
a class's 64 bits by chance with a probability of about n**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import words as W
from palimpsest.llm.components import connected
from palimpsest.llm.keyfilter import key_filter
from palimpsest.llm.storage import discard, written

SIZE, PERCENT = 5, 80
#: The order's table of word counts has 2**COUNT_BITS numbers, and is added up in blocks, by groups of tasks first.
COUNT_BITS, _BLOCKS, _FAN = 20, 32, 64
#: Sets and n-grams of one trie, about; sets of a block in the first comparison for components alone; prefix n-grams in one packed bucket; tasks that buckets are dealt to, at most.
GROUP_SETS, GROUP_NGRAMS, FIRST_SETS = 2048, 1 << 21, 128
BUCKET_NGRAMS = 1_000_000
MAX_TASKS = 8192
#: Bytes of the table that tells which walkers have an n-gram.
WALK_BYTES = 1 << 25
_POSTING = np.dtype([("gram", "<u8"), ("cls", "<i8"), ("n", "<u4")])


def _words(texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
    w = W.words(texts, W.NOT_SPACE)
    return W.spans_hash(texts.data, w.starts, w.ends, lower=True), w.bounds


def _place(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def ordered_sets(texts: W.Texts, size: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's different n-grams, in the global order, and where each text's begin."""
    hashes, bounds = _words(texts)
    grams, at = W.ngrams(hashes, bounds, size, whole=True)
    level = W.window_least(levels[_place(hashes)], bounds, size).astype(np.uint64)
    return W.distinct_sorted((level << np.uint64(59)) | (grams >> np.uint64(5)), at)


def class_ids(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each non-empty set, 0 for empty ones."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    full = np.diff(bounds) > 0
    if full.any():
        out[full] = np.add.reduceat(W.mix(values ^ np.uint64(0x5851F42D4C957F2D)), bounds[:-1][full])
        out[full] = W.mix(out[full] + np.diff(bounds)[full].astype(np.uint64))
    return out.view(np.int64)


def needed(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For sets of n: the prefix's length, and the least number of prefix n-grams shared with any set that reaches the threshold."""
    least = -(-percent * n // 100)
    extra = (100 - percent) * n // 200
    return np.where(n > 0, np.minimum(n, n - least + 1 + extra), 0), 1 + (100 - percent) * least // 200


def order_levels(read: DataFrame) -> tuple[np.ndarray, int]:
    """The bit length of each table place's count over all rows, 2**COUNT_BITS bytes, and the number of all words."""
    block = (1 << COUNT_BITS) // _BLOCKS

    def packed(k: int, group: int, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([group], pa.int32()), pa.array([pa.compress(counts.tobytes(), codec="zstd", asbytes=True)], pa.binary())], ["block", "fan", "counts"])

    def unpacked(x: pa.Scalar) -> np.ndarray:
        return np.frombuffer(pa.decompress(x.as_buffer(), block * 8, codec="zstd", asbytes=True), np.int64)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        group = (context.partitionId() if context else 0) % _FAN
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for texts in W.slices(batch.column(0)):
                total += np.bincount(_place(_words(texts)[0]), minlength=1 << COUNT_BITS)
        for k, part in enumerate(total.reshape(_BLOCKS, block)):
            if part.any():
                yield packed(k, group, part)

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(block, np.int64)
        for batch in batches:
            for x in batch.column("counts"):
                total += unpacked(x)
        yield packed(key[0].as_py(), key[1].as_py() if len(key) > 1 else 0, total)

    out, total = np.zeros((_BLOCKS, block), np.uint8), 0
    fields = "block int, fan int, counts binary"
    counts = read.select("_text").mapInArrow(partial, fields).groupBy("block", "fan").applyInArrow(add, fields)
    for row in counts.groupBy("block").applyInArrow(add, fields).collect():  # of fixed size
        own = unpacked(pa.scalar(bytes(row["counts"]), pa.binary()))
        out[row["block"]] = np.ceil(np.log2(own + 1))
        total += int(own.sum())
    return np.minimum(out.reshape(-1), 31), total


class Trie:
    """Ordered sets that share beginnings. Nodes are ranges of the sorted sets; each set has a leaf of its own."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
        local = np.split(ids.astype(np.int32), np.cumsum([len(s) for s in sets])[:-1])
        self.order = np.array(sorted(range(len(sets)), key=lambda i: local[i].astype(">i4").tobytes()))
        self.sets = [local[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets])
        shared = np.zeros(len(sets), np.int64)  # with the set before
        for k in range(1, len(sets)):
            a, b = self.sets[k - 1], self.sets[k]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            shared[k] = differ[0] if len(differ) else m
        #: per node: its range of sets, depth of its beginning and end, least and most size below, children
        self.low, self.high, self.begin, self.end, self.least, self.most = ([] for _ in range(6))
        self.children: list[list[int]] = []
        pending = [(0, len(sets), 0, -1)]
        while pending:
            a, z, d, up = pending.pop()
            inner = shared[a + 1 : z]
            end = int(inner.min()) if len(inner) else int(self.sizes[a])
            node = len(self.low)
            sizes = self.sizes[a:z]
            for column, x in zip((self.low, self.high, self.begin, self.end, self.least, self.most), (a, z, d, end, int(sizes.min()), int(sizes.max())), strict=True):
                column.append(x)
            self.children.append([])
            if up >= 0:
                self.children[up].append(node)
            if len(inner):
                cuts = [a, *(np.flatnonzero(inner == end) + a + 1).tolist(), z]
                pending += [(i, j, end, node) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def walk(self, percent: int, walkers: list[np.ndarray] | None = None, labels: _Labels | None = None, own_labels: _Labels | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(set, walkers that reach the threshold with it), each pair once; all numbered as they were given.

        Without walkers the trie's own sets walk, and a pair is found by the one that stands first. With labels (of sets) and own_labels (of
        walkers), which the caller may join between results, subtrees of the walker's own label are left.
        """
        p = percent
        if walkers is None:
            grams, names, size = self.sets, self.order, self.sizes
        else:
            size = np.array([len(w) for w in walkers])
            names = np.arange(len(walkers))
            grams = []
            for w in walkers:
                at = np.minimum(np.searchsorted(self.vocabulary, w), len(self.vocabulary) - 1)
                grams.append(at[self.vocabulary[at] == w].astype(np.int32))
        width = len(self.vocabulary)
        step = max(1, min(1024, WALK_BYTES // width))
        for first in range(0, len(grams), step):
            own = grams[first : first + step]
            counts = np.array([len(g) for g in own])
            ends = np.cumsum(counts)
            flat = np.concatenate(own).astype(np.int64)
            who = np.repeat(np.arange(len(own)), counts)
            has = np.zeros((width, len(own)), np.uint8)
            has[flat, who] = 1
            flat += who * width
            n = size[first : first + step]
            name = names[first : first + step]
            same = self._same(labels) if labels is not None else None
            stack = [(0, np.arange(len(own)), np.zeros(len(own), np.int64))]
            while stack:
                node, alive, overlap = stack.pop()
                a, z, begin, end, least, most = self.low[node], self.high[node], self.begin[node], self.end[node], self.least[node], self.most[node]
                fits = (100 * most >= p * n[alive]) & (100 * n[alive] >= p * least)
                if walkers is None:
                    fits &= alive + first < z - 1
                if same is not None and same[node] >= 0:
                    fits &= own_labels[name[alive]] != same[node]
                if not fits.all():
                    alive, overlap = alive[fits], overlap[fits]
                if not len(alive):
                    continue
                edge = self.sets[a][begin:end]
                if len(edge):
                    rows = has[edge]
                    gained = (rows if len(alive) == len(own) else rows[:, alive]).sum(axis=0, dtype=np.int64)
                    overlap = overlap + gained
                children = self.children[node]
                if not children:
                    hit = (100 + p) * overlap >= p * (n[alive] + most)
                    if walkers is None:
                        hit &= alive + first < a
                    if hit.any():
                        yield int(self.order[a]), name[alive[hit]]
                    continue
                rest = ends[alive] - np.searchsorted(flat, alive * width + int(edge[-1]), "right") if len(edge) else n[alive]
                stays = (100 + p) * (overlap + np.minimum(rest, most - end)) >= p * (n[alive] + least)
                if not stays.all():
                    alive, overlap = alive[stays], overlap[stays]
                if len(alive):
                    stack += [(c, alive, overlap) for c in children]

    def _same(self, labels: _Labels) -> np.ndarray:
        """For each node the one label of all sets below it, or -1."""
        own = labels[self.order]
        change = np.concatenate([[0], np.cumsum(own[1:] != own[:-1])])
        low, high = np.array(self.low), np.array(self.high)
        return np.where(change[low] == change[high - 1], own[low], -1)


class Linker:
    """What one trie's task returns: for each class the rows that it links with, and links that connect all that were found."""

    def __init__(self, anchor: int, cls: np.ndarray, weight: np.ndarray, others: list[np.ndarray] | None, labels: np.ndarray) -> None:
        """others: each class's anchors; labels: equal for classes that are linked already."""
        self.cls, self.weight, self.labels = cls, weight, labels
        self.links = np.zeros(len(cls), np.int64)
        self.joins: list[tuple[int, int]] = []
        self.smaller: np.ndarray | None = None
        if others is not None:
            before = [o[o < anchor] for o in others]
            shared, counts = np.unique(np.concatenate(before), return_counts=True)
            shared = shared[counts > 1]
            if len(shared):
                table = np.zeros((len(cls), len(shared)), bool)
                for k, o in enumerate(before):
                    table[k] = np.isin(shared, o)
                self.smaller = np.packbits(table, axis=1)

    def add(self, y: int, found: np.ndarray) -> None:
        owned = found if self.smaller is None else found[~(self.smaller[found] & self.smaller[y]).any(axis=1)]
        self.links[y] += self.weight[owned].sum()
        self.links[owned] += self.weight[y]
        foreign = found[self.labels[found] != self.labels[y]]
        if len(foreign):
            parts, at = np.unique(self.labels[foreign], return_index=True)
            self.joins += [(y, int(x)) for x in foreign[at]]
            every = np.append(parts, self.labels[y])
            self.labels[np.isin(self.labels, every)] = every.min()


def group_rows(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows with equal first `keys` columns, from batches in which they follow each other."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, z - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _anchored(table: np.ndarray, percent: int) -> np.ndarray:
    """(anchor, class, size, n-grams) for the bucket's n-grams that several classes of fitting sizes have."""
    if not len(table):
        return np.zeros((0, 4), np.int64)
    table = table[np.lexsort((table["cls"], table["n"], table["gram"]))]
    # A run: classes of one n-gram by size, cut where the next is too large for the one before, and so for all before.
    n = table["n"].astype(np.int64)
    new = np.concatenate([[True], (table["gram"][1:] != table["gram"][:-1]) | (100 * n[:-1] < percent * n[1:])])
    first = np.flatnonzero(new)
    length = np.diff(np.concatenate([first, [len(table)]]))
    rows = np.repeat(length >= 2, length)
    if not rows.any():
        return np.zeros((0, 4), np.int64)
    anchor = np.repeat(np.minimum.reduceat(table["cls"], first), length)[rows]
    cls, n = table["cls"][rows], n[rows]
    order = np.lexsort((cls, anchor))
    anchor, cls, n = anchor[order], cls[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (cls[1:] != cls[:-1])]))
    return np.stack([anchor[start], cls[start], n[start], np.diff(np.concatenate([start, [len(cls)]]))], axis=1)


def _strong(ties: np.ndarray, percent: int) -> np.ndarray:
    """(anchor, class, size) of the ties (anchor, class, size, n-grams) that classes keep: not of classes with too few tied n-grams, nor of weak anchors."""
    ties = ties[np.lexsort((ties[:, 0], ties[:, 1]))]
    first = np.flatnonzero(np.concatenate([[True], (ties[1:, :2] != ties[:-1, :2]).any(axis=1)]))
    shared = np.add.reduceat(ties[:, 3], first)
    ties = ties[first]
    order = np.lexsort((ties[:, 0], shared, ties[:, 1]))
    ties, shared = ties[order], shared[order]
    start = np.flatnonzero(np.concatenate([[True], ties[1:, 1] != ties[:-1, 1]]))
    size = np.diff(np.concatenate([start, [len(ties)]]))
    run = np.cumsum(shared)
    before = np.repeat(run[start] - shared[start], size)
    whole = np.repeat(np.add.reduceat(shared, start), size)
    _, least = needed(ties[:, 2], percent)
    return ties[(whole >= least) & (run - before > (least - 1) // 2), :3]


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT, group_sets: int = GROUP_SETS,
    group_ngrams: int = GROUP_NGRAMS, components_only: bool = False,
) -> DataFrame:
    """Per row: id, n_shingles, component_id, class_id, n_links. With components_only no n_links, and fewer pairs are looked at.

    Words are runs of other than space and \\t-\\r, with A-Z in lower case; a text of fewer than `size` words, but some, has
    one n-gram of all. Rows link when 100 * intersection >= percent * union. n_links: the other rows that the row links with,
    those with an equal set included. class_id: the least id of the rows with an equal set. component_id: the least id that links reach;
    null and empty texts link with nothing, and have their own id as both, and 0 links. Rows with equal sets link whatever their
    ids; null ids take part, but are never a component's or class's id unless it has no other. Empty tables give no rows. Other
    columns are not read.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = read.schema["_id"].dataType.simpleString()
    table, total = order_levels(read)
    levels = spark.sparkContext.broadcast(table)
    buckets = max(8, int(total * (100 - percent) * 1.5 / 100 / BUCKET_NGRAMS) + 1)
    tasks = min(buckets, MAX_TASKS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in W.slices(batch.column(1)):
                values, bounds = ordered_sets(texts, size, levels.value)
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, len(n)), pa.array(n), pa.array(class_ids(values, bounds), mask=n == 0)], ["_id", "n", "cls"])

    rows = written(read.mapInArrow(counted, f"_id {kind}, n bigint, cls bigint"))
    classes = written(rows.where("cls is not null").groupBy("cls").agg(F.min("_id").alias("first_id"), F.count(F.lit(1)).alias("weight")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # classes that this task has dealt out
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            postings = np.concatenate(held)
            held.clear()
            bucket = (W.mix(postings["gram"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            found, start = np.unique(bucket[order], return_index=True)
            pieces = [x.tobytes() for x in np.split(postings[order], start[1:])]
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(pieces, pa.binary())], ["bucket", "postings"])

        for batch in batches:
            for texts in W.slices(batch.column(0)):
                values, bounds = ordered_sets(texts, size, levels.value)
                n = np.diff(bounds)
                cls = class_ids(values, bounds)
                length, _ = needed(n, percent)
                for i, c in enumerate(cls.tolist()):
                    if c in seen:
                        length[i] = 0
                    seen.add(c)
                postings = np.zeros(int(length.sum()), _POSTING)
                at = np.repeat(bounds[:-1] - (np.cumsum(length) - length), length) + np.arange(len(postings))
                postings["gram"], postings["cls"], postings["n"] = values[at], np.repeat(cls, length), np.repeat(n, length)
                held.append(postings)
                if sum(map(len, held)) > 500_000:
                    yield flush()
        if held and sum(map(len, held)):
            yield flush()

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in group_rows(batches, 1):
            # Several tasks may have dealt out a class.
            postings = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), _POSTING) for x in group.column(1)]))
            found = _anchored(postings, percent)
            part = (W.mix(found[:, 1].view(np.uint64)) % np.uint64(buckets)).astype(np.int32) if len(found) else np.zeros(0, np.int32)
            order = np.argsort(part, kind="stable")
            parts, start = np.unique(part[order], return_index=True)
            pieces = [x.tobytes() for x in np.split(found[order], start[1:])][: len(parts)]
            yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array(pieces, pa.binary())], ["part", "ties"])

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in group_rows(batches, 1):
            kept = _strong(np.concatenate([np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 4) for x in group.column(1)]), percent)
            yield pa.RecordBatch.from_arrays([pa.array(kept[:, k]) for k in range(3)], ["anchor", "cls", "n"])

    dealt = read.select("_text").mapInArrow(deal, "bucket int, postings binary").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    # A class's ties come from many buckets; they meet in packed arrays too, dealt out by class.
    ties = dealt.mapInArrow(anchor, "part int, ties binary").repartition(tasks, "part").sortWithinPartitions("part")
    tied = written(ties.mapInArrow(prune, "anchor bigint, cls bigint, n bigint"))
    sizes = tied.groupBy("anchor").agg(F.count(F.lit(1)).alias("_size"), F.sum("n").alias("_ngrams")).where("_size > 1")
    in_blocks = lambda sets: F.greatest(F.ceil(F.col("_size") / sets), F.ceil(F.col("_ngrams") / group_ngrams)).cast("int")
    first_sets = min(group_sets, FIRST_SETS) if components_only else group_sets
    placed = tied.join(sizes.select("anchor", in_blocks(first_sets).alias("blocks"), in_blocks(group_sets).alias("tries")), "anchor")
    members = written(placed.select("anchor", "cls", "blocks", "tries", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("own")))
    discard(tied)

    # Full sets of the classes in groups, once for each task that has the class.
    wanted = written(members.groupBy("cls").agg(F.array_sort(F.collect_set("anchor")).alias("anchors")))
    member_filter = spark.sparkContext.broadcast(key_filter(wanted.select("cls")))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for texts in W.slices(batch.column(0)):
                values, bounds = ordered_sets(texts, size, levels.value)
                cls = class_ids(values, bounds)
                passes = member_filter.value.has(cls)
                keep = [i for i in np.flatnonzero(passes & (np.diff(bounds) > 0)).tolist() if not (int(cls[i]) in seen or seen.add(int(cls[i])))]
                parts = [values[bounds[i] : bounds[i + 1]].astype("<u8").tobytes() for i in keep]
                yield pa.RecordBatch.from_arrays([pa.array(cls[keep], pa.int64()), pa.array(parts, pa.binary())], ["cls", "grams"])

    found_sets = read.select("_text").mapInArrow(full, "cls bigint, grams binary").groupBy("cls").agg(F.first("grams").alias("grams"))
    carried = wanted if not components_only else wanted.select("cls", F.lit(None).cast("array<bigint>").alias("anchors"))
    sets = written(found_sets.join(carried, "cls").join(classes.select("cls", "weight"), "cls"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in group_rows(batches, 3):
            got = _linked(group, percent, components_only)
            if got is not None:
                yield got

    def links_of(dealt: DataFrame) -> DataFrame:
        """dealt: anchor, i, j, role, label, cls. Roles of a class in the task (i, j): 0 in the trie, 1 walks, 2 both."""
        filled = dealt.join(sets, "cls").select("anchor", "i", "j", "role", "label", "cls", "weight", "anchors", "grams")
        return written(filled.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j").mapInArrow(walk, "a bigint, b bigint, n bigint"))

    own, label = F.col("own"), F.lit(None).cast("bigint").alias("label")
    zero, last = F.lit(0), F.col("blocks") - 1
    if not components_only:
        # Block i walks the trie of block j, i <= j.
        other = members.withColumn("other", F.explode(F.sequence(zero, last)))
        role = F.when(own == F.col("other"), 2).when(own < F.col("other"), 1).otherwise(0).alias("role")
        found = links_of(other.select("anchor", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), role, label, "cls"))
        roots = connected(found.where("b is not null").select("a", "b"))
    else:
        # Each block walks its own trie and that of block 0.
        at_home = members.select("anchor", own.alias("i"), own.alias("j"), F.lit(2).alias("role"), label, "cls")
        to_first = members.where("own > 0").select("anchor", own.alias("i"), zero.alias("j"), F.lit(1).alias("role"), label, "cls")
        first = members.where("own = 0 and blocks > 1").withColumn("i", F.explode(F.sequence(F.lit(1), last)))
        found = links_of(at_home.union(to_first).union(first.select("anchor", "i", zero.alias("j"), zero.alias("role"), label, "cls")))
        roots = connected(found.where("b is not null").select("a", "b"))
        # What stands outside the largest component of a group of several blocks walks all of them.
        many = members.where("blocks > 1").join(roots, F.col("cls") == F.col("node"), "left").withColumn("label", F.coalesce("root", "cls")).drop("node", "root")
        parts = many.groupBy("anchor", "label").agg(F.count(F.lit(1)).alias("_n"), F.max("blocks").alias("_blocks"))
        largest = parts.groupBy("anchor").agg(F.max_by("label", F.struct("_n", "label")).alias("_largest"), F.sum("_n").alias("_all"), F.max("_n").alias("_most"), F.max("_blocks").alias("_blocks")).where("_all > _most")
        # A row for each block, so that a large group isn't joined in one task.
        largest = largest.withColumn("own", F.explode(F.sequence(zero, F.col("_blocks") - 1))).drop("_blocks")
        share = (F.col("_all") - F.col("_most")) / F.col("_all")
        many = written(many.join(largest, ["anchor", "own"]).withColumn("_walkers", F.greatest(F.lit(1), F.ceil(share * F.col("tries"))).cast("int")))
        if not many.isEmpty():
            outside = F.col("label") != F.col("_largest")
            block, trie = (F.pmod(F.xxhash64("cls", F.lit(1)), F.col(c)).cast("int") for c in ("_walkers", "tries"))
            walkers = many.where(outside).withColumn("j", F.explode(F.sequence(zero, F.col("tries") - 1))).select("anchor", block.alias("i"), "j", F.lit(1).alias("role"), "label", "cls")
            tries = many.withColumn("i", F.explode(F.sequence(zero, F.col("_walkers") - 1))).select("anchor", "i", trie.alias("j"), zero.alias("role"), "label", "cls")
            more = links_of(walkers.union(tries))
            discard(roots)
            roots = connected(found.union(more).where("b is not null").select("a", "b"))
            discard(more)
        discard(many)

    named = classes.join(roots, classes["cls"] == roots["node"], "left").select("cls", "first_id", "weight", F.coalesce("root", "cls").alias("root"))
    named = written(named)
    least = named.groupBy("root").agg(F.min("first_id").alias("component"))
    final = named.join(least, "root").select("cls", "first_id", "component", "weight")
    if not components_only:
        linked = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("_linked"))
        final = final.join(linked, "cls", "left").withColumn("n_links", F.col("weight") - 1 + F.coalesce("_linked", F.lit(0)))
    final = written(final.drop("weight", "_linked"))
    discard(roots, found, members, wanted, sets, classes, named)
    joined = rows.select("_id", "n", "cls").join(final, "cls", "left")
    mine = lambda name: F.when(F.col("cls").isNull(), F.col("_id")).otherwise(F.col(name))
    out = [F.col("_id").alias("id"), F.col("n").alias("n_shingles"), mine("component").alias("component_id"), mine("first_id").alias("class_id")]
    return joined.select(*out, *([] if components_only else [F.coalesce("n_links", F.lit(0)).alias("n_links")]))


class _Labels:
    """The labels of some of a linker's classes, as they are now."""

    def __init__(self, linker: Linker, at: np.ndarray) -> None:
        self.linker, self.at = linker, at

    def __getitem__(self, k: np.ndarray) -> np.ndarray:
        return self.linker.labels[self.at[k]]


def _linked(group: pa.Table, percent: int, components_only: bool) -> pa.RecordBatch | None:
    """Counts (a, null, n) and links (a, b, null) of one task's sets: anchor, i, j, role, label, cls, weight, anchors, grams."""
    role = np.asarray(group.column("role"))
    in_trie, walks = np.flatnonzero(role != 1), np.flatnonzero(role == 1)
    crossed = bool((role != 2).any())
    if not len(in_trie) or (crossed and not len(walks)) or (not crossed and len(in_trie) < 2):
        return None
    cls = np.asarray(group.column("cls"))
    grams = [np.frombuffer(x.as_buffer(), "<u8") for x in group.column("grams").combine_chunks()]
    given = group.column("label").fill_null(0).to_numpy()
    labels = np.unique(given, return_inverse=True)[1] if group.column("label").null_count == 0 else np.arange(len(cls))
    others = None if components_only else [x.values.to_numpy() for x in group.column("anchors").combine_chunks()]
    linker = Linker(int(group.column("anchor")[0].as_py()), cls, np.asarray(group.column("weight")), others, labels)
    trie = Trie([grams[k] for k in in_trie])

    who = walks if crossed else in_trie
    walk = trie.walk(percent, [grams[k] for k in walks] if crossed else None, _Labels(linker, in_trie) if components_only else None, _Labels(linker, who) if components_only else None)
    for y, found in walk:
        linker.add(int(in_trie[y]), who[found])
    counted = np.flatnonzero(linker.links) if not components_only else np.zeros(0, np.int64)
    a = np.concatenate([cls[counted], np.array([cls[x] for x, _ in linker.joins], np.int64)])
    b = np.concatenate([np.zeros(len(counted), np.int64), np.array([cls[y] for _, y in linker.joins], np.int64)])
    n = np.concatenate([linker.links[counted], np.zeros(len(linker.joins), np.int64)])
    if not len(a):
        return None
    is_count = np.arange(len(a)) < len(counted)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=is_count), pa.array(n, mask=~is_count)], ["a", "b", "n"])
