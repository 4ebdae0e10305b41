"""Nearest neighbours by inner product over balanced posting lists.

Index. Inner products become distances by one more component, sqrt(m*m - |x|*|x|) with m the largest norm; queries have 0 there. Centroids are fitted on a
bounded sample by splitting clusters in two, again and again, each cut at the median of a main direction, so lists are balanced by construction. Every row is
then sent to its nearest centroid, and, where it lies near a boundary, to each further one whose distance is at most `closure` times the least and that isn't
hidden behind one that it already has (replicas). Centroids are searched through a graph of their neighbours held in each worker: a beam moves for all rows
of a batch at once. The posting lists are a table in the shared folder. A list may have any size: tasks get
cells of (list, block of postings, block of queries).

Search. A query visits the lists whose centroids are at most `ratio` times as far as its nearest one. The ratio is the one that finds the stated share of
true neighbours of sample rows among sample rows, which are sparser than all rows, so that the whole index finds more. What a visited list holds is scored by matrix
products; whatever may be among the best is scored again component by component in double precision, so equal vectors have equal scores wherever they are met.

Each query also carries a floor, its k-th score in the sample: what scores less can't be among its nearest, so most cells answer with a few rows or none.

Equal vectors are one posting: a task sends a vector with its `k` + 1 least ids, and again only if it meets smaller ones, as no larger id can be among the `k`
nearest of any query. Equal queries are one query, answered with `k` + 1 neighbours, from which each row drops itself. So a third of all rows with one vector
costs a few postings for each task, and these are dealt over the list's blocks like all others.

Bounds: sample (`sample_rows`, 32 MB), centroids (`max_lists`, a few MB when broadcast), postings and queries of a cell (about `cell_rows`). Nothing else is on
the driver. With more rows than max_lists * list_rows, lists grow, and cells grow in number, not in size.

Stated cases. Vectors that are null, empty, zero, or hold a null or a component that isn't finite take no part, neither as queries nor as candidates; nor do
those of another length than most have (ties: the shortest). Null ids take no part. Ties go to the smaller id. Fewer candidates than k: all of them. Rows that
repeat an id and a vector are one candidate, and each is answered where it asks; an id with several vectors is one for each, and none for its own queries. No rows, or no query: no rows. Other columns may
have any names. Squares of norms must be numbers that doubles hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.storage import written

K = 20
SAMPLE_ROWS = 16_384
#: and at most so much of it, as it is sent to each worker
SAMPLE_BYTES = 32 << 20
LIST_ROWS = 256
MAX_LISTS = 4_096
CELL_ROWS = 8_192
#: Boundary rows go to further lists up to so many times the least distance.
CLOSURE = 1.06
REPLICAS = 4
#: Share of true neighbours of sample rows that the ratio must reach.
TARGET = 0.97
#: Lists that a query visits at least; these answer with their best rows whatever these score, so that k rows are found.
LEAST_VISITS = 4
_SEED = 20240611


class Index(NamedTuple):
    """What workers need to send a vector to lists: a few MB, whatever the number of rows."""

    centroids: np.ndarray
    #: ids of each centroid's neighbours
    graph: np.ndarray
    #: centroids from which every search starts
    starts: np.ndarray
    largest_norm: float
    ratio: float
    #: different vectors of the sample
    sample: np.ndarray


def _raised(vectors: np.ndarray, largest: float) -> np.ndarray:
    """Rows with the component that makes the largest inner product the least distance."""
    rest = np.sqrt(np.maximum(largest * largest - np.einsum("ij,ij->i", vectors, vectors), 0))
    return np.hstack([vectors, rest[:, None]])


def _with_zero(queries: np.ndarray) -> np.ndarray:
    return np.hstack([queries, np.zeros((len(queries), 1))])


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(np.einsum("ij,ij->i", a, a)[:, None] - 2 * a @ b.T + np.einsum("ij,ij->i", b, b), 0)


def balanced_centroids(points: np.ndarray, n_lists: int, rng: np.random.Generator) -> np.ndarray:
    """Means of n_lists groups of nearly equal size: the largest group is cut at the median of its main direction until there are enough.

    The direction comes from two centres that a few rounds of two-means find, so near copies stay together; the cut keeps both sides of the share they are due.
    """
    done: list[np.ndarray] = []
    work = [(np.arange(len(points)), n_lists)]
    while work:
        rows, n = work.pop()
        if n <= 1 or len(rows) <= 1:
            done.append(points[rows].mean(0))
            continue
        here = points[rows]
        two = here[rng.choice(len(rows), 2, replace=False)]
        for _ in range(8):
            side = (_squares(here, two).argmin(1) == 1)
            if side.all() or not side.any():
                break
            two = np.stack([here[~side].mean(0), here[side].mean(0)])
        along = here @ (two[1] - two[0])
        left = n // 2
        order = np.argsort(along, kind="stable")
        at = round(len(rows) * left / n)
        work += [(rows[order[:at]], left), (rows[order[at:]], n - left)]
    return np.unique(np.stack(done), axis=0)


def neighbour_graph(centroids: np.ndarray, rng: np.random.Generator, degree: int = 24, far: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Each centroid's nearest ones and some at random, and the starts: a spread set from which the beam begins."""
    n = len(centroids)
    near = np.zeros((n, min(degree, max(n - 1, 0))), np.int32)
    for first in range(0, n, 1024):
        d = _squares(centroids[first : first + 1024], centroids)
        d[np.arange(len(d)), first + np.arange(len(d))] = np.inf
        near[first : first + 1024] = np.argpartition(d, near.shape[1] - 1, 1)[:, : near.shape[1]] if near.shape[1] else 0
    # A ring through all makes the graph connected; random arcs make it small.
    ring = np.roll(np.arange(n, dtype=np.int32), 1)[:, None]
    graph = np.sort(np.hstack([near, ring, rng.integers(0, n, (n, far)).astype(np.int32)]), 1)
    again = np.hstack([np.zeros((n, 1), bool), graph[:, 1:] == graph[:, :-1]])
    graph = np.where(again, np.arange(n, dtype=np.int32)[:, None], graph)  # an arc to itself leads nowhere
    starts = [0]
    nearest = _squares(centroids, centroids[:1])[:, 0]
    while len(starts) < min(n, max(8, int(np.sqrt(n)))):
        starts.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _squares(centroids, centroids[starts[-1:]])[:, 0])
    return graph, np.array(starts, np.int32)


def search_graph(points: np.ndarray, index: Index, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each point, centroids in order of distance and their squared distances; `width` is the length of the beam.

    All points of a call move together: in each round every point opens the nearest centroid of its beam that isn't open, until all are.
    """
    n, n_lists = len(points), len(index.centroids)
    width = min(width, n_lists)
    c_squares = np.einsum("ij,ij->i", index.centroids, index.centroids)
    p_squares = np.einsum("ij,ij->i", points, points)
    seen = np.zeros((n, n_lists), bool)
    seen[:, index.starts] = True
    beam = np.zeros((n, width), np.int32)
    far = np.full((n, width), np.inf)
    shut = np.zeros((n, width), bool)

    def enter(rows: np.ndarray, ids: np.ndarray, squares: np.ndarray) -> None:
        every, of = np.hstack([far[rows], squares]), np.hstack([beam[rows], ids])
        opened = np.hstack([shut[rows], np.zeros(ids.shape, bool)])
        best = np.argpartition(every, width - 1, 1)[:, :width]
        far[rows], beam[rows], shut[rows] = (np.take_along_axis(x, best, 1) for x in (every, of, opened))

    everyone = np.arange(n)
    enter(everyone, np.broadcast_to(index.starts, (n, len(index.starts))), _squares(points, index.centroids[index.starts]))
    going = everyone
    while len(going):
        waiting = np.where(shut[going], np.inf, far[going])
        best = waiting.argmin(1)
        some = np.isfinite(waiting[np.arange(len(going)), best])
        going, best = going[some], best[some]
        if not len(going):
            break
        shut[going, best] = True
        around = index.graph[beam[going, best]]
        row, column = np.nonzero(~seen[going[:, None], around])
        p, c = going[row], around[row, column]
        seen[p, c] = True
        squares = np.full(around.shape, np.inf)
        squares[row, column] = np.maximum(p_squares[p] + c_squares[c] - 2 * np.einsum("ij,ij->i", points[p], index.centroids[c]), 0)
        enter(going, around, squares)
    order = np.lexsort((beam, far), axis=1)
    return np.take_along_axis(beam, order, 1), np.take_along_axis(far, order, 1)


def posting_lists(points: np.ndarray, index: Index, closure: float = CLOSURE, replicas: int = REPLICAS) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: the nearest list, and those beyond a boundary that the row lies near."""
    order, squares = search_graph(points, index, max(16, 4 * replicas))
    keep = np.zeros(order.shape, bool)
    keep[:, 0] = True
    limit = squares[:, :1] * closure**2
    for j in range(1, order.shape[1]):
        wants = (squares[:, j] <= limit[:, 0]) & (keep.sum(1) < replicas)
        rows = np.flatnonzero(wants)
        if not len(rows):
            continue
        # Hidden: a list that it already has is nearer to this centroid than the row itself is.
        hidden = np.zeros(len(rows), bool)
        for i in range(j):
            apart = ((index.centroids[order[rows, j]] - index.centroids[order[rows, i]]) ** 2).sum(1)
            hidden |= keep[rows, i] & (apart < squares[rows, j] * 0.25)
        keep[rows[~hidden], j] = True
    row, column = np.nonzero(keep)
    return row, order[row, column]


def visited_lists(queries: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, list, whether it is one of the nearest): lists whose distance is at most `ratio` times the least, and the LEAST_VISITS nearest.

    The beam grows until it ends beyond the ratio.
    """
    points = _with_zero(queries)
    rows, lists, ranks, todo, width = [], [], [], np.arange(len(points)), 64
    while len(todo):
        order, squares = search_graph(points[todo], index, width)
        inside = squares <= squares[:, :1] * index.ratio**2 * (1 + 1e-12)
        inside[:, :LEAST_VISITS] = True
        whole = ~inside[:, -1] | (order.shape[1] == len(index.centroids))
        row, column = np.nonzero(inside & whole[:, None])
        rows.append(todo[row])
        lists.append(order[row, column])
        ranks.append(column)
        todo, width = todo[~whole], width * 4
    return tuple(np.concatenate(x or [np.zeros(0, int)]) for x in (rows, lists, [r < LEAST_VISITS for r in ranks]))


def _calibrated(index: Index, sample: np.ndarray, k: int, target: float, rng: np.random.Generator) -> float:
    """The least ratio by which sample rows find the target share of their true neighbours in the sample."""
    row, lists = posting_lists(_raised(sample, index.largest_norm), index)
    held = np.zeros((len(sample), len(index.centroids)), bool)
    held[row, lists] = True
    asked = rng.choice(len(sample), min(512, len(sample)), replace=False)
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1.0
    best = np.argpartition(-scores, k - 1, 1)[:, :k]
    distance = np.sqrt(_squares(_with_zero(sample[asked]), index.centroids))
    ratio = distance / np.maximum(distance.min(1, keepdims=True), 1e-300)
    needed = np.stack([np.where(held[best[i]], ratio[i], np.inf).min(1) for i in range(len(asked))])
    return float(np.sort(needed, axis=None)[min(needed.size - 1, int(np.ceil(target * needed.size)))])


def fit(sample: np.ndarray, n_rows: int, largest_norm: float, k: int = K, list_rows: int = LIST_ROWS, max_lists: int = MAX_LISTS, target: float = TARGET) -> Index:
    """The index of a sample of the rows (without equal ones), for n_rows rows in all."""
    rng = np.random.default_rng(_SEED)
    n_lists = max(1, min(max_lists, -(-n_rows // list_rows), len(sample)))
    centroids = balanced_centroids(_raised(sample, largest_norm), n_lists, rng)
    graph, starts = neighbour_graph(centroids, rng)
    index = Index(centroids, graph, starts, largest_norm, 1.0, sample)
    return index._replace(ratio=_calibrated(index, sample, k, target, rng))


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors as doubles, and the rows that they stand in."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == dim)
    if not len(at) or not dim:
        return np.zeros((0, dim)), np.zeros(0, np.int64)
    flat = pc.fill_null(pc.list_flatten(column.take(pa.array(at))).cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    vectors = flat.reshape(len(at), dim) + 0.0  # -0.0 is 0.0
    good = np.isfinite(vectors).all(1) & (vectors != 0).any(1)
    return vectors[good], at[good]


def _keys(vectors: np.ndarray) -> list[bytes]:
    """128 bits of each vector's bytes."""
    return [hashlib.blake2b(v, digest_size=16).digest() for v in np.ascontiguousarray(vectors)]


def _first_places(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where each different key first stands, and for each row which of them it has."""
    places: dict[bytes, int] = {}
    which = np.fromiter((places.setdefault(x, len(places)) for x in keys), np.int64, len(keys))
    return np.unique(which, return_index=True)[1], which


def _sent(rows: DataFrame, index, k: int) -> DataFrame:
    """Rows (id, vector) as postings (list, salt, ids, vector): one for each list that a different vector of a batch goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Index = index.value
        known: dict[bytes, np.ndarray] = {}  # of vectors that a batch had twice: the least ids so far, as later batches need only smaller ones
        salt = 0
        for batch in batches:
            vectors, at = _matrix(batch.column("vector"), found.sample.shape[1])
            keys = _keys(vectors)
            first, which = _first_places(keys)
            if not len(first):
                continue
            ids = batch.column("id").to_numpy(zero_copy_only=False)[at]
            order = np.lexsort((ids, which))
            least = [np.unique(g)[: k + 1] for g in np.split(ids[order], np.cumsum(np.bincount(which))[:-1])]
            sends = np.ones(len(first), bool)
            for i, name in enumerate(keys[j] for j in first):
                before = known.get(name)
                if before is not None:
                    both = np.unique(np.concatenate([before, least[i]]))[: k + 1]
                    sends[i] = not np.array_equal(both, before)
                    known[name] = both
                elif len(least[i]) > 1 and len(known) < 4096:
                    known[name] = least[i]
            chosen = np.flatnonzero(sends)
            for begin in range(0, len(chosen), 512):
                part = chosen[begin : begin + 512]
                row, lists = posting_lists(_raised(vectors[first[part]], found.largest_norm), found)
                salts = (salt + np.arange(len(row))).astype(np.int32) & 0x3FFFFFFF
                salt += len(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists, pa.int32()), pa.array(salts), pa.array([least[part[i]].tolist() for i in row], pa.list_(pa.int64())), pa.array([vectors[first[part[i]]].tobytes() for i in row], pa.binary())],
                    ["list", "salt", "ids", "vector"],
                )

    return rows.mapInArrow(run, "list int, salt int, ids array<bigint>, vector binary")


def _different(rows: DataFrame, dim: int) -> DataFrame:
    """(key, vector) of the different vectors of rows, which each batch sends once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, _ = _matrix(batch.column("vector"), dim)
            keys = _keys(vectors)
            first, _ = _first_places(keys)
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in first], pa.binary()), pa.array([vectors[i].tobytes() for i in first], pa.binary())], ["key", "vector"])

    # Dealt out by a number of tasks, as the search behind it is the work, not the bytes.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.mapInArrow(run, "key binary, vector binary").repartition(n, "key").groupBy("key").agg(F.first("vector").alias("vector"))


def _asked(different: DataFrame, index, k: int) -> DataFrame:
    """Different queries as (list, salt, key, vector, floor), one for each list that they visit.

    floor: minus infinity for its nearest lists; else of k + 1 different vectors of the sample the least score, so k other rows have it at least and nothing below can be among the nearest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Index = index.value
        dim = found.sample.shape[1]
        norm = np.sqrt(np.einsum("ij,ij->i", found.sample, found.sample)).max()
        salt = 0
        for batch in batches:
            keys, raw = batch.column("key"), batch.column("vector").to_pylist()
            vectors = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), dim)
            for begin in range(0, len(vectors), 512):
                part = vectors[begin : begin + 512]
                floor = np.full(len(part), -np.inf)
                if len(found.sample) > k:
                    floor = np.partition(part @ found.sample.T, -(k + 1), 1)[:, -(k + 1)] - _slack(part, norm)
                row, lists, near = visited_lists(part, found)
                salts = (salt + row).astype(np.int32) & 0x3FFFFFFF
                salt += len(part)
                at = pa.array(row + begin)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(salts), keys.take(at), batch.column("vector").take(at), pa.array(np.where(near, -np.inf, floor[row]))], ["list", "salt", "key", "vector", "floor"])

    return different.mapInArrow(run, "list int, salt int, key binary, vector binary, floor double")


def _slack(queries: np.ndarray, norm: float) -> np.ndarray:
    """More than rounding can move an inner product of each query with a vector of at most that norm."""
    return 1e-12 * queries.shape[1] * norm * np.sqrt(np.einsum("ij,ij->i", queries, queries))


def best_of_cell(queries: np.ndarray, floors: np.ndarray, vectors: np.ndarray, least_ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, posting, exact score) of the postings that hold all of each query's k nearest rows, by score and least id.

    Scores are added up in one order wherever two vectors meet.
    """
    norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors)).max(initial=0.0)
    for first in range(0, len(queries), 512):
        part = queries[first : first + 512]
        rough = part @ vectors.T
        slack = _slack(part, norm)
        floor = floors[first : first + 512] - slack
        may = rough >= floor[:, None]
        if len(vectors) > k and may.sum() > 2 * k * len(part):
            may &= rough >= (np.partition(rough, -k, 1)[:, -k] - slack)[:, None]
        row, column = np.nonzero(may)
        exact = np.concatenate([(part[row[i : i + 8192]] * vectors[column[i : i + 8192]]).sum(1) for i in range(0, len(row), 8192)] or [np.zeros(0)])
        order = np.lexsort((least_ids[column], -exact, row))
        row, column, exact = row[order], column[order], exact[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        yield first + row[rank < k], column[rank < k], exact[rank < k]


def _answered(dim: int, k: int):
    """A cell's queries answered from its postings: (key, the k nearest as score and id)."""

    def run(postings: pa.Table, queries: pa.Table) -> pa.Table:
        got = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        if len(postings) and len(queries):
            matrix = lambda t: np.frombuffer(b"".join(t.column("vector").to_pylist()), np.float64).reshape(len(t), dim)
            vectors, asked = matrix(postings), matrix(queries)
            ids = postings.column("ids").combine_chunks()
            lengths = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
            flat, begins = pc.list_flatten(ids).to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
            for row, at, exact in best_of_cell(asked, queries.column("floor").to_numpy(), vectors, flat[begins], k):
                # postings to ids; a query then keeps its k best again, each id once
                n = lengths[at]
                row, exact = np.repeat(row, n), np.repeat(exact, n)
                members = flat[np.repeat(begins[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                order = np.lexsort((members, -exact, row))
                row, exact, members = row[order], exact[order], members[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (exact[1:] != exact[:-1]) | (members[1:] != members[:-1])
                row, exact, members = row[new], exact[new], members[new]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                got.append((row[keep], exact[keep], members[keep]))
        row, exact, members = (np.concatenate(x) for x in zip(*got, strict=True))
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        pairs = pa.StructArray.from_arrays([pa.array(-exact), pa.array(members, pa.int64())], ["minus", "id"])
        best = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)).astype(np.int32)), pairs)
        return pa.table({"key": queries.column("key").combine_chunks().take(pa.array(row[starts])) if len(row) else pa.array([], pa.binary()), "best": best})

    return run


def _sample(rows: DataFrame, n: int, most: int) -> DataFrame:
    """About `most` rows by a hash of id and vector, the same ones in each run."""
    share = min(1.0, 1.2 * most / max(n, 1))
    picked = rows if share >= 1 else rows.where(F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 40)) < int(share * (1 << 40)))
    return picked.orderBy(F.xxhash64("id", "vector")).limit(most)


def _usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
    sample_rows: int = SAMPLE_ROWS, list_rows: int = LIST_ROWS, max_lists: int = MAX_LISTS, target: float = TARGET, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query holds its k nearest other rows."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    usable = rows.where(F.col("id").isNotNull() & _usable(F.col("vector")))
    # One row for each length: the index is for the length that most vectors have.
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    sizes = usable.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return _empty(spark)
    dim, n = sizes["dim"], sizes["n"]
    usable = usable.where(F.size("vector") == dim)
    picked = _sample(usable, n, min(sample_rows, SAMPLE_BYTES // (8 * dim))).select("vector").toArrow().column(0).combine_chunks()
    sample = np.unique(_matrix(picked, dim)[0], axis=0)
    index = spark.sparkContext.broadcast(fit(sample, n, float(sizes["norm"]) * (1 + 1e-9), k, list_rows, max_lists, target))
    postings = written(_sent(usable.select("id", "vector"), index, k))
    queries = written(_asked(_different(usable.where("asks").select("vector"), dim), index, k))
    return _joined(usable, postings, queries, dim, k, cell_rows)


def _blocks(table: DataFrame, cell_rows: int) -> DataFrame:
    """How many blocks each list's rows make: one row a list, at most max_lists."""
    return table.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("n"))


def _joined(usable: DataFrame, postings: DataFrame, queries: DataFrame, dim: int, k: int, cell_rows: int) -> DataFrame:
    """Cells of (list, block, block of queries), their answers, and the best of these for each query row."""
    counts = _blocks(postings, cell_rows).withColumnRenamed("n", "blocks").join(_blocks(queries, cell_rows).withColumnRenamed("n", "q_blocks"), "list")
    counts = F.broadcast(counts)  # at most max_lists rows
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    sides = []
    for table, own, other, own_name, other_name in ((postings, "blocks", "q_blocks", "block", "q_block"), (queries, "q_blocks", "blocks", "q_block", "block")):
        dealt = table.join(counts, "list").withColumn(own_name, F.col("salt") % F.col(own)).withColumn(other_name, F.explode(every(other)))
        sides.append(dealt.drop("salt", "blocks", "q_blocks").groupBy("list", "block", "q_block"))
    answers = sides[0].cogroup(sides[1]).applyInArrow(_answered(dim, k + 1), "key binary, best array<struct<minus:double,id:bigint>>")
    first = lambda x: F.slice(F.array_sort(F.array_distinct(F.flatten(x))), 1, k + 1)
    merged = answers.groupBy("key").agg(first(F.collect_list("best")).alias("best"))
    asking = _query_keys(usable.where("asks").select("id", "vector"), dim)
    # A third of the queries may be one vector: AQE splits that key, as neither side is aggregated by it.
    found = asking.join(merged.hint("merge"), "key").select("id", F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, k).alias("best"))
    out = found.select("id", F.posexplode("best").alias("at", "one"))
    return out.select(F.col("id").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("one.id").alias("vec_id"), (-F.col("one.minus") + F.lit(0.0)).alias("score"))


def _query_keys(rows: DataFrame, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, at = _matrix(batch.column("vector"), dim)
            if not len(at):
                continue
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(_keys(vectors), pa.binary())], ["id", "key"])

    return rows.mapInArrow(run, "id long, key binary")


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
