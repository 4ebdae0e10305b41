import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import nearest as N
from palimpsest.llm import queries

SCHEMA = "vec_id long, embedding array<float>, id string, `list` int"


def brute(ids, vectors, asks, k):
    """Each asking row's k nearest other rows: score down, id up."""
    out = {}
    for q in asks:
        scores = np.array([float((vectors[q] * v).sum()) for v in vectors])
        others = [(-s, i) for s, i in zip(scores, ids, strict=True) if i != ids[q]]
        out[ids[q]] = [(i, -s) for s, i in sorted(others)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) / max(len(w), 1) for q, w in want.items()])


def clustered(n, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 40 + 1, dim))
    return (centres[rng.integers(0, len(centres), n)] + 0.3 * rng.normal(size=(n, dim))).astype(np.float32).astype(float)


def test_recall_and_order_of_the_query(spark):
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    vectors, ids = np.stack(table["embedding"]).astype(float), table["vec_id"].tolist()
    want = brute(ids, vectors, [i for i, x in enumerate(ids) if x % 20 == 0], 20)
    got = found(queries.QUERIES["op11_nearest"](spark, folder))
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert recall(got, want) >= 0.9
    for rows in got.values():
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))


def test_many_lists_of_vectors_of_any_length(spark):
    vectors = clustered(3000) * np.linspace(0.2, 3, 3000)[:, None]  # norms differ, so the largest product isn't the least angle
    vectors = vectors.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, [float(x) for x in v], "x", 1) for i, v in enumerate(vectors)], SCHEMA).repartition(5)
    want = brute(list(range(3000)), vectors, range(0, 3000, 50), 10)
    got = found(N.nearest(df, F.col("vec_id") % 50 == 0, k=10, list_rows=32, sample_rows=1500, cell_rows=100))
    assert recall(got, want) >= 0.9
    for q, rows in got.items():
        assert len(rows) == 10
        for i, score in rows:
            assert abs(score - float(vectors[q] @ vectors[i])) < 1e-9


def test_a_third_of_all_rows_has_one_vector(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(900, 8)).astype(np.float32).astype(float)
    vectors[rng.permutation(900)[:300]] = vectors[0]
    df = spark.createDataFrame([(i, [float(x) for x in v], None, None) for i, v in enumerate(vectors)], SCHEMA).repartition(4)
    want = brute(list(range(900)), vectors, range(0, 900, 20), 5)
    got = found(N.nearest(df, F.col("vec_id") % 20 == 0, k=5, list_rows=50, cell_rows=30, target=1.0))
    assert recall(got, want) >= 0.99
    same = [q for q in want if (vectors[q] == vectors[0]).all()]
    assert same and all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in same)


def test_rows_that_take_no_part_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 0.0]), (9, [1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    got = found(N.nearest(df, F.lit(True)))
    assert got == {0: [(8, 1.0), (1, 0.5)], 1: [(0, 0.5), (8, 0.5)], 8: [(0, 1.0), (1, 0.5)]}
    assert N.nearest(df.where("vec_id in (2, 4)"), F.lit(True)).collect() == []
    assert N.nearest(df.where("vec_id = 0"), F.lit(True)).collect() == []
    assert N.nearest(df, F.lit(False)).collect() == []


def test_repeated_rows_are_one_candidate(spark):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (2, [3.0, 3.0])]], SCHEMA)
    got = N.nearest(df, F.col("vec_id") == 1).select("vec_id", "score").collect()
    assert sorted(tuple(r) for r in got) == [(0, 4.0), (0, 4.0), (2, 9.0), (2, 9.0)]  # each asking row has its own answer


@pytest.mark.parametrize("width", [4, 16])
def test_graph_search_finds_near_centroids(width):
    rng = np.random.default_rng(5)
    points = N._raised(clustered(4000), 40.0)
    centroids = N.balanced_centroids(points, 200, rng)
    index = N.Index(centroids, *N.neighbour_graph(centroids, rng), 40.0, 1.2, points[:, :-1])
    order, squares = N.search_graph(points[:500], index, width)
    exact = N._squares(points[:500], centroids)
    assert np.allclose(np.take_along_axis(exact, order, 1), squares)
    assert (order[:, 0] == exact.argmin(1)).mean() > 0.97
    assert (np.diff(squares, axis=1) >= 0).all()


def test_lists_are_balanced():
    points = clustered(5000)
    centroids = N.balanced_centroids(points, 100, np.random.default_rng(0))
    sizes = np.bincount(N._squares(points, centroids).argmin(1), minlength=len(centroids))
    assert len(centroids) == 100 and sizes.max() < 6 * sizes.mean()
