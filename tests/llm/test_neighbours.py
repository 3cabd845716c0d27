import numpy as np
import pytest

from aerolith.llm import neighbours


def brute(ids, vectors, query_id, query, k=10):
    far = neighbours._distances(vectors, query)
    order = [i for i in np.lexsort((ids, far)) if ids[i] != query_id][:k]
    return [(int(ids[i]), far[i]) for i in order]


def recall(rows, ids, vectors, queries):
    good = total = 0
    for q, v in queries:
        want = brute(ids, vectors, q, v)
        got = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, len(want) + 1))
        assert [(r.score, r.vec_id) for r in got] == sorted((r.score, r.vec_id) for r in got)
        good += len({r.vec_id for r in got} & {i for i, _ in want})
        total += len(want)
    return good / total


def test_recall_on_clusters(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PER_LIST", 60)
    random = np.random.default_rng(1)
    centre = random.normal(size=(20, 32))
    vectors = (centre[random.integers(0, 20, 4000)] + 0.4 * random.normal(size=(4000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, rank int")
    rows = neighbours.search(df, df.where("vec_id % 100 = 0")).collect()
    ids, wide = np.arange(4000), vectors.astype(float)
    assert recall(rows, ids, wide, [(q, wide[q]) for q in range(0, 4000, 100)]) >= 0.9


def test_query(spark):
    sf_dir = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, vectors = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], float)
    rows = neighbours.op9_neighbours(spark, sf_dir).collect()
    assert recall(rows, ids, vectors, [(q, vectors[ids == q][0]) for q in ids if q % 100 == 0]) >= 0.9


def test_copies_ties_and_unusable_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100, [1.0, 0.0]), (200, [0.0, 2.0]), (200, [0.0, 2.0]), (41, None), (42, [0.0, 0.0]), (43, [float("nan"), 1.0]), (44, [None, 1.0]), (45, [float("inf"), 1.0]), (300, [0.0, 0.0]), (None, [1.0, 1.0]), (46, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.search(df, df.where("vec_id % 100 = 0")).collect()
    by = {q: [(r.vec_id, r.score) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] for q in {r.query_id for r in found}}
    assert set(by) == {0, 100, 200}
    assert by[0] == [(i, 0.0) for i in range(1, 11)]
    assert by[100] == [(i, 0.0) for i in range(10)]
    assert by[200] == [(i, pytest.approx(5**0.5)) for i in range(10)]


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0]), (2, [9.0, 9.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.search(df, df.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, pytest.approx(113**0.5))]
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0


def test_rotation_keeps_lengths():
    turn = neighbours.rotation(16)
    assert np.allclose(turn @ turn.T, np.eye(16))


def test_scan_without_pruning_error():
    random = np.random.default_rng(3)
    rows, queries = random.normal(size=(3000, 48)), random.normal(size=(20, 48))
    ids = np.arange(3000)
    hits = 0
    for q, (found, far) in zip(queries, neighbours.scan(ids, rows, queries, 11, neighbours.rotation(48)), strict=True):
        want = np.lexsort((ids, neighbours._distances(rows, q)))[:11]
        hits += len(set(found) & set(want))
        assert np.array_equal(far, np.sort(far))
    assert hits / 220 >= 0.97


def test_recall_without_clusters_and_with_many_lists(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PER_LIST", 50)
    random = np.random.default_rng(4)
    vectors = random.normal(size=(8000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    rows = neighbours.search(df, df.where("vec_id % 100 = 0")).collect()
    ids, wide = np.arange(8000), vectors.astype(float)
    assert recall(rows, ids, wide, [(q, wide[q]) for q in range(0, 8000, 100)]) >= 0.9


def test_exact_search_in_several_blocks_is_brute_force(spark, monkeypatch):
    for name, value in (("PER_LIST", 300), ("LIST_BLOCK", 90), ("QUERY_BLOCK", 5)):
        monkeypatch.setattr(neighbours, name, value)
    random = np.random.default_rng(5)
    vectors = np.round(random.normal(size=(2000, 20)), 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = neighbours.search(df, df.where("vec_id % 50 = 0"), exact=True).collect()
    for q in range(0, 2000, 50):
        got = [(r.vec_id, r.score) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)]
        assert got == brute(np.arange(2000), vectors, q, vectors[q])


def test_recall_at_500_lists(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PER_LIST", 16)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 20)
    random = np.random.default_rng(6)
    vectors = random.normal(size=(8000, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    rows = neighbours.search(df, df.where("vec_id % 100 = 0")).collect()
    wide = vectors.astype(float)
    assert recall(rows, np.arange(8000), wide, [(q, wide[q]) for q in range(0, 8000, 100)]) >= 0.9


def test_tests_never_leave_fewer_than_wanted():
    random = np.random.default_rng(7)
    rows, queries = random.normal(size=(500, 32)), random.normal(size=(5, 32))
    for found, _ in neighbours.scan(np.arange(500), rows, queries, 11, neighbours.rotation(32), epsilon=-20.0):
        assert len(found) == 11
