"""Operator 9 against brute force."""

import numpy as np
from pyspark.sql import functions as F

from meshloom.llm import neighbours, queries


def exact(ids, vectors, every=100, k=10):
    found = {}
    for q in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        d[ids == ids[q]] = np.inf
        first = np.lexsort((ids, d))[:k]
        found[int(ids[q])] = [(int(ids[i]), d[i]) for i in first if np.isfinite(d[i])]
    return found


def test_op9(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet").toPandas()
    want = exact(table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(float))
    got = {}
    for r in queries.op9_neighbours(spark, small).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    assert got.keys() == want.keys()
    hits = 0
    for q, rows in got.items():
        assert [r for *_, r in rows] == list(range(1, 11))
        true = dict(want[q])
        for i, score, _ in rows:
            if i in true:
                hits += 1
                assert score == true[i] or abs(score - true[i]) < 1e-12
    assert hits / (10 * len(want)) >= 0.95


def test_blocks_and_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 300)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 7)
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((2000, 16))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = neighbours.nearest_neighbours(table).collect()
    want = exact(np.arange(2000), vectors)
    assert len(rows) == 200
    assert np.mean([r["vec_id"] in dict(want[r["query_id"]]) for r in rows]) >= 0.9


def test_odd_vectors(spark):
    good = [(i, [float(i), 1.0, 0.0]) for i in range(1, 6)]
    odd = [(0, [1.0, 1.0, 0.0]), (100, [1.0, 1.0, 0.0]), (100, [1.0, 1.0, 0.0]), (7, None), (8, []), (9, [0.0, 0.0, 0.0]), (10, [1.0, None, 0.0]), (11, [float("nan"), 0.0, 0.0]), (12, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (13, [1.0, 2.0]), (200, [0.0, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, "x", "y") for i, v in good + odd], "vec_id long, embedding array<double>, block string, score string")
    rows = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest_neighbours(table).orderBy("query_id", "rank").collect()]
    assert [r for r in rows if r[0] == 0] == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 100, 0.0), (0, 4, 2, 1.0), (0, 5, 3, 2.0), (0, 6, 4, 3.0), (0, 7, 5, 4.0)]
    assert {r[0] for r in rows} == {0, 100}
    assert [r[2] for r in rows if r[0] == 100] == [0, 1, 2, 3, 4, 5]
    assert neighbours.nearest_neighbours(table.limit(0)).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    table = spark.createDataFrame([(100, [0.5, 0.5])] + [(i, [1.0, 1.0]) for i in range(40, 0, -1)], "vec_id long, embedding array<float>")
    rows = neighbours.nearest_neighbours(table.repartition(5, F.col("vec_id"))).orderBy("rank").collect()
    assert [r["vec_id"] for r in rows] == list(range(1, 11))
