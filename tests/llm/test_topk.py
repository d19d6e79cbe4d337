import math
import random

import pytest
from pyspark.sql import functions as F

from cairnfield.llm import topk as T


def brute(rows, queries, k):
    whole = lambda v: None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(64 * x) for x in v]
    rows = [(i, whole(v)) for i, v in rows if i is not None and whole(v) is not None]
    out = []
    for q, v in {(i, tuple(v)) for i, v in rows if i in queries}:
        scores = [(-max(-T.LONG, min(T.LONG, sum(a * b for a, b in zip(v, w)))), i) for i, w in rows if i != q]  # noqa: B905
        out += [(q, n, i, max(-T.LONG, min(T.LONG, int(-s)))) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def check(spark, rows, k=20):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, vector int").repartition(3)
    vectors = df.select("vec_id", T.whole(F.col("embedding")).alias("vector"))
    got = T.search(vectors, vectors.where("vec_id % 20 = 0"), k).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute([r[:2] for r in rows], {i for i, *_ in rows if i is not None and i % 20 == 0}, k)


@pytest.mark.parametrize("spread", [1.0, 0.02])
def test_equals_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 64)
    monkeypatch.setattr(T, "QUERY_BLOCK", 7)
    monkeypatch.setattr(T, "SLICE_ROWS", 100)
    r = random.Random(2)
    check(spark, [(i, [r.gauss(0, spread) for _ in range(24)], 1) for i in range(700)])


def test_edges(spark):
    rows = [(0, [1.0, 2.0], 1), (20, None, 1), (40, [1.0, None], 1), (60, [float("nan"), 1.0], 1), (80, [float("inf"), 1.0], 1), (1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1), (2, [0.5, 0.5], 1), (None, [9.0, 9.0], 1), (3, [-0.001, 0.0], 1), (5, [1.0], None), (100, [], 1)]
    check(spark, rows, 4)
    check(spark, rows[:0])


def test_huge_components(spark):
    check(spark, [(i, [1e17 * (i % 5 - 2), 3.0 + i], 1) for i in range(30)] + [(40, [1e30, 1e30], 1), (41, [1e30, 1e29], 1)], 40)


def test_scores_above_2_to_the_53_are_whole_numbers(spark):
    """Scores of 2^53 + 2, 2^53 + 1 and 2^53, which doubles can't tell apart."""
    big = 2.0**26
    rows = [(0, [big / 64, 1 / 64], 1)] + [(i, [2.0**27 / 64, d / 64], 1) for i, d in ((1, 0), (2, 1), (3, 2))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, vector int")
    vectors = df.select("vec_id", T.whole(F.col("embedding")).alias("vector"))
    got = T.search(vectors, vectors.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(3, 2**53 + 2), (2, 2**53 + 1), (1, 2**53)]
    check(spark, rows)


def test_one_plan_for_any_number_of_queries(spark, monkeypatch):
    monkeypatch.setattr(T, "QUERY_BLOCK", 3)
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 3)], 1) for i in range(100)], "vec_id long, embedding array<double>, vector int")
    vectors = df.select("vec_id", T.whole(F.col("embedding")).alias("vector"))
    plan = T.search(vectors, vectors.where("vec_id % 2 = 0"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Broadcast" not in plan


def test_queries_with_one_id_are_ranked_together(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [3.0, 1.0]), (2, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = T.search(vectors, vectors.where("vec_id = 0"), 3).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(1, 1, 3), (2, 1, 2), (3, 2, 2)]


def test_bounds_hold(spark):
    import numpy as np

    r = np.random.default_rng(1)
    a, b = r.normal(size=(50, 64)).round(1), r.normal(size=(60, 64)).round(1) + 1
    for s in T.LEVELS:
        assert (T.summary(a, s) @ T.summary(b, s).T + 1e-9 >= a @ b.T).all()
