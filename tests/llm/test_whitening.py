import math

import numpy as np
import pytest

from cairnfield.llm import whitening as W

TABLE = "vec_id long, embedding array<float>, n string, component int"


def plain(rows, k=4):
    """The contract by numpy's eigensolver: {(row, component): values}."""
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for _, v, *_ in rows]
    once = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, sums = len(once), once.sum(axis=0)
    y = np.array((n * once - sums).tolist(), float) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = []
    for (i, *_), v in zip(rows, x, strict=True):
        far = n * np.array(v, object) - sums
        for c in range(k):
            out.append((i, c + 1, n, sum(int(a) ** 2 for a in far), float(np.array(far.tolist(), float) / n @ vectors[:, c] / np.sqrt(values[c])), values[c] / (y * y).sum() * n))
    return out


def check(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[3], abs(r[4]))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    signs = {}
    for g, w in zip(got, want, strict=True):
        if abs(w[4]) > 1e-6:
            signs.setdefault(g[1], np.sign(g[4] * w[4]))
        assert g[4] * signs.get(g[1], 1) == pytest.approx(w[4], abs=1e-8)
        assert g[5] == pytest.approx(w[5], rel=1e-10) and g[6] < 1e-10


def test_equals_the_eigensolver(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(23, 23)) * np.linspace(1, 0.9, 23)
    rows = [(k, (rng.normal(size=23) @ mix).astype(np.float32).tolist(), "n", 1) for k in range(300)]
    rows += [(1000 + k, rows[k % 3][1], None, None) for k in range(200)] + [(None, rows[5][1], None, None)]
    got = W.whiten(spark.createDataFrame(rows, TABLE).repartition(5))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(got.collect(), plain(rows))


def test_edges(spark):
    bad = [(1, None, "", 1), (2, [1.0, None, 2.0], "", 1), (3, [1.0, float("nan"), 2.0], "", 1), (4, [1.0, float("-inf"), 2.0], "", 1)]
    run = lambda rows: W.whiten(spark.createDataFrame(rows, TABLE)).collect()
    assert run([]) == run(bad) == run([(1, [], "", 1)]) == []
    assert run([(1, [0.5, 0.25], "", 1), (2, [0.5, 0.25], "", 1)]) == []
    # one direction only, so one component
    line = [(k, [k / 4, -k / 4, 0.0], "", 1) for k in range(5)]
    got = run([*bad, *line, line[0]])
    assert len(got) == 6 and {r.component for r in got} == {1} and {r.n for r in got} == {5}
    check([r for r in got], plain([*line, line[0]], 1))
    # missing entries are zero
    assert sorted(r.whitened for r in run([(1, [1.0], "", 1), (2, [1.0, 2.0], "", 1)])) == pytest.approx([-1, 1])


def test_deviations_are_exact_or_null():
    sums = np.array([3 * 2**40, -(2**40)], object)
    x = np.array([[2**40, 5], [7, -(2**35)]])
    exact = [sum((3 * int(a) - int(s)) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    assert W._deviations(x, 3, sums) == [e if e < 2**63 else None for e in exact]
    small = np.array([[2**20, 5], [7, -3]])
    assert W._deviations(small, 3, np.array([1, 2], object)) == [(3 * 2**20 - 1) ** 2 + 13**2, 20**2 + 11**2]


def test_lanczos_restarts_and_breakdowns():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(200, 200)))[0]
    spectrum = np.concatenate(([9, 9, 9, 8.9, 8.8], np.linspace(8.5, 0, 195)))
    a = (q * spectrum) @ q.T
    passes = []
    values, vectors = W.lanczos(lambda v: passes.append(1) or a @ v, 200, 5, block=4, held=24)
    assert len(passes) > 6 and values == pytest.approx(spectrum[:5], abs=1e-9)
    assert np.abs(a @ vectors - vectors * values).max() < 1e-9
    # rank 3: the first product already breaks down
    b = (q[:, :3] * [5, 4, 3]) @ q[:, :3].T
    values, vectors = W.lanczos(lambda v: b @ v, 200, 4)
    assert values == pytest.approx([5, 4, 3, 0], abs=1e-9)
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12


def test_written_tables_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("cairnfield.storage.LOCAL_SHARED_DIR", str(tmp_path))
    rows = spark.createDataFrame([(k, [float(k), k * k / 8], "", 1) for k in range(9)], TABLE)
    W.fit(rows.select(W.whole(W.F.col("embedding")).alias("x")))
    assert list(tmp_path.iterdir()) == []
