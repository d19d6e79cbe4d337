import random

import pytest
from pyspark.sql import functions as F

from cairnfield.operators import search
from cairnfield.operators import tiling as tl
from cairnfield.plans import oplog, workload
from cairnfield.plans.registry import QUERIES
from cairnfield.schema import Box, boxes_table
from tests.model import Model
from tests.test_points import frame, queries, requests

SMALL = "/root/testdata/sf0.001"
SPOTS = [(x, y, 0) for x in range(3) for y in range(2)]


def script(seed, n=14):
    """Batches of changes in few places, with identifiers that don't follow arrival."""
    r, out, free = random.Random(seed), [], random.Random(seed).sample(range(1000), 400)
    for _ in range(n):
        kind = r.choice(("add", "add", "delete", "delete", "delete boxes", "restore"))
        if kind == "add":
            out.append((kind, [(free.pop(), r.choice(SPOTS)) for _ in range(r.randint(1, 12))]))
        elif kind == "delete":
            out.append((kind, [(k, r.choice([*SPOTS, (9, 9, 9)])) for k in range(r.randint(1, 9))]))
        else:
            x = r.randint(0, 2)
            out.append((kind, [Box((x, 0, 0), (x + r.randint(1, 2), r.randint(1, 2), 1))]))
    return [(free.pop(), r.choice(SPOTS)) for _ in range(9)], out


class Steps:
    """One batch after the other; requests take what came first, then the smallest identifier."""

    def __init__(self, points):
        self.state = {i: [p, 0, "LIVE"] for i, p in points}

    def step(self, seq, kind, rows):
        if kind == "add":
            self.state |= {i: [p, seq, "LIVE"] for i, p in rows}
        elif kind == "delete":
            for _, q in rows:
                here = sorted((b, i) for i, (p, b, s) in self.state.items() if p == q and s == "LIVE")
                if here:
                    self.state[here[0][1]][2] = "DELETED"
        else:
            was, becomes = ("LIVE", "DELETED") if kind == "delete boxes" else ("DELETED", "LIVE")
            for v in self.state.values():
                if v[2] == was and any(all(lo <= c < hi for c, lo, hi in zip(v[0], b.low, b.high, strict=True)) for b in rows):
                    v[2] = becomes

    def live(self):
        return {i for i, v in self.state.items() if v[2] == "LIVE"}


def logged(spark, batches):
    log = oplog.OpLog.create(spark)
    for kind, rows in batches:
        if kind == "add":
            log.add(frame(spark, rows))
        elif kind == "delete":
            log.delete(requests(spark, rows))
        else:
            (log.delete_boxes if kind == "delete boxes" else log.readd_boxes)(boxes_table(spark, rows))
    return log


@pytest.mark.parametrize("seed", [1, 2])
def test_a_log_equals_its_steps_at_every_time(spark, seed, monkeypatch, tmp_path):
    monkeypatch.setattr("cairnfield.storage.LOCAL_SHARED_DIR", str(tmp_path))
    points, batches = script(seed)
    log = logged(spark, batches)
    # read again, as another session would
    rows = oplog.OpLog(spark, log.path).rows()
    lives = oplog.lifetimes(frame(spark, points), rows)
    spans = [(r.point_id, r.born, r.died) for r in lives.collect()]
    steps = Steps(points)
    for seq, (kind, what) in enumerate(batches, 1):
        steps.step(seq, kind, what)
        assert sorted(i for i, b, d in spans if b <= seq and (d is None or d > seq)) == sorted(steps.live()), (seq, kind)
    assert {r.point_id: r.status for r in oplog.replay(frame(spark, points), rows).collect()} == {i: v[2] for i, v in steps.state.items()}
    assert {r.point_id for r in oplog.as_of(lives, 0).collect()} == {i for i, _ in points}
    log.close()


def test_log_edges(spark):
    log = oplog.OpLog.create(spark)
    assert log.last() == 0 and oplog.replay(frame(spark, []), log.rows()).collect() == []
    points = frame(spark, [(1, (0, 0, 0))])
    assert [r.status for r in oplog.replay(points, log.rows()).collect()] == ["LIVE"]
    log.delete(requests(spark, [(0, (5, 5, 5)), (1, (0, 0, 0)), (2, (0, 0, 0))])).add(frame(spark, [(0, (0, 0, 0))]))
    assert {r.point_id: r.status for r in oplog.replay(points, log.rows()).collect()} == {1: "DELETED", 0: "LIVE"}
    log.close()


def test_nearest_as_of_a_time(spark, monkeypatch):
    monkeypatch.setattr(tl, "TILE_ROWS", 60)
    monkeypatch.setattr(tl, "CELL_ROWS", 4)
    r = random.Random(5)
    rows = [(i, *(r.uniform(-5, 5) for _ in range(3)), b := r.randint(0, 90), r.choice((None, b + r.randint(1, 30)))) for i in range(500)]
    lives = spark.createDataFrame(rows, "point_id long, x float, y float, z float, born long, died long")
    asked = [(k, *(r.uniform(-7, 7) for _ in range(3)), r.randint(-5, 100)) for k in range(40)]
    table = spark.createDataFrame(asked, "query_id long, x float, y float, z float, at long")
    for few in (4096, 5):
        monkeypatch.setattr(search, "FEW_QUERIES", few)
        for cap in (None, 2.0):
            got = {}
            for x in search.knn_as_of(lives, table, 4, cap).orderBy("query_id", "rank").collect():
                got.setdefault(x.query_id, []).append((x.dist_sq, x.point_id))
            for k, *p, at in asked:
                model = Model()
                model.build([(i, (x, y, z)) for i, x, y, z, b, d in rows if b <= at and (d is None or d > at)])
                assert got.get(k, []) == model.nearest(p, 4, *([cap] if cap else []))


def test_workload_equals_the_model(spark, monkeypatch):
    for name, value in {"POINTS": 300, "INSERTS": 6, "DELETES": 3, "QUERIES": 2, "BOXES": 2, "EDGE": 4.0, "DELETE_EVERY": 10, "RESTORE_EVERY": 5}.items():
        monkeypatch.setattr(workload, name, value)
    points, log, asked = workload.steps(spark, 20)
    model, want = Model(), {}
    model.build([(r.point_id, (r.x, r.y, r.z)) for r in points.collect()])
    batches = {}
    for r in log.collect():
        batches.setdefault((r.seq, r.op), []).append(r)
    by_time = {}
    for r in asked.collect():
        by_time.setdefault(r["at"], []).append(r)
    for seq, op in sorted({*batches, *((t, "query") for t in by_time)}):
        rows = batches.get((seq, op), [])
        if op == "ADD_POINT":
            model.add([(r.point.point_id, (r.point.x, r.point.y, r.point.z)) for r in rows])
        elif op == "DELETE_POINT":
            model.delete([(r.point.point_id, (r.point.x, r.point.y, r.point.z)) for r in rows])
        elif op == "query":
            want |= {r.query_id: model.nearest((r.x, r.y, r.z), workload.K) for r in by_time[seq]}
        else:
            boxes = [((r.box.x_min, r.box.y_min, r.box.z_min), (r.box.x_max, r.box.y_max, r.box.z_max)) for r in rows]
            model.change_boxes(boxes, *(("LIVE", "DELETED") if op == "DELETE_BOX" else ("DELETED", "LIVE")))
    got = {}
    for r in workload.run(spark, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.dist_sq, r.point_id))
    assert got == want and len(want) == 40 and len(batches) == 20 + 19 + 2 + 4
    assert queries(spark, []).count() == 0


def test_points_of_different_batches_may_share_an_identifier(spark):
    points = [(7, (0, 0, 0)), (8, (1, 0, 0)), (9, (2, 0, 0))]
    batches = [
        ("add", [(7, (2, 0, 0)), (8, (1, 0, 0)), (9, (0, 1, 0))]),
        ("delete", [(0, (1, 0, 0)), (1, (2, 0, 0))]),
        ("delete boxes", [Box((0, 0, 0), (1, 1, 1))]),
    ]
    log = logged(spark, batches)
    got = sorted((r.point_id, (r.x, r.y, r.z), r.status) for r in oplog.replay(frame(spark, points), log.rows()).collect())
    assert got == [
        (7, (0, 0, 0), "DELETED"), (7, (2, 0, 0), "LIVE"), (8, (1, 0, 0), "DELETED"),
        (8, (1, 0, 0), "LIVE"), (9, (0, 1, 0), "LIVE"), (9, (2, 0, 0), "DELETED"),
    ]
    lives = oplog.lifetimes(frame(spark, points), log.rows())
    assert sorted((r.point_id, r.x, r.y) for r in oplog.as_of(lives, 3).collect()) == [(7, 2, 0), (8, 1, 0), (9, 0, 1)]
    log.close()


def test_early_queries_do_not_meet_all_cells(spark, monkeypatch):
    monkeypatch.setattr(tl, "TILE_ROWS", 200)
    monkeypatch.setattr(tl, "CELL_ROWS", 4)
    monkeypatch.setattr(search, "FEW_QUERIES", 3)
    r = random.Random(9)
    rows = [(i, *(r.uniform(-5, 5) for _ in range(3)), i, None) for i in range(4000)]
    lives = spark.createDataFrame(rows, "point_id long, x float, y float, z float, born long, died long")
    # at these times under three of a hundred points are live, too few for the cells around a query
    asked = [(k, *(r.uniform(-5, 5) for _ in range(3)), 60 + k) for k in range(40)]
    dealt, spread = [], tl.spread
    monkeypatch.setattr(tl, "spread", lambda *a: dealt.append(spread(*a)) or dealt[-1])
    got = {}
    for x in search.knn_as_of(lives, spark.createDataFrame(asked, "query_id long, x float, y float, z float, at long"), 2).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.point_id)
    for k, *p, at in asked:
        model = Model()
        model.build([(i, (x, y, z)) for i, x, y, z, b, _ in rows if b <= at])
        assert got[k] == [i for _, i in model.nearest(p, 2)]
    cells = tl.placed(lives, tl.build(lives)).select("tile", "cell").distinct().count()
    assert dealt[0].count() < 40 * cells / 3


def test_a_fold_shuffles_once_and_keeps_only_its_result(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("cairnfield.storage.shared_dir", lambda _: str(tmp_path))
    plans, wrote = [], oplog.staged
    monkeypatch.setattr(oplog, "staged", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or wrote(df, name))
    got = QUERIES["oplog_replay"](spark, SMALL)
    assert plans[-1].count("Exchange hashpartitioning") == 1 and "Join" not in plans[-1]
    assert [f.name.split("-")[0] for f in tmp_path.iterdir()] == ["replayed"] and got.count() == 13000


@pytest.mark.parametrize(("crowd", "few"), [(6, 100), (6, 0), (1 << 16, 0)])
def test_crowded_places_and_many_boxes_equal_the_steps(spark, monkeypatch, crowd, few):
    monkeypatch.setattr(oplog, "CROWD", crowd)
    monkeypatch.setattr(oplog, "SAMPLE", 1)
    monkeypatch.setattr(oplog, "FEW_BOXES", few)
    points, batches = script(3)
    log, steps = logged(spark, batches), Steps(points)
    for seq, (kind, what) in enumerate(batches, 1):
        steps.step(seq, kind, what)
    assert sorted((r.point_id, r.status) for r in oplog.replay(frame(spark, points), log.rows()).collect()) == sorted((i, v[2]) for i, v in steps.state.items())
    if few:
        lives = oplog.lifetimes(frame(spark, points), log.rows())
        assert sorted(r.point_id for r in oplog.as_of(lives, len(batches)).collect()) == sorted(steps.live())
    log.close()


def test_what_boxes_contain_is_never_stored(spark, monkeypatch):
    points = [(i, (i % 20, i // 20, 0)) for i in range(200)]
    boxes = [Box((0, 0, 0), (20, 10, 1))] * 60
    log = logged(spark, [("delete boxes" if k % 2 else "restore", [b]) for k, b in enumerate(boxes[:3])])
    for k in range(2):
        log.append(oplog.box_rows("ADD_BOX" if k else "DELETE_BOX", boxes_table(spark, boxes), F.col("box_id") * 2 + 10 + k))
    stored, wrote = [], oplog.staged
    monkeypatch.setattr(oplog, "staged", lambda df, name: stored.append(wrote(df, name)) or stored[-1])
    monkeypatch.setattr(oplog, "dropped", lambda *tables: None)
    lives = oplog.lifetimes(frame(spark, points), log.rows())
    # each of 120 changes ends or begins 200 stretches, which are 200 rows
    assert lives.count() == 200 * 62 and oplog.as_of(lives, 10).count() == 0 and oplog.as_of(lives, 11).count() == 200
    assert max(t.count() for t in stored) == 200
    log.close()
