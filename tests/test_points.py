import math
import random

import pytest
from pyspark.sql import functions as F

from cairnfield.functions.ranking import ranked
from cairnfield.operators import downsample, maintenance, mutate, search, stats
from cairnfield.operators import tiling as tl
from cairnfield.plans.index import PointIndex
from cairnfield.schema import Box, Params, boxes_table
from tests.model import Model

POINTS = "point_id long, x float, y float, z float, tag string"


def frame(spark, rows):
    return spark.createDataFrame([(i, *map(float, p), f"t{i}") for i, p in rows], POINTS)


def requests(spark, rows):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in rows], "request_id long, x float, y float, z float")


def queries(spark, rows):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in rows], "query_id long, x float, y float, z float")


def statuses(state):
    return {r.point_id: r.status for r in state.collect()}


def test_box_faces_and_odd_boxes(spark):
    state = mutate.build(frame(spark, [(0, (0, 0, 0)), (1, (1, 1, 1)), (2, (0.5, 0.5, 0.5))]))
    ids = lambda b: {r.point_id for r in search.box_search(state, b).collect()}
    assert ids(Box((0, 0, 0), (1, 1, 1))) == {0, 2}
    assert ids(Box((0, 0, 0), (1, 0, 1))) == ids(Box((1, 1, 1), (0, 0, 0))) == set()
    with pytest.raises(ValueError):
        Box((math.nan, 0, 0), (1, 1, 1))
    assert "tag" in search.box_search(state, Box((0, 0, 0), (1, 1, 1))).columns


def test_ball_is_closed(spark):
    state = mutate.build(frame(spark, [(0, (3, 4, 0)), (1, (3, 4, 0.01))]))
    assert [r.point_id for r in search.radius_search(state, (0, 0, 0), 5).collect()] == [0]
    for bad in (-1, math.nan):
        with pytest.raises(ValueError):
            search.radius_search(state, (0, 0, 0), bad)


def test_nan_and_null_points_are_not_points(spark):
    rows = spark.createDataFrame([(0, 1.0, 1.0, 1.0), (1, math.nan, 1.0, 1.0), (2, None, 1.0, 1.0)], "point_id long, x double, y double, z double")
    assert mutate.build(rows).count() == 1


def test_nearest_edges(spark):
    rows = [(0, (0, 0, 0)), (1, (2, 0, 0)), (2, (-2, 0, 0))]
    state = mutate.build(frame(spark, rows))
    got = search.knn(state, queries(spark, [(7, (0, 0, 0)), (8, (math.nan, 0, 0))]), 5).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.point_id, r.dist_sq) for r in got] == [(7, 1, 0, 0.0), (7, 2, 2, 4.0), (7, 3, 1, 4.0)]
    assert [r.point_id for r in search.knn(state, queries(spark, [(7, (0, 0, 0))]), 2).orderBy("rank").collect()] == [0, 2]
    assert search.knn(state, queries(spark, [(7, (0, 0, 0))]), 9, 2.0).count() == 3
    assert search.knn(state, queries(spark, [(7, (0, 0, 0))]), 9, -1.9).count() == 1
    with pytest.raises(ValueError):
        search.knn(state, queries(spark, [(7, (0, 0, 0))]), 0)
    assert search.knn(state.where("false"), queries(spark, [(7, (0, 0, 0))]), 3).count() == 0


@pytest.mark.parametrize("shape", ["even", "clusters", "ties", "line"])
def test_nearest_equals_brute_force(spark, shape, monkeypatch):
    monkeypatch.setattr(tl, "TILE_ROWS", 60)
    monkeypatch.setattr(tl, "CELL_ROWS", 4)
    r = random.Random(shape)
    place = {
        "even": lambda: (r.uniform(-5, 5), r.uniform(-5, 5), r.uniform(-5, 5)),
        "clusters": lambda: tuple(c + r.gauss(0, 0.01) for c in r.choice([(0, 0, 0), (100, 0, 0), (0, 3, 50)])),
        "ties": lambda: (r.randint(0, 3), r.randint(0, 2), 0),
        "line": lambda: (r.uniform(0, 1000), 5, 5),
    }[shape]
    rows = [(i, place()) for i in range(900)]
    asked = [(i, place()) for i in range(25)] + [(100, (1e6, -1e6, 0)), (101, rows[3][1])]
    model = Model()
    model.build(rows)
    got = {}
    for row in search.knn(mutate.build(frame(spark, rows)), queries(spark, asked), 6).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.dist_sq, row.point_id))
    assert got == {i: model.nearest(p, 6) for i, p in asked}


def test_many_regions_equal_few(spark, monkeypatch):
    r = random.Random(1)
    rows = [(i, tuple(r.uniform(-5, 5) for _ in range(3))) for i in range(800)]
    state = mutate.build(frame(spark, rows))
    boxes = boxes_table(spark, [Box.around(p, (1, 1, 1)) for _, p in rows[:40]])
    balls = queries(spark, rows[:40]).withColumn("radius", F.lit(1.5).cast("float"))
    few = set(search.multi_box_search(state, boxes).select("box_id", "point_id").collect()), set(search.multi_radius_search(state, balls).select("query_id", "point_id").collect())
    monkeypatch.setattr(search, "FEW_REGIONS", 3)
    monkeypatch.setattr(tl, "TILE_ROWS", 50)
    monkeypatch.setattr(tl, "CELL_ROWS", 8)
    many = set(search.multi_box_search(state, boxes).select("box_id", "point_id").collect()), set(search.multi_radius_search(state, balls).select("query_id", "point_id").collect())
    assert few == many and all(few)


def test_delete_points(spark):
    rows = [(i, (1, 2, 3)) for i in range(3)] + [(3, (1.0, 1.0, 1.0)), (4, (20, 20, 20))]
    state = mutate.build(frame(spark, rows))
    got = statuses(mutate.delete_points(state, requests(spark, [(0, (1, 2, 3)), (1, (1, 2, 3)), (2, (1 + 5e-7, 1, 1)), (3, (20.00001, 20, 20)), (4, (math.nan, 0, 0))])))
    assert got == {0: "DELETED", 1: "DELETED", 2: "LIVE", 3: "DELETED", 4: "LIVE"}
    assert statuses(mutate.delete_points(state, requests(spark, [(0, (1 + 2e-6, 1, 1))])))[3] == "LIVE"
    two = mutate.build(frame(spark, [(0, (1, 1, 1)), (1, (1 + 2.5e-7, 1, 1))]))
    near = statuses(mutate.delete_points(two, requests(spark, [(0, (1 + 5e-7, 1, 1)), (1, (1 + 5e-7, 1, 1))])))
    assert set(near.values()) == {"DELETED"}


def test_boxes_delete_restore_and_compact(spark):
    index = PointIndex(spark).build(frame(spark, [(i, (i, 0, 0)) for i in range(10)]))
    index, n = index.delete_boxes([Box((0, 0, 0), (5, 1, 1)), Box((3, 0, 0), (7, 1, 1))])
    assert n == 7 and index.size() == 10 and index.validnum() == 3
    index = index.readd_boxes([Box((1, 0, 0), (3, 1, 1))])
    assert index.validnum() == 5
    index = index.compact()
    assert index.size() == 5 and index.readd_boxes([Box((0, 0, 0), (9, 1, 1))]).size() == 5
    index, removed = index.take_removed()
    assert {r.point_id for r in removed.collect()} == {0, 3, 4, 5, 6} and index.take_removed()[1].count() == 0


def test_more_boxes_than_are_tested_in_place(spark):
    state = mutate.build(frame(spark, [(i, (i, 0, 0)) for i in range(150)]))
    boxes = boxes_table(spark, [Box((2 * k, 0, 0), (2 * k + 1, 1, 1)) for k in range(101)])
    assert {i for i, s in statuses(mutate.delete_boxes(state, boxes)).items() if s == "DELETED"} == set(range(0, 150, 2))


def test_thinning_edges(spark):
    crowd = mutate.build(frame(spark, [(i, (0.01 * i, 0, 0)) for i in range(3)] + [(9, (-0.1, 0, 0))]))
    new = frame(spark, [(20, (5, 5, 5))])
    after = downsample.add_points(crowd, new, 0.2)
    assert set(statuses(after).values()) == {"LIVE"} and after.count() == 5
    tie = mutate.build(frame(spark, [(0, (0.05, 0.1, 0.1))]))
    got = statuses(downsample.add_points(tie, frame(spark, [(5, (0.15, 0.1, 0.1)), (6, (0.05, 0.1, 0.1))]), 0.2))
    assert got[0] == "DOWNSAMPLED" and 6 in got and 5 not in got
    back = mutate.readd_boxes(downsample.add_points(tie, frame(spark, [(6, (0.05, 0.1, 0.1))]), 0.2), boxes_table(spark, [Box((-9, -9, -9), (9, 9, 9))]))
    assert statuses(back)[0] == "DOWNSAMPLED"


def test_stats_and_parameters(spark):
    empty = PointIndex(spark)
    assert empty.size() == empty.validnum() == 0 and empty.extent() == Box((0, 0, 0), (0, 0, 0)) and empty.ratios() == (0.0, 0.0)
    grown, n = empty.add_points(frame(spark, [(i, (i, -i, 0)) for i in range(20)]))
    assert n == 0 and grown.size() == 20 and grown.extent() == Box((0, -19, 0), (19, 0, 0))
    cut, _ = grown.delete_boxes([Box((0, -99, 0), (15, 1, 1))])
    assert cut.ratios()[0] == 0.75 and stats.wants_compaction(cut.state, Params()) and cut.compact_if_wanted().size() == 5
    assert PointIndex(spark).with_params().params == Params(0.5, 0.7, 0.2)
    assert cut.set_voxel(1.0).set_delete_criterion(0.9).set_balance_criterion(0.8).params == Params(0.9, 0.8, 1.0)
    with pytest.raises(ValueError):
        Params(voxel=0.0)


def test_ranks_across_blocks(spark):
    df = spark.range(0, 200000, 1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    got = {(r.k, r.o): r.rank for r in ranked(df, ["k"], "o").collect()}
    for k in range(3):
        assert [got[k, o] for o in sorted(o for a, o in got if a == k)] == list(range(1, sum(a == k for a, _ in got) + 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_operations_equal_the_model(spark, seed):
    """Values are quarters, so that many points meet; every step is compared."""
    r = random.Random(seed)
    place = lambda: tuple(r.randint(-8, 8) / 4 for _ in range(3))
    model, rows = Model(), [(i, place()) for i in range(80)]
    model.build(rows)
    index = PointIndex(spark).set_voxel(1.0).build(frame(spark, rows))
    fresh = 1000
    for _ in range(7):
        op = r.choice(["add", "thin", "delete", "boxes", "restore", "compact"])
        arrivals = [(fresh + k, place()) for k in range(15)]
        boxes = [((lo := place()), tuple(v + r.randint(0, 6) / 4 for v in lo)) for _ in range(2)]
        fresh += 100
        if op == "add":
            model.add(arrivals)
            index, _ = index.add_points(frame(spark, arrivals))
        elif op == "thin":
            n = model.add_thinned(arrivals, 1.0)
            index, counted = index.add_points(frame(spark, arrivals), thin=True)
            assert counted == n
        elif op == "delete":
            some = [(k, r.choice(rows)[1]) for k in range(10)]
            model.delete(some)
            index = index.delete_points(requests(spark, some))
        elif op == "boxes":
            n = model.change_boxes(boxes, "LIVE", "DELETED")
            index, counted = index.delete_boxes([Box(*b) for b in boxes])
            assert counted == n
        elif op == "restore":
            model.change_boxes(boxes, "DELETED", "LIVE")
            index = index.readd_boxes([Box(*b) for b in boxes])
        else:
            model.compact()
            index = index.compact()
        index = index.snapshot()
        assert statuses(index.state) == {i: p[3] for i, p in model.points.items()}, op
    asked = [(i, place()) for i in range(5)]
    got = {}
    for row in index.nearest(queries(spark, asked), 4).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.dist_sq, row.point_id))
    assert got == {i: model.nearest(p, 4) for i, p in asked}


def test_plans(spark, tmp_path):
    from cairnfield.sources.views import uniform

    points = uniform(spark, 3000)
    state = mutate.build(points)
    path = str(tmp_path / "state")
    maintenance.clustered(state).write.parquet(path)
    plan = search.box_search(spark.read.parquet(path), Box((0, 0, 0), (1, 1, 1)))._jdf.queryExecution().toString()
    assert "EqualTo(status,LIVE), GreaterThanOr" in plan.split("PushedFilters")[1]
    knn = search.knn(state, points.where("point_id % 100 = 0").withColumnRenamed("point_id", "query_id"), 3)
    knn = knn._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in knn and "CartesianProduct" not in knn


def test_few_queries_do_not_shuffle_points(spark):
    from cairnfield.sources.views import uniform

    state, asked = mutate.build(uniform(spark, 3000)), queries(spark, [(1, (0.1, 0.2, 0.3)), (2, (40.0, 0, 0)), (3, (0.1, 0.2, 0.3))])
    capped = search.knn(state, asked, 3, 1.0)
    plan = capped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan
    many = search.knn(state, asked, 3, 1.0, search.tl.build(state))
    assert sorted(map(tuple, capped.collect())) == sorted(map(tuple, many.collect())) and capped.count() == 6


def test_logs_can_be_replayed_and_snapshots_released(spark, tmp_path):
    index = PointIndex(spark).build(frame(spark, [(i, (i, 0, 0)) for i in range(8)]))
    start = index
    index, _ = index.add_points(frame(spark, [(20, (1, 1, 1))]))
    index, _ = index.delete_boxes([Box((0, 0, 0), (3, 1, 1))])
    index = index.delete_points(requests(spark, [(0, (5, 0, 0))])).readd_boxes([Box((0, 0, 0), (1, 1, 1))])
    assert [x[0] for x in index.log] == ["add_points", "delete_boxes", "delete_points", "readd_boxes"]
    assert statuses(start.replay(index.log).state) == statuses(index.state)
    once = index.snapshot(str(tmp_path / "a"))
    twice = once.snapshot(str(tmp_path / "b")).released()
    assert not (tmp_path / "a").exists() and twice.size() == 9
    twice.close()
    assert not (tmp_path / "b").exists()


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from cairnfield import storage

    session = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="yarn", getConf=dict))
    with pytest.raises(ValueError):
        storage.shared_dir(session)


def test_near_requests_reach_one_cell_or_two(spark):
    r = random.Random(6)
    values = [float(k) for k in range(-50, 51)] + [r.uniform(-100, 100) for _ in range(900)] + [k / 1000 for k in range(500)]
    rows = [(i, v, v + r.choice((-1, 1)) * r.uniform(0, mutate.SAME)) for i, v in enumerate(values)]
    cells = spark.createDataFrame(rows, "i long, v double, w double").select(mutate._cells_around(F.col("v")).alias("a"), mutate._fine(F.col("w")).alias("b")).collect()
    assert all(c.b in c.a and len(c.a) <= 2 for c in cells)
    assert sum(len(c.a) for c in cells) < 1.3 * len(cells)


def test_requests_beyond_a_place_take_its_neighbours(spark):
    at = [(0, 0, 0), (5e-7, 0, 0), (0, 0, 3)]
    state = mutate.build(frame(spark, [(1, at[0]), (2, at[0]), (3, at[1]), (4, at[1]), (5, at[2])]))
    # the third and fourth requests of a place with two points, and one of the place beside it
    asked = requests(spark, [(10, at[0]), (11, at[0]), (12, at[0]), (13, at[0]), (9, at[1])])
    assert statuses(mutate.delete_points(state, asked)) == {1: "DELETED", 2: "DELETED", 3: "DELETED", 4: "DELETED", 5: "LIVE"}
    after = mutate.delete_points(state, requests(spark, [(1, at[0]), (2, at[0]), (3, at[0])]))
    assert statuses(after) == {1: "DELETED", 2: "DELETED", 3: "DELETED", 4: "LIVE", 5: "LIVE"}


def test_cells_follow_the_values_of_an_axis(spark):
    r = random.Random(9)
    state = mutate.build(frame(spark, [(i, (r.randint(0, 2), r.uniform(0, 100), 7)) for i in range(6000)]))
    sizes = [c["count"] for c in tl.placed(state, tl.build(state)).groupBy("tile", "cell").count().collect()]
    assert sum(sizes) == 6000 and max(sizes) <= 4 * tl.CELL_ROWS


def test_queries_in_one_place_are_answered_once(spark, monkeypatch):
    monkeypatch.setattr(search, "FEW_QUERIES", 3)
    r, counted, bounds = random.Random(10), [], search._bounds
    rows = [(i, (r.randint(0, 3), r.randint(0, 2), r.choice((-0.0, 0.0)))) for i in range(300)]
    asked = [(1000 + i, rows[i % 40][1]) for i in range(80)] + [(2000, (50, 50, 50)), (2001, (50, 50, 50)), (2002, (math.nan, 0, 0))]
    monkeypatch.setattr(search, "_bounds", lambda kept, asked, *rest: counted.append(asked.count()) or bounds(kept, asked, *rest))
    model = Model()
    model.build(rows)
    got = {}
    for row in search.knn(mutate.build(frame(spark, rows)), queries(spark, asked), 4).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.dist_sq, row.point_id))
    assert got == {i: model.nearest(p, 4) for i, p in asked if i != 2002}
    assert counted == [len({p for _, p in asked if p[0] == p[0]})]


@pytest.mark.parametrize("falling", [False, True])
def test_thinning_counts_from_few_arrivals(spark, monkeypatch, falling):
    r, met, running = random.Random(11), [], downsample.running_min
    monkeypatch.setattr(downsample, "running_min", lambda df, *rest: met.append(df.count()) or running(df, *rest))
    old = [(i, (i % 3 + 0.9, 0.9, 0.9)) for i in range(2)]
    came = [(100 + i, (r.randint(0, 3) + (0.9 - i / 1500 if falling else r.random()), 0.5, 0.5)) for i in range(600)]
    # a little farther from the centre than one before: the same point
    came += [(1000 + i, (x + math.copysign(5e-7, x - int(x) - 0.5), y, z)) for i, (_, (x, y, z)) in enumerate(came[-30:])]
    model = Model()
    model.build(old)
    assert downsample.count(mutate.build(frame(spark, old)), frame(spark, came), 1.0).first()["added"] == model.add_thinned(came, 1.0)
    assert falling or met[0] < len(came) / 10
    assert downsample.count(mutate.build(frame(spark, old)), frame(spark, came).limit(0), 1.0).first()["added"] == 0
