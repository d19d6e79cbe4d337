import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnfield.operators import hierarchy, mutate, search
from cairnfield.operators import tiling as tl
from cairnfield.operators.selection import Wanted, ranked_values
from cairnfield.plans.index import PointIndex
from cairnfield.plans.tiled import TileTable
from cairnfield.schema import Box, Params
from tests.test_points import frame, requests


def cloud(n, seed=0, kind="even"):
    r = random.Random(seed)
    place = {
        "even": lambda: tuple(r.uniform(-9, 9) for _ in range(3)),
        "ties": lambda: (r.randint(0, 4), r.randint(0, 2), 0),
        "wide": lambda: (r.choice((-1, 1)) * 10 ** r.uniform(-30, 30), r.random(), 0),
    }[kind]
    return [(i, place()) for i in range(n)]


@pytest.mark.parametrize("kind", ["even", "ties", "wide"])
def test_selection_is_exact(spark, kind):
    rows = [(i % 3, float(np.float32(p[0]))) for i, p in cloud(700, 4, kind)]
    by = {g: sorted(v for h, v in rows if h == g) for g in range(3)}
    points = spark.createDataFrame(rows, "group long, value float").repartition(5)
    for share in (0, 0.37, 1):
        ask = {g: Wanted(v[0], v[-1], int(share * (len(v) - 1))) for g, v in by.items()}
        assert ranked_values(points, ask) == {g: v[int(share * (len(v) - 1))] for g, v in by.items()}


def plain_tree(points, rows):
    cuts, todo = {}, [(1, points)]
    while todo:
        node, p = todo.pop()
        a = np.array(p, np.float32)
        spread = a.max(0) - a.min(0)
        if len(p) <= rows or not spread.max() > 0:
            continue
        k = int(spread.argmax())
        v = np.sort(a[:, k])
        cut = v[len(v) // 2] if v[len(v) // 2] > v[0] else v[v > v[0]][0]
        cuts[node] = (k, float(cut))
        todo += [(2 * node, a[a[:, k] < cut]), (2 * node + 1, a[a[:, k] >= cut])]
    return cuts


@pytest.mark.parametrize("kind", ["even", "ties"])
def test_cuts_and_nodes_equal_a_plain_tree(spark, kind):
    rows = cloud(300, 1, kind)
    state = mutate.build(frame(spark, rows)).repartition(3)
    tree = hierarchy.build(state, 30)
    assert tree.cuts == plain_tree([p for _, p in rows], 30) and len(tree.cuts) > 6
    state = mutate.add_points(mutate.delete_boxes(state, spark.createDataFrame([(0, -1.0, 3.0, -9.0, 9.0, -9.0, 9.0)], "box_id long, x_min float, x_max float, y_min float, y_max float, z_min float, z_max float")), frame(spark, [(1000 + i, (8.5, 0.1, 0.1)) for i in range(200)]))[0]
    leaves = {r["point_id"]: r["leaf"] for r in state.select("point_id", tree.leaf().alias("leaf")).collect()}
    got = {r["node"]: r for r in hierarchy.nodes(state, tree, Params(0.5, 0.7)).collect()}
    every = state.collect()
    for node, r in got.items():
        mine = [x for x in every if hierarchy.is_under(leaves[x.point_id], node)]
        alive = [x for x in mine if x.status == "LIVE"]
        assert (r["size"], r["invalid"]) == (len(mine), len(mine) - len(alive))
        assert (r["x_min"], r["z_max"]) == ((min(x.x for x in alive), max(x.z for x in alive)) if alive else (None, None))
        left = sum(hierarchy.is_under(leaves[x.point_id], 2 * node) for x in mine)
        assert r["alpha_bal"] == (None if node not in tree.cuts else max(left / len(mine), 1 - left / len(mine)))
        over = r["alpha_del"] > 0.5 or (r["alpha_bal"] or 0) > 0.7
        assert r["rebuild"] == (len(mine) > 10 and over)
    assert any(r["rebuild"] for r in got.values())


def test_tree_edges(spark):
    empty = mutate.build(frame(spark, []))
    assert hierarchy.build(empty).cuts == {} and hierarchy.nodes(empty, hierarchy.Hierarchy()).collect() == []
    same = mutate.build(frame(spark, [(i, (1, 1, 1)) for i in range(50)]))
    assert hierarchy.build(same, 5).cuts == {}
    assert hierarchy.nodes(same, hierarchy.Hierarchy()).select("node", "size", "alpha_bal", "rebuild").collect() == [(1, 50, None, False)]


def files(path):
    return {p.relative_to(path): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_only_concerned_tiles_are_rewritten(spark, tmp_path):
    rows = cloud(600, 2)
    model = {i: np.float32(p) for i, p in rows}
    table = TileTable.create(spark, frame(spark, rows), Params(0.4, 0.7), 40, str(tmp_path / "t"))
    first = files(tmp_path / "t")
    box = Box((2, 2, 2), (9, 9, 9))
    dead = {i for i, p in model.items() if (p >= 2).all() and (p < 9).all()}
    table.delete_boxes([box])
    after = files(tmp_path / "t")
    assert 0 < len(first.items() & after.items()) < len(first) and len(dead) > 10
    assert {r.point_id for r in table.state().where("status = 'DELETED'").collect()} == dead
    tops = hierarchy.tops(table.nodes())
    assert tops and 1 not in tops
    new, gone = table.rebuilt()
    last = files(tmp_path / "t")
    kept = {f for f in after if not any(hierarchy.is_under(int(f.parent.name.split("=")[1]), t) for t in tops)}
    assert kept and all(last[f] == after[f] for f in kept)
    state = {r.point_id: r.status for r in new.state().collect()}
    removed = {r.point_id for r in gone.collect()}
    assert removed and removed <= dead and state.keys() == model.keys() - removed
    assert all(state[i] == ("DELETED" if i in dead else "LIVE") for i in state) and hierarchy.tops(new.nodes()) == []
    new.readd_boxes([box]).append(frame(spark, [(5000, (1, 1, 1))]))
    assert new.state().where("status = 'LIVE'").count() == 600 - len(removed) + 1
    new.close()
    assert not (tmp_path / "t").exists()


def test_balance_of_an_index(spark):
    index = PointIndex(spark).build(frame(spark, cloud(200, 3))).with_tree(20)
    assert index.ratios() == (0.0, 0.5) and index.compact_if_wanted() is index
    grown, _ = index.add_points(frame(spark, [(1000 + i, (8.9, 8.9, 8.9)) for i in range(400)]))
    assert grown.ratios()[1] == pytest.approx(500 / 600) and grown.compact_if_wanted().tree is None
    cut, n = index.delete_boxes([Box((-10, -10, -10), (10, 10, 3))])
    assert cut.ratios()[0] == n / 200 > 0.5 and cut.compact_if_wanted().size() == 200 - n


def test_plans_do_not_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("cairnfield.storage.LOCAL_SHARED_DIR", str(tmp_path))
    index, sizes = PointIndex(spark).build(frame(spark, cloud(50, 5))), []
    for k in range(4):
        index, _ = index.add_points(frame(spark, [(100 + 10 * k + i, p) for i, p in cloud(5, 6 + k)]), thin=True)
        index = index.delete_points(requests(spark, [(k, (0, 0, 0))]))
        sizes.append(len(index.state._jdf.queryExecution().optimizedPlan().toString()))
    assert len(set(sizes)) == 1
    index.close()
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("state")]


def test_regions_are_few_rows(spark, monkeypatch):
    monkeypatch.setattr(tl, "TILE_ROWS", 60)
    points = mutate.build(frame(spark, cloud(4000, 7))).drop("seq", "status")
    tiling = tl.build(points, 16)
    boxes = spark.createDataFrame([(0, *[-20.0, 20.0] * 3), (1, 5.0, 5.0, -1.0, 1.0, -1.0, 1.0), (2, 3.0, -3.0, *[-9.0, 9.0] * 2)], "box_id long, x_min float, x_max float, y_min float, y_max float, z_min float, z_max float")
    covers = F.lit(True)
    for a in "xyz":
        covers = covers & (F.col(f"{a}_min") <= F.col(f"{a}_low")) & (F.col(f"{a}_high") < F.col(f"{a}_max"))
    whole, border = tl.split(boxes.where("box_id = 0"), tiling, [F.col(f"{a}_min").cast("double") for a in "xyz"], [F.col(f"{a}_max").cast("double") for a in "xyz"], covers)
    assert border.count() == 0 and whole.count() == tiling.tiles.count()
    got = search.multi_box_search(mutate.build(frame(spark, cloud(4000, 7))), boxes, tiling)
    assert got.where("box_id = 0").count() == got.count() == 4000
    balls = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1000.0), (1, 0.0, 0.0, 0.0, 4.0)], "query_id long, x float, y float, z float, radius float")
    near = search.multi_radius_search(points, balls, tiling).groupBy("query_id").count().collect()
    want = sum(float(np.float32(x) ** 2 + np.float32(y) ** 2 + np.float32(z) ** 2) <= 16 for _, (x, y, z) in cloud(4000, 7))
    assert {r["query_id"]: r["count"] for r in near} == {0: 4000, 1: want}
    plan = search.multi_box_search(points, boxes, tiling)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cuts_go_down_level_by_level(spark, monkeypatch):
    r = random.Random(12)
    points = frame(spark, [(i, (r.uniform(0, 9), r.randint(0, 3), r.uniform(0, 1))) for i in range(400)])
    asked, leaf = [], hierarchy.Hierarchy.leaf
    monkeypatch.setattr(hierarchy.Hierarchy, "leaf", lambda self: asked.append(1) or leaf(self))
    tree = hierarchy.build(points, 30)
    # points are led from the root once, then only from their node to its children
    assert len(asked) == 1 and tree.depth >= 4
    sizes = points.groupBy(tree.leaf().alias("n")).count().collect()
    assert max(s["count"] for s in sizes) <= 30 or all(n.bit_length() <= hierarchy.MAX_DEPTH for n in tree.cuts)
