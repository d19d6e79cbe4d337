"""Space-filling order: keys, covering cubes, and what a scan skips."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cairnfield.operators import curve, mutate, search
from cairnfield.operators.curve import Curve
from cairnfield.plans.ordered import OrderedTable
from cairnfield.schema import AXES, BALL, BOX, Box, boxes_table

UNIT = Curve(Box((0, 0, 0), (1, 1, 1)))
SMALL = {"parquet.block.size": "4096", "parquet.page.size": "1024", "parquet.block.size.row.check.min": "50"}


def scattered(spark, n, seed=3):
    return spark.range(n).select(F.col("id").alias("point_id"), *((F.rand(seed + k) * 100).cast("float").alias(a) for k, a in enumerate(AXES)), F.concat(F.lit("t"), "id").alias("tag"))


def morton(cells):
    return sum(((c >> b) & 1) << (3 * b + 2 - k) for k, c in enumerate(cells) for b in range(curve.BITS))


def test_keys_interleave_all_bits(spark):
    rng = random.Random(1)
    cells = [tuple(rng.randrange(1 << curve.BITS) for _ in AXES) for _ in range(200)] + [(0, 0, 0), (2**20 - 1,) * 3]
    rows = spark.createDataFrame(cells, "x long, y long, z long").select("*", curve.interleaved(*map(F.col, AXES)).alias("key")).collect()
    assert [r["key"] for r in rows] == [morton((r["x"], r["y"], r["z"])) for r in rows]


def test_cells_outside_the_extent_and_of_infinities(spark):
    values = [-math.inf, -5.0, 0.0, 0.5, 1.0, 7.0, math.inf]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(UNIT.cell("x", F.col("x")).alias("c")).collect()
    assert [r["c"] for r in rows] == [0, 0, 0, 2**19, 2**20 - 1, 2**20 - 1, 2**20 - 1]
    flat = Curve(Box((1, 1, 1), (1, 1, 1)))
    assert spark.createDataFrame([(9.0,)], "x double").select(flat.cell("x", F.col("x")).alias("c")).first()["c"] == 0


def test_pieces_cover_their_regions_and_are_few(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        low = [rng.random() for _ in AXES]
        # thin, long, tiny and whole boxes
        high = [v + rng.choice([0.0, 1e-6, 1e-3, 0.1, 1.0]) for v in low]
        rows.append((i, *(v for pair in zip(low, high) for v in pair)))
    boxes = spark.createDataFrame(rows, BOX)
    found = {}
    for r in UNIT.pieces(boxes, *([F.col(f"{a}_{s}") for a in AXES] for s in ("min", "max"))).collect():
        found.setdefault(r["box_id"], []).append((r["free"], r["prefix"]))
    stretches = curve.stretches(UNIT.pieces(boxes, *([F.col(f"{a}_{s}") for a in AXES] for s in ("min", "max"))))
    assert len(found) == 60 and all(len(p) <= curve.PIECES and len(set(p)) == len(p) for p in found.values())
    for i, *bounds in rows:
        for _ in range(30):
            inside = [rng.uniform(lo, hi) for lo, hi in zip(bounds[::2], bounds[1::2])]
            key = morton([min(2**20 - 1, max(0, int(v * 2**20))) for v in inside])
            # bounds are stored as floats, so a point may lie a cell beyond them
            if all(hi - lo > 1e-4 for lo, hi in zip(bounds[::2], bounds[1::2])) and all(lo + 1e-5 < v < hi - 1e-5 for v, lo, hi in zip(inside, bounds[::2], bounds[1::2])):
                assert sum(key >> 3 * free == prefix for free, prefix in found[i]) == 1
                assert any(low <= key <= high for low, high in stretches)


def test_merged_keeps_the_widest_gaps():
    assert curve.merged([(50, 60), (0, 1), (2, 3), (10, 11), (12, 20)], 2) == [(0, 20), (50, 60)]
    assert curve.merged([(5, 9), (0, 100)], 5) == [(0, 100)] and curve.merged([], 5) == []
    many = curve.merged([(10 * i, 10 * i + 1) for i in range(1000)], 64)
    assert len(many) == 64 and many[0][0] == 0 and many[-1][1] == 9991


def _read(df) -> int:
    """Rows that the scan of a plan without a shuffle hands on."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    return execution.executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_many_boxes_skip_row_groups(spark):
    table = OrderedTable.create(mutate.build(scattered(spark, 20000)).drop("seq"), options=SMALL)
    boxes = boxes_table(spark, [Box((k, k, k), (k + 1, k + 1, k + 1)) for k in range(5, 90, 4)] + [Box((10, 80, 30), (12, 82, 33))])
    bounds = ([F.col(f"{a}_{s}") for a in AXES] for s in ("min", "max"))
    near = table.near(table.curve.pieces(boxes, *bounds))
    assert "PushedFilters" in (text := near._jdf.queryExecution().toString()) and "GreaterThanOrEqual(morton" in text
    assert 0 < _read(near) < 20000 / 4
    same = lambda df: sorted(map(tuple, df.select("box_id", "point_id", *AXES, "tag").collect()))
    assert same(table.box_search(boxes)) == same(search.multi_box_search(table.state(), boxes)) != []
    table.close()


@pytest.mark.parametrize("few", [True, False])
def test_regions_equal_the_plain_search(spark, monkeypatch, few):
    from cairnfield.plans import ordered

    monkeypatch.setattr(ordered, "FEW_PIECES", 1 << 15 if few else 0)
    points = scattered(spark, 3000).union(spark.createDataFrame([(5000 + i, 50.0, 50.0, 50.0, "same") for i in range(40)], "point_id long, x float, y float, z float, tag string"))
    state = mutate.delete_boxes(mutate.build(points), boxes_table(spark, [Box((0, 0, 0), (30, 100, 100))]))
    table = OrderedTable.create(state)
    arrivals = spark.createDataFrame([(9000, 150.0, -20.0, 50.0, "far")], "point_id long, x float, y float, z float, tag string")
    table.append(mutate.build(arrivals))
    state = table.state()
    rows = [(0, 20.0, 60.0, 0.0, 50.0, 10.0, 11.0), (1, 50.0, 50.0, 50.0, 50.0, 50.0, 50.0), (2, -math.inf, math.inf, -math.inf, math.inf, -math.inf, math.inf), (3, 9.0, 8.0, 0.0, 1.0, 0.0, 1.0), (4, math.nan, 8.0, 0.0, 1.0, 0.0, 1.0), (5, 140.0, 160.0, -30.0, 0.0, 0.0, 99.0)]
    boxes = spark.createDataFrame(rows, BOX)
    name = lambda df, *cs: sorted(map(tuple, df.select(*cs).collect()))
    assert name(table.box_search(boxes), "box_id", "point_id", "tag") == name(search.multi_box_search(state, boxes), "box_id", "point_id", "tag")
    balls = spark.createDataFrame([(0, 50.0, 50.0, 50.0, 0.0), (1, 40.0, 70.0, 20.0, 9.0), (2, 0.0, 0.0, 0.0, -1.0), (3, 50.0, 50.0, 50.0, 500.0), (4, math.nan, 0.0, 0.0, 5.0)], BALL)
    plain = name(search.multi_radius_search(state, balls), "query_id", "point_id", "dist_sq")
    assert name(table.radius_search(balls), "query_id", "point_id", "dist_sq") == plain and sum(r[0] == 0 for r in plain) == 40
    table.close()


def test_empty_tables_and_a_clashing_column(spark):
    nothing = mutate.build(scattered(spark, 0))
    table = OrderedTable.create(nothing)
    boxes = boxes_table(spark, [Box((0, 0, 0), (9, 9, 9))])
    assert table.box_search(boxes).count() == 0
    full = OrderedTable.create(mutate.build(scattered(spark, 10)))
    assert full.box_search(boxes.limit(0)).count() == 0
    with pytest.raises(ValueError):
        OrderedTable.create(nothing.withColumn("morton", F.lit(1)))
