"""Box, ball and nearest-neighbour queries over live points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.functions.geometry import axes, box_dist_sq, box_far_sq, dist_sq, in_box, in_fixed_box, real
from cairnfield.operators import tiling as tl
from cairnfield.schema import AXES, LIVE, Box, finite
from cairnfield.storage import dropped, staged

#: Regions up to this number are broadcast; more are joined by tile and cell.
FEW_REGIONS = 1000
#: Nearest-neighbour queries up to this number are broadcast, and points aren't shuffled.
FEW_QUERIES = 4096


def live(state: DataFrame) -> DataFrame:
    """The live points of a state: all columns but the status."""
    return (state.where(F.col("status") == LIVE) if "status" in state.columns else state).drop("status")


def box_search(state: DataFrame, box: Box) -> DataFrame:
    """Live points in a half-open box. The bounds are plain comparisons with literals, so they
    reach the scan of a stored state and prune its row groups."""
    return live(state).where(in_fixed_box(box))


def radius_search(state: DataFrame, centre: tuple[float, float, float], radius: float) -> DataFrame:
    """Live points in a closed ball, with ``dist_sq``.

    The distance can't be pushed to a scan; bounds of the ball's box, a little wider than
    floats could tell apart, are added for that.
    """
    if radius != radius or radius < 0:
        raise ValueError("a radius is a number that isn't negative")
    points = live(state)
    for a, c in zip(AXES, centre, strict=True):
        reach = radius * (1 + 1e-5) + abs(c) * 1e-6 + 1e-30
        points = points.where((F.col(a) >= real(c - reach)) & (F.col(a) <= real(c + reach)))
    d = dist_sq(axes(), tuple(map(real, centre)))
    return points.withColumn("dist_sq", d).where(F.col("dist_sq") <= real(radius) * real(radius))


def _small(regions: DataFrame) -> bool:
    return len(regions.limit(FEW_REGIONS + 1).take(FEW_REGIONS + 1)) <= FEW_REGIONS


def multi_box_search(state: DataFrame, boxes: DataFrame, tiling: tl.Tiling | None = None) -> DataFrame:
    """A row (box_id, point columns) for each live point in each of many boxes.

    A few boxes, which is checked, are broadcast. More are dealt to the tiles and cells that
    they touch, and meet the points of these in an equi-join; tiles that a box covers
    whole are one row of it, and their points aren't tested.
    """
    points = live(state)
    bounds = boxes.where(finite(tuple(f"{a}_{s}" for a in AXES for s in ("min", "max"))))
    low, high = axes("", "_min"), axes("", "_max")
    if tiling is None and _small(bounds):
        joined = points.join(F.broadcast(bounds), in_box(axes(), low, high))
    else:
        tiling = tiling or tl.build(points)
        covers = F.lit(True)
        for a in AXES:
            covers = covers & (F.col(f"{a}_min") <= F.col(f"{a}_low")) & (F.col(f"{a}_high") < F.col(f"{a}_max"))
        whole, border = tl.split(bounds, tiling, [c.cast("double") for c in low], [c.cast("double") for c in high], covers)
        placed = tl.placed(points, tiling)
        tested = placed.join(border, ["tile", "cell"]).where(in_box(axes(), low, high))
        joined = tested.select("box_id", *points.columns).union(placed.join(whole, "tile").select("box_id", *points.columns))
    return joined.select("box_id", *points.columns)


def multi_radius_search(state: DataFrame, balls: DataFrame, tiling: tl.Tiling | None = None) -> DataFrame:
    """A row (query_id, point columns, dist_sq) for each live point in each of many balls; as
    ``multi_box_search``. Balls with a null, a NaN or a negative radius match nothing."""
    points = live(state)
    named = balls.where(finite((*AXES, "radius")) & (F.col("radius") >= 0)).select("query_id", *(F.col(a).alias(f"q_{a}") for a in AXES), "radius")
    centre = axes("q_")
    inside = dist_sq(axes(), centre) <= F.col("radius") * F.col("radius")
    if tiling is None and _small(named):
        joined = points.join(F.broadcast(named), inside)
    else:
        tiling = tiling or tl.build(points)
        reach = F.col("radius").cast("double")
        # the farthest corner is well inside, so that rounding to floats can't matter
        corners = (tuple(F.col(f"{a}_{s}") for a in AXES) for s in ("low", "high"))
        covers = box_far_sq(centre, *corners) * (1 + 1e-5) + 1e-30 <= reach * reach
        whole, border = tl.split(named, tiling, [tl.widened(c, reach, -1) for c in centre], [tl.widened(c, reach, 1) for c in centre], covers)
        placed = tl.placed(points, tiling)
        columns = ["query_id", *points.columns, *(f"q_{a}" for a in AXES)]
        joined = placed.join(border, ["tile", "cell"]).where(inside).select(*columns).union(placed.join(whole, "tile").select(*columns))
    return joined.select("query_id", *points.columns, dist_sq(axes(), centre).alias("dist_sq"))


def _order(id_column: str = "point_id") -> list[Column]:
    return [F.col("dist_sq"), *(F.col(a) for a in AXES), F.col(id_column)]


def knn(state: DataFrame, queries: DataFrame, k: int, max_dist: float | None = None, tiling: tl.Tiling | None = None) -> DataFrame:
    """``query_id, rank, point columns, dist_sq``: the k nearest live points of each query.

    Ranks follow (dist_sq, x, y, z, point_id), so ties have one result. ``max_dist`` is
    inclusive and compared in double after squaring. Queries with null or NaN coordinates
    find nothing; with fewer candidates than k, all are returned.

    Exact in two equi-joins by (tile, cell), whatever the density. The first meets each
    query's own and neighbouring cells: its k-th distance there bounds the true one. The few queries
    that find fewer there meet larger blocks; one with fewer than k points in all is bounded by the farthest corner of all tiles. The second meets the cells within that bound. A few queries,
    which are counted, are broadcast, and tasks keep the k best of their points. With more,
    of points in one place only the k first are kept, and of queries in one place one is answered
    for all, so a place with very many is reduced before. A few capped queries take one join, by cells as wide as the cap.
    """
    return _knn(live(state), queries, k, max_dist, tiling)


def knn_as_of(lives: DataFrame, queries: DataFrame, k: int, max_dist: float | None = None, tiling: tl.Tiling | None = None) -> DataFrame:
    """As ``knn``, each query among the points that were live at its time ``at``: of ``lives`` (point
    columns, born, died) the rows with born <= at and a died that is null or later, or of (point columns, times) those
    with an odd number of times up to it. One
    plan answers the queries of all times; a point's rows don't overlap, so it comes once."""
    return _knn(lives, queries, k, max_dist, tiling, timed=True).drop(*LIFE)


#: Columns that tell when a point was live.
LIFE = ("born", "died", "times")


def _alive(columns: list[str]) -> Column:
    if "times" in columns:
        return F.size(F.filter("times", lambda t: t <= F.col("q_at"))) % 2 == 1
    return (F.col("born") <= F.col("q_at")) & (F.col("died").isNull() | (F.col("died") > F.col("q_at")))


def _knn(points: DataFrame, queries: DataFrame, k: int, max_dist: float | None, tiling: tl.Tiling | None, timed: bool = False) -> DataFrame:
    if k < 1:
        raise ValueError("k is at least 1")
    extra = [F.col("at").alias("q_at")] if timed else []
    alive = _alive(points.columns) if timed else F.lit(True)
    asked = queries.where(finite()).select("query_id", *(F.col(a).alias(f"q_{a}") for a in AXES), *extra)
    few = len(asked.select("query_id").limit(FEW_QUERIES + 1).take(FEW_QUERIES + 1)) <= FEW_QUERIES
    cap = float("inf") if max_dist is None else float(max_dist) * float(max_dist)
    if few and tiling is None and cap < 1e300:
        return _nearest(_capped(points, asked, cap).where(alive), points, k)
    members = None
    if not few and not timed:
        # written, as each step reads them
        place = Window.partitionBy(*AXES).orderBy("point_id")
        points = staged(points.withColumn("twin_", F.row_number().over(place)).where(F.col("twin_") <= k).drop("twin_"), "twins")
        members, asked = _one_a_place(asked)
    tiling = tiling or tl.build(points, max(tl.CELL_ROWS, k))
    kept = tl.placed(points, tiling)
    centre = axes("q_")

    bound = _bounds(kept, asked, k, tiling, few, alive)
    low, high = (tuple(F.col(f"{a}_{s}") for a in AXES) for s in ("low", "high"))
    far = box_far_sq(centre, low, high) * (1 + 1e-5) + 1e-30
    own = asked.select("*", *(F.col(f"q_{a}").alias(a) for a in AXES)).withColumn("tile", tiling.tile())
    own = own.join(F.broadcast(tiling.tiles), "tile", "left").select(*asked.columns, F.when((F.col("n") >= k) & F.lit(not timed), far).alias("near"))
    whole = tiling.extent()
    all_ = box_far_sq(centre, *(tuple(F.lit(whole[a][s]) for a in AXES) for s in (0, 1))) * (1 + 1e-5) + 1e-30
    limited = own.join(bound, "query_id", "left").select(*asked.columns, F.least(F.coalesce("bound", "near", all_), F.lit(cap)).alias("bound"))

    reach = F.sqrt("bound")
    touches = box_dist_sq(centre, low, high) <= F.col("bound") * (1 + 1e-5) + 1e-30
    dealt = tl.spread(limited, tiling, [tl.widened(c, reach, -1) for c in centre], [tl.widened(c, reach, 1) for c in centre], touches)
    # written, its size is known: if it is small, points aren't shuffled
    dealt = staged(dealt, "dealt") if few else dealt
    met = kept.join(dealt, ["tile", "cell"]).withColumn("dist_sq", dist_sq(axes(), centre))
    met = met.where((F.col("dist_sq").cast("double") <= F.col("bound")) & (F.col("dist_sq").cast("double") <= F.lit(cap)) & alive)
    found = _nearest(met, points, k)
    if members is None:
        return found
    return found.withColumnRenamed("query_id", "asker").join(members, "asker").select(found.columns)


def _one_a_place(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which query answers for each one (query_id, asker), and those that do: the first of each place."""
    asked = staged(asked, "asked")
    places = staged(asked.groupBy(*(f"q_{a}" for a in AXES)).agg(F.min("query_id").alias("asker")), "places")
    members = asked.join(places, [f"q_{a}" for a in AXES]).select("query_id", "asker")
    return members, places.withColumnRenamed("asker", "query_id").select(asked.columns)


def _nearest(met: DataFrame, points: DataFrame, k: int) -> DataFrame:
    ranks = F.row_number().over(Window.partitionBy("query_id").orderBy(*_order()))
    return met.withColumn("rank", ranks).where(F.col("rank") <= k).select("query_id", "rank", *points.columns, "dist_sq")


def _capped(points: DataFrame, asked: DataFrame, cap: float) -> DataFrame:
    """Points within the cap of each of a few queries, by cells that are a little wider."""
    edge = max(cap**0.5 * (1 + 1e-5), 1e-30)
    # bounded, so that a cell has neighbours; this never parts what is within an edge
    cell = lambda c: F.floor(F.least(F.greatest(c.cast("double") / edge, F.lit(-(2.0**52))), F.lit(2.0**52)))
    around = asked
    for a in AXES:
        own = cell(F.col(f"q_{a}"))
        around = around.withColumn(f"c_{a}", F.explode(F.array(own - 1, own, own + 1)))
    keys = [f"c_{a}" for a in AXES]
    placed = points.withColumns({f"c_{a}": cell(F.col(a)) for a in AXES})
    met = placed.join(F.broadcast(around), keys).withColumn("dist_sq", dist_sq(axes(), axes("q_")))
    return met.where(F.col("dist_sq").cast("double") <= F.lit(cap))


def _bounds(kept: DataFrame, asked: DataFrame, k: int, tiling: tl.Tiling, few: bool, alive: Column) -> DataFrame:
    """``query_id, bound``: the k-th distance of each query to what is around it, a staged table.

    Queries first meet the cells around their own. Those that find fewer than k points there, as when
    few were live at their time, meet larger and larger blocks that hold them (``BLOCKS``), up to one of all
    points: each time far fewer are left, so that what is met doesn't grow with queries times points. What
    finds no k points anywhere has no bound.
    """
    time = [c for c in asked.columns if c == "q_at"]
    life = [c for c in LIFE if c in kept.columns] if time else []
    at = asked.select("query_id", *time, *(F.col(f"q_{a}").alias(a) for a in AXES)).withColumn("tile", tiling.tile())
    points = kept.select(*AXES, *life, "tile", "cell")

    def bounded(met: DataFrame) -> DataFrame:
        near = met.where(alive).select("query_id", dist_sq(axes(), axes("q_")).cast("double").alias("d"))
        order = F.row_number().over(Window.partitionBy("query_id").orderBy("d"))
        return near.withColumn("r", order).where(F.col("r") <= k).groupBy("query_id").agg(F.max("d").alias("bound"), F.count("*").alias("c")).where(F.col("c") == k).drop("c")

    own = at.join(F.broadcast(tiling.tiles), "tile")
    around = own
    for a in AXES:
        c = tl.cell_index(F.col(a), a)
        around = around.withColumn(f"{a}_cell", F.explode(F.sequence(F.greatest(c - 1, F.lit(0)), F.least(c + 1, F.col(f"{a}_cells") - 1))))
    cells = around.select("query_id", *time, *(F.col(a).alias(f"q_{a}") for a in AXES), "tile", tl._cell([F.col(f"{a}_cell") for a in AXES]).alias("cell"))
    cells = F.broadcast(cells) if few else cells
    found = staged(bounded(points.join(cells, ["tile", "cell"])), "bounds")

    placed = own.select("query_id", *time, *(F.col(a).alias(f"q_{a}") for a in AXES), "tile", tl._cell([tl.cell_index(F.col(a), a) for a in AXES]).alias("cell"))
    # a query outside all points' tiles has no cell of its own; it meets the blocks of its tile's number
    lost = at.join(F.broadcast(tiling.tiles.select("tile")), "tile", "left_anti").select("query_id", *time, *(F.col(a).alias(f"q_{a}") for a in AXES), "tile", F.lit(0).alias("cell"))
    placed = placed.unionByName(lost)
    for block in BLOCKS:
        open_ = staged(placed.join(found.select("query_id"), "query_id", "left_anti"), "open")
        if open_.isEmpty():
            dropped(open_)
            break
        blocks = open_.withColumn("block", block()).drop("tile", "cell")
        # written, its size is known: if it is small, points aren't shuffled
        met = points.withColumn("block", block()).drop("tile", "cell").join(blocks, "block")
        more = staged(found.unionByName(bounded(met)), "bounds")
        dropped(found, open_)
        found = more
    return found


def _block(bits: int, tiles: int) -> Column:
    """The block of the columns tile and cell: cells of a tile without their last ``bits`` along each axis, or all,
    and tiles without their last ``tiles``."""
    parts = lambda c, size: [F.floor(c / (size * size)), F.floor(c / size) % size, c % size]
    tile = [F.shiftright(p.cast("int"), tiles) for p in parts(F.col("tile"), tl.SLABS)]
    cell = [F.shiftright(p.cast("int"), bits) for p in parts(F.col("cell"), 1 << tl.CELL_BITS)]
    out = F.lit(0).cast("long")
    for p in tile:
        out = out * tl.SLABS + p
    for p in cell:
        out = out * (1 << tl.CELL_BITS) + p
    return out


#: Blocks that hold a query, each within the next one: four cells along each axis, its tile, four tiles, all.
BLOCKS = tuple(lambda b=b, t=t: _block(b, t) for b, t in ((2, 0), (tl.CELL_BITS, 0), (tl.CELL_BITS, 2), (tl.CELL_BITS, 4)))
