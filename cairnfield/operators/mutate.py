"""Bulk load, insertion, deletion and re-insertion: each maps a state to a new state."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.functions.geometry import SAME, axes, in_box, same_point
from cairnfield.functions.ranking import ranked
from cairnfield.operators import search
from cairnfield.schema import AXES, DELETED, LIVE, STATE_COLUMNS, finite, payload
from cairnfield.storage import dropped, staged

#: Boxes up to this number are tested row by row.
FEW_BOXES = 100


def build(points: DataFrame) -> DataFrame:
    """A new state with every point live. Rows with null or NaN coordinates aren't points."""
    return _rows(points, F.lit(0))


def _rows(points: DataFrame, seq: Column) -> DataFrame:
    rest = [c for c in points.columns if c not in STATE_COLUMNS]
    floats = [F.col(a).cast("float").alias(a) for a in AXES]
    return points.select("point_id", *floats, *rest, seq.cast("long").alias("seq"), F.lit(LIVE).alias("status")).where(finite())


def arriving(arrivals: DataFrame) -> DataFrame:
    """Arrivals as live rows of a state. Those without a ``seq`` come in the order of their
    identifiers, from 1."""
    return _rows(arrivals, F.col("seq") if "seq" in arrivals.columns else F.greatest(F.col("point_id") + 1, F.lit(1)))


def add_points(state: DataFrame, arrivals: DataFrame) -> tuple[DataFrame, int]:
    """Appends all arrivals. The count is 0: only insertion with thinning counts."""
    return state.unionByName(arriving(arrivals), allowMissingColumns=True), 0


def inside_any(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Identifiers of the points that lie in at least one box."""
    found = search.multi_box_search(points.select("point_id", *AXES), boxes)
    return found.select(F.col("point_id").alias("hit_id")).distinct()


def _restatus(state: DataFrame, hits: DataFrame, was: str, becomes: str) -> DataFrame:
    changed = F.col("hit_id").isNotNull() & (F.col("status") == was)
    joined = state.join(hits, F.col("point_id") == F.col("hit_id"), "left")
    return joined.select(*(F.when(changed, becomes).otherwise(F.col("status")).alias("status") if c == "status" else c for c in state.columns))


def delete_boxes(state: DataFrame, boxes: DataFrame) -> DataFrame:
    """Live points inside any box become deleted. A few boxes are tested in place, row by row;
    more go by ``inside_any``."""
    return _in_boxes(state, boxes, LIVE, DELETED)


def readd_boxes(state: DataFrame, boxes: DataFrame) -> DataFrame:
    """Deleted points inside any box become live again; thinned-out ones don't."""
    return _in_boxes(state, boxes, DELETED, LIVE)


def _in_boxes(state: DataFrame, boxes: DataFrame, was: str, becomes: str) -> DataFrame:
    bounds = [f"{a}_{s}" for a in AXES for s in ("min", "max")]
    few = boxes.where(finite(tuple(bounds))).select(*bounds).limit(FEW_BOXES + 1).collect()
    if len(few) > FEW_BOXES:
        return _restatus(state, inside_any(state.where(F.col("status") == was), boxes), was, becomes)
    hit = F.lit(False)
    for b in few:
        hit = hit | in_box(axes(), *(tuple(F.lit(b[f"{a}_{s}"]).cast("float") for a in AXES) for s in ("min", "max")))
    changed = hit & (F.col("status") == was)
    return state.withColumn("status", F.when(changed, becomes).otherwise(F.col("status")))


def delete_boxes_count(state: DataFrame, boxes: DataFrame) -> DataFrame:
    """One row: how many live points the boxes delete, each counted once."""
    after = delete_boxes(state.withColumn("was_live_", F.col("status") == LIVE), boxes)
    return after.agg(F.count_if(F.col("was_live_") & (F.col("status") == DELETED)).alias("deleted"))


def delete_points(state: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request (request_id, x, y, z) deletes at most one live point in its place.

    Points and requests with equal coordinates are matched by rank: the n-th request takes
    the point with the n-th smallest identifier, so n requests delete up to n copies. The
    requests that are left may take a point closer than 1e-6 on every axis, in the order of
    (request_id, point_id). Rows are ranked in blocks, so a place with very many
    points isn't sorted by one task.
    """
    wanted = staged(requests.select(F.col("request_id").cast("long").alias("request_id"), *(F.col(a).cast("float").alias(a) for a in AXES)).where(finite()), "wanted")
    # written, so that what the state comes from isn't worked out for each step
    held = staged(state, "before")
    # how many requests a place has tells which of its points go; requests are counted before they are shuffled
    asked = staged(wanted.groupBy(*(F.col(a).alias(f"w_{a}") for a in AXES)).agg(F.count("*").alias("asked")), "asked")
    alive = held.where(F.col("status") == LIVE).select("point_id", *AXES)
    met = staged(alive.join(asked, _same_place("w_")).select("point_id", *AXES, "asked"), "met")
    exact = staged(ranked(met, list(AXES), "point_id").where(F.col("rank") <= F.col("asked")).select(F.col("point_id").alias("hit_id")), "exact")
    hits = exact
    found = met.groupBy(*AXES).agg(F.count("*").alias("found"))
    short = asked.join(found, _same_place("w_"), "left").where(F.coalesce("found", F.lit(0)) < F.col("asked"))
    short = staged(short.select(*(f"w_{a}" for a in AXES), F.coalesce("found", F.lit(0)).alias("found")), "short")
    for near in _near_matches(alive, exact, wanted, short):
        hits = hits.union(near)
    dropped(wanted, asked, met, short)
    return _restatus(held, hits, LIVE, DELETED)


def _same_place(prefix: str) -> Column:
    out = F.lit(True)
    for a in AXES:
        out = out & (F.col(a) == F.col(f"{prefix}{a}"))
    return out


def _cells_around(value: Column) -> Column:
    """The cells that SAME around a value reaches: one for most values, two at most. The
    grid is shifted, as whole numbers would all lie on its lines."""
    value = value.cast("double")
    return F.array_distinct(F.array(_fine(value - SAME), _fine(value + SAME)))


def _fine(value: Column) -> Column:
    return F.floor(value.cast("double") / F.lit(16 * SAME) + F.lit(0.37))


def _near_matches(alive: DataFrame, exact: DataFrame, wanted: DataFrame, short: DataFrame):
    """Points for requests of the places ``short`` (w_x, w_y, w_z, found) that exact matches don't serve: pairs within
    SAME; in each round the pairs that are first both for their request and their point. Places meet by
    their cells before requests and points do: few are so close. Each
    round's tables are written, so that none is worked out again by later ones."""
    around = short
    for a in AXES:
        around = around.withColumn(f"k_{a}", F.explode(_cells_around(F.col(f"w_{a}"))))
    places = alive.select(*AXES).distinct().select("*", *(_fine(F.col(a)).alias(f"k_{a}") for a in AXES))
    close = around.join(places, [f"k_{a}" for a in AXES]).where(same_point(axes(), axes("w_")) & ~_same_place("w_"))
    close = staged(close.select(*(f"w_{a}" for a in AXES), "found", *(F.col(a).alias(f"p_{a}") for a in AXES)), "close")
    if close.isEmpty():
        dropped(close)
        return
    lacking = close.select(*(f"w_{a}" for a in AXES), "found").distinct()
    rest = ranked(wanted.join(lacking, _same_place("w_")).select("request_id", *AXES, "found"), list(AXES), "request_id").where(F.col("rank") > F.col("found"))
    rest = rest.select("request_id", *(F.col(a).alias(f"r_{a}") for a in AXES))
    free = alive.join(close.select(*(f"p_{a}" for a in AXES)).distinct(), _same_place("p_"), "left_semi").join(exact, F.col("point_id") == F.col("hit_id"), "left_anti")
    there = reduce(and_, (F.col(f"r_{a}") == F.col(f"w_{a}") for a in AXES))
    pairs = rest.join(close.drop("found"), there).join(free, _same_place("p_"))
    pairs = staged(pairs.select("request_id", "point_id").distinct(), "pairs")
    dropped(close)
    while not pairs.isEmpty():
        by_request, by_point = Window.partitionBy("request_id").orderBy("point_id"), Window.partitionBy("point_id").orderBy("request_id")
        first = pairs.withColumn("a", F.row_number().over(by_request)).withColumn("b", F.row_number().over(by_point)).where("a = 1 AND b = 1")
        chosen = staged(first.select("request_id", "point_id"), "chosen")
        yield chosen.select(F.col("point_id").alias("hit_id"))
        left = staged(pairs.join(chosen.select("request_id"), "request_id", "left_anti").join(chosen.select("point_id"), "point_id", "left_anti"), "pairs")
        dropped(pairs)
        pairs = left
    dropped(pairs)


def live_points(state: DataFrame) -> DataFrame:
    """All live points with their payload."""
    return state.where(F.col("status") == LIVE).select("point_id", *AXES, *payload(state))
