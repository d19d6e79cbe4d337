"""Insertion that keeps one point for each touched voxel."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.functions.geometry import SAME, SLACK, axes, dist_sq, same_point, voxel_centre, voxel_key
from cairnfield.functions.ranking import running_min
from cairnfield.operators.mutate import arriving, build
from cairnfield.schema import AXES, DOWNSAMPLED, LIVE
from cairnfield.storage import staged

KEYS = ["vx", "vy", "vz"]


def _voxelled(points: DataFrame, size: float) -> DataFrame:
    named = points.withColumns(dict(zip(KEYS, voxel_key(size), strict=True)))
    return named.withColumn("d", dist_sq(axes(), voxel_centre(size)))


def _order(arrival: bool) -> list:
    """Nearest to the centre; among equals the latest arrival, and any before an old point."""
    return [F.col("d").alias("d"), F.lit(0 if arrival else 1).alias("old"), (-F.col("seq") if arrival else F.lit(0)).cast("long").alias("late"), F.col("point_id").alias("id")]


def add_points(state: DataFrame, arrivals: DataFrame, size: float) -> DataFrame:
    """The state after ``arrivals`` (point_id, x, y, z, seq) came in order of seq, each keeping
    or taking its voxel.

    Of each voxel with an arrival one point stays: the nearest to its centre among live and
    arriving points. Old points that lose are thinned out; arrivals that lose aren't stored.
    Voxels without an arrival stay as they are. The winner is an aggregate, so tasks reduce
    their own rows first; only winners are joined with the state.
    """
    new = _voxelled(arriving(arrivals), size)
    old = _voxelled(state.where(F.col("status") == LIVE), size)
    touched = new.groupBy(*KEYS).agg(F.min(F.struct(*_order(True))).alias("best"))
    keys = [F.col(k).alias(f"t_{k}") for k in KEYS]
    here = F.lit(True)
    for k in KEYS:
        here = here & (F.col(k) == F.col(f"t_{k}"))
    oldest = old.join(touched.select(*keys), here, "left_semi").groupBy(*KEYS).agg(F.min(F.struct(*_order(False))).alias("best"))
    winners = touched.unionByName(oldest).groupBy(*(F.col(k).alias(f"t_{k}") for k in KEYS)).agg(F.min("best").alias("best"))
    kept = new.join(winners, here & (F.col("best.old") == 0) & (F.col("best.id") == F.col("point_id")) & (F.col("best.late") == -F.col("seq")))
    lost = F.col("best").isNotNull() & (F.col("status") == LIVE) & ((F.col("best.old") == 0) | (F.col("best.id") != F.col("point_id")))
    marked = _voxelled(state, size).join(winners, here, "left")
    status = F.when(lost, DOWNSAMPLED).otherwise(F.col("status")).alias("status")
    after = marked.select(*(status if c == "status" else c for c in state.columns))
    return after.unionByName(kept.select(*(c for c in state.columns if c in kept.columns)), allowMissingColumns=True)


def count(state: DataFrame, arrivals: DataFrame, size: float) -> DataFrame:
    """One row, ``added``: how many arrivals took their voxel or found it crowded.

    An arrival counts if it is the first of its voxel and that didn't hold exactly one live
    point; if none before it is nearer; or if the one that holds the voxel is the
    same point. The holder so far is a running minimum over old points and earlier arrivals, of those
    that ``_contenders`` leaves.
    """
    struct = lambda arrival: F.struct(*_order(arrival)[:1], F.lit(0 if arrival else 1).alias("old"), *_order(arrival)[2:], *AXES)
    # written, so that what the arrivals come from isn't worked out for each step
    came = staged(arrivals.select(*(c for c in ("point_id", *AXES, "seq") if c in arrivals.columns)), "arrivals")
    new, firsts = _contenders(_voxelled(arriving(came), size))
    new = new.withColumn("holder", struct(True))
    old = _voxelled(state.where(F.col("status") == LIVE), size).withColumn("holder", struct(False))
    crowd = old.groupBy(*(F.col(k).alias(f"t_{k}") for k in KEYS)).agg(F.count("*").alias("olds"), F.min("holder").alias("first_holder"))
    run = running_min(new, KEYS, "seq", F.col("holder"), "earlier").join(crowd, _same_voxel("t_"), "left").join(firsts, _same_voxel("f_"))
    held = F.least("earlier", "first_holder")
    first = (F.col("seq") == F.col("first_seq")) & (F.coalesce("olds", F.lit(0)) != 1)
    near = held.isNull() | (F.col("d") <= held["d"])
    twin = same_point(axes(), tuple(held[a] for a in AXES))
    return run.agg(F.count_if(first | near | F.coalesce(twin, F.lit(False))).alias("added"))


def _same_voxel(prefix: str) -> Column:
    return reduce(and_, (F.col(k) == F.col(f"{prefix}{k}") for k in KEYS))


def _contenders(new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The arrivals that may take their voxel, a staged table, and each voxel's first order number
    (f_vx, f_vy, f_vz, first_seq).

    Order numbers fall into stretches, each as long as all before it. One that is farther from the centre
    than the nearest of earlier stretches, by more than points in one place may be, neither takes
    the voxel nor is nearer than any later one. Each task reduces its rows to one for a voxel and stretch.
    """
    start = new.agg(F.min("seq")).first()[0] or 0
    cut = new.withColumn("stretch", F.floor(F.log2(F.col("seq").cast("double") - F.lit(float(start)) + 1)).cast("int"))
    before = Window.partitionBy(*KEYS).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    least = cut.groupBy(*KEYS, "stretch").agg(F.min("d").alias("least"), F.min("seq").alias("first"))
    names = [F.col(k).alias(f"f_{k}") for k in KEYS]
    # written, its size is known: if it is small, arrivals aren't shuffled
    bounds = staged(least.select(*names, F.col("stretch").alias("f_stretch"), "first", F.min("least").over(before).alias("bound")), "stretches")
    near = F.sqrt(F.col("d").cast("double")) <= F.sqrt(F.col("bound").cast("double")) * (1 + SLACK) + 2 * SAME
    met = cut.join(bounds, _same_voxel("f_") & (F.col("stretch") == F.col("f_stretch"))).where(F.col("bound").isNull() | near)
    return staged(met.select(*new.columns), "contenders"), bounds.groupBy(*(f"f_{k}" for k in KEYS)).agg(F.min("first").alias("first_seq"))


def build_thinned(points: DataFrame, size: float) -> DataFrame:
    """A state that is filled by one thinned insertion into an empty index."""
    return add_points(build(points.limit(0)), points, size)
