"""Queries over states in space-filling order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.operators import mutate
from cairnfield.operators.curve import BITS, Curve
from cairnfield.plans.queries import _BALL_JOIN, _BOX_JOIN, HALF, _balls, _query
from cairnfield.plans.ordered import OrderedTable
from cairnfield.schema import AXES
from cairnfield.sources import views
from cairnfield.sources.views import VIEW_SQL


def _cell_sql(a: str) -> str:
    last = f"{2**BITS - 1}::DOUBLE"
    return f"CAST(floor(least(greatest(({a}::DOUBLE - {a}_low) * ({2**BITS}::DOUBLE / ({a}_high - {a}_low)), 0::DOUBLE), {last})) AS BIGINT) AS {a}_cell"


_BITS_SQL = " + ".join(f"((({a}_cell >> b) & 1) << (3 * b + {2 - k}))" for k, a in enumerate(AXES))


@_query(
    "morton_order",
    f"""
WITH p AS ({VIEW_SQL["pv_evt"]}),
e AS (SELECT {", ".join(f"{f}({a})::DOUBLE AS {a}_{s}" for a in AXES for f, s in (("min", "low"), ("max", "high")))} FROM p),
c AS (SELECT point_id, {", ".join(map(_cell_sql, AXES))} FROM p, e)
SELECT point_id, CAST(list_sum(list_transform(range(0, {BITS}), lambda b: {_BITS_SQL})) AS BIGINT) AS morton FROM c
""",
)
def morton_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point's place in the space-filling order."""
    points = mutate.build(views.pv_evt(spark, sf_dir))
    return points.select("point_id", Curve.over(points).key().alias("morton"))


def _stored(points: DataFrame) -> OrderedTable:
    return OrderedTable.create(mutate.build(points).drop("seq"))


@_query("multi_box_ordered", _BOX_JOIN)
def multi_box_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many boxes against a state stored in space-filling order."""
    points = views.pv_evt(spark, sf_dir)
    return _stored(points).box_search(views.boxes_around(points.where(F.col("point_id") % 100 == 0), HALF))


@_query("multi_radius_ordered", _BALL_JOIN)
def multi_radius_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many balls against a state stored in space-filling order."""
    points = views.pv_evt(spark, sf_dir)
    return _stored(points).radius_search(_balls(points))
