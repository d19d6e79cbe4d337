"""Queries over the tree of median splits: exact cuts, node aggregates, partial rebuilds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.operators import hierarchy, mutate
from cairnfield.plans.queries import BOXES, OFFSET, _query, any_box_sql
from cairnfield.plans.tiled import TileTable
from cairnfield.schema import AXES, Params, boxes_table
from cairnfield.sources import views
from cairnfield.sources.views import VIEW_SQL
from cairnfield.storage import dropped, staged

#: Leaves of the queries, small enough that the given tables make several levels.
LEAF = 500
LEVELS = 8
PARAMS = Params(delete_criterion=0.3, balance_criterion=0.6)


def levels_sql(rows: str) -> str:
    """CTEs ``n0`` to ``n{LEVELS}`` that rebuild the tree: every row of ``rows`` (x, y, z, base)
    with its node after so many levels, and ``cuts``. Only rows with ``base`` make cuts."""
    value = "CASE axis WHEN 0 THEN x WHEN 1 THEN y ELSE z END"
    out = [f"n0 AS MATERIALIZED (SELECT *, 1::BIGINT AS node FROM ({rows}))"]
    for k in range(LEVELS):
        spread = [f"max({a}) - min({a})" for a in AXES]
        out.append(f"""
        a{k} AS (SELECT node, n, CASE WHEN dx >= dy AND dx >= dz THEN 0 WHEN dy >= dz THEN 1 ELSE 2 END AS axis FROM (
          SELECT node, count(*) AS n, {", ".join(f"{s} AS d{a}" for a, s in zip(AXES, spread, strict=True))} FROM n{k} WHERE base AND node >= {1 << k} GROUP BY node
        ) WHERE n > {LEAF} AND greatest(dx, dy, dz) > 0),
        v{k} AS (SELECT node, n, axis, {value} AS v FROM n{k} JOIN a{k} USING (node) WHERE base),
        m{k} AS (SELECT node, any_value(axis) AS axis, min(v) AS low, list_sort(list(v))[any_value(n) // 2 + 1] AS middle, list_sort(list_distinct(list(v)))[2] AS second FROM v{k} GROUP BY node),
        c{k} AS MATERIALIZED (SELECT node, axis, CASE WHEN middle > low THEN middle ELSE second END AS cut FROM m{k}),
        n{k + 1} AS MATERIALIZED (SELECT n.* EXCLUDE (node), CASE WHEN c.node IS NULL THEN n.node ELSE 2 * n.node + CAST({value} >= cut AS INTEGER) END AS node
          FROM n{k} n LEFT JOIN c{k} c ON n.node = c.node)""")
    out.append("cuts AS (" + " UNION ALL ".join(f"SELECT * FROM c{k}" for k in range(LEVELS)) + ")")
    return ",".join(out)


_STATE_SQL = f"""
SELECT point_id, x, y, z, CASE WHEN {any_box_sql(BOXES)} THEN 'DELETED' ELSE 'LIVE' END AS status, true AS base FROM ({VIEW_SQL["pv_evt"]})
UNION ALL SELECT point_id + {OFFSET}, x, y, z, 'LIVE', false FROM ({VIEW_SQL["pv_emb"]})
"""

_NODES_SQL = f"""
f AS (SELECT *, CAST(floor(log2(node)) AS INTEGER) AS deep FROM n{LEVELS}),
anc AS (SELECT point_id, x, y, z, status, node >> unnest(range(0, deep + 1)) AS node FROM f),
g AS (SELECT node, count(*) AS size, count(*) FILTER (status <> 'LIVE') AS invalid,
  {", ".join(f"{f}({a}) FILTER (status = 'LIVE') AS {a}_{f}" for a in AXES for f in ("min", "max"))} FROM anc GROUP BY node),
h AS (SELECT g.*, CASE WHEN cuts.node IS NOT NULL THEN coalesce(l.size, 0) END AS left_size
  FROM g LEFT JOIN cuts ON g.node = cuts.node LEFT JOIN g l ON l.node = 2 * g.node),
t AS (SELECT *, CAST(invalid AS DOUBLE) / size AS alpha_del, greatest(CAST(left_size AS DOUBLE) / size, 1.0::DOUBLE - CAST(left_size AS DOUBLE) / size) AS bal FROM h),
u AS (SELECT *, CASE WHEN left_size IS NOT NULL THEN bal END AS alpha_bal,
  size > 10 AND (alpha_del > {PARAMS.delete_criterion}::DOUBLE OR coalesce(left_size IS NOT NULL AND bal > {PARAMS.balance_criterion}::DOUBLE, false)) AS rebuild FROM t)
"""


def _half(a: str) -> str:
    return f"((CAST({a}_max AS DOUBLE) - CAST({a}_min AS DOUBLE)) * 0.5::DOUBLE)"


def _state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = views.pv_evt(spark, sf_dir).select("point_id", *AXES)
    more = views.pv_emb(spark, sf_dir).select((F.col("point_id") + OFFSET).alias("point_id"), *AXES)
    state = mutate.delete_boxes(mutate.build(events), boxes_table(spark, BOXES))
    return events, mutate.add_points(state, more)[0]


@_query(
    "node_balance",
    f"""WITH {levels_sql(_STATE_SQL)}, {_NODES_SQL}
    SELECT node, CAST(floor(log2(node)) AS INTEGER) AS level, size, invalid, x_min, x_max, y_min, y_max, z_min, z_max,
      ({_half("x")} * {_half("x")} + {_half("y")} * {_half("y")}) + {_half("z")} * {_half("z")} AS radius_sq, left_size, alpha_del, alpha_bal, rebuild FROM u""",
)
def node_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the events' tree after deletions and insertions, with its balance."""
    events, state = _state(spark, sf_dir)
    held = staged(events, "events")
    tree = hierarchy.build(held, LEAF, LEVELS)
    dropped(held)
    return hierarchy.nodes(state, tree, PARAMS)


@_query(
    "median_cuts",
    f"""WITH {levels_sql(f"SELECT point_id, x, y, z, true AS base FROM ({VIEW_SQL['pv_li']})")}
    SELECT node, axis, cut FROM cuts""",
)
def median_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact cuts of the lines' tree, which has very many equal coordinates."""
    points = staged(mutate.build(views.pv_li(spark, sf_dir)).select(*AXES), "lines")
    tree = hierarchy.build(points, LEAF, LEVELS)
    dropped(points)
    return spark.createDataFrame([(n, a, float(v)) for n, (a, v) in tree.cuts.items()], "node long, axis int, cut float")


@_query(
    "partial_rebuild",
    f"""WITH {levels_sql(_STATE_SQL)}, {_NODES_SQL},
    r AS (SELECT DISTINCT point_id FROM anc JOIN u USING (node) WHERE rebuild)
    SELECT point_id, x, y, z, status, r.point_id IS NOT NULL AS rebuilt FROM f LEFT JOIN r USING (point_id)
    WHERE r.point_id IS NULL OR status = 'LIVE'""",
)
def partial_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored tiles after deletions and insertions, once the parts over a criterion were rebuilt."""
    events = views.pv_evt(spark, sf_dir).select("point_id", *AXES)
    more = views.pv_emb(spark, sf_dir).select((F.col("point_id") + OFFSET).alias("point_id"), *AXES)
    table = TileTable.create(spark, events, PARAMS, LEAF).delete_boxes(BOXES).append(more)
    before = table.tree
    tops = hierarchy.tops(table.nodes())
    after, gone = table.rebuilt()
    leaf = before.leaf()
    inside = F.lit(False)
    for top in tops:
        inside = inside | (F.expr(f"shiftright(leaf_, greatest(0, length(bin(leaf_)) - {top.bit_length()}))") == top)
    out = staged(after.state().withColumn("leaf_", leaf).select("point_id", *AXES, "status", inside.alias("rebuilt")), "rebuilt")
    after.close()
    dropped(gone)
    return out
