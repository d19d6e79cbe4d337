"""Queries over the driver's tables, each with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.operators import downsample, maintenance, mutate, search, stats
from cairnfield.operators import tiling as tl
from cairnfield.schema import AXES, Box, boxes_table
from cairnfield.sources import views
from cairnfield.sources.views import VIEW_SQL
from cairnfield.storage import new_path, staged
from cairnfield.streaming import ingest, removed, voxels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EMB_BOX = Box((-0.1, -0.2, -0.1), (0.15, 0.1, 0.2))
BALL = ((75.0, 50.0, 350.0), 60.0)
BOXES = [Box((10, 5, 20), (60, 40, 300)), Box((40, 20, 200), (90, 80, 500)), Box((100, 0, 0), (130, 200, 90)), Box((0, 0, 600), (150, 30, 650))]
BACK = [Box((30, 10, 100), (70, 60, 400))]
HALF = (5.0, 20.0, 24.0)
RADIUS, NEAR, K, VOXEL, COARSE, WIDE = 12.0, 5.0, 5, 0.2, 5.0, 40.0
OFFSET = 1_000_000_000_000


def _query(name: str, sql: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return register


def f32(v: float) -> str:
    return f"CAST({v!r} AS FLOAT)"


def box_sql(box: Box, p: str = "") -> str:
    return " AND ".join(f"{p}{a} >= {f32(lo)} AND {p}{a} < {f32(hi)}" for a, lo, hi in zip(AXES, box.low, box.high, strict=True))


def any_box_sql(boxes: list[Box]) -> str:
    return " OR ".join(f"({box_sql(b)})" for b in boxes)


def dist_sql(p: str, q: str) -> str:
    dx, dy, dz = (f"({p}.{a} - {q}.{a})" for a in AXES)
    return f"({dx} * {dx} + {dy} * {dy}) + {dz} * {dz}"


def hundredth(points: DataFrame, name: str = "query_id") -> DataFrame:
    """The query set of searches: points whose identifier is divisible by 100."""
    return points.where(F.col("point_id") % 100 == 0).select(F.col("point_id").alias(name), *AXES)


# loading and reading


@_query("build_scan", VIEW_SQL["pv_emb"])
def build_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutate.live_points(mutate.build(views.pv_emb(spark, sf_dir)))


@_query("box_search", f"SELECT * FROM ({VIEW_SQL['pv_emb']}) WHERE {box_sql(EMB_BOX)}")
def box_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.box_search(mutate.build(views.pv_emb(spark, sf_dir)), EMB_BOX).drop("seq")


@_query("colorize", f"SELECT *, 255 AS r, 128 AS g, 0 AS b FROM ({VIEW_SQL['pv_emb']}) WHERE {box_sql(EMB_BOX)}")
def colorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.colorize(box_search(spark, sf_dir), 255, 128, 0)


_CENTRE = f"(SELECT {', '.join(f'{f32(c)} AS {a}' for a, c in zip(AXES, BALL[0], strict=True))})"


@_query("radius_search", f"SELECT p.*, {dist_sql('p', 'c')} AS dist_sq FROM ({VIEW_SQL['pv_evt']}) p, {_CENTRE} c WHERE {dist_sql('p', 'c')} <= {f32(BALL[1])} * {f32(BALL[1])}")
def radius_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.radius_search(mutate.build(views.pv_evt(spark, sf_dir)), *BALL).drop("seq")


_BOX_JOIN = f"""
WITH p AS ({VIEW_SQL["pv_evt"]}), b AS (
  SELECT point_id AS box_id, {", ".join(f"{a} - {f32(h)} AS {a}_min, {a} + {f32(h)} AS {a}_max" for a, h in zip(AXES, HALF, strict=True))}
  FROM p WHERE point_id % 100 = 0
)
SELECT box_id, p.* FROM p JOIN b ON {" AND ".join(f"p.{a} >= b.{a}_min AND p.{a} < b.{a}_max" for a in AXES)}
"""


@_query("multi_box_search", _BOX_JOIN)
def multi_box_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.pv_evt(spark, sf_dir)
    boxes = views.boxes_around(points.where(F.col("point_id") % 100 == 0), HALF)
    return search.multi_box_search(mutate.build(points), boxes).drop("seq")


@_query("multi_box_tiled", _BOX_JOIN)
def multi_box_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way that many boxes take, whatever their number."""
    points = views.pv_evt(spark, sf_dir)
    boxes = views.boxes_around(points.where(F.col("point_id") % 100 == 0), HALF)
    state = mutate.build(points)
    return search.multi_box_search(state, boxes, tl.build(state)).drop("seq")


_BALL_JOIN = f"""
WITH p AS ({VIEW_SQL["pv_evt"]}), q AS (SELECT point_id AS query_id, x, y, z FROM p WHERE point_id % 100 = 0)
SELECT query_id, p.*, {dist_sql("p", "q")} AS dist_sq FROM p JOIN q ON {dist_sql("p", "q")} <= {f32(RADIUS)} * {f32(RADIUS)}
"""


def _balls(points: DataFrame) -> DataFrame:
    return hundredth(points).withColumn("radius", F.lit(RADIUS).cast("float"))


@_query("multi_radius_search", _BALL_JOIN)
def multi_radius_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.pv_evt(spark, sf_dir)
    return search.multi_radius_search(mutate.build(points), _balls(points)).drop("seq")


@_query("multi_radius_tiled", _BALL_JOIN)
def multi_radius_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.pv_evt(spark, sf_dir)
    state = mutate.build(points)
    return search.multi_radius_search(state, _balls(points), tl.build(state)).drop("seq")


def knn_sql(view: str, cap: float | None = None) -> str:
    near = f" WHERE CAST({dist_sql('p', 'q')} AS DOUBLE) <= {cap!r}::DOUBLE * {cap!r}::DOUBLE" if cap else ""
    return f"""
    WITH p AS MATERIALIZED ({VIEW_SQL[view]}), q AS (SELECT point_id AS query_id, x, y, z FROM p WHERE point_id % 100 = 0),
    d AS (SELECT query_id, p.*, {dist_sql("p", "q")} AS dist_sq FROM p, q{near}),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist_sq, x, y, z, point_id) AS INTEGER) AS rank FROM d)
    SELECT * FROM r WHERE rank <= {K}
    """


def _knn(points: DataFrame, cap: float | None = None) -> DataFrame:
    return search.knn(mutate.build(points), hundredth(points), K, cap).drop("seq")


@_query("knn_k5", knn_sql("pv_evt"))
def knn_k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(views.pv_evt(spark, sf_dir))


@_query("knn_max_dist", knn_sql("pv_evt", NEAR))
def knn_max_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(views.pv_evt(spark, sf_dir), NEAR)


@_query("knn_ties", knn_sql("pv_li"))
def knn_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    # written, so that lines aren't numbered again in each step
    return _knn(staged(views.pv_li(spark, sf_dir), "lines"))


@_query("knn_emb", knn_sql("pv_emb"))
def knn_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(views.pv_emb(spark, sf_dir))


# counts and extent

_DELETED = f"SELECT *, CASE WHEN {any_box_sql(BOXES)} THEN 'DELETED' ELSE 'LIVE' END AS status FROM ({VIEW_SQL['pv_evt']})"


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutate.delete_boxes(mutate.build(views.pv_evt(spark, sf_dir)), boxes_table(spark, BOXES))


@_query("size_validnum", f"SELECT count(*) AS size, count(*) FILTER (status = 'LIVE') AS validnum FROM ({_DELETED})")
def size_validnum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sizes(_cut(spark, sf_dir))


@_query("tree_range", f"SELECT {', '.join(f'coalesce({g}({a}), 0::FLOAT) AS {a}_{g}' for a in AXES for g in ('min', 'max'))} FROM ({_DELETED}) WHERE status = 'LIVE'")
def tree_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.extent(_cut(spark, sf_dir))


@_query(
    "alpha",
    f"""WITH c AS (SELECT {", ".join(f"CAST(floor({a}::DOUBLE / 20.0::DOUBLE) AS BIGINT) AS c_{a}" for a in AXES)}, count(*) AS n,
      count(*) FILTER (status = 'LIVE') AS alive FROM ({_DELETED}) GROUP BY ALL)
    SELECT CAST(sum(n) - sum(alive) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS alpha_del, CAST(max(alive) AS DOUBLE) / CAST(sum(alive) AS DOUBLE) AS alpha_bal FROM c""",
)
def alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ratios(_cut(spark, sf_dir), 20.0)


# insertion and deletion


@_query(
    "add_points",
    f"SELECT point_id, x, y, z, event_type, NULL::INTEGER AS label, 'LIVE' AS status FROM ({VIEW_SQL['pv_evt']}) UNION ALL SELECT point_id + {OFFSET}, x, y, z, NULL, label, 'LIVE' FROM ({VIEW_SQL['pv_emb']})",
)
def add_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = views.pv_emb(spark, sf_dir).withColumn("point_id", F.col("point_id") + OFFSET)
    return mutate.add_points(mutate.build(views.pv_evt(spark, sf_dir)), more)[0].drop("seq")


def _ranks_sql(requests: str) -> str:
    return f"""
    WITH p AS ({VIEW_SQL["pv_li"]}), w AS ({requests}),
    a AS (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY point_id) AS n FROM p),
    b AS (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY request_id) AS n FROM w)
    SELECT a.point_id, a.x, a.y, a.z, a.l_returnflag, CASE WHEN b.n IS NULL THEN 'LIVE' ELSE 'DELETED' END AS status
    FROM a LEFT JOIN b ON a.x = b.x AND a.y = b.y AND a.z = b.z AND a.n = b.n
    """


@_query("delete_points", _ranks_sql("SELECT point_id AS request_id, x, y, z FROM p WHERE l_returnflag = 'R'"))
def delete_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.pv_li(spark, sf_dir)
    requests = points.where(F.col("l_returnflag") == "R").select(F.col("point_id").alias("request_id"), *AXES)
    return mutate.delete_points(mutate.build(points), requests).drop("seq")


@_query("delete_points_dups", _ranks_sql("SELECT 2 * point_id + t.t AS request_id, x, y, z FROM p, (SELECT unnest([0, 1]) AS t) t WHERE l_returnflag = 'N'"))
def delete_points_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requests for each returned line's place: both copies of a pair go, and others too."""
    points = views.pv_li(spark, sf_dir)
    twice = F.explode(F.array(F.lit(0), F.lit(1)))
    requests = points.where(F.col("l_returnflag") == "N").withColumn("t", twice).select((2 * F.col("point_id") + F.col("t")).alias("request_id"), *AXES)
    return mutate.delete_points(mutate.build(points), requests).drop("seq")


@_query("delete_boxes", _DELETED)
def delete_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir).drop("seq")


@_query("delete_boxes_count", f"SELECT count(*) AS deleted FROM ({_DELETED}) WHERE status = 'DELETED'")
def delete_boxes_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutate.delete_boxes_count(mutate.build(views.pv_evt(spark, sf_dir)), boxes_table(spark, BOXES))


_READDED = f"SELECT * REPLACE (CASE WHEN status = 'DELETED' AND ({any_box_sql(BACK)}) THEN 'LIVE' ELSE status END AS status) FROM ({_DELETED})"


@_query("readd_boxes", _READDED)
def readd_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutate.readd_boxes(_cut(spark, sf_dir), boxes_table(spark, BACK)).drop("seq")


@_query("compact_live", f"SELECT * EXCLUDE (status) FROM ({_READDED}) WHERE status = 'LIVE'")
def compact_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = mutate.readd_boxes(_cut(spark, sf_dir), boxes_table(spark, BACK))
    return maintenance.clustered(maintenance.compact(state)[0]).drop("seq", "status")


@_query("removed_points", f"SELECT * EXCLUDE (status) FROM ({_READDED}) WHERE status = 'DELETED'")
def removed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.compact(mutate.readd_boxes(_cut(spark, sf_dir), boxes_table(spark, BACK)))[1]


@_query(
    "removed_feed",
    f"""SELECT * EXCLUDE (status), CAST(0 AS INTEGER) AS compaction FROM ({_READDED}) WHERE status = 'DELETED'
    UNION ALL SELECT * EXCLUDE (status), CAST(1 AS INTEGER) AS compaction FROM ({_READDED}) WHERE status = 'LIVE' AND ({any_box_sql(BACK)})""",
)
def removed_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two compactions publish what they removed; a reader that starts again after the first
    gets each point once."""
    folder, into = new_path(spark, "feed"), new_path(spark, "delivered")
    live, gone = maintenance.compact(mutate.readd_boxes(_cut(spark, sf_dir), boxes_table(spark, BACK)))
    for number in range(2):
        removed.publish(gone, folder, number)
        removed.deliver(spark, folder, gone.schema, into)
        live, gone = maintenance.compact(mutate.delete_boxes(live, boxes_table(spark, BACK)))
    return removed.delivered(spark, into, gone.schema)


# thinning


def centre_sql(size: float) -> tuple[str, str]:
    """Voxel keys, and the float distance to the voxel's centre."""
    keys = ", ".join(f"CAST(floor({a} / {f32(size)}) AS BIGINT) AS v{a}" for a in AXES)
    low = {a: f"CAST(floor({a} / {f32(size)}) AS FLOAT) * {f32(size)}" for a in AXES}
    middle = {a: f"CAST(CAST({lo} AS DOUBLE) + CAST(({lo} + {f32(size)}) - {lo} AS DOUBLE) / 2.0::DOUBLE AS FLOAT)" for a, lo in low.items()}
    dx, dy, dz = (f"({a} - {middle[a]})" for a in AXES)
    return keys, f"({dx} * {dx} + {dy} * {dy}) + {dz} * {dz}"


_KEYS, _D = centre_sql(VOXEL)


@_query(
    "downsample_build",
    f"""WITH v AS (SELECT *, {_KEYS}, {_D} AS d FROM ({VIEW_SQL["pv_li"]})),
    r AS (SELECT *, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY d, point_id DESC) AS n FROM v)
    SELECT point_id, x, y, z, l_returnflag FROM r WHERE n = 1""",
)
def downsample_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutate.live_points(downsample.build_thinned(views.pv_li(spark, sf_dir), VOXEL))


_KEYS5, _D5 = centre_sql(COARSE)
_BOTH = f"""
WITH s AS (SELECT point_id, x, y, z, 0::BIGINT AS seq, 1 AS old FROM ({VIEW_SQL["pv_evt"]})
  UNION ALL SELECT point_id + {OFFSET}, x, y, z, point_id + 1 + {OFFSET}, 0 FROM ({VIEW_SQL["pv_li"]})),
v AS (SELECT *, {_KEYS5}, {_D5} AS d FROM s),
"""


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    more = views.pv_li(spark, sf_dir).select((F.col("point_id") + OFFSET).alias("point_id"), *AXES)
    return mutate.build(views.pv_evt(spark, sf_dir).select("point_id", *AXES)), more


@_query(
    "downsample_incremental",
    _BOTH
    + """r AS (SELECT *, min(old) OVER (PARTITION BY vx, vy, vz) = 0 AS touched,
      row_number() OVER (PARTITION BY vx, vy, vz ORDER BY d, old, seq DESC, point_id) AS n FROM v)
    SELECT point_id, x, y, z, CASE WHEN n > 1 AND touched THEN 'DOWNSAMPLED' ELSE 'LIVE' END AS status
    FROM r WHERE old = 1 OR n = 1""",
)
def downsample_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return downsample.add_points(*_two(spark, sf_dir), COARSE).drop("seq")


@_query(
    "downsample_count",
    _BOTH
    + """h AS (SELECT *, count(*) FILTER (old = 1) OVER (PARTITION BY vx, vy, vz) AS olds,
      row_number() OVER (PARTITION BY vx, vy, vz, old ORDER BY seq) AS arrival,
      min({'d': d, 'old': old, 'late': -seq, 'id': point_id, 'x': x, 'y': y, 'z': z}) OVER (PARTITION BY vx, vy, vz
        ORDER BY seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM v)
    SELECT count(*) AS added FROM h WHERE old = 0 AND ((arrival = 1 AND olds <> 1) OR held IS NULL OR d <= held.d
      OR (abs(x - held.x)::DOUBLE < 1e-6::DOUBLE AND abs(y - held.y)::DOUBLE < 1e-6::DOUBLE AND abs(z - held.z)::DOUBLE < 1e-6::DOUBLE))""",
)
def downsample_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return downsample.count(*_two(spark, sf_dir), COARSE)


# everything together


@_query(
    "lifecycle",
    f"""
    WITH s AS (SELECT * EXCLUDE (event_type) FROM ({_READDED}) WHERE status = 'LIVE'),
    p AS MATERIALIZED (SELECT point_id, x, y, z FROM s UNION ALL SELECT point_id + {OFFSET}, x, y, z FROM ({VIEW_SQL["pv_emb"]})),
    q AS (SELECT point_id AS query_id, x, y, z FROM ({VIEW_SQL["pv_evt"]}) WHERE point_id % 100 = 0),
    d AS (SELECT query_id, p.*, {dist_sql("p", "q")} AS dist_sq FROM p, q),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist_sq, x, y, z, point_id) AS INTEGER) AS rank FROM d)
    SELECT * FROM r WHERE rank <= {K}""",
)
def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build, append, delete boxes, restore a box, compact, then the nearest neighbours."""
    events = views.pv_evt(spark, sf_dir).select("point_id", *AXES)
    more = views.pv_emb(spark, sf_dir).select((F.col("point_id") + OFFSET).alias("point_id"), *AXES)
    state = mutate.delete_boxes(mutate.build(events), boxes_table(spark, BOXES))
    state = mutate.add_points(mutate.readd_boxes(state, boxes_table(spark, BACK)), more)[0]
    live, _ = maintenance.compact(state)
    return search.knn(live, hundredth(events), K).drop("seq")


def _thinned_sql(size: float) -> str:
    keys, d = centre_sql(size)
    return f"""WITH v AS (SELECT *, {keys}, {d} AS d FROM ({VIEW_SQL["pv_evt"]})),
    r AS (SELECT *, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY d, point_id DESC) AS n FROM v)
    SELECT point_id, x, y, z, event_type FROM r WHERE n = 1"""


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.readStream.schema(views.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    return views.as_evt(raw).withColumn("seq", F.col("point_id") + 1)


@_query("stream_ingest", _thinned_sql(COARSE))
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream, thinned batch by batch."""
    folder = new_path(spark, "stream")
    last = ingest.ingest(_event_stream(spark, sf_dir), folder, COARSE)
    return mutate.live_points(ingest.state_after(spark, folder, last))


@_query("stream_voxels", _thinned_sql(WIDE))
def stream_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream; Spark's state store holds each voxel's point."""
    folder = new_path(spark, "voxels")
    voxels.ingest(_event_stream(spark, sf_dir), folder, WIDE)
    return voxels.live_points(spark, folder)
