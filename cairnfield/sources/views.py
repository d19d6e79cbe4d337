"""Points from the driver's tables, a synthetic source, and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnfield.schema import Box


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pv_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three components of each embedding; payload ``label``."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), *(e[k].cast("float").alias(a) for k, a in enumerate("xyz")), "label")


def pv_evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User, value and hours since 2024 of each event; payload ``event_type``."""
    return as_evt(table(spark, sf_dir, "events"))


def as_evt(events: DataFrame) -> DataFrame:
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(3600000000.0)
    return events.select(
        F.col("event_id").alias("point_id"), F.col("user_id").cast("float").alias("x"), F.col("value").cast("float").alias("y"), hours.cast("float").alias("z"), "event_type"
    )


#: Columns that tell the lines of one order apart.
LINE = ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def pv_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity, price and discount of each line; payload ``l_returnflag``.

    Lines have no key of their own: identifiers are the order's, times 2^20, and the
    line's rank in its order, so numbering needs no global sort.
    """
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * F.lit(1 << 20) + rank).alias("point_id"),
        F.col("l_quantity").cast("float").alias("x"),
        (F.col("l_extendedprice") / 1000).cast("float").alias("y"),
        (F.col("l_discount") * 100).cast("float").alias("z"),
        "l_returnflag",
    )


VIEW_SQL = {
    "pv_emb": "SELECT vec_id AS point_id, CAST(embedding[1] AS FLOAT) AS x, CAST(embedding[2] AS FLOAT) AS y, CAST(embedding[3] AS FLOAT) AS z, label FROM embeddings",
    "pv_evt": "SELECT event_id AS point_id, CAST(user_id AS FLOAT) AS x, CAST(value AS FLOAT) AS y, CAST((epoch_us(ts) - 1704067200000000) / 3600000000.0::DOUBLE AS FLOAT) AS z, event_type FROM events",
    "pv_li": f"SELECT l_orderkey * 1048576 + row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE)}) AS point_id, CAST(l_quantity AS FLOAT) AS x, CAST(l_extendedprice / 1000 AS FLOAT) AS y, CAST(l_discount * 100 AS FLOAT) AS z, l_returnflag FROM lineitem",
}


def uniform(spark: SparkSession, n: int, low: float = -5.0, high: float = 5.0, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """``n`` points spread evenly over a cube, the same for each seed and partition number."""
    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    axes = [(F.rand(seed + k) * (high - low) + low).cast("float").alias(a) for k, a in enumerate("xyz")]
    return ids.select(F.col("id").alias("point_id"), *axes)


def colorize(points: DataFrame, r: int, g: int, b: int) -> DataFrame:
    """Adds a constant colour."""
    return points.withColumns({"r": F.lit(r), "g": F.lit(g), "b": F.lit(b)})


def boxes_around(points: DataFrame, half: tuple[float, float, float]) -> DataFrame:
    """A box for each point, with the point's identifier and given half-lengths."""
    bounds = []
    for a, h in zip("xyz", half, strict=True):
        h = F.lit(float(h)).cast("float")
        bounds += [(F.col(a) - h).alias(f"{a}_min"), (F.col(a) + h).alias(f"{a}_max")]
    return points.select(F.col("point_id").alias("box_id"), *bounds)


def demo_boxes() -> dict[str, Box]:
    """The boxes of the search and the deletion walk-throughs."""
    return {"search": Box.around((10, 0, 0), (5, 5, 50)), "delete": Box.around((5, -5, 10), (10, 10, 20))}
