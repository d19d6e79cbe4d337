"""Types of points, regions, queries and states, and the index parameters."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIVE, DELETED, DOWNSAMPLED = "LIVE", "DELETED", "DOWNSAMPLED"
AXES = ("x", "y", "z")


def _floats(*names: str, nullable: bool = False) -> list[T.StructField]:
    return [T.StructField(n, T.FloatType(), nullable) for n in names]


POINT = T.StructType([T.StructField("point_id", T.LongType(), False), *_floats(*AXES)])
POINT_INTENSITY = T.StructType([*POINT, *_floats("intensity", nullable=True)])
POINT_NORMAL = T.StructType([*POINT_INTENSITY, *_floats("normal_x", "normal_y", "normal_z", "curvature", nullable=True)])
BOX = T.StructType([T.StructField("box_id", T.LongType(), False), *_floats(*(f"{a}_{side}" for a in AXES for side in ("min", "max")))])
BALL = T.StructType([T.StructField("query_id", T.LongType(), False), *_floats(*AXES, "radius")])
QUERY = T.StructType([T.StructField("query_id", T.LongType(), False), *_floats(*AXES)])

#: Columns that every state has besides the payload.
STATE_COLUMNS = ("point_id", *AXES, "seq", "status")


@dataclass(frozen=True)
class Params:
    """Thresholds of an index: the share of deleted points and the share of one cell that ask
    for a compaction, and the edge of a voxel."""

    delete_criterion: float = 0.5
    balance_criterion: float = 0.6
    voxel: float = 0.2

    def __post_init__(self):
        if not (math.isfinite(self.voxel) and self.voxel > 0):
            raise ValueError("the voxel's edge must be positive")


@dataclass(frozen=True)
class Box:
    """A half-open box: min <= p < max on every axis."""

    low: tuple[float, float, float]
    high: tuple[float, float, float]

    def __post_init__(self):
        if any(math.isnan(v) for v in (*self.low, *self.high)):
            raise ValueError("a box has no NaN bounds")

    @classmethod
    def around(cls, centre: tuple[float, float, float], half: tuple[float, float, float]) -> Box:
        return cls(tuple(c - h for c, h in zip(centre, half, strict=True)), tuple(c + h for c, h in zip(centre, half, strict=True)))


def boxes_table(spark, boxes: list[Box]) -> DataFrame:
    rows = [(i, *(float(v) for pair in zip(b.low, b.high, strict=True) for v in pair)) for i, b in enumerate(boxes)]
    return spark.createDataFrame(rows, BOX)


def finite(columns: tuple[str, ...] = AXES) -> Column:
    """True where all the columns hold numbers: no null and no NaN."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c)
    return out


def payload(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in STATE_COLUMNS]
