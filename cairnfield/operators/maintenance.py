"""Compaction: purging deleted points, the feed of removed points, and clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.operators import tiling as tl
from cairnfield.schema import AXES, DELETED, LIVE


def compact(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The live points as a new state, and the points that were deleted and now are gone.
    Thinned-out points are purged too, but aren't reported."""
    return state.where(F.col("status") == LIVE), state.where(F.col("status") == DELETED).drop("seq", "status")


def clustered(state: DataFrame, partitions: int | None = None) -> DataFrame:
    """The state ranged and sorted by tile and cell, so that files and row groups written from
    it cover small boxes and box queries skip most of them."""
    placed = tl.placed(state, tl.build(state.select(*AXES)))
    keys = ["tile", "cell"]
    ranged = placed.repartitionByRange(partitions, *keys) if partitions else placed.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys).drop(*keys)
