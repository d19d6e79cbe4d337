"""Exact order statistics of many groups at once, by refining histograms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins that a pass counts in all, and at least for each group.
ALL_BINS, BINS = 1 << 18, 256


@dataclass(frozen=True)
class Wanted:
    """The ``rank``-th smallest value (from 0) of those of a group in [low, high]."""

    low: float
    high: float
    rank: int


def ranked_values(points: DataFrame, wanted: dict[int, Wanted]) -> dict[int, float]:
    """The value each group of ``points`` (group, value float) is asked for.

    Each pass counts the values of all groups in bins between their bounds and goes on
    with the bin that has the rank, between the smallest and largest value found there; a
    group is done when these are equal, so the result is exact. Tasks count before
    rows are shuffled, and a pass returns a row for each group. Groups are few (nodes of one
    level of a bounded tree), so their bounds may be broadcast.
    """
    found = {g: w.low for g, w in wanted.items() if w.low == w.high}
    open_ = {g: w for g, w in wanted.items() if w.low != w.high}
    while open_:
        bins_each = max(BINS, ALL_BINS // len(open_))
        rows = [(g, float(w.low), float(w.high), int(w.rank)) for g, w in open_.items()]
        bounds = points.sparkSession.createDataFrame(rows, "in_group long, low double, high double, wanted long")
        v = F.col("value").cast("double")
        joined = points.join(F.broadcast(bounds), F.col("group") == F.col("in_group")).where((v >= F.col("low")) & (v <= F.col("high")))
        place = F.floor((v - F.col("low")) / (F.col("high") - F.col("low")) * bins_each)
        bins = joined.groupBy("group", "wanted", F.least(place, F.lit(bins_each - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
        upto = F.sum("n").over(Window.partitionBy("group").orderBy("bin"))
        hit = bins.withColumn("upto", upto).where((F.col("upto") > F.col("wanted")) & (F.col("upto") - F.col("n") <= F.col("wanted")))
        for r in hit.select("group", "least", "most", (F.col("wanted") - F.col("upto") + F.col("n")).alias("rank")).collect():
            if r["least"] == r["most"]:
                found[r["group"]] = r["least"]
                del open_[r["group"]]
            else:
                open_[r["group"]] = Wanted(r["least"], r["most"], r["rank"])
    return found


def next_values(points: DataFrame, above: dict[int, float]) -> dict[int, float]:
    """The smallest value over a bound in each group, where there is one."""
    if not above:
        return {}
    bounds = points.sparkSession.createDataFrame([(g, float(v)) for g, v in above.items()], "in_group long, above double")
    joined = points.join(F.broadcast(bounds), F.col("group") == F.col("in_group")).where(F.col("value").cast("double") > F.col("above"))
    return {r["group"]: r["v"] for r in joined.groupBy("group").agg(F.min("value").alias("v")).collect()}
