"""Counts, extent and balance of a state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.schema import AXES, LIVE, Params


def sizes(state: DataFrame) -> DataFrame:
    """One row: ``size`` with deleted points, ``validnum`` without."""
    return state.agg(F.count("*").alias("size"), F.count_if(F.col("status") == LIVE).alias("validnum"))


def extent(state: DataFrame) -> DataFrame:
    """One row: bounds of the live points, zeros if there are none."""
    bounds = [F.coalesce(f(a), F.lit(0).cast("float")).alias(f"{a}_{s}") for a in AXES for f, s in ((F.min, "min"), (F.max, "max"))]
    return state.where(F.col("status") == LIVE).agg(*bounds)


def ratios(state: DataFrame, cell: float = 1.0) -> DataFrame:
    """One row: ``alpha_del``, the share of points that aren't live, and ``alpha_bal``, the
    largest share of the live points in one cube with edge ``cell``; zeros if empty."""
    cube = [F.floor(F.col(a).cast("double") / F.lit(float(cell))).cast("long").alias(f"c_{a}") for a in AXES]
    live = F.count_if(F.col("status") == LIVE)
    by_cell = state.groupBy(*cube).agg(F.count("*").alias("n"), live.alias("alive"))
    share = lambda part, whole: F.coalesce(F.when(whole > 0, part / whole), F.lit(0.0))
    n, alive = F.sum("n"), F.sum("alive")
    return by_cell.agg(share((n - alive).cast("double"), n).alias("alpha_del"), share(F.max("alive").cast("double"), alive).alias("alpha_bal"))


def wants_compaction(state: DataFrame, params: Params, cell: float = 1.0) -> bool:
    """Whether either ratio is above its criterion, for more than ten points."""
    if sizes(state).first()["size"] <= 10:
        return False
    row = ratios(state, cell).first()
    return row["alpha_del"] > params.delete_criterion or row["alpha_bal"] > params.balance_criterion
