"""Density-adaptive tiles: quantile slabs along x, cut along y, cut along z.

The tile table is bounded by ``SLABS`` cubed, whatever the data's size, so it may be
collected and broadcast. Within a tile a regular grid of cells is fitted to its extent and
count. A point's (tile, cell) is the key of all joins between points and regions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions.geometry import SLACK
from cairnfield.schema import AXES

SLABS = 16
TILE_ROWS, CELL_ROWS = 20_000, 16
#: At most 2^10 cells of a tile along each axis.
CELL_BITS = 10
ACCURACY = 1000


@dataclass(frozen=True)
class Tiling:
    cuts: tuple[list, list, list]  # cuts of x; of y by slab; of z by slab and part
    tiles: DataFrame  # tile, n, and each axis' low, high, cells and scale

    def extent(self) -> dict[str, tuple[float, float]]:
        """The bounds of all points by axis; zeros without points."""
        row = self.tiles.agg(*(f(f"{a}_{s}").alias(f"{a}_{s}") for a in AXES for f, s in ((F.min, "low"), (F.max, "high")))).first()
        return {a: (row[f"{a}_low"] or 0.0, row[f"{a}_high"] or 0.0) for a in AXES}

    def tile(self) -> Column:
        """The tile of the columns x, y and z."""
        i = _slab(F.array(*map(F.lit, self.cuts[0])) if self.cuts[0] else None, "x")
        j = _slab(_nested(self.cuts[1], i), "y")
        k = _slab(_nested(self.cuts[2], i * SLABS + j), "z")
        return ((i * SLABS + j) * SLABS + k).cast("int")


def _slab(cuts: Column | None, axis: str) -> Column:
    if cuts is None:
        return F.lit(0)
    return F.size(F.filter(cuts, lambda c: c <= F.col(axis)))


def _nested(cuts: list, at: Column) -> Column | None:
    if not any(cuts):
        return None
    return F.element_at(F.array(*(F.array(*map(F.lit, c)) if c else F.array().cast("array<float>") for c in cuts)), at + 1)


def build(points: DataFrame, cell_rows: int | None = None) -> Tiling:
    """Tiles of ``points`` (x, y, z floats). Cuts are approximate quantiles, which tasks sketch
    before their sketches are merged; extents and counts are exact. Cells are sized for about
    ``cell_rows`` points, by default CELL_ROWS: an axis has no more of them than values, which are
    sketched, and the others have the more."""
    n = points.count()
    parts = min(SLABS, max(1, round((n / TILE_ROWS) ** (1 / 3))))
    empty = ([], [[] for _ in range(SLABS)], [[] for _ in range(SLABS * SLABS)])
    if parts > 1:
        shares = [k / parts for k in range(1, parts)]
        quantiles = lambda a: F.percentile_approx(a, shares, ACCURACY).alias("cuts")
        empty[0].extend(points.agg(quantiles("x")).first()["cuts"])
        at = Tiling(empty, points)
        slab = _slab(F.array(*map(F.lit, empty[0])), "x")
        for r in points.groupBy(slab.alias("i")).agg(quantiles("y")).collect():
            empty[1][r["i"]].extend(r["cuts"])
        part = _slab(_nested(empty[1], slab), "y")
        for r in points.groupBy((slab * SLABS + part).alias("i")).agg(quantiles("z")).collect():
            empty[2][r["i"]].extend(r["cuts"])
    at = Tiling(empty, points)
    bounds = [f(a).cast("double").alias(f"{a}_{name}") for a in AXES for f, name in ((F.min, "low"), (F.max, "high"))]
    values = [F.approx_count_distinct(a).alias(f"{a}_values") for a in AXES]
    rows = points.groupBy(at.tile().alias("tile")).agg(F.count("*").alias("n"), *bounds, *values).collect()
    table = []
    for r in rows:
        cells = _sides(r["n"] / (cell_rows or CELL_ROWS), [r[f"{a}_values"] for a in AXES])
        scales = [c / (r[f"{a}_high"] - r[f"{a}_low"]) if r[f"{a}_high"] > r[f"{a}_low"] and r[f"{a}_high"] - r[f"{a}_low"] != float("inf") else 0.0 for a, c in zip(AXES, cells, strict=True)]
        scales = [s if s < 1e300 else 0.0 for s in scales]
        table.append((r["tile"], r["n"], *(r[f"{a}_{name}"] for a in AXES for name in ("low", "high")), *cells, *scales))
    kinds = [("double", "low", "high"), ("int", "cells"), ("double", "scale")]
    fields = ", ".join(["tile int, n long", *(f"{a}_{name} {kind}" for kind, *names in kinds for a in AXES for name in names)])
    return Tiling(empty, points.sparkSession.createDataFrame(table, fields))


def _sides(cells: float, values: list[int]) -> list[int]:
    """Numbers of cells along the axes whose product is about ``cells``."""
    sides, left = [1] * len(values), cells
    for done, i in enumerate(sorted(range(len(values)), key=values.__getitem__)):
        sides[i] = max(1, min(1 << CELL_BITS, values[i], round(max(left, 1) ** (1 / (len(values) - done)))))
        left /= sides[i]
    return sides


def cell_index(value: Column, axis: str) -> Column:
    """Cell of a value along an axis of a tile; never falls as the value grows."""
    place = F.floor((value.cast("double") - F.col(f"{axis}_low")) * F.col(f"{axis}_scale"))
    return F.greatest(F.lit(0), F.least(F.col(f"{axis}_cells") - 1, place)).cast("int")


def _cell(indexes: list[Column]) -> Column:
    x, y, z = indexes
    return F.shiftleft(F.shiftleft(x, CELL_BITS) + y, CELL_BITS) + z


def placed(points: DataFrame, tiling: Tiling) -> DataFrame:
    """``points`` with their tile and cell."""
    joined = points.withColumn("tile", tiling.tile()).join(F.broadcast(tiling.tiles), "tile")
    return joined.select(*points.columns, "tile", _cell([cell_index(F.col(a), a) for a in AXES]).alias("cell"))


def _below(cuts: Column, bound: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c.cast("double") <= bound))


def touched(regions: DataFrame, tiling: Tiling, low: list[Column], high: list[Column]) -> DataFrame:
    """``regions`` with a row for each tile that their bounds touch and that has points.

    The slabs along x between the bounds follow from the cuts, then the parts along y of each,
    then those along z: an equi-join with the bounded tile table, not a test of each tile.
    """
    out = regions.withColumns({f"{a}_{s}_": c for a, lo, hi in zip(AXES, low, high, strict=True) for s, c in (("lo", lo), ("hi", hi))})
    first = F.array(*map(F.lit, tiling.cuts[0])) if tiling.cuts[0] else None
    i, j = F.col("i_"), F.col("j_")
    for name, axis, cuts in (("i_", "x", first), ("j_", "y", _nested(tiling.cuts[1], i)), ("k_", "z", _nested(tiling.cuts[2], i * SLABS + j))):
        ends = [F.lit(0) if cuts is None else _below(cuts, F.col(f"{axis}_{e}_")) for e in ("lo", "hi")]
        # bounds that are the wrong way round touch nothing
        out = out.where(F.col(f"{axis}_lo_") <= F.col(f"{axis}_hi_")).withColumn(name, F.explode(F.sequence(*ends)))
    out = out.withColumn("tile", ((i * SLABS + j) * SLABS + F.col("k_")).cast("int")).join(F.broadcast(tiling.tiles), "tile")
    for a in AXES:
        out = out.where((F.col(f"{a}_lo_") <= F.col(f"{a}_high")) & (F.col(f"{a}_hi_") >= F.col(f"{a}_low")))
    return out


def _cells(tiles: DataFrame, columns: list[str]) -> DataFrame:
    names = []
    for a in AXES:
        names.append(f"{a}_cell")
        tiles = tiles.withColumn(names[-1], F.explode(F.sequence(cell_index(F.col(f"{a}_lo_"), a), cell_index(F.col(f"{a}_hi_"), a))))
    return tiles.select(*columns, "tile", _cell([F.col(c) for c in names]).alias("cell"))


def spread(regions: DataFrame, tiling: Tiling, low: list[Column], high: list[Column], touches: Column | None = None) -> DataFrame:
    """``regions`` with a row for each (tile, cell) that their bounds [low, high], in double, touch.
    ``touches`` may be a sharper test of a tile."""
    tiles = touched(regions, tiling, low, high)
    return _cells(tiles if touches is None else tiles.where(touches), regions.columns)


def split(regions: DataFrame, tiling: Tiling, low: list[Column], high: list[Column], covers: Column) -> tuple[DataFrame, DataFrame]:
    """``regions`` by the tiles they cover whole (``tile``), whose points need no test, and by the
    (tile, cell) of the others that they touch. ``covers`` tests a tile by its ``x_low`` ... ``z_high``."""
    tiles = touched(regions, tiling, low, high).withColumn("covered_", covers)
    return tiles.where("covered_").select(*regions.columns, "tile"), _cells(tiles.where("NOT covered_"), regions.columns)


def widened(value: Column, by: Column, sign: int) -> Column:
    """A bound of a ball, in double, a little wider than floats could tell apart."""
    return value.cast("double") + sign * (by * (1 + SLACK) + F.abs(value.cast("double")) * 1e-6 + 1e-30)
