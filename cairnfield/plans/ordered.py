"""A stored state in space-filling order, so that regions read the row groups near them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions.geometry import axes, dist_sq, in_box
from cairnfield.operators import curve
from cairnfield.operators import tiling as tl
from cairnfield.operators.curve import Curve
from cairnfield.operators.search import live
from cairnfield.schema import AXES, finite
from cairnfield.storage import new_path, removed

#: Pieces of regions up to this number are broadcast; a piece is a region's row and two numbers.
FEW_PIECES = 1 << 15


@dataclass(frozen=True)
class OrderedTable:
    """A state below ``path``, dealt and sorted by Morton key, so that the statistics of files, row
    groups and pages bound small cubes.

    Regions become intervals of keys. At most 64 that hold those of all regions go to the scan
    as comparisons; the points that are left meet the regions' cubes in an equi-join by size and
    prefix, then the exact test. Rows of equal keys may be dealt to several files.
    """

    spark: SparkSession
    path: str
    curve: Curve
    columns: tuple[str, ...]

    @classmethod
    def create(cls, state: DataFrame, path: str | None = None, options: dict[str, str] | None = None) -> OrderedTable:
        """Stores ``state`` (point_id, x, y, z, other columns); ``options`` go to the Parquet writer."""
        if curve.KEY in state.columns:
            raise ValueError(f"a column {curve.KEY} clashes with the key's")
        spark = state.sparkSession
        table = cls(spark, path or new_path(spark, "ordered"), Curve.over(state), tuple(state.columns))
        table._written(state, "errorifexists", options or {})
        return table

    def _written(self, rows: DataFrame, mode: str, options: dict[str, str]) -> None:
        order = [curve.KEY, "point_id"]
        keyed = rows.withColumn(curve.KEY, self.curve.key()).repartitionByRange(*order).sortWithinPartitions(*order)
        keyed.write.mode(mode).options(**options).parquet(self.path)

    def append(self, arrivals: DataFrame, options: dict[str, str] | None = None) -> None:
        """Adds rows as files of their own, in the order of the same extent."""
        self._written(arrivals.select(*self.columns), "append", options or {})

    def close(self) -> None:
        removed(self.spark, self.path)

    def stored(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def state(self) -> DataFrame:
        return self.stored().select(*self.columns)

    def near(self, pieces: DataFrame) -> DataFrame:
        """The live points, with their keys, in the intervals that hold all ``pieces``."""
        return live(self.stored().where(curve.within(curve.stretches(pieces))))

    def box_search(self, boxes: DataFrame) -> DataFrame:
        """A row (box_id, point columns) for each live point in each half-open box; as
        ``search.multi_box_search``."""
        bounds = boxes.where(finite(tuple(f"{a}_{s}" for a in AXES for s in ("min", "max"))))
        low, high = axes("", "_min"), axes("", "_max")
        return self._met(bounds, list(low), list(high), lambda: in_box(axes(), low, high)).select("box_id", *self._points())

    def radius_search(self, balls: DataFrame) -> DataFrame:
        """A row (query_id, point columns, dist_sq) for each live point in each closed ball; as
        ``search.multi_radius_search``."""
        named = balls.where(finite((*AXES, "radius")) & (F.col("radius") >= 0)).select("query_id", *(F.col(a).alias(f"q_{a}") for a in AXES), "radius")
        centre = axes("q_")
        reach = F.col("radius").cast("double")
        bounds = ([tl.widened(c, reach, sign) for c in centre] for sign in (-1, 1))
        met = self._met(named, *bounds, lambda: dist_sq(axes(), centre) <= F.col("radius") * F.col("radius"))
        return met.select("query_id", *self._points(), dist_sq(axes(), centre).alias("dist_sq"))

    def _points(self) -> list[str]:
        return [c for c in self.columns if c != "status"]

    def _met(self, regions: DataFrame, low: list[Column], high: list[Column], test: Callable[[], Column]) -> DataFrame:
        pieces = self.curve.pieces(regions, low, high)
        sizes = sorted(r["free"] for r in pieces.select("free").distinct().collect())
        points = self.near(pieces)
        # a row for each size of cube in use, of which there are at most BITS + 1
        keys = [F.struct(F.lit(b).alias("free"), F.shiftright(curve.KEY, 3 * b).alias("prefix")) for b in sizes]
        at = F.explode(F.array(*keys) if keys else F.expr("cast(array() as array<struct<free int, prefix bigint>>)"))
        placed = points.withColumn("at_", at).select(*self._points(), "at_.free", "at_.prefix")
        few = pieces.limit(FEW_PIECES + 1).count() <= FEW_PIECES
        return placed.join(F.broadcast(pieces) if few else pieces, ["free", "prefix"]).where(test())
