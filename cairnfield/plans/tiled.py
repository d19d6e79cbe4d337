"""A stored state in tiles, of which changes and rebuilds rewrite only those they concern."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions.geometry import axes, in_box
from cairnfield.operators import hierarchy, mutate
from cairnfield.operators.hierarchy import Hierarchy
from cairnfield.schema import AXES, DELETED, LIVE, Box, Params
from cairnfield.storage import dropped, new_path, removed, staged


@dataclass(frozen=True)
class TileTable:
    """A state below ``path`` in one folder for each leaf of ``tree``.

    Changes rewrite the tiles that boxes touch (by the tiles' extents), insertions add files, and
    ``rebuilt`` rewrites what is below nodes that are over a criterion, with new cuts.
    A tile is overwritten as a whole after its new rows were written elsewhere, so a lost
    executor costs a task. The tiles' number is bounded by the tree's depth.
    Unlike ``PointIndex`` this table is changed in place: readers of an older object see the new rows.
    """

    spark: SparkSession
    path: str
    tree: Hierarchy
    columns: tuple[str, ...]
    params: Params = Params()
    leaf_rows: int | None = None

    @classmethod
    def create(cls, spark: SparkSession, points: DataFrame, params: Params | None = None, leaf_rows: int | None = None, path: str | None = None) -> TileTable:
        """Stores ``points``, all live, in tiles of about ``leaf_rows``."""
        state = staged(mutate.build(points), "points")
        tree = hierarchy.build(state, leaf_rows)
        table = cls(spark, path or new_path(spark, "tiles"), tree, tuple(state.columns), params or Params(), leaf_rows)
        table._written(state, "errorifexists")
        dropped(state)
        return table

    def _written(self, rows: DataFrame, mode: str) -> None:
        tiled = rows.withColumn("tile", self.tree.leaf()).repartition("tile")
        tiled.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("tile").parquet(self.path)

    def _stored(self) -> DataFrame:
        fields = self.spark.read.parquet(self.path)
        return fields.select(*self.columns, F.col("tile").cast("long").alias("tile"))

    def state(self) -> DataFrame:
        return self._stored().select(*self.columns)

    def nodes(self) -> DataFrame:
        return hierarchy.nodes(self.state(), self.tree, self.params)

    def append(self, arrivals: DataFrame) -> TileTable:
        """Adds points as new files of their tiles."""
        grown = self._stored().select(*self.columns).limit(0).unionByName(mutate.arriving(arrivals), allowMissingColumns=True)
        self._written(grown.select(*self.columns), "append")
        return self

    def delete_boxes(self, boxes: list[Box]) -> TileTable:
        return self._in_boxes(boxes, LIVE, DELETED)

    def readd_boxes(self, boxes: list[Box]) -> TileTable:
        return self._in_boxes(boxes, DELETED, LIVE)

    def _in_boxes(self, boxes: list[Box], was: str, becomes: str) -> TileTable:
        """Tiles with a row that changes are rewritten; the others' files stay."""
        hit = F.lit(False)
        for b in boxes:
            hit = hit | in_box(axes(), *(tuple(F.lit(float(v)).cast("float") for v in side) for side in (b.low, b.high)))
        changed = hit & (F.col("status") == was)
        touched = [r["tile"] for r in self._stored().where(changed).select("tile").distinct().collect()]
        if touched:
            rows = self._stored().where(F.col("tile").isin(touched)).withColumn("status", F.when(changed, becomes).otherwise(F.col("status")))
            self._replaced(rows.select(*self.columns), touched, self.tree)
        return self

    def _replaced(self, rows: DataFrame, tiles: list[int], tree: Hierarchy) -> TileTable:
        """The table with ``rows``, by the cuts of ``tree``, in place of whole ``tiles``."""
        table = replace(self, tree=tree)
        held = staged(rows, "retiled")
        kept = {r["tile"] for r in held.select(tree.leaf().alias("tile")).distinct().collect()}
        table._written(held, "overwrite")
        for gone in {*tiles} - kept:
            removed(self.spark, f"{self.path}/tile={gone}")
        dropped(held)
        return table

    def rebuilt(self) -> tuple[TileTable, DataFrame]:
        """Purges and splits anew the parts below the topmost nodes over a criterion, and returns
        the deleted points that went, as a written table. All else stays as it is,
        files included. A part whose points are in one place is purged, but can't be split."""
        tops = hierarchy.tops(self.nodes())
        stored = self._stored()
        tiles = [r["tile"] for r in stored.select("tile").distinct().collect()]
        concerned = [t for t in tiles if any(hierarchy.is_under(t, top) for top in tops)]
        part = stored.where(F.col("tile").isin(concerned)).select(*self.columns)
        gone = staged(part.where(F.col("status") == DELETED).drop("seq", "status"), "removed")
        if not concerned:
            return self, gone
        alive = staged(part.where(F.col("status") == LIVE), "alive")
        tree = self.tree
        for top in tops:
            tree = tree.under(top)
        tree = hierarchy.build(alive.select(*AXES), self.leaf_rows, start=tree)
        table = self._replaced(alive, concerned, tree)
        dropped(alive)
        return table, gone

    def close(self) -> None:
        removed(self.spark, self.path)
