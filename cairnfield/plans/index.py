"""A point index: an immutable state with the operations of a mutable one."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.operators import downsample, hierarchy, maintenance, mutate, search, stats
from cairnfield.operators.hierarchy import Hierarchy
from cairnfield.schema import AXES, LIVE, POINT, Box, Params, boxes_table
from cairnfield.storage import new_path, removed


@dataclass(frozen=True)
class PointIndex:
    """Every change returns a new index; readers keep the one they have. ``log`` has the changes
    since the last build, in order; ``paths`` the tables that this index or one before it
    has written: snapshots, and the states after changes that join, which
    would make the plan longer with each one. ``tree`` has the cuts by which balance is measured."""

    spark: SparkSession
    params: Params = field(default_factory=Params)
    state: DataFrame | None = None
    removed: DataFrame | None = None
    log: tuple[tuple, ...] = ()
    paths: tuple[str, ...] = ()
    tree: Hierarchy | None = None

    def __post_init__(self):
        if self.state is None:
            object.__setattr__(self, "state", mutate.build(self.spark.createDataFrame([], POINT)))

    # parameters
    def with_params(self, delete_criterion: float = 0.5, balance_criterion: float = 0.7, voxel: float = 0.2) -> PointIndex:
        return replace(self, params=Params(delete_criterion, balance_criterion, voxel))

    def set_delete_criterion(self, value: float) -> PointIndex:
        return replace(self, params=replace(self.params, delete_criterion=value))

    def set_balance_criterion(self, value: float) -> PointIndex:
        return replace(self, params=replace(self.params, balance_criterion=value))

    def set_voxel(self, value: float) -> PointIndex:
        return replace(self, params=replace(self.params, voxel=value))

    # contents
    def build(self, points: DataFrame) -> PointIndex:
        """Replaces all points. Earlier deletions vanish without being reported."""
        return replace(self, state=mutate.build(points), log=(), tree=None)

    def _changed(self, name: str, *arguments: object, **fields: object) -> PointIndex:
        return replace(self, log=(*self.log, (name, *arguments)), **fields)

    def _joined(self, name: str, *arguments: object, state: DataFrame) -> PointIndex:
        """After a change that joins: its state is written, so the next one's plan begins with a scan."""
        path = new_path(self.spark, "state")
        state.write.parquet(path)
        stored = self.spark.read.schema(state.schema).parquet(path)
        return self._changed(name, *arguments, state=stored, paths=(*self.paths, path))

    def replay(self, log: Iterable[tuple]) -> PointIndex:
        """The index after the changes of a log, in their order."""
        index = self
        for name, *arguments in log:
            changed = getattr(index, name)(*arguments)
            index = changed[0] if isinstance(changed, tuple) else changed
        return index

    def add_points(self, arrivals: DataFrame, thin: bool = False) -> tuple[PointIndex, int]:
        if not thin:
            state, n = mutate.add_points(self.state, arrivals)
            return self._changed("add_points", arrivals, thin, state=state), n
        n = downsample.count(self.state, arrivals, self.params.voxel).first()["added"]
        return self._joined("add_points", arrivals, thin, state=downsample.add_points(self.state, arrivals, self.params.voxel)), n

    def delete_points(self, requests: DataFrame) -> PointIndex:
        return self._joined("delete_points", requests, state=mutate.delete_points(self.state, requests))

    def _table(self, boxes: DataFrame | list[Box]) -> DataFrame:
        return boxes_table(self.spark, boxes) if isinstance(boxes, list) else boxes

    def delete_boxes(self, boxes: DataFrame | list[Box]) -> tuple[PointIndex, int]:
        table = self._table(boxes)
        n = mutate.delete_boxes_count(self.state, table).first()["deleted"]
        return self._after(boxes)("delete_boxes", boxes, state=mutate.delete_boxes(self.state, table)), n

    def readd_boxes(self, boxes: DataFrame | list[Box]) -> PointIndex:
        return self._after(boxes)("readd_boxes", boxes, state=mutate.readd_boxes(self.state, self._table(boxes)))

    def _after(self, boxes: DataFrame | list[Box]) -> Callable[..., PointIndex]:
        """A short list of boxes is a row-wise change; a table may be joined."""
        return self._changed if isinstance(boxes, list) and len(boxes) <= mutate.FEW_BOXES else self._joined

    # queries
    def nearest(self, queries: DataFrame, k: int, max_dist: float | None = None) -> DataFrame:
        return search.knn(self.state, queries, k, max_dist)

    def box(self, box: Box) -> DataFrame:
        return search.box_search(self.state, box)

    def radius(self, centre: tuple[float, float, float], radius: float) -> DataFrame:
        return search.radius_search(self.state, centre, radius)

    def flatten(self) -> DataFrame:
        return mutate.live_points(self.state)

    def size(self) -> int:
        return self.state.count()

    def validnum(self) -> int:
        return stats.sizes(self.state).first()["validnum"]

    def with_tree(self, leaf_rows: int | None = None) -> PointIndex:
        """The index with cuts at the medians of its live points, by which ``ratios``, ``nodes`` and
        ``compact_if_wanted`` measure the changes from then on."""
        return replace(self, tree=hierarchy.build(self.state.where(F.col("status") == LIVE), leaf_rows))

    def nodes(self) -> DataFrame:
        """The tree's nodes with sizes, extents and balance, as ``hierarchy.nodes``."""
        index = self if self.tree else self.with_tree()
        return hierarchy.nodes(self.state, index.tree, self.params)

    def ratios(self) -> tuple[float, float]:
        """The share of points that aren't live, and the larger share of the root's children;
        zeros without points, and a share of 1 for a root that is a leaf."""
        row = self.nodes().where("node = 1").select("alpha_del", F.coalesce("alpha_bal", F.lit(1.0)).alias("alpha_bal")).first()
        return (row["alpha_del"], row["alpha_bal"]) if row else (0.0, 0.0)

    def extent(self) -> Box:
        row = stats.extent(self.state).first()
        return Box(*(tuple(row[f"{a}_{s}"] for a in AXES) for s in ("min", "max")))

    # upkeep
    def compact(self) -> PointIndex:
        """Purges deleted points into the feed of removed points, and clusters the rest."""
        state, removed = maintenance.compact(self.state)
        feed = removed if self.removed is None else self.removed.unionByName(removed, allowMissingColumns=True)
        return self._changed("compact", state=state, removed=feed, tree=None)

    def compact_if_wanted(self) -> PointIndex:
        """Compacts if the tree's root is over a criterion: too many deleted points, or a child too large."""
        root = self.nodes().where("node = 1").first()
        return self.compact() if root and root["rebuild"] else self

    def take_removed(self) -> tuple[PointIndex, DataFrame]:
        """The feed of removed points so far, and the index with an empty feed."""
        nothing = self.state.drop("seq", "status").where(F.lit(False))
        return replace(self, removed=None), nothing if self.removed is None else self.removed

    def snapshot(self, path: str | None = None) -> PointIndex:
        """The state as a clustered table in the shared folder, which cuts its lineage. Box
        queries on it push their bounds to the scan."""
        path = path or new_path(self.spark, "index")
        maintenance.clustered(self.state).write.partitionBy("status").parquet(path)
        stored = self.spark.read.parquet(path)
        return replace(self, state=stored.select(*self.state.columns), paths=(*self.paths, path))

    def released(self, keep: int = 1) -> PointIndex:
        """Deletes all snapshots but the last ``keep``; indexes that read them are void then."""
        cut = len(self.paths) - keep
        for path in self.paths[: max(0, cut)]:
            removed(self.spark, path)
        return replace(self, paths=self.paths[max(0, cut) :])

    def close(self) -> None:
        """Deletes all snapshots."""
        self.released(0)
