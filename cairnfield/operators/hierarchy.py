"""A tree of median splits over points: its cuts, its nodes' aggregates, and what wants rebuilding.

Nodes have heap numbers: the root is 1, the children of n are 2n and 2n + 1. Cuts are at most
2^MAX_DEPTH, whatever the data's size, so they may be collected; points stay in leaf
buckets. The cuts stay as they were built while points come and go, which is what
balance is measured by.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.operators.selection import Wanted, next_values, ranked_values
from cairnfield.schema import AXES, LIVE, Params
from cairnfield.storage import dropped, staged

#: Nodes with more live points are split, down to this depth.
LEAF_ROWS, MAX_DEPTH = 20_000, 12
#: Nodes up to this size are never rebuilt.
SMALL_TREE = 10


@dataclass(frozen=True)
class Hierarchy:
    """``cuts``: of each inner node the axis (0, 1, 2) and the float from which points go right."""

    cuts: dict[int, tuple[int, float]] = field(default_factory=dict)

    @property
    def depth(self) -> int:
        return max((n.bit_length() for n in self.cuts), default=0)

    def leaf(self) -> Column:
        """The leaf of the columns x, y and z, in one pass over the cuts' literals."""
        if not self.cuts:
            return F.lit(1).cast("long")
        size = 1 << self.depth
        texts = [",".join(str(self.cuts.get(n, (-1, 0.0))[k]) for n in range(size)) for k in (0, 1)]
        axis, pivot = F.split(F.lit(texts[0]), ",").cast("array<int>"), F.split(F.lit(texts[1]), ",").cast("array<float>")

        def step(node: Column, _: Column) -> Column:
            a = F.element_at(axis, node + 1)
            value = F.when(a == 0, F.col("x")).when(a == 1, F.col("y")).otherwise(F.col("z"))
            right = (value >= F.element_at(pivot, node + 1)).cast("int")
            return F.when(a < 0, node).otherwise(node * 2 + right)

        return F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(1), step).cast("long")

    def under(self, node: int) -> Hierarchy:
        """The cuts without those of a node and what is below it."""
        return Hierarchy({n: c for n, c in self.cuts.items() if not is_under(n, node)})


def is_under(node: int, top: int) -> bool:
    """Whether ``node`` is ``top`` or below it."""
    return node >= top and node >> (node.bit_length() - top.bit_length()) == top


def build(points: DataFrame, leaf_rows: int | None = None, max_depth: int = MAX_DEPTH, start: Hierarchy | None = None) -> Hierarchy:
    """Splits ``points`` (x, y, z floats) at exact medians of the longest axis of each node's
    extent, level by level; all nodes of a level are worked out together.

    Points below the cut go left, others right. Where half of a node's points or more are on its lowest value, the cut is the next one,
    so neither side is empty; a node whose points are all in one place is a leaf. With ``start``,
    its leaves are split further.
    """
    rows, cuts = leaf_rows or LEAF_ROWS, dict(start.cuts) if start else {}
    # points are written with their node level by level: its children follow from its own cut, not from the root's on
    held = staged(points.select(*AXES, Hierarchy(cuts).leaf().alias("group")), "level")
    while True:
        bounds = [f(a).alias(f"{a}_{s}") for a in AXES for f, s in ((F.min, "low"), (F.max, "high"))]
        axes, wanted = {}, {}
        for r in held.groupBy("group").agg(F.count("*").alias("n"), *bounds).where(F.col("n") > rows).collect():
            node = r["group"]
            spread = [np.float32(r[f"{a}_high"]) - np.float32(r[f"{a}_low"]) for a in AXES]
            k = int(np.argmax(spread))
            if node.bit_length() > max_depth or not spread[k] > 0:
                continue
            axes[node] = k
            wanted[node] = Wanted(r[f"{AXES[k]}_low"], r[f"{AXES[k]}_high"], r["n"] // 2)
        if not wanted:
            dropped(held)
            return Hierarchy(cuts)
        value = F.when(F.col("axis") == 0, F.col("x")).when(F.col("axis") == 1, F.col("y")).otherwise(F.col("z"))
        session = points.sparkSession
        on = session.createDataFrame(list(axes.items()), "node long, axis int")
        valued = held.join(F.broadcast(on), F.col("group") == F.col("node")).select("group", value.alias("value"))
        middle = ranked_values(valued, wanted)
        middle |= next_values(valued, {n: v for n, v in middle.items() if v == wanted[n].low})
        cuts |= {n: (axes[n], v) for n, v in middle.items()}
        fresh = session.createDataFrame([(n, axes[n], float(v)) for n, v in middle.items()], "node long, axis int, cut float")
        # nodes without a cut are leaves, and their points are done
        onward = held.join(F.broadcast(fresh), F.col("group") == F.col("node"))
        below = staged(onward.select(*AXES, (F.col("group") * 2 + (value >= F.col("cut")).cast("long")).alias("group")), "level")
        dropped(held)
        held = below


def nodes(state: DataFrame, tree: Hierarchy, params: Params | None = None) -> DataFrame:
    """A row for each node with points, of a state with columns x, y, z and status:

    ``node, level, size, invalid`` (points that aren't live), the live points' extent (``x_min`` ...
    ``z_max``, null if there are none) and ``radius_sq`` of the ball around it, ``left_size, alpha_del``
    (invalid / size), ``alpha_bal`` (the larger child's share of size; null in a leaf) and
    ``rebuild``: for more than SMALL_TREE points, alpha_del or alpha_bal is over its criterion.

    Points are aggregated by leaf, once; leaves are rolled up to all their ancestors, and so
    are at most 2^MAX_DEPTH rows from there on.
    """
    params = params or Params()
    live = F.col("status") == LIVE
    extent = [(f"{a}_{s}", a, f) for a in AXES for s, f in (("min", F.min), ("max", F.max))]
    leaves = state.groupBy(tree.leaf().alias("leaf")).agg(
        F.count("*").alias("size"), F.count_if(~live).alias("invalid"), *(f(F.when(live, F.col(a))).alias(name) for name, a, f in extent)
    )
    up = F.transform(F.sequence(F.lit(0), F.length(F.bin("leaf")) - 1), lambda k: F.call_function("shiftright", F.col("leaf"), k))
    every = leaves.withColumn("node", F.explode(up)).groupBy("node").agg(F.sum("size").alias("size"), F.sum("invalid").alias("invalid"), *(f(name).alias(name) for name, _, f in extent))
    left = every.where(F.col("node") % 2 == 0).select((F.col("node") / 2).cast("long").alias("parent"), F.col("size").alias("left_size"))
    both = every.join(left, F.col("node") == F.col("parent"), "left")
    inner = F.col("node").isin(list(tree.cuts)) if tree.cuts else F.lit(False)
    both = both.withColumn("left_size", F.when(inner, F.coalesce("left_size", F.lit(0).cast("long"))))
    share = F.col("left_size") / F.col("size")
    half = [(F.col(f"{a}_max").cast("double") - F.col(f"{a}_min").cast("double")) * F.lit(0.5) for a in AXES]
    out = both.select(
        "node",
        (F.length(F.bin("node")) - 1).alias("level"),
        "size",
        "invalid",
        *(name for name, _, _ in extent),
        ((half[0] * half[0] + half[1] * half[1]) + half[2] * half[2]).alias("radius_sq"),
        "left_size",
        (F.col("invalid") / F.col("size")).alias("alpha_del"),
        F.greatest(share, F.lit(1.0) - share).alias("alpha_bal"),
    )
    over = (F.col("alpha_del") > F.lit(params.delete_criterion)) | F.coalesce(F.col("alpha_bal") > F.lit(params.balance_criterion), F.lit(False))
    return out.withColumn("rebuild", (F.col("size") > SMALL_TREE) & over)


def tops(table: DataFrame) -> list[int]:
    """The nodes of ``nodes`` that want rebuilding and aren't below another that does."""
    asked = sorted(r["node"] for r in table.where("rebuild").select("node").collect())
    out: list[int] = []
    for n in asked:
        if not any(is_under(n, t) for t in out):
            out.append(n)
    return out
