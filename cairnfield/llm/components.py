"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.llm._common import dropped, staged

JUMPS = 3


def components(edges: DataFrame) -> DataFrame:
    """``node long, root long`` for each node of ``edges`` (a long, b long); the root is the
    smallest node that can be reached.

    In each round every group hooks onto its smallest neighbour, if that is smaller;
    chains of such hooks are shortened by joining them with themselves, and the edges are
    rewritten between groups. Edges within a group go, so the table shrinks with each round
    and the loop ends when none is left. Every step is an aggregate or an equi-join of
    staged tables, whose hot keys Spark can split; a lost executor costs one step at most.
    Null ends and loops are ignored.
    """
    links = staged(
        edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "links",
    )
    groups = staged(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("root", F.col("node")), "groups")
    while not links.isEmpty():
        hooks = staged(links.groupBy(F.col("b").alias("from")).agg(F.min("a").alias("to")), "hooks")
        for _ in range(JUMPS):
            onward = hooks.select(F.col("from").alias("via"), F.col("to").alias("end"))
            longer = staged(hooks.join(onward, F.col("to") == F.col("via"), "left").select("from", F.coalesce("end", "to").alias("to")), "hooks")
            dropped(hooks)
            hooks = longer
        moved = groups.join(hooks, F.col("root") == F.col("from"), "left").select("node", F.coalesce("to", "root").alias("root"))
        left, right = (hooks.select(F.col("from").alias(f"{x}_from"), F.col("to").alias(f"{x}_to")) for x in "ab")
        rewritten = (
            links.join(left, F.col("a") == F.col("a_from"), "left")
            .join(right, F.col("b") == F.col("b_from"), "left")
            .select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"))
            .where(F.col("a") != F.col("b"))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )
        old = groups, links, hooks
        groups, links = staged(moved, "groups"), staged(rewritten, "links")
        dropped(*old)
    dropped(links)
    return groups
