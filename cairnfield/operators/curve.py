"""Space-filling order: Morton keys of points, and the key intervals that cover regions.

An axis is cut into 2^BITS equal cells over an extent; values outside it fall into the
outermost. A key interleaves the bits of a point's three cells, so each cube of 2^b cells is one
interval of keys: those with one prefix, which is the key without its last 3b bits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.schema import AXES, Box

BITS = 20
#: Cubes that a region is covered with, at most.
PIECES = 64
#: Levels above this one (8^COARSE cubes) are what the driver sees of all regions.
COARSE = 4
#: Intervals that are pushed to a scan, at most.
STRETCHES = 64
KEY = "morton"


#: Each number of STEP bits with two zeros after each bit.
STEP = 5
SPREAD = [sum((i >> b & 1) << 3 * b for b in range(STEP)) for i in range(1 << STEP)]


def _spread(cell: Column) -> Column:
    """The bits of a cell, each followed by two zeros."""
    table, last = F.array(*map(F.lit, SPREAD)).cast("array<long>"), F.lit((1 << STEP) - 1)
    parts = [F.shiftleft(F.get(table, F.shiftright(cell, at).bitwiseAND(last).cast("int")), 3 * at) for at in range(0, BITS, STEP)]
    return reduce(lambda p, q: p.bitwiseOR(q), parts)


def interleaved(x: Column, y: Column, z: Column) -> Column:
    return F.shiftleft(_spread(x), 2).bitwiseOR(F.shiftleft(_spread(y), 1)).bitwiseOR(_spread(z))


@dataclass(frozen=True)
class Curve:
    """The order over ``extent``, whose bounds must be finite."""

    extent: Box

    @classmethod
    def over(cls, points: DataFrame) -> Curve:
        """The order over the finite coordinates of ``points``; a single cell without any."""
        bounded = [F.when(F.abs(F.col(a).cast("double")) < F.lit(math.inf), F.col(a).cast("double")) for a in AXES]
        row = points.agg(*(f(c).alias(f"{a}_{s}") for a, c in zip(AXES, bounded, strict=True) for f, s in ((F.min, "low"), (F.max, "high")))).first()
        low, high = (tuple(row[f"{a}_{s}"] or 0.0 for a in AXES) for s in ("low", "high"))
        return cls(Box(low, high))

    def cell(self, axis: str, value: Column) -> Column:
        """The cell of a value (a long); never falls as the value grows."""
        low, high = (bounds[AXES.index(axis)] for bounds in (self.extent.low, self.extent.high))
        if not high > low:
            return F.when(value.isNotNull(), F.lit(0).cast("long"))
        place = (value.cast("double") - F.lit(low)) * F.lit(2.0**BITS / (high - low))
        return F.floor(F.least(F.greatest(place, F.lit(0.0)), F.lit(2.0**BITS - 1))).cast("long")

    def key(self) -> Column:
        """The key of the columns x, y and z."""
        return interleaved(*(self.cell(a, F.col(a)) for a in AXES))

    def pieces(self, regions: DataFrame, low: list[Column], high: list[Column]) -> DataFrame:
        """``regions`` with a row (free, prefix) for each cube that covers a part of their bounds
        [low, high]: cubes of 2^free cells, the smallest size of which PIECES do."""
        out = regions.withColumns({f"{a}_{s}_": self.cell(a, c) for a, lo, hi in zip(AXES, low, high, strict=True) for s, c in (("lo", lo), ("hi", hi))})
        for a in AXES:
            # bounds that are the wrong way round touch nothing
            out = out.where(F.col(f"{a}_lo_") <= F.col(f"{a}_hi_"))

        def cubes(free: Column) -> Column:
            cut = lambda name: F.call_function("shiftright", F.col(name), free)
            return reduce(lambda p, a: p * (cut(f"{a}_hi_") - cut(f"{a}_lo_") + 1), AXES, F.lit(1.0))

        sizes = F.sequence(F.lit(0), F.lit(BITS))
        out = out.withColumn("free", F.get(F.filter(sizes, lambda free: cubes(free) <= PIECES), 0))
        for a in AXES:
            ends = (F.expr(f"shiftright({a}_{s}_, free)") for s in ("lo", "hi"))
            out = out.withColumn(f"{a}_at_", F.explode(F.sequence(*ends)))
        return out.select(*regions.columns, "free", interleaved(*(F.col(f"{a}_at_") for a in AXES)).alias("prefix"))


def merged(found: list[tuple[int, int]], most: int = STRETCHES) -> list[tuple[int, int]]:
    """Closed intervals in order, joined over all but the widest gaps, so that ``most`` are left."""
    found = sorted(found)
    joined: list[tuple[int, int]] = []
    for low, high in found:
        if joined and low <= joined[-1][1] + 1:
            joined[-1] = (joined[-1][0], max(high, joined[-1][1]))
        else:
            joined.append((low, high))
    gaps = sorted(range(1, len(joined)), key=lambda i: joined[i - 1][1] - joined[i][0])
    breaks = sorted(gaps[: most - 1])
    return [(joined[i][0], joined[j - 1][1]) for i, j in zip([0, *breaks], [*breaks, len(joined)], strict=True)] if joined else []


def stretches(pieces: DataFrame) -> list[tuple[int, int]]:
    """At most STRETCHES intervals of keys that hold those of all ``pieces`` (free, prefix).

    The pieces are reduced to one interval in each of 8^COARSE cubes before the driver sees them.
    """
    shift = 3 * (BITS - COARSE)
    low = F.expr("shiftleft(prefix, 3 * free)")
    cubes = pieces.select(F.col("prefix").cast("long").alias("prefix"), "free").distinct().select(low.alias("low"), (F.expr("shiftleft(prefix + 1, 3 * free)") - 1).alias("high"))
    parts = cubes.withColumn("cube", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright("high", shift))))
    first, last = F.shiftleft("cube", shift), F.shiftleft(F.col("cube") + 1, shift) - 1
    held = parts.groupBy("cube").agg(F.min(F.greatest("low", first)).alias("low"), F.max(F.least("high", last)).alias("high"))
    return merged([(r["low"], r["high"]) for r in held.collect()])


def within(intervals: list[tuple[int, int]], key: str = KEY) -> Column:
    """Whether a key lies in one of the intervals, as comparisons with literals that scans take."""
    tests = [F.col(key).between(F.lit(low), F.lit(high)) for low, high in intervals]
    while len(tests) > 1:
        # in pairs, so that the expression stays flat
        tests = [reduce(lambda p, q: p | q, tests[i : i + 2]) for i in range(0, len(tests), 2)]
    return tests[0] if tests else F.lit(False)
