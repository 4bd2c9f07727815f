"""Range joins by dyadic cells.

Time is cut to cells of 2^level units. An interval is put on the level at which
it touches two neighbouring cells at most, whatever its length: two rows, not one for every cell it
crosses. A point lies in one cell of each level, so a join on (keys, level, cell) has every
interval that can hold the point beside it, and few others: intervals in a cell are longer
than an eighth of it. Levels are three apart, and a point looks only at the levels that
intervals of its own keys are on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 3  # levels are multiples of this
LEVELS = tuple(range(0, 63, STEP))
UNIT_S = 1.0


def cell(t: Column, unit: float) -> Column:
    return F.floor(t / F.lit(unit)).cast("long")


def at_level(c: Column, level: Column) -> Column:
    return F.call_function("shiftright", c, level)


def level_of(first: Column, last: Column) -> Column:
    """The least level at which cells first..last are two at most."""
    bits = F.length(F.bin(last - first - 1))
    return F.when(last - first <= 1, F.lit(0)).otherwise(F.ceil(bits / STEP).cast("int") * STEP)


def placed(intervals: DataFrame, start: str, end: str, unit: float) -> DataFrame:
    """Intervals with `_level` and `_cell`, a row for each of the cells, two at most.
    One that ends before it starts holds nothing and has none."""
    a, z = cell(F.col(start), unit), cell(F.col(end), unit)
    on = intervals.filter(F.col(start) <= F.col(end)).withColumn("_level", level_of(a, z))
    both = F.array_distinct(F.array(at_level(a, F.col("_level")), at_level(z, F.col("_level"))))
    return on.withColumn("_cell", F.explode(both))


def points_in(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], t: str, start: str, end: str,
    unit: float = UNIT_S, few_points: bool = False,
) -> DataFrame:
    """Every point with every closed interval of equal keys that holds it: the columns of both,
    the keys once. Other names must differ. Null keys and ends meet nothing.

    The levels of a key's intervals, 21 at most, are joined to its points; with `few_points`
    the points look at all levels, and the intervals are read once only.
    """
    on = placed(intervals, start, end, unit)
    if few_points:
        seen = points.withColumn("_levels", F.array(*map(F.lit, LEVELS)))
    else:
        levels = on.groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))
        seen = points.join(levels, list(keys))
    probe = seen.withColumn("_level", F.explode("_levels")).withColumn("_cell", at_level(cell(F.col(t), unit), F.col("_level")))
    met = probe.drop("_levels").join(on, [*keys, "_level", "_cell"])
    return met.filter(F.col(t).between(F.col(start), F.col(end))).drop("_level", "_cell")


def overlapping(
    intervals: DataFrame, windows: DataFrame, keys: Sequence[str], start: str, end: str, w0: str, w1: str, unit: float = UNIT_S,
) -> DataFrame:
    """Every interval with every window of equal keys that it shares an instant with. Two meet
    where the interval starts inside the window, or else the window starts inside it."""
    whole = intervals.filter(F.col(start) <= F.col(end))
    begun = points_in(whole, windows, keys, start, w0, w1, unit)
    held = points_in(windows.filter(F.col(w0) <= F.col(w1)), whole, keys, w0, start, end, unit, few_points=True)
    return begun.unionByName(held.filter(F.col(start) < F.col(w0)))
