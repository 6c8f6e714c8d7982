"""Running aggregates along chromosomes, computed stretch by stretch so that no task holds a chromosome.

A stretch is a range of STRETCH positions. Within it a window runs over its own rows; what the stretches before it
carry over comes from one row for each stretch (their number is bounded by the length of the genome, not by the data).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

STRETCH = 65_536


def stretch(df: DataFrame, at: Column, width: int = STRETCH) -> DataFrame:
    """df with `_stretch`, the range of positions that a row lies in."""
    return df.withColumn("_stretch", F.floor(at / width))


def running(df: DataFrame, keys: tuple, order: list, values: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """df (with _stretch) with a column for each of values: name -> (max, min or sum, what), over the rows before (and itself).

    `order` sorts the rows of a stretch; stretches must be in the same order.
    """
    hows: dict[str, Callable] = {"max": F.max, "min": F.min, "sum": F.sum}
    own = Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    per = df.groupBy(*keys, "_stretch").agg(*(hows[how](what).alias(f"_c_{name}") for name, (how, what) in values.items()))
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_stretch", *(hows[how](f"_c_{name}").over(before).alias(f"_b_{name}") for name, (how, _) in values.items()))
    local = df.withColumns({f"_l_{name}": hows[how](what).over(own) for name, (how, what) in values.items()})
    joined = local.join(per, [*keys, "_stretch"], "left")
    end = {"max": F.array_max, "min": F.array_min}
    both = {name: end[how](F.array_compact(F.array(f"_l_{name}", f"_b_{name}"))) if how in end else F.coalesce(f"_l_{name}", F.lit(0)) + F.coalesce(f"_b_{name}", F.lit(0)) for name, (how, _) in values.items()}
    return joined.withColumns(both).drop(*(f"_{p}_{name}" for p in "lb" for name in values))


def previous(df: DataFrame, keys: tuple, order: list[str], name: str, what: Column) -> DataFrame:
    """df (with _stretch) with `name`: a struct of `what` in the row before, null for the first row of keys."""
    w = Window.partitionBy(*keys, "_stretch").orderBy(*order)
    held = F.struct(what.alias("v"))
    last = df.groupBy(*keys, "_stretch").agg(F.max_by(held, F.struct(*order)).alias("_last"))
    carried = last.select(*keys, "_stretch", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_stretch")).alias("_before"))
    own = df.withColumn("_own", F.lag(held).over(w))
    return own.join(carried, [*keys, "_stretch"], "left").withColumn(name, F.coalesce("_own", "_before")).drop("_own", "_before")
