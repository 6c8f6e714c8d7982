"""Exact quantiles of groups of any size, by counts and ranks instead of a buffer of a group's values.

Equal values are counted, groups are cut into slices of values, and running sums of the counts go slice by slice, so no
task holds a group. Only the values between whose ranks a quantile lies are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .running import running
from .shared import sized_join, written

#: Slices of values that one group's counts are cut into; their borders set the work's division only.
SLICES = 64
#: So many counted values, of all groups together, are ranked without slices.
FEW = 100_000


def value_counts(df: DataFrame, by: list[str], value: Column, weight: Column | None = None) -> DataFrame:
    """(by, _v, _n): how often each value (a double; null and NaN are left out) occurs in each group."""
    n = F.count("*") if weight is None else F.sum(weight)
    own = df.withColumn("_v", value.cast("double")).where("_v IS NOT NULL AND NOT isnan(_v)")
    return own.groupBy(*by, "_v").agg(n.cast("long").alias("_n")).where("_n > 0")


def ranked_values(counts: DataFrame, by: list[str]) -> DataFrame:
    """counts with _to, the number of rows of the group with at most that value, and _all, the group's rows; counts is a written table."""
    if counts.limit(FEW + 1).count() <= FEW:
        w = Window.partitionBy(*by)
        return counts.withColumns({"_to": F.sum("_n").over(w.orderBy("_v")), "_all": F.sum("_n").over(w)})
    cuts = counts.agg(F.percentile_approx("_v", [k / SLICES for k in range(1, SLICES)], 1000).alias("_cuts"))
    # One row with at most SLICES numbers.
    sliced = counts.join(F.broadcast(cuts)).withColumn("_stretch", F.size(F.filter(F.array_distinct("_cuts"), lambda c: c < F.col("_v")))).drop("_cuts")
    ranks = running(sliced, tuple(by), ["_v"], {"_to": ("sum", F.col("_n"))})
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    return sized_join(ranks, totals, by)


def quantiles(df: DataFrame, by: list[str], value: Column, ps: dict[str, float], weight: Column | None = None) -> DataFrame:
    """(by, a column for each of ps: name -> probability) of each group that has a value, interpolated between ranks.

    Without weight each row counts once, else as often as weight says. With by empty there is one row, if any value.
    Rows with a null in `by` belong to no group.
    """
    keys = by or ["_g"]
    # Written: slices, ranks and totals all start from the counts, and what made them runs once.
    counts = written(value_counts(df if by else df.withColumn("_g", F.lit(0)), keys, value, weight), "values")
    ranks = ranked_values(counts, keys)
    found, some = [], F.lit(False)
    for name, p in ps.items():
        at = F.lit(float(p)) * (F.col("_all") - 1)
        for kind, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            held = (rank >= F.col("_to") - F.col("_n")) & (rank < F.col("_to"))
            some = some | held
            found.append(F.max(F.when(held, F.col("_v"))).alias(f"_{kind}_{name}"))
    ends = ranks.where(some).groupBy(*keys).agg(F.max("_all").alias("_all"), *found)
    at = lambda p: F.lit(float(p)) * (F.col("_all") - 1)
    between = [(F.col(f"_lo_{n}") + (at(p) - F.floor(at(p))) * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n) for n, p in ps.items()]
    return ends.select(*by, *between)


def cut_points(df: DataFrame, by: list[str], value: Column, ps: list[float], name: str = "b") -> DataFrame:
    """(by, name): an array of the quantiles ps of each group."""
    given = {f"_p{k}": p for k, p in enumerate(ps)}
    return quantiles(df, by, value, given).select(*by, F.array(*given).alias(name))


def interval_of(value: Column, cuts: Column) -> Column:
    """The number, from 1, of the interval between cuts that a value lies in; a cut belongs to the interval below it."""
    return 1 + F.size(F.filter(cuts, lambda c: c < value))


def medians(df: DataFrame, by: list[str], value: Column, name: str = "median", weight: Column | None = None) -> DataFrame:
    return quantiles(df, by, value, {name: 0.5}, weight)

