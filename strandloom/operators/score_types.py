"""Scores of bins by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class ScoreType:
    """U4: what a score is measured in, and how its distribution is shown."""

    name: str
    unit: str
    log10: bool = False
    z: bool = True
    quantile: bool = True
    minimum: float = 0.0


TYPES: dict[str, ScoreType] = {}
_MAKERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def score(kind: ScoreType) -> Callable:
    """Registers a function from counts (sample, chrom, start0, n_obs, n_wgt) to rows with `value`, under a name."""

    def register(make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        TYPES[kind.name], _MAKERS[kind.name] = kind, make
        return make

    return register


def get(name: str) -> Callable[[DataFrame], DataFrame]:
    """The score function called `name`; an unknown name is an error that lists the known ones."""
    if name not in _MAKERS:
        raise KeyError(f"no score {name!r}; there are {', '.join(sorted(_MAKERS))}")
    return _MAKERS[name]


@score(ScoreType("cpm", "reads per million", log10=True, minimum=0.001))
def cpm(counts: DataFrame) -> DataFrame:
    total = counts.groupBy("sample").agg(F.sum("n_obs").alias("t"))
    return counts.join(total, "sample").withColumn("value", F.col("n_obs") * 1e6 / F.col("t")).drop("t")


@score(ScoreType("mean_weight", "weight per read", quantile=False))
def mean_weight(counts: DataFrame) -> DataFrame:
    return counts.withColumn("value", F.when(F.col("n_obs") > 0, F.col("n_wgt").cast("double") / F.when(F.col("n_obs") > 0, F.col("n_obs"))).otherwise(0.0))


def aggregated(counts: DataFrame, name: str, agg: str = "avg") -> DataFrame:
    """(chrom, start0, value) of a score over all samples of a bin; agg is avg or sum."""
    how = {"avg": F.avg, "sum": F.sum}[agg]
    kind = TYPES[name]
    rows = get(name)(counts).groupBy("chrom", "start0").agg(how("value").alias("value"))
    return rows.withColumn("value", F.log10(F.greatest("value", F.lit(kind.minimum)))) if kind.log10 else rows
