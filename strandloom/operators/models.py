"""Models and tests over grouped rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .running import running


def path_loglik(rows: DataFrame, keys: list[str], state: str = "state") -> DataFrame:
    """M8: the sum of the emissions of a given path; null states are left out."""
    return rows.groupBy(*keys).agg(F.sum(F.element_at("emissions", F.col(state))).alias("loglik"))


#: Ranges of values that a test's windows run over one by one.
SLICES = 1024


def bh_fdr(df: DataFrame, p: str) -> DataFrame:
    """Q-values by Benjamini and Hochberg, in [0, 1]; a null p has none.

    Equal p-values are counted first. Ranks and the smallest p * n / rank from the top down run within slices of [0, 1];
    each slice carries one number over to the next.
    """
    values = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("_n")).withColumn("_stretch", F.least(F.floor(F.col(p) * SLICES), F.lit(SLICES - 1)))
    ranked = running(values.withColumn("_g", F.lit(0)), ("_g",), [p], {"_k": ("sum", F.col("_n"))})
    total = values.agg(F.sum("_n").alias("_t"))
    least = ranked.join(F.broadcast(total)).withColumn("_m", -F.least(F.lit(1.0), F.col(p) * F.col("_t") / F.col("_k"))).withColumn("_stretch", -F.col("_stretch"))
    q = running(least, ("_g",), [F.desc(p)], {"_q": ("max", F.col("_m"))}).select(p, (-F.col("_q")).alias("q"))
    return df.join(q, p, "left")


def ks_two_sample(df: DataFrame, value: str, first: str) -> DataFrame:
    """(d, location): the largest gap between two empirical distributions and the least value where it is reached.

    Values are counted first; running sums go by slices between approximate quantiles, which set the work's division only.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(F.col(first)).alias("a"), F.count_if(~F.col(first)).alias("b")).withColumn("_g", F.lit(0))
    cuts = c.agg(F.percentile_approx(value, [k / 64 for k in range(1, 64)]).alias("_cuts"), F.sum("a").alias("_ta"), F.sum("b").alias("_tb"))
    dealt = c.join(F.broadcast(cuts)).withColumn("_stretch", F.size(F.filter("_cuts", lambda x: x < F.col(value)))).drop("_cuts")
    sums = running(dealt, ("_g",), [value], {"_sa": ("sum", F.col("a")), "_sb": ("sum", F.col("b"))})
    gap = F.abs(F.col("_sa") / F.col("_ta") - F.col("_sb") / F.col("_tb"))
    return sums.select(F.round(gap, 12).alias("g"), F.col(value).alias("v")).agg(F.max("g").alias("d"), F.max_by("v", F.struct("g", (-F.col("v")).alias("m"))).alias("location"))
