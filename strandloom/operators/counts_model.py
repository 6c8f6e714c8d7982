"""Negative-binomial models of counts by GC content (M1-M5, M7), and the normal quantile function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .quantiles import quantiles
from .shared import sized_join, written

#: A model has a step for each 1/STEPS of GC.
STEPS = 200
ROUNDS, TOLERANCE = 60, 1e-9
#: θ of a fit that shows no more spread than a Poisson distribution.
POISSON = 1000.0
#: Probabilities within TINY of 0 or 1 have no z-score.
TINY = 1e-300


def _design(g):
    import numpy as np

    return np.stack([np.ones_like(g), g, g**2, g**3], 1)


def fit_nb(y, g, w):
    """What fit_grouped does for all samples, for one sample's arrays: (coefficients, θ) of log μ = b0 + b1 g + b2 g² + b3 g³ for counts y that occur w times, by weighted least squares and Newton steps on log θ."""
    import numpy as np

    x, theta = _design(g), 10.0
    mu = np.maximum(y, 0.5 * (w @ y) / w.sum())
    beta, before = np.linalg.lstsq(x * np.sqrt(w)[:, None], np.log(mu) * np.sqrt(w), rcond=None)[0], np.inf
    most = int(y.max()) if len(y) else 0
    for _ in range(ROUNDS):
        eta = np.clip(x @ beta, -30, 30)
        mu = np.exp(eta)
        v = w * mu / (1 + mu / theta)
        z = eta + (y - mu) / mu
        beta = np.linalg.solve(x.T @ (x * v[:, None]) + 1e-12 * np.eye(4), x.T @ (v * z))
        mu = np.exp(np.clip(x @ beta, -30, 30))
        for _ in range(5):
            # Sums over 0..y-1 stand for the differences of the digamma and trigamma functions.
            j = np.arange(most)
            one = np.concatenate([[0], np.cumsum(1 / (theta + j))])[y.astype(int)]
            two = np.concatenate([[0], np.cumsum(-1 / (theta + j) ** 2)])[y.astype(int)]
            d1 = w @ (one + np.log(theta / (theta + mu)) + 1 - (y + theta) / (mu + theta))
            d2 = w @ (two + 1 / theta - 2 / (theta + mu) + (y + theta) / (mu + theta) ** 2)
            slope, curve = theta * d1, theta * d1 + theta * theta * d2
            step = -slope / curve if curve < 0 else np.sign(slope)
            theta = float(np.clip(theta * np.exp(np.clip(step, -1, 1)), 1e-3, POISSON))
        if abs(beta - before).max() < TOLERANCE:
            break
        before = beta
    return beta, theta


def cdf(mu: float, theta: float, most: int):
    """F(0), ..., F(most) of the negative binomial."""
    import numpy as np

    k = np.arange(1, most + 1)
    logs = theta * np.log(theta / (theta + mu)) + np.concatenate([[0.0], np.cumsum(np.log((k - 1 + theta) / k * (mu / (mu + theta))))])
    return np.minimum(1.0, np.cumsum(np.exp(logs)))


def z_of(lower: float, upper: float) -> float | None:
    """Φ⁻¹ of the middle of two cumulative probabilities."""
    from statistics import NormalDist

    p = (lower + upper) / 2
    return NormalDist().inv_cdf(p) if TINY < p < 1 - 1e-16 else None


FIT = "sample string, beta array<double>, theta double, gc_min double, gc_max double, rows long"


def digamma(x: Column, terms: int = 8) -> Column:
    """The derivative of the log of the gamma function for x > 0: a recurrence up to x + terms, then its asymptotic series."""
    y = x + terms
    r = 1 / (y * y)
    series = F.log(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    for k in range(terms):
        series = series - 1 / (x + k)
    return series


def trigamma(x: Column, terms: int = 8) -> Column:
    """The second derivative, likewise."""
    y = x + terms
    r = 1 / (y * y)
    series = 1 / y + r / 2 + r / y * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * 5 / 66))))
    for k in range(terms):
        series = series + 1 / ((x + k) * (x + k))
    return series


def _sums(points: DataFrame, state: dict) -> dict:
    """For each sample of state the sums of one step over all of its points (gc, y, n): the normal equations of the coefficients, and both derivatives for θ.

    GC is taken between -1 and 1 here. Without coefficients the means are the counts, none below half of their mean.
    """
    spark = points.sparkSession
    side = spark.createDataFrame([(s, None if x["beta"] is None else x["beta"].tolist(), x["theta"], x["base"], x["middle"], x["half"]) for s, x in state.items()], "sample string, beta array<double>, theta double, base double, middle double, half double")
    # One row for each sample.
    x = points.join(F.broadcast(side), "sample").withColumn("u", (F.col("gc") - F.col("middle")) / F.col("half"))
    b, u, y, w, theta = F.col("beta"), F.col("u"), F.col("y").cast("double"), F.col("n").cast("double"), F.col("theta")
    powers = [F.lit(1.0), u, u * u, u * u * u, u * u * u * u, u * u * u * u * u, u * u * u * u * u * u]
    fit = b[0] + b[1] * u + b[2] * powers[2] + b[3] * powers[3]
    x = x.withColumn("eta", F.when(b.isNull(), F.log(F.greatest(y, F.col("base")))).otherwise(F.least(F.greatest(fit, F.lit(-30.0)), F.lit(30.0))))
    eta = F.col("eta")
    mu = F.exp(eta)
    v = F.when(b.isNull(), w).otherwise(w * mu / (1 + mu / theta))
    z = F.when(b.isNull(), eta).otherwise(eta + (y - mu) / mu)
    normal = [F.sum(v * p).alias(f"x{k}") for k, p in enumerate(powers)] + [F.sum(v * z * p).alias(f"z{k}") for k, p in enumerate(powers[:4])]
    one = w * (digamma(y + theta) - digamma(theta) + F.log(theta / (theta + mu)) + 1 - (y + theta) / (mu + theta))
    two = w * (trigamma(y + theta) - trigamma(theta) + 1 / theta - 2 / (theta + mu) + (y + theta) / ((mu + theta) * (mu + theta)))
    return {r["sample"]: r for r in x.groupBy("sample").agg(*normal, F.sum(one).alias("d1"), F.sum(two).alias("d2")).collect()}


def fit_grouped(points: DataFrame, rounds: int = ROUNDS, tolerance: float = 1e-8, start: dict[str, tuple] | None = None) -> dict[str, tuple]:
    """sample -> (coefficients, θ), the same optimum as fit_nb's, of all samples at once. points: sample, gc, y, n; start: a fit to begin with.

    Each round is one aggregation over the points of all samples that have not settled; a few sums of each reach the
    driver, where four equations are solved and log θ takes one Newton step.
    """
    import numpy as np

    state = {}
    for r in points.groupBy("sample").agg((F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("mean"), F.min("gc").alias("low"), F.max("gc").alias("high")).collect():
        state[r["sample"]] = {"beta": None, "theta": 10.0, "base": max(0.5 * r["mean"], 1e-9), "middle": (r["low"] + r["high"]) / 2, "half": max((r["high"] - r["low"]) / 2, 1e-6)}
    for s, (beta, theta) in (start or {}).items():
        if s in state:
            # The polynomial in gc as one in (gc - middle) / half.
            c = np.poly1d(beta[::-1])(np.poly1d([state[s]["half"], state[s]["middle"]])).coeffs[::-1]
            state[s] |= {"beta": np.concatenate([c, np.zeros(4 - len(c))]), "theta": theta}
    open_ = dict(state)
    for _ in range(rounds):
        if not open_:
            break
        for s, r in _sums(points.where(F.col("sample").isin(list(open_))), open_).items():
            x, theta = state[s], state[s]["theta"]
            square = np.array([[r[f"x{i + j}"] for j in range(4)] for i in range(4)])
            after = np.linalg.lstsq(square, np.array([r[f"z{k}"] for k in range(4)]), rcond=1e-13)[0]
            before, x["beta"] = x["beta"], after
            if before is None:
                continue
            slope, curve = theta * r["d1"], theta * r["d1"] + theta * theta * r["d2"]
            step = -slope / curve if curve < 0 else np.sign(slope)
            x["theta"] = float(np.clip(theta * np.exp(np.clip(step, -1, 1)), 1e-3, POISSON))
            if abs(after - before).max() < tolerance and abs(np.log(x["theta"] / theta)) < tolerance:
                del open_[s]

    def in_gc(x):
        # The polynomial in (gc - middle) / half as one in gc.
        out, power = np.zeros(4), np.poly1d([1.0])
        for k in range(4):
            c = x["beta"][k] * power.coeffs[::-1]
            out[: len(c)] += c
            power = power * np.poly1d([1 / x["half"], -x["middle"] / x["half"]])
        return out

    return {s: (in_gc(x), x["theta"]) for s, x in state.items()}


def nb_gc_fit(bins: DataFrame, sample: int = 200_000) -> DataFrame:
    """M1: a model of each sample. bins: sample, gc, reads (of one allele).

    A rough fit uses the rows inside of the 2.5-97.5 % band of their GC step, of which at most `sample` for each sample
    (those with the smallest hashes); the model is then fitted to all rows whose z-score in the rough fit is within 3.
    """
    own = bins.where("gc IS NOT NULL AND reads IS NOT NULL").select("sample", F.col("gc").cast("double").alias("gc"), F.round("reads").cast("long").alias("y"), F.xxhash64(*bins.columns).alias("_h"))
    step = F.floor(F.col("gc") * 20 + 0.5).alias("step")
    points = written(own.groupBy("sample", "gc", "y").agg(F.count("*").alias("n")), "points")
    band = quantiles(points.select("*", step), ["sample", "step"], F.col("y"), {"low": 0.025, "high": 0.975}, F.col("n"))
    inside = sized_join(own.select("*", step), band, ["sample", "step"]).where("y BETWEEN low AND high").select("sample", "gc", "y", "_h")
    # The rows of the smallest hashes by a cut on the hash: the share that `sample` is of the rows.
    total = inside.groupBy("sample").agg(F.count("*").alias("_n"))
    cut = (F.col("_h").cast("double") / 2.0**64 + 0.5) <= F.lit(float(sample)) / F.col("_n")
    rough = written(sized_join(inside, total, "sample").where(cut).groupBy("sample", "gc", "y").agg(F.count("*").alias("n")), "rough")
    spark = bins.sparkSession
    roughly = fit_grouped(rough, tolerance=1e-4)
    first = spark.createDataFrame([(s, b.tolist(), t) for s, (b, t) in roughly.items()], "sample string, beta array<double>, theta double")
    b, g = F.col("beta"), F.col("gc")
    mu = F.exp(F.least(F.greatest(b[0] + b[1] * g + b[2] * g * g + b[3] * g * g * g, F.lit(-30.0)), F.lit(30.0)))
    z = (F.col("y") - F.col("mu")) / F.sqrt(F.col("mu") + F.col("mu") * F.col("mu") / F.col("theta"))
    near = points.join(F.broadcast(first), "sample").withColumn("mu", mu).where(F.abs(z) <= 3).select("sample", "gc", "y", "n")
    models = spark.createDataFrame([(s, b.tolist(), t) for s, (b, t) in fit_grouped(written(near, "near"), start=roughly).items()], "sample string, beta array<double>, theta double")
    ends = points.groupBy("sample").agg(F.min("gc").alias("gc_min"), F.max("gc").alias("gc_max"), F.sum("n").alias("rows"))
    return ends.join(F.broadcast(models), "sample").select("sample", "beta", "theta", "gc_min", "gc_max", "rows")


def nb_model_table(models: DataFrame) -> DataFrame:
    """M2: (sample, step, gc, mu, theta, peak) for each step of GC between a model's least and greatest; peak: the modal count."""
    steps = models.withColumn("step", F.explode(F.sequence(F.floor(F.col("gc_min") * STEPS), F.ceil(F.col("gc_max") * STEPS)))).withColumn("gc", F.col("step") / STEPS)
    b, g = F.col("beta"), F.col("gc")
    mu = F.exp(b[0] + b[1] * g + b[2] * g * g + b[3] * g * g * g)
    table = steps.withColumn("mu", mu)
    peak = F.when(F.col("theta") > 1, F.floor(F.col("mu") * (F.col("theta") - 1) / F.col("theta"))).otherwise(0)
    return table.select("sample", "step", "gc", "mu", "theta", peak.cast("double").alias("peak"))


def nb_predict(bins: DataFrame, table: DataFrame, kind: str = "adjusted") -> DataFrame:
    """M3: bins (sample, gc, ...) with `mu`, `theta` and `predicted`: mu, peak, or adjusted (mu where the peak is below 10); GC is clamped to the model's range."""
    ends = table.groupBy("sample").agg(F.min("step").alias("_lo"), F.max("step").alias("_hi"))
    step = F.greatest(F.col("_lo"), F.least(F.col("_hi"), F.floor(F.col("gc") * STEPS + 0.5)))
    placed = bins.join(ends, "sample").withColumn("step", step).drop("_lo", "_hi")
    value = {"mu": F.col("mu"), "peak": F.col("peak"), "adjusted": F.when(F.col("peak") < 10, F.col("mu")).otherwise(F.col("peak"))}[kind]
    return placed.join(table.drop("gc"), ["sample", "step"]).withColumn("predicted", value).drop("peak")


def _tails(batches):
    import pandas as pd

    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            f = cdf(r.mu * r.alleles, r.theta, int(r.most))
            out += [(r.sample, r.step, r.alleles, k, float(f[k]), z_of(float(f[k - 1]) if k else 0.0, float(f[k]))) for k in range(int(r.most) + 1)]
        yield pd.DataFrame(out, columns=["sample", "step", "alleles", "k", "p", "z"])


def nb_scores(bins: DataFrame, table: DataFrame) -> DataFrame:
    """M4, M5: bins (sample, gc, reads, alleles, ...) with `p`, the lower tail of k = ceil(reads + 0.001), and `z`.

    z is Φ⁻¹ of the middle of F(k - 1) and F(k) under mean mu * alleles, null where it is infinite. Tails are computed
    once for each step and number of alleles, up to the largest count of the sample.
    """
    ends = table.groupBy("sample").agg(F.min("step").alias("_lo"), F.max("step").alias("_hi"))
    step = F.greatest(F.col("_lo"), F.least(F.col("_hi"), F.floor(F.col("gc") * STEPS + 0.5)))
    placed = bins.join(ends, "sample").withColumn("step", step).withColumn("k", F.ceil(F.col("reads") + 0.001)).drop("_lo", "_hi")
    used = placed.groupBy("sample", "step", "alleles").agg(F.max("k").alias("most"))
    tails = used.join(table.select("sample", "step", "mu", "theta"), ["sample", "step"]).select("sample", "step", "alleles", "mu", "theta", "most").mapInPandas(_tails, "sample string, step long, alleles int, k long, p double, z double")
    return placed.join(tails, ["sample", "step", "alleles", "k"])


def _emissions(copies: int):
    def run(batches):
        import numpy as np

        for pdf in batches:
            mu = np.maximum(0.1, pdf["mu"].to_numpy()[:, None] * np.arange(copies + 1) / 2)
            theta, k = pdf["theta"].to_numpy()[:, None], np.round(pdf["reads"].to_numpy()).astype(int)
            # log of gamma(k + θ) / (gamma(θ) k!), by sums of logs.
            ratio = np.array([np.log((np.arange(n) + t) / np.arange(1, n + 1)).sum() for n, t in zip(k, theta[:, 0])])[:, None]
            logs = ratio + theta * np.log(theta / (theta + mu)) + k[:, None] * np.log(mu / (mu + theta))
            yield pdf[["sample", "chrom", "start0", "end1"]].assign(emissions=list(logs))

    return run


def copy_number_viterbi(predicted: DataFrame, copies: int = 6, trans_prob: float = 1e-6) -> DataFrame:
    """M7: runs (sample, chrom, start0, end1, cn, n) of the most likely copy numbers 0..copies.

    predicted (M3): sample, chrom, start0, end1, reads, mu (of two copies), theta. No copies have mean 0.1.
    """
    from . import intervals, viterbi

    kinds = "sample string, chrom string, start0 long, end1 long"
    rows = predicted.select("sample", "chrom", "start0", "end1", "reads", "mu", "theta").mapInPandas(_emissions(copies), f"{kinds}, emissions array<double>")
    path = viterbi.viterbi_by_key(rows, ["sample", "chrom"], "start0", trans_prob, states=copies + 1).withColumn("cn", F.col("state") - 1)
    return intervals.run_length_group(path, "cn", [F.count("*").alias("n")], ["sample", "chrom"])


def normal_quantile(p: Column) -> Column:
    """Φ⁻¹ by a rational approximation with relative error below 1.2e-9; null outside of (0, 1)."""
    # The coefficients of the approximation.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

    def poly(cs: tuple, x: Column) -> Column:
        out = F.lit(cs[0])
        for k in cs[1:]:
            out = out * x + k
        return out

    q = p - 0.5
    r = q * q
    tail = lambda t: poly(c, F.sqrt(-2 * F.log(t))) / poly(d, F.sqrt(-2 * F.log(t)))
    middle = poly(a, r) * q / poly(b, r)
    return F.when((p <= 0) | (p >= 1), None).when(p < 0.02425, tail(p)).when(p > 0.97575, -tail(1 - p)).otherwise(middle)
