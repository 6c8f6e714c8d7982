"""Principal components and k-means of wide rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import written


def _assembled(rows: DataFrame, cols: list[str]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    fine = rows.where(F.forall(F.array(*(F.col(c).cast("double") for c in cols)), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return fine.withColumn("features", array_to_vector(F.array(*(F.col(c).cast("double") for c in cols))))


def scaled(rows: DataFrame, cols: list[str]) -> DataFrame:
    """rows with the vector `z` of the columns, centred and scaled; rows with a null or non-finite value are dropped, constant columns are 0."""
    from pyspark.ml.feature import StandardScaler

    own = _assembled(rows, cols)
    return StandardScaler(inputCol="features", outputCol="z", withMean=True, withStd=True).fit(own).transform(own)


def pca(rows: DataFrame, cols: list[str], k: int) -> DataFrame:
    """M9: rows with the array `pc` of their k first components; each component's largest loading is positive."""
    import numpy as np
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    z = scaled(rows, cols)
    model = PCA(k=k, inputCol="z", outputCol="_pc").fit(z)
    loadings = np.array(model.pc.toArray())
    sign = np.sign(loadings[np.abs(loadings).argmax(0), range(loadings.shape[1])]).tolist()
    out = model.transform(z).withColumn("_a", vector_to_array("_pc"))
    return out.withColumn("pc", F.array(*(F.col("_a")[i] * s for i, s in enumerate(sign)))).drop("features", "z", "_pc", "_a")


#: Samples of which the Gram matrix may have rows; it goes to the driver.
MOST_SAMPLES = 2000


def gram(values: DataFrame, sample: str, features: list[str], value: str, scale: bool = False) -> DataFrame:
    """(a, b, g) for samples a <= b: sums of products of centred values over all features. Features without a row of a sample are 0 there.

    Values are kept long and never made dense: centring each feature over the n samples takes from a product's sum the
    means of its row and column and adds that of all. With scale each feature is divided by its standard deviation, and
    constant ones are left out. Null and non-finite values count as 0; samples are those of the table.
    """
    x = F.col(value).cast("double")
    own = values.select(F.col(sample).alias("a"), *features, F.when(F.abs(x) < float("inf"), x).otherwise(0.0).alias("x"))
    own = own.groupBy("a", *features).agg(F.sum("x").alias("x"))
    names = own.select("a").distinct()
    n = names.count()
    if n > MOST_SAMPLES:
        raise ValueError(f"{n} samples: their Gram matrix is no small one; use pca over columns")
    if scale:
        spread = own.groupBy(*features).agg(((F.sum(F.col("x") * F.col("x")) - F.sum("x") * F.sum("x") / n) / max(1, n - 1)).alias("_var")).where("_var > 1e-12")
        own = own.join(spread, features).withColumn("x", F.col("x") / F.sqrt("_var")).drop("_var")
    kept = own.where("x <> 0")
    # A feature meets itself once for each two samples; sums are combined before they are shuffled.
    other = kept.select(*features, F.col("a").alias("b"), F.col("x").alias("y"))
    raw = kept.join(other, features).where("a <= b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("k"))
    grid = names.join(names.withColumnRenamed("a", "b"), F.col("a") <= F.col("b"))
    k = grid.join(raw, ["a", "b"], "left").fillna(0.0, ["k"])
    both = k.unionByName(k.where("a < b").select(F.col("b").alias("a"), F.col("a").alias("b"), "k"))
    row = both.groupBy("a").agg((F.sum("k") / n).alias("m"))
    total = row.agg((F.sum("m") / n).alias("all"))
    # n rows, and one.
    means = k.join(F.broadcast(row), "a").join(F.broadcast(row.select(F.col("a").alias("b"), F.col("m").alias("m_b"))), "b").join(F.broadcast(total))
    return means.select("a", "b", (F.col("k") - F.col("m") - F.col("m_b") + F.col("all")).alias("g"))


def sample_pca(values: DataFrame, sample: str, features: list[str], value: str, k: int = 2, scale: bool = False) -> DataFrame:
    """M9 of few samples over many features: (sample, pc, share): each sample's first k components and their shares of the variance.

    Only the samples' Gram matrix is decomposed. Each component's largest value is positive; a component beyond the
    rank is 0 everywhere.
    """
    import numpy as np

    rows = gram(values, sample, features, value, scale).collect()
    names = sorted({r["a"] for r in rows})
    place = {s: i for i, s in enumerate(names)}
    g = np.zeros((len(names), len(names)))
    for r in rows:
        g[place[r["a"]], place[r["b"]]] = g[place[r["b"]], place[r["a"]]] = r["g"]
    found, vectors = np.linalg.eigh(g) if names else (np.zeros(0), np.zeros((0, 0)))
    found, vectors = np.maximum(found[::-1][:k], 0), vectors[:, ::-1][:, :k]
    if names:
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(vectors.shape[1])])
    all_of = max(float(np.trace(g)), 1e-300)
    rank = found > 1e-9 * all_of
    scores, share = vectors * np.sqrt(found * rank), (found * rank / all_of).tolist()
    kind = values.schema[sample].dataType.simpleString()
    made = [(s, scores[i].tolist(), share) for i, s in enumerate(names)]
    return values.sparkSession.createDataFrame(made, f"`{sample}` {kind}, pc array<double>, share array<double>")


def kmeans(rows: DataFrame, cols: list[str], k: int = 20, starts: int = 10, rounds: int = 500, scale: bool = True) -> tuple[DataFrame, float]:
    """Rows with `cluster` (1 is the largest) and the inertia of the best of `starts` starts."""
    from pyspark.ml.clustering import KMeans

    own = scaled(rows, cols) if scale else _assembled(rows, cols).withColumn("z", F.col("features"))
    best = min((KMeans(k=k, maxIter=rounds, seed=s, featuresCol="z", predictionCol="_c").fit(own) for s in range(starts)), key=lambda m: m.summary.trainingCost)
    sizes = sorted(range(len(best.summary.clusterSizes)), key=lambda c: (-best.summary.clusterSizes[c], c))
    rank = F.element_at(F.create_map(*(x for i, c in enumerate(sizes) for x in (F.lit(c), F.lit(i + 1)))), F.col("_c"))
    return best.transform(own).withColumn("cluster", rank).drop("features", "z", "_c"), best.summary.trainingCost


#: Groups that are clustered each on its own, in the same passes.
MOST_GROUPS = 100
#: A start has settled once no centre moves by more than this share of its group's spread.
SETTLED = 1e-4


def _distances(z, c):
    """Squared distances of rows and centres; what rounding leaves of equal ones is 0."""
    import numpy as np

    both = (z * z).sum(1)[:, None] + (c * c).sum(1)
    d = both - 2 * (z @ c.T)
    return np.where(d > 1e-12 * both, d, 0.0)


def _each_part(frames, d: int, scales: dict):
    """(key, n, x, z) of each group's rows in a batch and each scaling; scales: (g, name) -> (means, divisors)."""
    import numpy as np

    for pdf in frames:
        at, rows = pdf["g"].to_numpy(), pdf[["n", *(f"x{i}" for i in range(d))]].to_numpy(dtype=float)
        for g in np.unique(at):
            own = rows[at == g]
            for key, (mean, by) in scales.items():
                if key[0] == g:
                    yield key, own[:, 0], own[:, 1:], (own[:, 1:] - mean) / by


def _told(out: dict):
    import pandas as pd

    return pd.DataFrame([(*key, v.ravel()) for key, v in out.items()], columns=["g", "name", "v"])


def _drawn(d: int, scales: dict, centres: dict, starts: int):
    """v: of each start the smallest key and its row. A row is drawn as often as its number times its squared distance from the centres so far."""

    def run(frames):
        import numpy as np

        mix = lambda h: (h := (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9), h := (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB), h ^ (h >> np.uint64(31)))[-1]
        out: dict = {}
        for key, n, x, z in _each_part(frames, d, scales):
            have = centres[key].shape[1]
            h = np.zeros(len(x), dtype=np.uint64)
            for j in range(d):
                h = mix(h + np.uint64(0x9E3779B97F4A7C15) + np.ascontiguousarray(x[:, j]).view(np.uint64))
            best = out.setdefault(key, np.full((starts, d + 1), np.inf))
            for s in range(starts):
                w = n * _distances(z, centres[key][s]).min(1) if have else n
                u = ((mix(h + np.uint64(0x9E3779B97F4A7C15 * (1 + s * 100_003 + have) % 2**64)) >> np.uint64(11)).astype(float) + 0.5) / 2**53
                with np.errstate(divide="ignore"):
                    drawn = -np.log(u) / w
                i = int(drawn.argmin())
                if drawn[i] < best[s, 0] or np.isinf(best[s]).all():
                    best[s] = [drawn[i], *z[i]]
        yield _told(out)

    return run


def _moved(d: int, scales: dict, centres: dict, active: dict):
    """v: of each active start and centre the number of its rows, their sums, and their squared distances."""

    def run(frames):
        import numpy as np

        out: dict = {}
        for key, n, _, z in _each_part(frames, d, {k: v for k, v in scales.items() if active[k]}):
            k = centres[key].shape[1]
            sums = out.setdefault(key, np.zeros((len(active[key]), k, d + 2)))
            weights = [n, *(n * z[:, j] for j in range(d))]
            for a, s in enumerate(active[key]):
                far = _distances(z, centres[key][s])
                label = far.argmin(1)
                for j, w in enumerate([*weights, n * far[np.arange(len(z)), label]]):
                    sums[a, :, j] += np.bincount(label, w, minlength=k)
        yield _told(out)

    return run


def _squares(d: int, scales: dict):
    """v: sums of the squares of each column."""

    def run(frames):
        out: dict = {}
        for key, n, _, z in _each_part(frames, d, scales):
            out[key] = out.get(key, 0) + n @ (z * z)
        yield _told(out)

    return run


def clusters_by(rows: DataFrame, group: str, cols: list[str], scalings: dict[str, bool], k: int = 20, starts: int = 10, rounds: int = 500) -> DataFrame:
    """M10 by index stage: rows with a column for each of scalings (name -> whether columns are scaled): the cluster among its group's rows, 1 is the largest.

    Null in a group with fewer than k distinct rows, and for rows with an unknown value or group. Starts draw their
    centres by distance (k-means++) and move them until they settle, `rounds` times at most; the start with the least
    inertia holds. Distinct rows are counted once, and a pass over them moves the centres of all groups, scalings and
    starts, so a task holds a batch of rows and its sums, and the driver the centres.
    """
    import numpy as np

    values = [r[0] for r in rows.where(F.col(group).isNotNull()).select(group).distinct().orderBy(group).limit(MOST_GROUPS + 1).collect()]
    if len(values) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups in {group}")
    if not values:
        return rows.withColumns({name: F.lit(None).cast("int") for name in scalings})
    d, x = len(cols), [F.col(c).cast("double") for c in cols]
    fine = F.coalesce(F.forall(F.array(*x), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    code = F.element_at(F.create_map(*(y for i, v in enumerate(values) for y in (F.lit(v), F.lit(i)))), F.col(group))
    told = rows.select(F.when(fine, code).alias("g"), *(v.alias(f"x{i}") for i, v in enumerate(x))).where("g IS NOT NULL").groupBy("g", *(f"x{i}" for i in range(d))).agg(F.count("*").alias("n"))
    # Not in fewer files than tasks run at once, as each pass reads them.
    counts = written(told.repartition(rows.sparkSession.sparkContext.defaultParallelism, "g", *(f"x{i}" for i in range(d))).sortWithinPartitions("g"), "counts")
    held = [r.g for r in counts.groupBy("g").agg(F.count("*").alias("m")).collect() if r.m >= k]

    def passed(run):
        out: dict = {}
        # A row for each task, group and scaling.
        for r in counts.where(F.col("g").isin(held)).mapInPandas(run, "g int, name string, v array<double>").collect():
            out.setdefault((r.g, r.name), []).append(np.array(r.v))
        return out

    # Means first, then squares about them.
    zero = {(g, "_"): (np.zeros(d), np.ones(d)) for g in held}
    one = lambda at: {key: np.zeros((1, 1, d)) for key in at}
    totals = {key[0]: sum(v).reshape(d + 2) for key, v in passed(_moved(d, zero, one(zero), {key: [0] for key in zero})).items()} if held else {}
    means = {g: t[1 : d + 1] / t[0] for g, t in totals.items()}
    spread = passed(_squares(d, {(g, "_"): (m, np.ones(d)) for g, m in means.items()})) if held else {}
    scales, centres, wide = {}, {}, {}
    for (g, _), v in spread.items():
        square, n = sum(v), totals[g][0]
        sd = np.sqrt(square / max(1, n - 1))
        for name, scale in scalings.items():
            # Constant columns are 0.
            by = np.where(sd > 0, sd, np.inf) if scale else np.ones(d)
            scales[g, name], centres[g, name], wide[g, name] = (means[g], by), np.zeros((starts, 0, d)), np.sqrt((square / by**2).sum() / n)
    if scales:
        for _ in range(k):
            for key, v in passed(_drawn(d, scales, centres, starts)).items():
                own = np.array(v).reshape(-1, starts, d + 1)
                first = own[own[:, :, 0].argmin(0), np.arange(starts)]
                centres[key] = np.concatenate([centres[key], first[:, None, 1:]], 1)
    active, cost, size = {key: list(range(starts)) for key in scales}, {}, {}
    last = {key: centres[key].copy() for key in scales}
    for turn in range(rounds + 1):
        for key, v in (passed(_moved(d, scales, centres, active)) if any(active.values()) else {}).items():
            sums, going = sum(v).reshape(len(active[key]), k, d + 2), []
            for s, t in zip(active[key], sums):
                cost[key, s], size[key, s], last[key][s] = t[:, -1].sum(), t[:, 0], centres[key][s]
                new = np.where(t[:, :1] > 0, t[:, 1 : d + 1] / np.maximum(t[:, :1], 1), centres[key][s])
                if turn < rounds and np.sqrt(((new - centres[key][s]) ** 2).sum(1)).max() > SETTLED * wide[key]:
                    going.append(s)
                    centres[key][s] = new
            active[key] = going
    chosen = {}
    for key in scales:
        best = min(range(starts), key=lambda s: cost[key, s])
        order = np.argsort(-size[key, best], kind="stable")
        chosen[key] = last[key][best][order]

    def nearest(name: str):
        @F.pandas_udf("int")
        def cluster(told):
            out, g = np.full(len(told), -1), told["g"].fillna(-1).to_numpy()
            for key in scales:
                if key[1] == name:
                    at = np.flatnonzero(g == key[0])
                    z = (told.iloc[at, 1:].to_numpy(dtype=float) - scales[key][0]) / scales[key][1]
                    out[at] = _distances(z, chosen[key]).argmin(1) + 1
            return told["g"].__class__(out)

        return F.nullif(cluster(F.struct(F.when(fine, code).alias("g"), *(v.alias(f"x{i}") for i, v in enumerate(x)))), F.lit(-1))

    return rows.withColumns({name: nearest(name) for name in scalings})


def kmeans_by(rows: DataFrame, group: str, cols: list[str], k: int = 20, starts: int = 10, rounds: int = 500, scale: bool = False) -> DataFrame:
    """M10 by index stage in one scaling: rows with `cluster`."""
    return clusters_by(rows, group, cols, {"cluster": scale}, k, starts, rounds)
