"""Count models, resampling, components and scores against plain loops."""

import math
import random
from statistics import NormalDist, median

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import counts_model as nb, multivariate as mv, quantiles as qt, resampling as rs, score_types, viterbi as vb


def pmf(k, mu, theta):
    return math.exp(math.lgamma(k + theta) - math.lgamma(theta) - math.lgamma(k + 1) + theta * math.log(theta / (theta + mu)) + k * math.log(mu / (mu + theta)))


def test_fit_is_the_likelihoods_optimum():
    r = np.random.default_rng(4)
    g = np.round(r.uniform(0.3, 0.6, 4000), 2)
    mu = np.exp(1 + 3 * g - 2 * g**2)
    y = r.negative_binomial(5, 5 / (5 + mu)).astype(float)
    beta, theta = nb.fit_nb(y, g, np.ones(len(y)))

    def loss(b, t):
        m = np.exp(np.stack([np.ones_like(g), g, g**2, g**3], 1) @ b)
        return -sum(math.log(pmf(k, x, t)) for k, x in zip(y, m))

    best = loss(beta, theta)
    assert abs(theta - 5) < 1
    for k in range(4):
        for d in (-0.02, 0.02):
            other = beta.copy()
            other[k] += d
            assert loss(other, theta) > best
    assert loss(beta, theta * 1.05) > best and loss(beta, theta / 1.05) > best


def test_tails_and_z_scores(spark):
    table = spark.createDataFrame([("a", 80, 0.4, 6.0, 3.0, 4.0), ("a", 81, 0.405, 12.0, 3.0, 8.0)], "sample string, step long, gc double, mu double, theta double, peak double")
    bins = spark.createDataFrame([("a", 0.4, 5.0, 2), ("a", 0.9, 0.0, 1), ("a", 0.1, 7.5, 1)], "sample string, gc double, reads double, alleles int")
    got = {r.gc: r for r in nb.nb_scores(bins, table).collect()}
    for gc, mu in ((0.4, 12.0), (0.9, 12.0), (0.1, 6.0)):
        k = got[gc].k
        assert k == math.ceil(got[gc].reads + 0.001)
        p = sum(pmf(i, mu, 3.0) for i in range(k + 1))
        assert math.isclose(got[gc].p, p, rel_tol=1e-9)
        assert math.isclose(got[gc].z, NormalDist().inv_cdf(p - pmf(k, mu, 3.0) / 2), rel_tol=1e-9)
    kinds = {k: {r.gc: r.predicted for r in nb.nb_predict(bins, table, k).collect()} for k in ("mu", "peak", "adjusted")}
    assert kinds["mu"][0.9] == 12.0 and kinds["peak"][0.4] == 4.0 and kinds["adjusted"][0.4] == 6.0


def test_model_table_has_each_step_and_the_modal_count(spark):
    fit = spark.createDataFrame([("a", [2.0, 0.5, 0.0, 0.0], 4.0, 0.4, 0.42, 9)], nb.FIT)
    got = nb.nb_model_table(fit).orderBy("step").collect()
    assert [r.step for r in got] == [80, 81, 82, 83, 84]
    for r in got:
        assert math.isclose(r.mu, math.exp(2 + 0.5 * r.gc)) and r.peak == max(range(40), key=lambda k: pmf(k, r.mu, 4.0))


def test_copy_numbers_of_a_gain(spark):
    counts = [20] * 10 + [40] * 10 + [0] * 6
    rows = [("a", "c", i * 10, i * 10 + 10, float(n), 20.0, 50.0) for i, n in enumerate(counts)]
    got = nb.copy_number_viterbi(spark.createDataFrame(rows, "sample string, chrom string, start0 long, end1 long, reads double, mu double, theta double")).orderBy("start0").collect()
    assert [(r.start0, r.end1, r.cn, r.n) for r in got] == [(0, 100, 2, 10), (100, 200, 4, 10), (200, 260, 0, 6)]


def viterbi_by_loop(e, move, forced=None, reverse=False):
    """The definition, one row after the other: states from 1, or nulls without a path."""
    e = [[-math.inf if x is None or math.isnan(x) else x for x in row] for row in e]
    for t, f in enumerate(forced or []):
        if f is not None:
            e[t] = [0.0 if k == f - 1 else -math.inf for k in range(len(e[t]))]
    e = [[0.0] * len(row) if max(row) == -math.inf else row for row in e]
    if len(e) == 1:
        return [None]
    e = e[::-1] if reverse else e
    states = range(len(e[0]))
    score, back = list(e[0]), []
    for row in e[1:]:
        best = [max(states, key=lambda i: (score[i] + move[i][j], -i)) for j in states]
        score, back = [score[best[j]] + move[best[j]][j] + row[j] for j in states], [*back, best]
    if max(score) == -math.inf:
        return [None] * len(e)
    path = [max(states, key=lambda j: (score[j], -j))]
    for best in back[::-1]:
        path.append(best[path[-1]])
    path = [j + 1 for j in path[::-1]]
    return path[::-1] if reverse else path


def log_moves(n, p, weights=None):
    return [[(lambda x: math.log(x) if x else -math.inf)((1 - p * (n - 1) if i == j else p) * (weights[i][j] if weights else 1)) for j in range(n)] for i in range(n)]


VITERBI = "sample string, chrom string, start0 long, emissions array<double>, forced int"


def test_viterbi_equals_all_paths(spark):
    import itertools

    r = random.Random(2)
    e = [[r.uniform(-3, 0) for _ in range(3)] for _ in range(6)]
    e[2][1] = -math.inf
    rows = spark.createDataFrame([("a", "c", i, v, None) for i, v in enumerate(e)], VITERBI)
    move = log_moves(3, 0.1)
    score = lambda p: sum(e[i][s] for i, s in enumerate(p)) + sum(move[a][b] for a, b in zip(p, p[1:]))
    best = [s + 1 for s in max(itertools.product(range(3), repeat=6), key=score)]
    assert best == viterbi_by_loop(e, move)
    for width in (1, 2, 100):
        assert [x.state for x in vb.viterbi_by_key(rows, ["sample", "chrom"], "start0", 0.1, width=width).orderBy("start0").collect()] == best


def test_viterbi_by_stretches_equals_the_loop(spark):
    """Long rows with ties, masked rows, gaps between stretches, forced states, a key of one row and null keys."""
    r = random.Random(7)
    rows, by = [], {}
    for key, n in (("a", 300), ("b", 1), (None, 40), ("d", 25)):
        for i in range(n):
            # Whole numbers, so that ties are exact.
            e = [float(r.randrange(-4, 1)) if r.random() < 0.8 else r.choice([None, -math.inf, float("nan")]) for _ in range(3)]
            at = i * 10 + (5000 if i > 150 else 0)
            forced = r.randrange(1, 4) if r.random() < 0.05 else None
            rows.append(("s", key, at, e if r.random() < 0.97 else None, forced))
            by.setdefault(key, []).append((at, rows[-1][3] or [None] * 3, forced))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, VITERBI)
    weights = [[1, 2, 0], [1, 1, 1], [0.5, 1, 1]]
    given = [[0.0, -2.0, -3.0], [-1.0, -1.0, -2.0], [-math.inf, -1.0, 0.0]]
    for options, move in (({}, log_moves(3, 0.25)), ({"forced": "forced"}, log_moves(3, 0.25)), ({"reverse": True, "weights": weights}, log_moves(3, 0.25, weights)), ({"trans_logs": given, "forced": "forced", "reverse": True}, given)):
        got: dict = {}
        for x in vb.viterbi_by_key(df, ["sample", "chrom"], "start0", 0.25, width=200, **options).orderBy("start0").collect():
            got.setdefault(x.chrom, []).append((x.start0, x.forced, x.state))
        for key, own in by.items():
            want = viterbi_by_loop([e for _, e, _ in own], move, [f for *_, f in own] if "forced" in options else None, options.get("reverse", False))
            assert got[key] == [(at, f, s) for (at, _, f), s in zip(own, want)], (key, options)
    # No way from state 1 to state 2 and back: no path.
    stuck = spark.createDataFrame([("s", "c", i, [0.0, 0.0], 1 + i % 2) for i in range(6)], VITERBI)
    assert {x.state for x in vb.viterbi_by_key(stuck, ["chrom"], "start0", trans_logs=[[0.0, -math.inf], [-math.inf, 0.0]], forced="forced", width=2).collect()} == {None}
    assert vb.viterbi_by_key(df.where("false"), ["chrom"], "start0", 0.1).count() == 0
    with pytest.raises(ValueError, match="3 states"):
        vb.viterbi_by_key(df, ["chrom"], "start0", trans_logs=[[0.0]], states=3)


@pytest.mark.parametrize("few", [0, 100_000])
def test_quantiles_equal_numpy(spark, monkeypatch, few):
    monkeypatch.setattr(qt, "FEW", few)
    r = np.random.default_rng(8)
    # A hot group with a third of all rows and few values, skewed groups, ties, one row, and nothing but nulls.
    groups = {"hot": r.integers(0, 5, 3000).astype(float), "wide": np.exp(r.normal(0, 3, 3000)), "tied": np.full(50, 7.5), "one": np.array([3.0]), "two": np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None), ("hot", None), ("wide", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    ps = {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {x.g: x for x in qt.quantiles(df, ["g"], F.col("v"), ps).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert np.allclose([got[g][n] for n in ps], np.quantile(vs, list(ps.values())), rtol=1e-12)
    # Counted rows give what repeated rows give; cuts of the whole table; where values lie between them.
    counted = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    assert {x.g: x.median for x in qt.medians(counted, ["g"], F.col("v"), weight=F.col("n")).collect()} == {g: got[g].c for g in groups}
    everything = np.concatenate(list(groups.values()))
    cuts = qt.cut_points(df, [], F.col("v"), [0.25, 0.5]).collect()
    assert len(cuts) == 1 and np.allclose(cuts[0].b, np.quantile(everything, [0.25, 0.5]))
    assert [x[0] for x in spark.createDataFrame([(1.0,), (2.0,), (2.5,), (9.0,)], "v double").select(qt.interval_of(F.col("v"), F.array(F.lit(2.0), F.lit(3.0)))).collect()] == [1, 1, 2, 3]
    assert qt.quantiles(df.where("false"), ["g"], F.col("v"), ps).count() == 0


def test_grouped_fits_equal_single_fits(spark):
    r = np.random.default_rng(11)
    rows, singles = [], {}
    for s, (size, theta) in {"a": (4000, 5.0), "b": (1500, 1.2), "c": (3000, 40.0)}.items():
        g = np.round(r.uniform(0.3, 0.6, size), 2)
        mu = np.exp(1.5 + 3 * g - 2 * g**2)
        y = r.negative_binomial(theta, theta / (theta + mu))
        points, n = np.unique(np.stack([g, y], 1), axis=0, return_counts=True)
        singles[s] = nb.fit_nb(points[:, 1], points[:, 0], n.astype(float))
        rows += [(s, float(p[0]), int(p[1]), int(k)) for p, k in zip(points, n)]
    got = nb.fit_grouped(spark.createDataFrame(rows, "sample string, gc double, y long, n long"))
    for s, (beta, theta) in singles.items():
        assert np.allclose(got[s][0], beta, atol=1e-6, rtol=1e-6) and math.isclose(got[s][1], theta, rel_tol=1e-6), s


def test_model_leaves_outliers_out(spark):
    r = np.random.default_rng(3)
    rows = []
    for _ in range(3000):
        g = round(float(r.uniform(0.35, 0.55)), 2)
        mu = math.exp(2 + g)
        rows.append(("a", g, float(r.negative_binomial(8, 8 / (8 + mu)))))
    clean = nb.nb_gc_fit(spark.createDataFrame(rows, "sample string, gc double, reads double")).first()
    dirty = nb.nb_gc_fit(spark.createDataFrame(rows + [("a", 0.45, 500.0)] * 20 + [("a", None, 4.0), ("a", 0.4, None)], "sample string, gc double, reads double")).first()
    mu = lambda f, g: math.exp(sum(b * g**k for k, b in enumerate(f.beta)))
    assert dirty.rows == 3020 and all(math.isclose(mu(dirty, g), mu(clean, g), rel_tol=0.05) for g in (0.4, 0.45, 0.5))
    assert all(math.isclose(mu(clean, g), math.exp(2 + g), rel_tol=0.15) for g in (0.4, 0.45, 0.5))


def test_polygamma_columns(spark):
    x = [0.001, 0.5, 1.0, 3.7, 50.0, 1e4]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", nb.digamma(F.col("x")).alias("d"), nb.trigamma(F.col("x")).alias("t")).collect()
    # Differences of logs of the gamma function, and pi^2 / 6.
    for row in got:
        assert math.isclose(sum(1 / (row.x + k) for k in range(5)), spark.createDataFrame([(row.x + 5,)], "x double").select(nb.digamma(F.col("x"))).first()[0] - row.d, rel_tol=1e-9)
    one = next(row for row in got if row.x == 1.0)
    assert math.isclose(one.d, -0.5772156649015329, rel_tol=1e-12) and math.isclose(one.t, math.pi**2 / 6, rel_tol=1e-12)


def test_chi_squared_tail_and_brown(spark):
    for x in (0.1, 2.0, 9.0, 60.0):
        assert math.isclose(rs.upper_gamma(2, x), math.exp(-x) * (1 + x), rel_tol=1e-10)
    p = spark.createDataFrame([(0.01,), (0.2,), (0.5,)], "p double")
    alone = rs.brown_combined(p, spark.createDataFrame([], "rho double")).first()
    stat = -2 * sum(math.log(x) for x in (0.01, 0.2, 0.5))
    h = stat / 2
    assert math.isclose(alone.statistic, stat) and alone.scale == 1 and alone.df == 6 and math.isclose(alone.p, math.exp(-h) * (1 + h + h * h / 2), rel_tol=1e-9)
    tied = rs.brown_combined(p, spark.createDataFrame([(0.9,), (0.9,), (0.9,)], "rho double")).first()
    assert tied.df < 6 and tied.scale > 1 and tied.p > alone.p


def test_normal_quantile(spark):
    ps = [1e-9, 0.001, 0.02425, 0.3, 0.5, 0.9, 0.9999]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0]], "p double").select(nb.normal_quantile(F.col("p"))).collect()]
    assert all(math.isclose(a, NormalDist().inv_cdf(p), rel_tol=1e-8, abs_tol=1e-8) for a, p in zip(got, ps)) and got[-2:] == [None, None]


def test_resampled_medians(spark):
    r = random.Random(1)
    rows = [(g, float(r.gauss(10 * i, 1)), k) for i, g in enumerate("ab") for k in range(60)]
    df = spark.createDataFrame(rows, "g string, v double, k long")
    for q in rs.bootstrap_median_ci(df, "g", "v", "k", sample=100, replicates=200).collect():
        own = [v for g, v, _ in rows if g == q.g]
        assert q.n == 60 and math.isclose(q.median, median(own)) and min(own) < q.low <= q.median <= q.high < max(own)
    far = rs.permutation_median_diff(df.withColumn("a", F.col("g") == "a").withColumn("k", F.xxhash64("g", "k") % 1000), "a", "v", "k", replicates=99).first()
    assert math.isclose(far.diff, median(v for g, v, _ in rows if g == "a") - median(v for g, v, _ in rows if g == "b")) and math.isclose(far.p, 0.02)


def test_replicates_spread_like_independent_ones(spark):
    """Widths and levels of the resampled statistics against NumPy's generator, which orders by products alone miss."""
    r = np.random.default_rng(3)
    v = np.round(r.gamma(2.0, 10.0, 400), 1)
    df = spark.createDataFrame([("g", float(x), k, k % 3 == 0) for k, x in enumerate(v)], "g string, v double, k long, a boolean")
    q = rs.bootstrap_median_ci(df, "g", "v", "k", sample=400, replicates=1000).first()
    low, high = np.quantile(np.median(r.choice(v, (4000, 400)), axis=1), [0.025, 0.975])
    assert abs((q.high - q.low) / (high - low) - 1) < 0.25 and abs(q.low - low) < 0.25 * (high - low)
    na = 134
    found = np.array([x.d for x in rs.relabelled(df.select("a", "v", "k"), na, 400, 3000).collect()])
    null = []
    for _ in range(3000):
        w = r.permutation(v)
        null.append(np.median(w[:na]) - np.median(w[na:]))
    assert len(found) == 3000 and abs(found.mean()) < 0.2 * np.std(null) and abs(found.std() / np.std(null) - 1) < 0.08


def test_relabelling_by_batches_equals_the_window(spark):
    rows = [(k % 4 == 0, float((k * 7) % 23), k // 2) for k in range(90)] + [(None, 1.0, 1), (True, None, 2), (False, 3.0, None)]
    df = spark.createDataFrame(rows, "a boolean, v double, k long")
    one, two = (rs.permutation_median_diff(df, "a", "v", "k", replicates=1100, limit=x).first() for x in (1000, 10))
    assert one == two and 0 < one.p <= 1
    clean = df.dropna()
    own = [sorted(x.d for x in rs.relabelled(clean, 23, 90, 700, x).collect()) for x in (1000, 10)]
    assert own[0] == own[1] and len(own[0]) == 700
    assert rs.permutation_median_diff(df.where("a"), "a", "v", "k", replicates=9).first() == (None, None)
    assert rs.permutation_median_diff(df.limit(0), "a", "v", "k", replicates=9).first() == (None, None)


def test_components_and_clusters(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 3)) @ np.diag([5, 1, 0.2]) @ np.array([[1, 1, 0], [0, 1, 1], [1, 0, 1]])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(900, float("nan"), 1.0, 1.0)], "i long, a double, b double, c double")
    got = {q.i: q.pc for q in mv.pca(df, ["a", "b", "c"], 2).collect()}
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    vectors = np.linalg.eigh(np.cov(z.T))[1][:, ::-1][:, :2]
    want = z @ (vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(2)]))
    assert 900 not in got and np.allclose([got[i] for i in range(200)], want, atol=1e-6)
    far = spark.createDataFrame([(i, float(i % 3 * 100 + i % 2), 0.0) for i in range(30)], "i long, a double, b double")
    rows, cost = mv.kmeans(far, ["a", "b"], k=3, starts=2, rounds=20, scale=False)
    assert rows.groupBy("cluster").count().count() == 3 and cost <= 30


def test_clusters_of_each_group(spark):
    rows = [(i, "ab"[i % 2], float(i % 4 * 100 + i % 3), 1.0) for i in range(60)] + [(100, "c", 1.0, 1.0), (101, "c", 2.0, 1.0), (102, "c", 1.0, 1.0), (103, "a", float("nan"), 1.0), (104, None, 1.0, 1.0), (105, "b", None, 1.0)]
    df = spark.createDataFrame(rows, "i long, g string, x double, y double")
    got = {r.i: r.cluster for r in mv.kmeans_by(df, "g", ["x", "y"], k=2, starts=2, rounds=10).collect()}
    # Group a holds x about 0 and 200, group b about 100 and 300; c has two distinct rows, the clusters themselves.
    for start in (0, 1):
        parts = [{got[i] for i in range(60) if i % 4 == k} for k in (start, start + 2)]
        assert sorted(map(sorted, parts)) == [[1], [2]]
    assert got[100] == got[102] != got[101] and all(got[i] is None for i in (103, 104, 105)) and len(got) == len(rows)
    few = mv.kmeans_by(spark.createDataFrame(rows[60:63], "i long, g string, x double, y double"), "g", ["x", "y"], k=3)
    assert {r.cluster for r in few.collect()} == {None}


def test_sample_components_equal_numpy(spark):
    r = np.random.default_rng(6)
    x = r.poisson(2.0, (6, 300)).astype(float) * r.choice([0, 1, 3], (6, 1)) + r.poisson(1.0, (6, 300))
    x[:, 7] = 4.0
    rows = [(f"s{i}", "c", j, float(v)) for i, line in enumerate(x) for j, v in enumerate(line) if v] + [("s0", "c", 900, float("nan")), ("s1", "c", 901, None)]
    df = spark.createDataFrame(rows, "sample string, chrom string, bin long, n double")
    for scale in (False, True):
        z = x - x.mean(0)
        if scale:
            sd = x.std(0, ddof=1)
            z = z[:, sd > 1e-6] / sd[sd > 1e-6]
        got = {(q.a, q.b): q.g for q in mv.gram(df, "sample", ["chrom", "bin"], "n", scale).collect()}
        assert np.allclose([[got[tuple(sorted((f"s{i}", f"s{j}")))] for j in range(6)] for i in range(6)], z @ z.T)
        u, d, _ = np.linalg.svd(z, full_matrices=False)
        found = {q["sample"]: q for q in mv.sample_pca(df, "sample", ["chrom", "bin"], "n", 3, scale).collect()}
        scores = u[:, :3] * d[:3]
        scores *= np.sign(scores[np.abs(scores).argmax(0), range(3)])
        assert np.allclose([found[f"s{i}"].pc for i in range(6)], scores, atol=1e-6) and np.allclose(found["s0"].share, d[:3] ** 2 / (d**2).sum())
    assert mv.sample_pca(df.where("false"), "sample", ["chrom", "bin"], "n").count() == 0


def test_scores_by_name(spark):
    counts = spark.createDataFrame([("s", "c", 0, 3, 6.0), ("s", "c", 1000, 1, 1.0), ("t", "c", 0, 0, 0.0), ("t", "c", 1000, 5, 5.0)], "sample string, chrom string, start0 long, n_obs long, n_wgt double")
    got = {r.start0: r.value for r in score_types.aggregated(counts, "cpm", "sum").collect()}
    assert math.isclose(got[0], math.log10(750000)) and math.isclose(got[1000], math.log10(1250000))
    assert {r.start0: r.value for r in score_types.aggregated(counts, "mean_weight").collect()} == {0: 1.0, 1000: 1.0}
    with pytest.raises(KeyError, match="cpm"):
        score_types.get("unknown")


def test_counted_relabellings_equal_ordered_ones(spark, monkeypatch):
    """Beyond the array's limit relabellings are counted by part and value: the same differences, and no row for each relabelling."""
    import numpy as np

    from strandloom.operators.scalars import PRIME

    r = np.random.default_rng(3)
    k = [*r.permutation(900).tolist(), 5, 5, 5, 7 + PRIME, PRIME, 2**40 + 3]
    rows = [(bool(x % 3 == 0), float(v), int(x)) for x, v in zip(k, r.integers(0, 40, len(k)))]
    own = spark.createDataFrame(rows, "a boolean, v double, k long")
    monkeypatch.setattr(rs, "PART", 100)
    monkeypatch.setattr(rs, "DRAWN", 60)
    na = sum(a for a, _, _ in rows)
    got = rs.counted_relabellings(own, na, len(rows), 150)
    want = rs.relabelled(own, na, len(rows), 150)
    assert sorted(x.d for x in got.collect()) == sorted(x.d for x in want.collect())
    assert rs.counted_relabellings(spark.range(2000).selectExpr("id % 2 = 0 AS a", "cast(id AS double) AS v", "id AS k"), 1000, 2000, 9) is None


def test_clusters_by_stage_are_whole(spark):
    """All starts and rounds of each group and scaling: no worse than Spark's k-means, rows at their nearest mean, largest first; the query has 20 clusters."""
    from strandloom.plans import catalog

    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(size=(240, 3)) * [1, 4, 0.5] + r.integers(0, 4, (240, 1)) * 6, r.normal(size=(150, 3))]).round(2)
    rows = [(i, "ab"[i >= 240], *map(float, v)) for i, v in enumerate(x)] + [(900, "c", 1.0, 1.0, 1.0), (901, "a", math.nan, 1.0, 1.0), (902, None, 1.0, 1.0, 1.0), *((1000 + i, "a", *map(float, x[0])) for i in range(5))]
    df = spark.createDataFrame(rows, "i long, g string, x double, y double, z double")
    got = mv.clusters_by(df, "g", ["x", "y", "z"], {"plain": False, "scaled": True}, k=6).collect()
    assert len(got) == len(rows) and all(q.plain is None and q.scaled is None for q in got if q.i in (900, 901, 902))
    for g in "ab":
        own = [q for q in got if q.g == g and q.i != 901]
        z = np.array([[q.x, q.y, q.z] for q in own])
        for name in ("plain", "scaled"):
            label = np.array([q[name] for q in own])
            w = z / z.std(0, ddof=1) if name == "scaled" else z
            sizes = [int((label == c).sum()) for c in range(1, 7)]
            assert sizes == sorted(sizes, reverse=True) and min(sizes) > 0
            means = np.array([w[label == c].mean(0) for c in range(1, 7)])
            far = ((w[:, None] - means) ** 2).sum(2)
            assert (far[np.arange(len(w)), label - 1] <= far.min(1) + 1e-2).all()
            _, cost = mv.kmeans(df.where(F.col("g") == g).toDF("i", "g", "a", "b", "c"), ["a", "b", "c"], k=6, starts=3, rounds=100, scale=name == "scaled")
            assert far.min(1).sum() <= 1.02 * cost
    told = catalog.queries()["m10_kmeans_by_stage"](spark, "/root/testdata/sf0.001").collect()
    assert {q.scaling for q in told} == {"scaled", "unscaled"} and max(q.cluster or 0 for q in told) == 20


def test_hashes_by_differences_equal_the_sql(spark):
    """A relabelling's hashes follow from the last one's by additions: the same as mixed() for any order of relabellings, and no product is taken for the next one."""
    from strandloom.operators.scalars import PRIME, mixed

    keys = [0, 1, 2, 77, PRIME - 1, PRIME, PRIME + 5, 2**40 + 3, 2**62]
    reps = [1, 2, 3, 4, 900, 901, 3, PRIME - 1, PRIME, PRIME + 1]
    got = spark.createDataFrame([(r, k) for r in set(reps) for k in keys], "r long, k long").select("r", "k", mixed(F.col("r"), F.col("k")).alias("h")).collect()
    want = {(q.r, q.k): q.h for q in got}
    draw = rs._hashes(np.array(keys, dtype=np.int64))
    for r in reps:
        assert draw(r).tolist() == [want[r, k] for k in keys] and draw(r + 1).dtype == np.uint32
        draw(r)
    mask = np.random.default_rng(1).random(4099) < 0.01
    assert all((rs._rare(m) == np.flatnonzero(m)).all() for m in (mask, mask[:4096], mask[:0], mask[:8]))
