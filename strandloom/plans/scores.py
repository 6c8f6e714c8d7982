"""Queries of count models, resampling, components and scores by name."""

from pyspark.sql import functions as F

from ..operators import counts_model as nb, multivariate as mv, resampling as rs, score_types
from ..operators.scalars import mixed_sql
from ..operators.shared import written
from .aggregates import DENSE_SQL, dense
from .profiles import STAGES, vectors
from .registry import query


def binned(inserts, bins):
    """Counts per sample and bin with a GC content and the alleles of each chromosome."""
    gc = 0.3 + (F.floor(F.col("start0") / 1000) * 37) % 300 / 1000.0
    alleles = F.when(F.col("chrom") == "chrX", 1).otherwise(2)
    return dense(inserts, bins).select("sample", "chrom", "start0", (F.col("start0") + 1000).alias("end1"), gc.alias("gc"), alleles.alias("alleles"), F.col("n_obs").alias("count"), (F.col("n_obs") / alleles).alias("reads"))


def fitted(inserts, bins):
    return nb.nb_gc_fit(binned(inserts, bins).where("alleles = 2").select("sample", "gc", "reads", "chrom", "start0"))


@query("m1_nb_gc_fit")
def m1(inserts, bins):
    """No SQL: iterated least squares and Newton steps, tested against the likelihood's optimum."""
    return fitted(inserts, bins).select("sample", *(F.round(F.col("beta")[k], 4).alias(f"b{k}") for k in range(4)), F.round("theta", 3).alias("theta"), "rows")


@query("m2_nb_model_table")
def m2(inserts, bins):
    return nb.nb_model_table(fitted(inserts, bins)).select("sample", "step", "gc", F.round("mu", 4).alias("mu"), "peak")


@query("m3_nb_predict")
def m3(inserts, bins):
    table = nb.nb_model_table(fitted(inserts, bins))
    return nb.nb_predict(binned(inserts, bins), table).select("sample", "chrom", "start0", "reads", F.round("predicted", 4).alias("predicted"))


GIVEN_SQL = "g AS (SELECT sample, LN(COUNT(*) / 5000.0) AS b0, COUNT(*) % 7 / 10.0 AS b1, -(COUNT(*) % 5) / 20.0 AS b2, 2.0 + COUNT(*) % 9 AS theta FROM f_inserts GROUP BY 1), s AS (SELECT sample, UNNEST(range(60, 121)) AS step, b0, b1, b2, theta FROM g), m AS (SELECT sample, step, theta, EXP(b0 + b1 * (step / 200.0) + b2 * POW(step / 200.0, 2) + 0.05 * POW(step / 200.0, 3)) AS mu FROM s), t AS (SELECT sample, step, theta, mu, FLOOR(mu * (theta - 1) / theta) AS peak FROM m)"


def given_models(inserts):
    """A made model of each sample, so that what follows from a model can be checked."""
    n = F.col("n")
    beta = F.array(F.log(n / 5000.0), n % 7 / 10.0, -(n % 5) / 20.0, F.lit(0.05))
    return inserts.groupBy("sample").agg(F.count("*").alias("n")).select("sample", beta.alias("beta"), (2.0 + n % 9).alias("theta"), F.lit(0.3).alias("gc_min"), F.lit(0.6).alias("gc_max"))


@query("m2_table_of_given_models", f"WITH {GIVEN_SQL} SELECT sample, step, ROUND(mu, 6) AS mu, theta, peak FROM t")
def m2_given(inserts):
    return nb.nb_model_table(given_models(inserts)).select("sample", "step", F.round("mu", 6).alias("mu"), "theta", "peak")


@query("m3_predictions_of_given_models", f"WITH {DENSE_SQL}, {GIVEN_SQL}, b AS (SELECT d.*, CAST(LEAST(120, GREATEST(60, FLOOR((0.3 + (start0 // 1000 * 37) % 300 / 1000.0) * 200 + 0.5))) AS BIGINT) AS step FROM d) SELECT b.sample, b.chrom, b.start0, ROUND(CASE WHEN t.peak < 10 THEN t.mu ELSE t.peak END, 6) AS predicted FROM b JOIN t ON t.sample = b.sample AND t.step = b.step")
def m3_given(inserts, bins):
    told = nb.nb_predict(binned(inserts, bins), nb.nb_model_table(given_models(inserts)))
    return told.select("sample", "chrom", "start0", F.round("predicted", 6).alias("predicted"))


@query("m4_nb_zscore")
def m4(inserts, bins):
    rows = binned(inserts, bins).withColumn("reads", F.col("count").cast("double"))
    return nb.nb_scores(rows, nb.nb_model_table(fitted(inserts, bins))).select("sample", "chrom", "start0", F.round("z", 4).alias("z"))


@query("m5_nb_cumprob")
def m5(inserts, bins):
    rows = binned(inserts, bins).withColumn("alleles", F.lit(1))
    return nb.nb_scores(rows, nb.nb_model_table(fitted(inserts, bins))).select("sample", "chrom", "start0", F.round("p", 6).alias("p"))


@query("m7_copy_number_viterbi")
def m7(inserts, bins):
    table = nb.nb_model_table(fitted(inserts, bins)).withColumn("mu", F.col("mu") * 2)
    rows = nb.nb_predict(binned(inserts, bins).withColumn("reads", F.col("count").cast("double")), table)
    return nb.copy_number_viterbi(rows)


STAGE_COLS = [f"s{k}" for k in range(1, STAGES + 1)]


def wide(regions, inserts, samples):
    v = vectors(regions, inserts, samples)
    return v.select("name", "peak_set", *(F.col("counts")[k].alias(c) for k, c in enumerate(STAGE_COLS)))


@query("m9_pca")
def m9(regions, inserts, samples):
    return mv.pca(written(wide(regions, inserts, samples), "wide"), STAGE_COLS, 2).select("name", F.round(F.col("pc")[0], 4).alias("pc1"), F.round(F.col("pc")[1], 4).alias("pc2"))


GRAM_SQL = "WITH x AS (SELECT sample, chrom, start0 // 1000 AS b, CAST(COUNT(*) AS DOUBLE) AS x FROM f_inserts GROUP BY 1, 2, 3), s AS (SELECT DISTINCT sample FROM x), f AS (SELECT DISTINCT chrom, b FROM x), d AS (SELECT f.chrom, f.b, s.sample, COALESCE(x.x, 0) AS x FROM f CROSS JOIN s LEFT JOIN x ON x.chrom = f.chrom AND x.b = f.b AND x.sample = s.sample), c AS (SELECT chrom, b, sample, x - AVG(x) OVER (PARTITION BY chrom, b) AS x FROM d) SELECT p.sample AS a, q.sample AS b, ROUND(SUM(p.x * q.x), 3) AS g FROM c p JOIN c q ON p.chrom = q.chrom AND p.b = q.b AND p.sample <= q.sample GROUP BY 1, 2"


def sample_bins(inserts):
    return inserts.groupBy("sample", "chrom", F.floor(F.col("start0") / 1000).alias("bin")).agg(F.count("*").alias("n"))


@query("m9_gram_matrix", GRAM_SQL)
def m9_gram(inserts):
    """What the samples' components are found from: products of their centred bins, which are never made dense."""
    return mv.gram(sample_bins(inserts), "sample", ["chrom", "bin"], "n").withColumn("g", F.round("g", 3))


@query("m9_sample_pca")
def m9_samples(inserts):
    """No SQL: eigenvectors of the matrix above; tests/test_models.py holds them against NumPy."""
    found = mv.sample_pca(sample_bins(inserts), "sample", ["chrom", "bin"], "n", 2)
    return found.select("sample", *(F.round(F.col("pc")[k], 3).alias(f"pc{k + 1}") for k in range(2)), *(F.round(F.col("share")[k], 5).alias(f"share{k + 1}") for k in range(2)))


@query("m10_kmeans")
def m10(regions, inserts, samples):
    """Sizes and mean first stage of the clusters with the least inertia of three starts."""
    rows, _ = mv.kmeans(written(wide(regions, inserts, samples), "wide"), STAGE_COLS, k=4, starts=3, rounds=50)
    return rows.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg("s1"), 3).alias("s1"))


@query("m10_kmeans_by_stage")
def m10_by(regions, inserts, samples):
    """Each region with the others of its strongest stage; sizes of the 20 clusters with the least inertia of ten starts, in two scalings."""
    own = wide(regions, inserts, samples)
    top = F.array_max(F.array(*STAGE_COLS))
    indexed = own.withColumn("index_stage", F.when(top > 0, F.array_position(F.array(*STAGE_COLS), top)))
    indexed = written(indexed, "indexed")
    told = mv.clusters_by(indexed, "index_stage", STAGE_COLS, {"unscaled": False, "scaled": True})
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("scaling"), F.col(c).alias("cluster")) for c in ("unscaled", "scaled"))))
    return told.select("index_stage", each.alias("_e")).groupBy("_e.scaling", "index_stage", "_e.cluster").agg(F.count("*").alias("n"))


BOOT = 1000
M13_SQL = f"WITH o AS (SELECT chrom, CAST(end1 - start0 AS DOUBLE) AS v, ROW_NUMBER() OVER (PARTITION BY chrom ORDER BY (CAST(SUBSTR(name, 2) AS BIGINT) * 2654435761 + 11) % 4294967296, CAST(SUBSTR(name, 2) AS BIGINT)) AS k FROM f_regions), s AS (SELECT chrom, v, k, COUNT(*) OVER (PARTITION BY chrom) AS n FROM o WHERE k <= {BOOT}), d AS (SELECT g.chrom, r.r AS r, {mixed_sql('r.r', 'j.j')} % g.n + 1 AS k FROM (SELECT DISTINCT chrom, n FROM s) g, range(0, {BOOT}) AS r(r), range(0, {BOOT}) AS j(j) WHERE j.j < g.n), m AS (SELECT d.chrom, d.r, MEDIAN(s.v) AS m FROM d JOIN s ON s.chrom = d.chrom AND s.k = d.k GROUP BY 1, 2), q AS (SELECT chrom, QUANTILE_CONT(m, 0.025) AS low, QUANTILE_CONT(m, 0.975) AS high FROM m GROUP BY 1) SELECT s.chrom, CAST(COUNT(*) AS INTEGER) AS n, MEDIAN(s.v) AS median, ROUND(MAX(q.low), 4) AS low, ROUND(MAX(q.high), 4) AS high FROM s JOIN q ON q.chrom = s.chrom GROUP BY 1"


@query("m13_bootstrap_median_ci", M13_SQL)
def m13(regions):
    own = regions.select("chrom", (F.col("end1") - F.col("start0")).alias("v"), F.substring("name", 2, 20).cast("long").alias("id"))
    ci = rs.bootstrap_median_ci(own, "chrom", "v", "id", sample=BOOT, replicates=BOOT)
    return ci.select("chrom", "n", "median", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


def brown(regions):
    """The tests are the sets of regions, their correlation the share that two sets' counts have in common."""
    n = regions.groupBy("peak_set").agg(F.count("*").alias("n"))
    p = n.select(((F.col("n") % 97 + 1) / 98.0).alias("p"))
    other = n.select(F.col("peak_set").alias("b"), F.col("n").alias("m"))
    rho = n.join(other, F.col("peak_set") < F.col("b")).select((F.least("n", "m") / F.greatest("n", "m") / 2).alias("rho"))
    return rs.brown_combined(p, rho)


@query("m16_brown_combined")
def m16(regions):
    """No SQL for the chi-squared tail."""
    return brown(regions).select(*(F.round(c, 6).alias(c) for c in ("statistic", "scale", "df", "p")))


BROWN_SQL = "WITH n AS (SELECT peak_set, COUNT(*) AS n FROM f_regions GROUP BY 1), x AS (SELECT SUM(-2 * LN((n % 97 + 1) / 98.0)) AS x, COUNT(*) AS k FROM n), r AS (SELECT LEAST(a.n, b.n) / GREATEST(a.n, b.n) / 2 AS rho FROM n a JOIN n b ON a.peak_set < b.peak_set), v AS (SELECT 4.0 * (SELECT k FROM x) + 2 * SUM(3.263 * rho + 0.710 * rho * rho + 0.027 * rho * rho * rho) AS v FROM r) SELECT ROUND(x.x, 6) AS statistic, ROUND(v.v / (4 * x.k), 6) AS scale, ROUND(8.0 * x.k * x.k / v.v, 6) AS df FROM x, v"


@query("m16_brown_parts", BROWN_SQL)
def m16_parts(regions):
    """What the tail is taken of: the statistic, its scale and degrees of freedom."""
    return brown(regions).select(*(F.round(c, 6).alias(c) for c in ("statistic", "scale", "df")))


PERMUTED = 9_999
M18_SQL = f"WITH o AS (SELECT strand = '+' AS a, CAST(end1 - start0 AS DOUBLE) AS v, CAST(SUBSTR(name, 2) AS BIGINT) AS k FROM f_genes), t AS (SELECT COUNT(*) FILTER (WHERE a) AS na, MEDIAN(v) FILTER (WHERE a) - MEDIAN(v) FILTER (WHERE NOT a) AS diff FROM o), r AS (SELECT r.r AS r, o.v, ROW_NUMBER() OVER (PARTITION BY r.r ORDER BY {mixed_sql('r.r', 'o.k')}, o.k) AS place FROM o, range(1, {PERMUTED + 1}) AS r(r)), d AS (SELECT r.r, MEDIAN(r.v) FILTER (WHERE place <= na) - MEDIAN(r.v) FILTER (WHERE place > na) AS d FROM r, t GROUP BY 1) SELECT MAX(t.diff) AS diff, ROUND(LEAST(1.0, 2 * (1 + LEAST(COUNT(*) FILTER (WHERE d >= diff), COUNT(*) FILTER (WHERE d <= diff))) / {PERMUTED + 1}), 6) AS p FROM d, t"


def stranded(genes):
    return genes.select((F.col("strand") == "+").alias("a"), (F.col("end1") - F.col("start0")).alias("v"), F.substring("name", 2, 20).cast("long").alias("k"))


@query("m18_permutation_median_diff", M18_SQL)
def m18(genes):
    return rs.permutation_median_diff(stranded(genes), "a", "v", "k", replicates=PERMUTED).withColumn("p", F.round("p", 6))


@query("m18_permutation_all")
def m18_all(genes):
    """All 99,999 relabellings; without SQL, which would sort the genes as often. The query above is the same with fewer."""
    return rs.permutation_median_diff(stranded(genes), "a", "v", "k").withColumn("p", F.round("p", 6))


def quantile_sql(p: str) -> str:
    """The rational approximation as SQL over the column p."""
    poly = lambda cs, x: "".join("(" for _ in cs[1:]) + str(cs[0]) + "".join(f"*{x}+{c})" for c in cs[1:])
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
    q, r = f"({p}-0.5)", f"(({p}-0.5)*({p}-0.5))"
    tail = lambda t: f"{poly(c, f'SQRT(-2*LN({t}))')}/{poly(d, f'SQRT(-2*LN({t}))')}"
    return f"CASE WHEN {p}<=0 OR {p}>=1 THEN NULL WHEN {p}<0.02425 THEN {tail(p)} WHEN {p}>0.97575 THEN -({tail(f'(1-{p})')}) ELSE {poly(a, r)}*{q}/{poly(b, r)} END"


@query("m19_qq_points", f"WITH c AS (SELECT peak_set, end1 - start0 AS size, COUNT(*) AS n FROM f_regions GROUP BY 1, 2), p AS (SELECT *, CAST((SUM(n) OVER (PARTITION BY peak_set ORDER BY size) - n / 2) / SUM(n) OVER (PARTITION BY peak_set) AS DOUBLE) AS p FROM c) SELECT peak_set, size, n, ROUND({quantile_sql('p')}, 6) AS expected FROM p")
def m19(regions):
    own = regions.select("peak_set", (F.col("end1") - F.col("start0")).alias("size"))
    return rs.qq_points(own, "peak_set", "size").withColumn("expected", F.round("expected", 6))


@query("u1_scores_by_name", f"WITH {DENSE_SQL}, t AS (SELECT sample, SUM(n_obs) AS t FROM d GROUP BY 1), v AS (SELECT 'cpm' AS score, d.chrom, d.start0, d.n_obs * 1e6 / t.t AS value FROM d JOIN t ON t.sample = d.sample UNION ALL SELECT 'mean_weight', chrom, start0, CASE WHEN n_obs > 0 THEN CAST(n_wgt AS DOUBLE) / n_obs ELSE 0 END FROM d), a AS (SELECT score, 'avg' AS agg, chrom, start0, AVG(value) AS value FROM v GROUP BY ALL UNION ALL SELECT score, 'sum', chrom, start0, SUM(value) FROM v GROUP BY ALL) SELECT score, agg, chrom, start0, ROUND(CASE WHEN score = 'cpm' THEN LOG10(GREATEST(value, 0.001)) ELSE value END, 5) AS value FROM a")
def u1(inserts, bins):
    """Each registered score, by its name, under both row aggregators."""
    counts, out = dense(inserts, bins), None
    for name in sorted(score_types.TYPES):
        for agg in ("avg", "sum"):
            own = score_types.aggregated(counts, name, agg).select(F.lit(name).alias("score"), F.lit(agg).alias("agg"), "chrom", "start0", F.round("value", 5).alias("value"))
            out = own if out is None else out.unionByName(own)
    return out
