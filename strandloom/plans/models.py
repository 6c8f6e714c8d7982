"""Queries of models, resampling and tests."""

from pyspark.sql import functions as F

from ..operators import chains, models, viterbi
from .aggregates import DENSE_SQL, dense
from .registry import query


M6_SQL = f"WITH RECURSIVE {DENSE_SQL}, t AS (SELECT chrom, start0, SUM(n_obs) AS n FROM d GROUP BY 1, 2), l AS (SELECT AVG(n) AS lam, LN(0.999) AS st, LN(0.001) AS mv FROM t), e AS (SELECT chrom, start0, ROW_NUMBER() OVER (PARTITION BY chrom ORDER BY start0) AS i, n * LN(lam * 0.7) - lam * 0.7 AS a, n * LN(lam * 1.4) - lam * 1.4 AS b, st, mv FROM t, l), v AS (SELECT chrom, i, a AS s1, b AS s2, [1] AS p1, [2] AS p2 FROM e WHERE i = 1 UNION ALL SELECT e.chrom, e.i, GREATEST(s1 + st, s2 + mv) + a, GREATEST(s1 + mv, s2 + st) + b, list_append(CASE WHEN s1 + st >= s2 + mv THEN p1 ELSE p2 END, 1), list_append(CASE WHEN s1 + mv >= s2 + st THEN p1 ELSE p2 END, 2) FROM v JOIN e ON e.chrom = v.chrom AND e.i = v.i + 1), m AS (SELECT chrom, MAX(i) AS i FROM e GROUP BY 1) SELECT e.chrom, e.start0, CAST((CASE WHEN s1 >= s2 THEN p1 ELSE p2 END)[e.i] AS INTEGER) AS state FROM m JOIN v ON v.chrom = m.chrom AND v.i = m.i JOIN e ON e.chrom = m.chrom"


@query("m6_viterbi", M6_SQL)
def m6(inserts, bins):
    """Two states of insert density along each chromosome."""
    d = dense(inserts, bins).groupBy("chrom", "start0").agg(F.sum("n_obs").alias("n"))
    lam = d.agg(F.avg("n").alias("lam"))
    rate = lambda f: F.col("n") * F.log(F.col("lam") * f) - F.col("lam") * f
    rows = d.crossJoin(F.broadcast(lam)).select("chrom", "start0", F.array(rate(0.7), rate(1.4)).alias("emissions"))
    return viterbi.viterbi_by_key(rows, ["chrom"], "start0", 1e-3, states=2)


@query("m12_linear_fit", f"WITH {DENSE_SQL} SELECT sample, ROUND(REGR_SLOPE(n_wgt, n_obs), 6) AS slope, ROUND(REGR_INTERCEPT(n_wgt, n_obs), 6) AS intercept, ROUND(CORR(n_wgt, n_obs), 6) AS r FROM d GROUP BY 1")
def m12(inserts, bins):
    x, y = F.col("n_obs").cast("double"), F.col("n_wgt").cast("double")
    return dense(inserts, bins).groupBy("sample").agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.round(F.corr(y, x), 6).alias("r"))


@query("m15_bh_fdr", "WITH p AS (SELECT name, (start0 % 9973 + 1) / 9974.0 AS p FROM f_genes), r AS (SELECT name, p, RANK() OVER (ORDER BY p) + COUNT(*) OVER (PARTITION BY p) - 1 AS k, COUNT(*) OVER () AS n FROM p) SELECT name, ROUND(MIN(LEAST(1.0, p * n / k)) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING), 6) AS q FROM r")
def m15(genes):
    p = genes.select("name", ((F.col("start0") % 9973 + 1) / 9974.0).alias("p"))
    return models.bh_fdr(p, "p").select("name", F.round("q", 6).alias("q"))


@query("m17_ks_two_sample", "WITH v AS (SELECT end1 - start0 AS z, chrom = 'chr1' AS one FROM f_regions WHERE chrom IN ('chr1', 'chr2')), c AS (SELECT z, COUNT(*) FILTER (WHERE one) AS a, COUNT(*) FILTER (WHERE NOT one) AS b FROM v GROUP BY 1), s AS (SELECT z, SUM(a) OVER (ORDER BY z) / SUM(a) OVER () AS fa, SUM(b) OVER (ORDER BY z) / SUM(b) OVER () AS fb FROM c) SELECT ROUND(MAX(ABS(fa - fb)), 6) AS d, ARG_MIN(z, (-ROUND(ABS(fa - fb), 12), z)) AS location FROM s")
def m17(regions):
    own = regions.where("chrom IN ('chr1', 'chr2')").select((F.col("end1") - F.col("start0")).alias("z"), (F.col("chrom") == "chr1").alias("one"))
    return models.ks_two_sample(own, "z", "one").select(F.round("d", 6).alias("d"), "location")


@query("m20_poisson_expectation", f"WITH {DENSE_SQL}, h AS (SELECT sample, n_obs AS k, COUNT(*) AS n FROM d GROUP BY 1, 2), l AS (SELECT sample, SUM(k * n) / SUM(n) AS lam, SUM(n) AS t FROM h GROUP BY 1) SELECT h.sample, h.k, h.n, ROUND(l.t * EXP(h.k * LN(l.lam) - l.lam - LGAMMA(h.k + 1)), 5) AS expected FROM h JOIN l ON l.sample = h.sample")
def m20(inserts, bins):
    h = dense(inserts, bins).groupBy("sample", F.col("n_obs").alias("k")).agg(F.count("*").alias("n"))
    lam = h.groupBy("sample").agg((F.sum(F.col("k") * F.col("n")) / F.sum("n")).alias("lam"), F.sum("n").alias("t"))
    log_factorial = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("k"), F.lit(1)).cast("int")), F.lit(0.0), lambda s, x: s + F.log(x.cast("double")))
    pmf = F.exp(F.col("k") * F.log("lam") - F.col("lam") - log_factorial)
    return h.join(F.broadcast(lam), "sample").select("sample", "k", "n", F.round(F.col("t") * pmf, 5).alias("expected"))


def closer(inserts):
    """Inserts by sample with their starts twenty times closer together, so that masks of some 800 bases see many."""
    start = F.floor(F.col("start0") / 20)
    return inserts.select(F.col("sample").alias("stage"), "chrom", start.alias("start0"), (start + F.col("end1") - F.col("start0")).alias("end1"))


@query("m11_dinuc_chains")
def m11(inserts):
    """Without SQL: tests/test_chains.py holds the placements against a plain version."""
    return chains.dinuc_chains(closer(inserts))


@query("m11_chain_scores")
def m11_scores(inserts):
    own = closer(inserts)
    return chains.chain_scores(chains.dinuc_chains(own), own)


@query("m11_chain_groups")
def m11_groups(inserts):
    own = closer(inserts)
    return chains.chain_groups(chains.dinuc_chains(own), own)
