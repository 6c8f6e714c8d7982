"""Queries of aggregations and windows."""

from pyspark.sql import Window, functions as F

from ..operators import intervals as iv, profiles as pr, scalars as sc
from ..operators.quantiles import cut_points, interval_of, medians, quantiles
from ..operators.resampling import equal_sample
from ..operators.shared import sized_join, written
from .registry import query
from .scalars import COUNTS, LEVEL_SQL, stage_counts

def size():
    return F.col("end1") - F.col("start0")


GC = "CAST(start0 % 101 AS INTEGER)"


def dense(inserts, bins):
    n = inserts.groupBy("sample", "chrom", sc.bin_start(F.col("start0")).alias("start0")).agg(F.count("*").alias("n_obs"), F.sum("wgt").alias("n_wgt"))
    grid = bins.select("chrom", "start0").crossJoin(F.broadcast(inserts.select("sample").distinct()))
    return grid.join(n, ["sample", "chrom", "start0"], "left").fillna(0, ["n_obs", "n_wgt"])


DENSE_SQL = "n AS (SELECT sample, chrom, start0 // 1000 * 1000 AS start0, COUNT(*) AS n_obs, SUM(wgt) AS n_wgt FROM f_inserts GROUP BY 1, 2, 3), d AS (SELECT s.sample, b.chrom, b.start0, COALESCE(n.n_obs, 0) AS n_obs, COALESCE(n.n_wgt, 0) AS n_wgt FROM f_bins b CROSS JOIN (SELECT DISTINCT sample FROM f_inserts) s LEFT JOIN n ON n.sample = s.sample AND n.chrom = b.chrom AND n.start0 = b.start0)"


@query("g1_stage_funnel", "SELECT sample, a AS n1, b AS n2, c AS n3, d AS n4, ROUND(b / a, 3) AS f2, ROUND(c / b, 3) AS f3, ROUND(d / c, 3) AS f4 FROM (SELECT sample, COUNT(*) AS a, COUNT(*) FILTER (WHERE start0 % 10 <> 0) AS b, COUNT(*) FILTER (WHERE start0 % 10 <> 0 AND end1 % 7 <> 0) AS c, COUNT(*) FILTER (WHERE start0 % 10 <> 0 AND end1 % 7 <> 0 AND genome = 'prm') AS d FROM f_inserts GROUP BY 1)")
def g1(inserts):
    one, two, three = F.col("start0") % 10 != 0, F.col("end1") % 7 != 0, F.col("genome") == "prm"
    per = inserts.groupBy("sample").agg(F.count("*").alias("n1"), F.count_if(one).alias("n2"), F.count_if(one & two).alias("n3"), F.count_if(one & two & three).alias("n4"))
    return per.select("*", *(F.round(F.col(f"n{k}") / F.col(f"n{k - 1}"), 3).alias(f"f{k}") for k in (2, 3, 4)))


@query("g2_bin_counts", f"WITH {DENSE_SQL} SELECT sample, chrom, start0, n_obs, ROUND(n_wgt, 4) AS n_wgt FROM d")
def g2(inserts, bins):
    return dense(inserts, bins).withColumn("n_wgt", F.round("n_wgt", 4))


@query("g3_isl_distribution", f"SELECT sample, genome, isl, ROUND(n / SUM(n) OVER (PARTITION BY sample, genome), 6) AS share FROM (SELECT sample, genome, CAST({LEVEL_SQL} AS INTEGER) AS isl, COUNT(*) AS n FROM f_inserts GROUP BY 1, 2, 3)")
def g3(inserts):
    n = inserts.groupBy("sample", "genome", sc.insert_size_level(size()).alias("isl")).agg(F.count("*").alias("n"))
    return n.select("sample", "genome", "isl", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("sample", "genome")), 6).alias("share"))


@query("g4_size_by_gc_histogram", f"SELECT sample, genome, end1 - start0 AS insert_size, {GC} AS gc_pct, COUNT(*) AS n, ROUND(SUM(wgt), 4) AS w FROM f_inserts GROUP BY 1, 2, 3, 4")
def g4(inserts):
    return inserts.groupBy("sample", "genome", size().alias("insert_size"), (F.col("start0") % 101).cast("int").alias("gc_pct")).agg(F.count("*").alias("n"), F.round(F.sum("wgt"), 4).alias("w"))


MERS_SQL = "SELECT lang, nonamer, COUNT(*) AS n FROM (SELECT lang, SUBSTR(c, p, 3) || SUBSTR(c, p + 5, 3) || SUBSTR(c, p + 10, 3) AS nonamer FROM (SELECT lang, c, UNNEST(range(1, LENGTH(c) - 11)) AS p FROM (SELECT lang, SUBSTR(seq, o + 1, 212) AS c FROM (SELECT lang, seq, UNNEST(range(0, LENGTH(seq) - 12, 200)) AS o FROM f_seq)))) WHERE regexp_full_match(nonamer, '[ACGT]{9}') GROUP BY 1, 2"
MERS = f"k AS ({MERS_SQL})"


def mers(seq):
    return sc.kmer_counts(seq, by=["lang"])


@query("g6_kmer_genome_counts", f"WITH {MERS} SELECT lang, nonamer, n FROM k")
def g6(seq):
    return mers(seq)


@query("g7_kmer_frequencies", f"WITH {MERS} SELECT lang, nonamer, ROUND(n / SUM(n) OVER (PARTITION BY lang), 9) AS f FROM k")
def g7(seq):
    return mers(seq).select("lang", "nonamer", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("lang")), 9).alias("f"))


@query("g8_kmer_weighted_freq", f"WITH {MERS}, f AS (SELECT lang, nonamer, n / SUM(n) OVER (PARTITION BY lang) AS f, SUM(n) OVER (PARTITION BY lang) AS w FROM k), t AS (SELECT SUM(w) AS w FROM (SELECT DISTINCT lang, w FROM f)) SELECT nonamer, ROUND(SUM(f.f * f.w) / MAX(t.w), 9) AS f FROM f, t GROUP BY 1")
def g8(seq):
    f = mers(seq).withColumn("w", F.sum("n").over(Window.partitionBy("lang"))).withColumn("f", F.col("n") / F.col("w"))
    total = f.select("lang", "w").distinct().agg(F.sum("w").alias("t"))
    return f.crossJoin(F.broadcast(total)).groupBy("nonamer").agg(F.round(F.sum(F.col("f") * F.col("w")) / F.max("t"), 9).alias("f"))


@query("g9_kmer_enrichment", f"WITH {MERS}, f AS (SELECT lang, nonamer, n / SUM(n) OVER (PARTITION BY lang) AS f FROM k) SELECT a.nonamer, ROUND(LOG10(a.f) - LOG10(b.f), 6) AS m, ROUND((LOG10(a.f) + LOG10(b.f)) / 2, 6) AS a, (LENGTH(a.nonamer) - LENGTH(REPLACE(a.nonamer, 'CG', ''))) // 2 + (LENGTH(a.nonamer) - LENGTH(REPLACE(a.nonamer, 'GC', ''))) // 2 >= 2 AS rich FROM f a JOIN f b ON a.nonamer = b.nonamer AND a.lang = 'en' AND b.lang = 'fr'")
def g9(seq):
    f = mers(seq).withColumn("f", F.log10(F.col("n") / F.sum("n").over(Window.partitionBy("lang"))))
    a, b = f.where("lang = 'en'").select("nonamer", F.col("f").alias("x")), f.where("lang = 'fr'").select("nonamer", F.col("f").alias("y"))
    rich = F.regexp_count("nonamer", F.lit("CG")) + F.regexp_count("nonamer", F.lit("GC")) >= 2
    return a.join(b, "nonamer").select("nonamer", F.round(F.col("x") - F.col("y"), 6).alias("m"), F.round((F.col("x") + F.col("y")) / 2, 6).alias("a"), rich.alias("rich"))


@query("g11_weight_histogram", "WITH h AS (SELECT sample, CAST(ROUND(LOG10(wgt) * 10) AS BIGINT) AS slot, COUNT(*) AS n FROM f_inserts GROUP BY 1, 2), q AS (SELECT sample, QUANTILE_CONT(CAST(ROUND(LOG10(wgt) * 10) AS DOUBLE) / 10, [0.01, 0.5, 0.99]) AS q FROM f_inserts GROUP BY 1) SELECT h.sample, h.slot, h.n, ROUND(q.q[1], 6) AS q01, ROUND(q.q[2], 6) AS q50, ROUND(q.q[3], 6) AS q99 FROM h JOIN q ON q.sample = h.sample")
def g11(inserts):
    """The quantiles are those of the histogram with each slot repeated by its count."""
    h = inserts.groupBy("sample", F.round(F.log10("wgt") * 10).cast("long").alias("slot")).agg(F.count("*").alias("n"))
    q = quantiles(h, ["sample"], F.col("slot") / 10, {"q01": 0.01, "q50": 0.5, "q99": 0.99}, F.col("n"))
    return h.join(q, "sample").select("sample", "slot", "n", *(F.round(c, 6).alias(c) for c in ("q01", "q50", "q99")))


LEVEL_ROWS = ", ".join(f"({x})" for x in sc.LEVELS)


@query("g12_bin_mappability_gc", f"WITH r AS (SELECT *, list_extract([{', '.join(map(str, sc.LEVELS))}], CAST(end1 % {len(sc.LEVELS)} + 1 AS INTEGER)) AS isl FROM f_regions), g AS (SELECT b.chrom, b.start0, b.end1, CAST(l.isl AS INTEGER) AS isl FROM f_bins b CROSS JOIN (VALUES {LEVEL_ROWS}) AS l(isl)) SELECT g.chrom, g.start0, g.isl, ROUND(COALESCE(SUM(CASE WHEN r.start0 IS NOT NULL THEN LEAST(g.end1, r.end1) - GREATEST(g.start0, r.start0) END), 0) / 1000, 4) AS map, ROUND(COALESCE(SUM((LEAST(g.end1, r.end1) - GREATEST(g.start0, r.start0)) * (r.start0 % 100)) / SUM(LEAST(g.end1, r.end1) - GREATEST(g.start0, r.start0)), 0), 4) AS gc FROM g LEFT JOIN r ON g.chrom = r.chrom AND g.isl = r.isl AND g.start0 < r.end1 AND r.start0 < g.end1 GROUP BY 1, 2, 3")
def g12(bins, regions):
    """Every bin at each of the size levels; a region is mappable at the level that its end picks."""
    levels = F.array(*map(F.lit, sc.LEVELS))
    leveled = regions.select("chrom", "start0", "end1", F.element_at(levels, (F.col("end1") % len(sc.LEVELS) + 1).cast("int")).alias("isl"))
    bp = F.sum("overlap_bp")
    per = iv.overlap_pairs(bins, leveled).groupBy("chrom", "start0", F.col("b_isl").alias("isl")).agg(F.round(bp / 1000, 4).alias("map"), F.round(F.sum(F.col("overlap_bp") * (F.col("b_start0") % 100)) / bp, 4).alias("gc"))
    grid = bins.select("chrom", "start0", F.explode(levels).alias("isl"))
    return grid.join(per, ["chrom", "start0", "isl"], "left").fillna(0.0, ["map", "gc"])


@query("g13_rounded_value_histogram", "SELECT slot, COUNT(*) FILTER (WHERE isl = 35) AS isl_35, COUNT(*) FILTER (WHERE isl = 40) AS isl_40 FROM (SELECT 35 AS isl, FLOOR((n % 97 / 97.0) * 20 + 0.5) / 20 AS slot FROM f_track UNION ALL SELECT 40, FLOOR((bp % 89 / 89.0) * 20 + 0.5) / 20 FROM f_track) GROUP BY 1")
def g13(track):
    slot = lambda c, m: F.floor((F.col(c) % m / float(m)) * 20 + 0.5) / 20
    both = track.select(F.explode(F.array(F.struct(F.lit(35).alias("isl"), slot("n", 97).alias("slot")), F.struct(F.lit(40).alias("isl"), slot("bp", 89).alias("slot")))).alias("s")).select("s.*")
    return both.groupBy("slot").agg(F.count_if(F.col("isl") == 35).alias("isl_35"), F.count_if(F.col("isl") == 40).alias("isl_40"))


@query("g14_cpm_rpkm", f"WITH {DENSE_SQL} SELECT sample, chrom, start0, ROUND(n_obs * 1e6 / SUM(n_obs) OVER (PARTITION BY sample), 6) AS cpm, ROUND(n_obs * 1e6 / SUM(n_obs) OVER (PARTITION BY sample) / 2, 6) AS rpkm FROM d")
def g14(inserts, bins):
    d = dense(inserts, bins)
    # Each insert lies in one bin of the grid; the total is joined, so that no window gathers a sample in one task.
    total = inserts.groupBy("sample").agg(F.count("*").alias("t"))
    cpm = F.col("n_obs") * 1e6 / F.col("t")
    # Two ends make one insert, and a bin is one kilobase.
    return d.join(F.broadcast(total), "sample").select("sample", "chrom", "start0", F.round(cpm, 6).alias("cpm"), F.round(cpm / 2, 6).alias("rpkm"))


@query("g15_tss_rpkm", "WITH i AS (SELECT chrom, start0, end1, CASE WHEN start0 % 2 = 0 THEN '+' ELSE '-' END AS strand FROM f_inserts), w AS (SELECT name, chrom, strand, side, CASE WHEN (strand = '+') = (side = 'up') THEN p - 1000 ELSE p END AS start0, CASE WHEN (strand = '+') = (side = 'up') THEN p ELSE p + 1000 END AS end1 FROM (SELECT *, CASE WHEN strand = '+' THEN start0 ELSE end1 END AS p FROM f_genes) CROSS JOIN (VALUES ('up'), ('down')) AS s(side)), c AS (SELECT w.name, COUNT(*) FILTER (WHERE side = 'up') AS up, COUNT(*) FILTER (WHERE side = 'down') AS down FROM w JOIN i ON i.chrom = w.chrom AND i.strand = w.strand AND i.start0 < w.end1 AND w.start0 < i.end1 GROUP BY 1), t AS (SELECT COUNT(*) AS t FROM f_inserts) SELECT name, up, down, ROUND(up * 1e6 / t, 6) AS up_rpkm, ROUND(down * 1e6 / t, 6) AS down_rpkm, ROUND((down - up) * 1e6 / t, 6) AS difference, CASE WHEN up = 0 THEN CAST('inf' AS DOUBLE) ELSE ROUND(down / up, 6) END AS fold FROM c, t")
def g15(genes, inserts):
    """Inserts of the gene's strand in one kilobase on either side; genes without any are left out."""
    own = inserts.select("chrom", "start0", "end1", F.when(F.col("start0") % 2 == 0, "+").otherwise("-").alias("strand"))
    windows = iv.overlap_count(iv.tss_flanks(genes), own, keys=("chrom", "strand"))
    of = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0))
    c = windows.groupBy("name").agg(of("up").alias("up"), of("down").alias("down")).where("up + down > 0")
    rpkm = lambda n: F.round(n * 1e6 / F.col("t"), 6)
    up, down = F.col("up"), F.col("down")
    scaled = c.crossJoin(F.broadcast(own.agg(F.count("*").alias("t"))))
    return scaled.select("name", "up", "down", rpkm(up).alias("up_rpkm"), rpkm(down).alias("down_rpkm"), rpkm(down - up).alias("difference"), F.round(sc.divided(down.cast("double"), up.cast("double")), 6).alias("fold"))


@query("g16_fold_from_mean", f"WITH {COUNTS} SELECT name, stage, ROUND(LOG2(n / AVG(n) OVER (PARTITION BY name)), 6) AS fold FROM c")
def g16(regions, inserts, samples):
    c = stage_counts(regions, inserts, samples)
    return c.select("name", "stage", F.round(F.log2(F.col("n") / F.avg("n").over(Window.partitionBy("name"))), 6).alias("fold"))


@query("g17_score_distribution", f"WITH {DENSE_SQL}, e AS (SELECT sample, n_obs FROM d WHERE chrom <> 'chrX'), h AS (SELECT sample, CAST(ROUND(n_obs / 5) * 5 AS BIGINT) AS x, COUNT(*) AS k FROM e GROUP BY 1, 2), p AS (SELECT sample, x AS peak_x FROM h QUALIFY ROW_NUMBER() OVER (PARTITION BY sample ORDER BY k DESC, x) = 1), m AS (SELECT sample, CAST(MEDIAN(n_obs) AS DOUBLE) AS median, ROUND(AVG(n_obs), 6) AS mean, ROUND(STDDEV_SAMP(n_obs), 6) AS sd FROM e GROUP BY 1) SELECT h.sample, h.x, ROUND(h.k / SUM(h.k) OVER (PARTITION BY h.sample), 6) AS share, p.peak_x, m.median, m.mean, m.sd FROM h JOIN p ON p.sample = h.sample JOIN m ON m.sample = h.sample")
def g17(inserts, bins):
    """Of the bins outside of chrX: the histogram in units of 5, and the sample's peak and moments in each of its rows."""
    values = dense(inserts, bins).where("chrom <> 'chrX'").groupBy("sample", "n_obs").agg(F.count("*").alias("c"))
    h = values.groupBy("sample", (F.round(F.col("n_obs") / 5) * 5).cast("long").alias("x")).agg(F.sum("c").alias("k"))
    peak = h.groupBy("sample").agg(F.max_by("x", F.struct("k", (-F.col("x")).alias("m"))).alias("peak_x"), F.sum("k").alias("t"))
    n, s1, s2 = F.sum("c"), F.sum(F.col("c") * F.col("n_obs")), F.sum(F.col("c") * F.col("n_obs") * F.col("n_obs"))
    moments = values.groupBy("sample").agg(F.round(s1 / n, 6).alias("mean"), F.round(F.sqrt((n * s2 - s1 * s1) / (n * (n - 1))), 6).alias("sd"))
    moments = moments.join(medians(values, ["sample"], F.col("n_obs"), weight=F.col("c")), "sample")
    return h.join(peak, "sample").join(moments, "sample").select("sample", "x", F.round(F.col("k") / F.col("t"), 6).alias("share"), "peak_x", "median", "mean", "sd")


@query("g18_aggregate_series", f"WITH {DENSE_SQL} SELECT s.stage_type, d.chrom, d.start0, ROUND(AVG(d.n_obs), 6) AS mean, CAST(SUM(d.n_obs) AS BIGINT) AS total FROM d JOIN f_samples s ON s.sample = d.sample WHERE s.stage_type IS NOT NULL GROUP BY 1, 2, 3")
def g18(inserts, bins, samples):
    d = dense(inserts, bins).join(F.broadcast(samples.where("stage_type IS NOT NULL").select("sample", "stage_type")), "sample")
    return d.groupBy("stage_type", "chrom", "start0").agg(F.round(F.avg("n_obs"), 6).alias("mean"), F.sum("n_obs").alias("total"))


@query("g19_stage_delta", f"WITH {DENSE_SQL} SELECT d.chrom, d.start0, ROUND(AVG(d.n_obs) FILTER (WHERE s.stage_type = 'round') - AVG(d.n_obs) FILTER (WHERE s.stage_type = 'elong'), 6) AS delta FROM d JOIN f_samples s ON s.sample = d.sample GROUP BY 1, 2")
def g19(inserts, bins, samples):
    d = dense(inserts, bins).join(F.broadcast(samples.select("sample", "stage_type")), "sample")
    mean = lambda t: F.avg(F.when(F.col("stage_type") == t, F.col("n_obs")))
    return d.groupBy("chrom", "start0").agg(F.round(mean("round") - mean("elong"), 6).alias("delta"))


EMIT = f"e AS (SELECT stage, isl, LN(GREATEST(f, 1e-5) / SUM(GREATEST(f, 1e-5)) OVER (PARTITION BY stage)) AS ll FROM (SELECT stage, isl, n / SUM(n) OVER (PARTITION BY stage) AS f FROM (SELECT s.stage, CAST({LEVEL_SQL} AS INTEGER) AS isl, COUNT(*) AS n FROM f_inserts i JOIN f_samples s ON s.sample = i.sample GROUP BY 1, 2)))"


def emissions(inserts, samples):
    n = inserts.join(F.broadcast(samples.select("sample", "stage")), "sample").groupBy("stage", sc.insert_size_level(size()).alias("isl")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("stage")
    f = n.withColumn("f", F.greatest(F.col("n") / F.sum("n").over(w), F.lit(1e-5)))
    return f.select("stage", "isl", F.log(F.col("f") / F.sum("f").over(w)).alias("ll"))


@query("g20_state_emissions", f"WITH {EMIT} SELECT stage, isl, ROUND(ll, 6) AS ll FROM e")
def g20(inserts, samples):
    return emissions(inserts, samples).withColumn("ll", F.round("ll", 6))


@query("g21_nrll", f"WITH {EMIT}, p AS (SELECT a.isl, a.ll - b.ll AS d FROM e a JOIN e b ON a.isl = b.isl AND a.stage = 'late_ES' AND b.stage = 'early_RS') SELECT b.chrom, b.start0, ROUND(AVG(p.d), 5) AS nrll FROM f_bins b LEFT JOIN (SELECT chrom, start0 // 1000 * 1000 AS bs0, CAST({LEVEL_SQL} AS INTEGER) AS isl FROM f_inserts) i ON i.chrom = b.chrom AND i.bs0 = b.start0 LEFT JOIN p ON p.isl = i.isl GROUP BY 1, 2")
def g21(inserts, samples, bins):
    e = emissions(inserts, samples)
    p = e.where("stage = 'late_ES'").select("isl", F.col("ll").alias("x")).join(e.where("stage = 'early_RS'").select("isl", F.col("ll").alias("y")), "isl").select("isl", (F.col("x") - F.col("y")).alias("d"))
    per = inserts.select("chrom", sc.bin_start(F.col("start0")).alias("start0"), sc.insert_size_level(size()).alias("isl")).join(F.broadcast(p), "isl", "left").groupBy("chrom", "start0").agg(F.round(F.avg("d"), 5).alias("nrll"))
    return bins.select("chrom", "start0").join(per, ["chrom", "start0"], "left")


@query("g22_region_mean_log10", "SELECT name, CASE WHEN v < 0.001 THEN -3.0 ELSE CAST(TRUNC(LOG10(v) * 100 + 0.5) AS BIGINT) / 100 END AS v FROM (SELECT g.name, AVG(b.start0 // 1000 % 17 / 16.0) AS v FROM f_genes g JOIN f_bins b ON g.chrom = b.chrom AND g.start0 < b.end1 AND b.start0 < g.end1 GROUP BY 1)")
def g22(genes, bins):
    signal = bins.withColumn("v", F.floor(F.col("start0") / 1000) % 17 / 16.0)
    per = iv.overlap_pairs(genes, signal).groupBy("name").agg(F.avg("b_v").alias("v"))
    return per.select("name", sc.floored_log10(F.col("v")).alias("v"))


@query("g23_weighted_median_index", f"WITH {COUNTS}, r AS (SELECT name, k, n, SUM(n) OVER (PARTITION BY name ORDER BY k) AS cum, SUM(n) OVER (PARTITION BY name) AS t FROM c), h AS (SELECT name, k, n, (cum - n / 2) / t AS q FROM r), b AS (SELECT name, MAX(k) FILTER (WHERE q <= 0.5) AS k0, MAX(q) FILTER (WHERE q <= 0.5) AS q0, MIN(k) FILTER (WHERE q > 0.5) AS k1, MIN(q) FILTER (WHERE q > 0.5) AS q1, FIRST(k ORDER BY n DESC, k) AS top FROM h GROUP BY 1) SELECT name, ROUND(CASE WHEN k0 IS NULL THEN k1 WHEN k1 IS NULL THEN k0 ELSE k0 + (k1 - k0) * (0.5 - q0) / (q1 - q0) END, 6) AS idx, CAST(ROUND(CASE WHEN k0 IS NULL THEN k1 WHEN k1 IS NULL THEN k0 ELSE k0 + (k1 - k0) * (0.5 - q0) / (q1 - q0) END) AS INTEGER) AS nearest, top FROM b")
def g23(regions, inserts, samples):
    """The stage index at half of the signal, between the middles of the stages' shares of it; the stage nearest to it; the strongest."""
    c = stage_counts(regions, inserts, samples)
    w = Window.partitionBy("name")
    q = (F.sum("n").over(w.orderBy("k")) - F.col("n") / 2) / F.sum("n").over(w)
    low, high = F.col("q") <= 0.5, F.col("q") > 0.5
    b = c.withColumn("q", q).groupBy("name").agg(F.max(F.when(low, F.col("k"))).alias("k0"), F.max(F.when(low, F.col("q"))).alias("q0"), F.min(F.when(high, F.col("k"))).alias("k1"), F.min(F.when(high, F.col("q"))).alias("q1"), F.max_by("k", F.struct("n", (-F.col("k")).alias("m"))).alias("top"))
    between = F.col("k0") + (F.col("k1") - F.col("k0")) * (0.5 - F.col("q0")) / (F.col("q1") - F.col("q0"))
    idx = F.when(F.col("k0").isNull(), F.col("k1")).when(F.col("k1").isNull(), F.col("k0")).otherwise(between)
    return b.select("name", F.round(idx, 6).alias("idx"), F.round(idx).cast("int").alias("nearest"), "top")


@query("g24_centered_centroid", f"WITH {COUNTS}, m AS (SELECT name, k, n - AVG(n) OVER (PARTITION BY k) AS v FROM c) SELECT name, ROUND(SUM(k * GREATEST(v, 0)) / SUM(GREATEST(v, 0)), 6) AS centroid, MAX(v) - MIN(v) > 1 AS dynamic FROM m GROUP BY 1 HAVING SUM(GREATEST(v, 0)) > 0")
def g24(regions, inserts, samples):
    """Regions without a stage above its mean go; dynamic ones vary by more than 1 about the stages' means."""
    c = stage_counts(regions, inserts, samples)
    mean = c.groupBy("k").agg(F.avg("n").alias("m"))
    v = F.col("n") - F.col("m")
    up = F.greatest(v, F.lit(0.0))
    per = c.join(F.broadcast(mean), "k").groupBy("name").agg(F.sum(F.col("k") * up).alias("x"), F.sum(up).alias("w"), (F.max(v) - F.min(v) > 1).alias("dynamic")).where("w > 0")
    return per.select("name", F.round(F.col("x") / F.col("w"), 6).alias("centroid"), "dynamic")


@query("g27_cluster_overlap_fraction", "WITH h AS (SELECT a.peak_set, score, end1 - start0 AS z, EXISTS (SELECT 1 FROM f_genes b WHERE a.chrom = b.chrom AND a.start0 < b.end1 AND b.start0 < a.end1) AS hit FROM f_regions a), t AS (SELECT ROUND(AVG(CASE WHEN EXISTS (SELECT 1 FROM f_genes g WHERE g.chrom = b.chrom AND g.start0 < b.end1 AND b.start0 < g.end1) THEN 1.0 ELSE 0.0 END), 6) AS genome_fraction FROM f_bins b) SELECT peak_set, COUNT(*) AS n, ROUND(AVG(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS fraction, ROUND(AVG(score), 3) AS mean_score, CAST(MEDIAN(z) AS DOUBLE) AS median_size, MAX(genome_fraction) AS genome_fraction FROM h, t GROUP BY 1")
def g27(regions, genes, bins):
    """By set: the share of its regions that overlap a gene, beside the share of the genome's bins that do."""
    hit = lambda df: iv.overlap_count(df, genes).withColumn("hit", (F.col("n") > 0).cast("double"))
    genome = hit(bins).agg(F.round(F.avg("hit"), 6).alias("genome_fraction"))
    per = hit(regions).groupBy("peak_set").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("fraction"), F.round(F.avg("score"), 3).alias("mean_score"))
    return per.join(medians(regions, ["peak_set"], size(), "median_size"), "peak_set").crossJoin(F.broadcast(genome))


@query("g29_interval_max_score", "SELECT g.name, MAX(g.strand) AS cluster, MAX(CAST(r.score AS DOUBLE)) AS top, COUNT(r.name) > 0 AS hit FROM f_genes g LEFT JOIN f_regions r ON g.chrom = r.chrom AND g.start0 < r.end1 AND r.start0 < g.end1 GROUP BY 1")
def g29(genes, regions):
    top = iv.overlap_max(genes, regions, ["name"], {"top": F.col("score"), "_any": F.lit(0)})
    own = genes.groupBy("name").agg(F.max("strand").alias("cluster"))
    return own.join(top, "name", "left").select("name", "cluster", "top", F.col("_any").isNotNull().alias("hit"))


@query("g30_in_out_summary", f"WITH {DENSE_SQL}, h AS (SELECT b.chrom, b.start0, EXISTS (SELECT 1 FROM f_genes g WHERE g.chrom = b.chrom AND g.start0 < b.end1 AND b.start0 < g.end1) AS inside FROM f_bins b) SELECT d.sample, h.inside, COUNT(*) AS n, CAST(MEDIAN(d.n_obs) AS DOUBLE) AS median, ROUND(QUANTILE_CONT(d.n_obs, 0.9), 6) AS p90 FROM d JOIN h ON h.chrom = d.chrom AND h.start0 = d.start0 GROUP BY 1, 2")
def g30(inserts, bins, genes):
    flags = iv.overlap_count(bins, genes, name="k").select("chrom", "start0", (F.col("k") > 0).alias("inside"))
    by = ["sample", "inside"]
    counts = dense(inserts, bins).join(flags, ["chrom", "start0"]).groupBy(*by, "n_obs").agg(F.count("*").alias("c"))
    q = quantiles(counts, by, F.col("n_obs"), {"median": 0.5, "p90": 0.9}, F.col("c"))
    return counts.groupBy(*by).agg(F.sum("c").alias("n")).join(q, by).withColumn("p90", F.round("p90", 6))


LATER = (("s2", "2-HIGH"), ("s3", "3-MEDIUM"), ("s4", "5-LOW"))
LATER_SQL = ", ".join(f"EXISTS (SELECT 1 FROM f_regions b WHERE b.peak_set = '{other}' AND a.chrom = b.chrom AND a.start0 < b.end1 AND b.start0 < a.end1) AS {name}" for name, other in LATER)


@query("g32_presence_flows", f"SELECT s2, s3, s4, CASE WHEN s2 AND s3 AND s4 THEN 'kept' WHEN NOT s4 THEN 'lost' ELSE 'reappeared' END AS flow, COUNT(*) AS n FROM (SELECT {LATER_SQL} FROM f_regions a WHERE a.peak_set = '1-URGENT') GROUP BY 1, 2, 3, 4")
def g32(regions):
    """Kept: in all three later sets; lost: not in the last; reappeared: in the last after a set without it."""
    own = regions.where("peak_set = '1-URGENT'")
    for name, other in LATER:
        own = iv.overlap_count(own, regions.where(F.col("peak_set") == other), name=name).withColumn(name, F.col(name) > 0)
    flow = F.when(F.expr("s2 AND s3 AND s4"), "kept").when(~F.col("s4"), "lost").otherwise("reappeared")
    return own.groupBy("s2", "s3", "s4", flow.alias("flow")).agg(F.count("*").alias("n"))


@query("g34_spike_in_share", "WITH c AS (SELECT sample, COUNT(*) FILTER (WHERE genome = 'prm') AS primary_n, COUNT(*) FILTER (WHERE genome = 'spk') AS spike_n FROM f_inserts GROUP BY 1) SELECT c.sample, c.primary_n, c.spike_n, ROUND(c.spike_n / (c.primary_n + c.spike_n), 6) AS share, ROUND(c.spike_n / r.spike_n, 6) AS factor, ROUND(c.primary_n / (c.spike_n / r.spike_n), 3) AS scaled FROM c, (SELECT spike_n FROM c WHERE sample = 's1') r")
def g34(inserts):
    """factor: a sample's spike-in against that of s1; scaled: its primary inserts by that factor."""
    count = lambda g: F.count_if(F.col("genome") == g)
    c = inserts.groupBy("sample").agg(count("prm").alias("primary_n"), count("spk").alias("spike_n"))
    reference = c.where("sample = 's1'").select(F.col("spike_n").alias("r"))
    factor = F.col("spike_n") / F.col("r")
    return c.crossJoin(F.broadcast(reference)).select("sample", "primary_n", "spike_n", F.round(F.col("spike_n") / (F.col("primary_n") + F.col("spike_n")), 6).alias("share"), F.round(factor, 6).alias("factor"), F.round(F.col("primary_n") / factor, 3).alias("scaled"))


@query("g35_size_distribution", f"WITH i AS (SELECT sample, chrom, start0, end1, wgt, EXISTS (SELECT 1 FROM f_regions r WHERE r.chrom = i.chrom AND r.start0 < i.end1 AND i.start0 < r.end1) AS peak FROM f_inserts i) SELECT sample, peak, z, ROUND(n / SUM(n) OVER (PARTITION BY sample, peak), 6) AS share, ROUND(gc, 6) AS gc FROM (SELECT sample, peak, end1 - start0 AS z, COUNT(*) AS n, SUM(CAST(ROUND(wgt * 100) AS BIGINT) * {GC}) / SUM(CAST(ROUND(wgt * 100) AS BIGINT)) AS gc FROM i GROUP BY 1, 2, 3)")
def g35(inserts, regions):
    """Inserts in peaks and off them apart; weights in whole hundredths, so that sums do not depend on their order."""
    told = iv.overlap_count(inserts.select("sample", "chrom", "start0", "end1", "wgt"), regions.select("chrom", "start0", "end1"), name="k").withColumn("peak", F.col("k") > 0)
    w = F.round(F.col("wgt") * 100).cast("long")
    per = told.groupBy("sample", "peak", size().alias("z")).agg(F.count("*").alias("n"), (F.sum(w * (F.col("start0") % 101)) / F.sum(w)).alias("gc"))
    total = per.groupBy("sample", "peak").agg(F.sum("n").alias("t"))
    return per.join(total, ["sample", "peak"]).select("sample", "peak", "z", F.round(F.col("n") / F.col("t"), 6).alias("share"), F.round("gc", 6).alias("gc"))


@query("g35_gc_within_size", f"SELECT sample, z, gc, ROUND(n / SUM(n) OVER (PARTITION BY sample, z), 6) AS share FROM (SELECT sample, end1 - start0 AS z, {GC} AS gc, COUNT(*) AS n FROM f_inserts GROUP BY 1, 2, 3)")
def g35_gc(inserts):
    per = inserts.groupBy("sample", size().alias("z"), (F.col("start0") % 101).cast("int").alias("gc")).agg(F.count("*").alias("n"))
    return per.select("sample", "z", "gc", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("sample", "z")), 6).alias("share"))


@query("g37_v_plot_histogram", "SELECT CAST(FLOOR(FLOOR((i.start0 + i.end1) / 2.0 - (g.start0 + 500)) / 50) * 50 AS BIGINT) AS x, (i.end1 - i.start0) // 10 * 10 AS y, COUNT(*) AS n FROM f_inserts i JOIN (SELECT chrom, start0, start0 + 1000 AS end1 FROM f_genes) g ON i.chrom = g.chrom AND i.start0 < g.end1 AND g.start0 < i.end1 GROUP BY 1, 2")
def g37(inserts, genes):
    return pr.v_plot(inserts, genes.select("chrom", "start0"), []).select("x", "y", "n")


ANCHORED = "p AS (SELECT i.sample, i.stage_type, CAST(FLOOR(FLOOR((i.start0 + i.end1) / 2.0 - (g.start0 + 500)) / 50) * 50 AS BIGINT) AS x, (i.end1 - i.start0) // 10 * 10 AS y FROM e i JOIN (SELECT chrom, start0, start0 + 1000 AS end1 FROM f_genes) g ON i.chrom = g.chrom AND i.start0 < g.end1 AND g.start0 < i.end1)"
EQUAL_SQL = f"WITH o AS (SELECT i.*, s.stage_type, ROW_NUMBER() OVER (PARTITION BY i.sample ORDER BY ((i.start0 * 640 + i.end1 - i.start0) * 2654435761 + 11) % 4294967296, i.chrom, i.start0, i.end1) AS k FROM f_inserts i JOIN f_samples s ON s.sample = i.sample WHERE s.stage_type IS NOT NULL), e AS (SELECT * FROM o WHERE k <= (SELECT MIN(n) // 2 FROM (SELECT COUNT(*) AS n FROM o GROUP BY sample))), {ANCHORED}, h AS (SELECT stage_type, x, y, COUNT(*) AS n FROM p GROUP BY 1, 2, 3), t AS (SELECT stage_type, SUM(n) AS t FROM h GROUP BY 1), f AS (SELECT h.stage_type, x, y, n, n / t AS f FROM h JOIN t ON t.stage_type = h.stage_type) SELECT x, y, SUM(n) FILTER (WHERE stage_type = 'round') AS n_round, SUM(n) FILTER (WHERE stage_type = 'elong') AS n_elong, ROUND(COALESCE(SUM(f) FILTER (WHERE stage_type = 'elong'), 0) - COALESCE(SUM(f) FILTER (WHERE stage_type = 'round'), 0), 8) AS difference FROM f GROUP BY 1, 2"


@query("g37_v_plot_difference", EQUAL_SQL)
def g37_difference(inserts, genes, samples):
    """As many inserts of each sample, half of those of the smallest one, and the shares of one set of samples less those of the other."""
    own = sized_join(inserts, samples.where("stage_type IS NOT NULL").select("sample", "stage_type"), "sample").select("sample", "stage_type", "chrom", "start0", "end1")
    sizes = own.groupBy("sample").agg(F.count("*").alias("n"))
    n = sizes.agg(F.floor(F.min("n") / 2)).first()[0] or 0
    taken = equal_sample(own, ["sample"], n, sc.hash_order(F.col("start0") * 640 + size(), 11), ["chrom", "start0", "end1"])
    h = written(pr.v_plot(taken, genes.select("chrom", "start0"), ["stage_type"]), "v_plot")
    shares = sized_join(h, h.groupBy("stage_type").agg(F.sum("n").alias("t")), "stage_type").withColumn("f", F.col("n") / F.col("t"))
    of = lambda c, t: F.sum(F.when(F.col("stage_type") == t, F.col(c)))
    difference = F.coalesce(of("f", "elong"), F.lit(0.0)) - F.coalesce(of("f", "round"), F.lit(0.0))
    return shares.groupBy("x", "y").agg(of("n", "round").alias("n_round"), of("n", "elong").alias("n_elong"), F.round(difference, 8).alias("difference"))


@query("g40_positioned_median", "SELECT name, COUNT(*) AS n, CAST(MEDIAN(i.start0 - g.start0) AS DOUBLE) AS median FROM f_genes g JOIN f_inserts i ON i.chrom = g.chrom AND i.start0 < g.end1 AND g.start0 < i.end1 WHERE i.end1 - i.start0 <= 400 GROUP BY 1 HAVING COUNT(*) >= 25")
def g40(genes, inserts):
    own = inserts.where(size() <= 400).select("chrom", "start0", "end1")
    named = written(genes.groupBy("name").agg(F.count("*").alias("rows"), F.min(F.struct("chrom", "start0", "end1")).alias("g")), "named")
    one = iv.overlap_median(named.where("rows = 1").select("name", "g.*"), own).where("n >= 25").select("name", "n", "median")
    # Genes that share a name share a median: only they make pairs.
    again = sized_join(genes, named.where("rows > 1").select("name"), "name", "left_semi")
    pairs = iv.overlap_pairs(own, again)
    offsets = pairs.groupBy(F.col("b_name").alias("name"), (F.col("start0") - F.col("b_start0")).alias("at")).agg(F.count("*").alias("c"))
    n = offsets.groupBy("name").agg(F.sum("c").alias("n")).where("n >= 25")
    return one.unionByName(n.join(medians(offsets, ["name"], F.col("at"), weight=F.col("c")), "name"))


WINDOWS_SQL = "w AS (SELECT sample, chrom, start0 // 10000 * 10000 AS w, COUNT(*) AS n FROM f_inserts GROUP BY 1, 2, 3)"


def window_counts(inserts):
    return inserts.groupBy("sample", "chrom", sc.bin_start(F.col("start0"), 10000).alias("w")).agg(F.count("*").alias("n"))


@query("g42_multi_sample_window_counts", f"WITH {WINDOWS_SQL} SELECT sample, chrom, w, n FROM w")
def g42(inserts):
    return window_counts(inserts)


@query("g42_sample_correlation", f"WITH {WINDOWS_SQL}, t AS (SELECT COUNT(*) AS k FROM (SELECT DISTINCT chrom, w FROM w)), s AS (SELECT sample, SUM(n) AS s, SUM(n * n) AS ss FROM w GROUP BY 1), p AS (SELECT a.sample AS a, b.sample AS b, SUM(a.n * b.n) AS xy FROM w a JOIN w b ON a.chrom = b.chrom AND a.w = b.w AND a.sample < b.sample GROUP BY 1, 2) SELECT p.a, p.b, ROUND((k * xy - x.s * y.s) / SQRT(CAST(k * x.ss - x.s * x.s AS DOUBLE) * CAST(k * y.ss - y.s * y.s AS DOUBLE)), 6) AS r FROM p JOIN s x ON x.sample = p.a JOIN s y ON y.sample = p.b, t")
def g42_correlation(inserts):
    """Pearson's r of every two samples over the windows that any sample has; a window without a count is 0.

    The pairs of one window are those of its samples, not of its inserts; the sums are of whole numbers.
    """
    n = window_counts(inserts)
    k = n.select("chrom", "w").distinct().agg(F.count("*").alias("k"))
    s = n.groupBy("sample").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("ss"))
    own = lambda name: n.select("chrom", "w", F.col("sample").alias(name), F.col("n").alias(f"n_{name}"))
    pairs = own("a").join(own("b"), ["chrom", "w"]).where("a < b").groupBy("a", "b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("xy"))
    of = lambda name: s.select(F.col("sample").alias(name), F.col("s").alias(f"s_{name}"), F.col("ss").alias(f"ss_{name}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").crossJoin(F.broadcast(k))
    spread = lambda name: (F.col("k") * F.col(f"ss_{name}") - F.col(f"s_{name}") * F.col(f"s_{name}")).cast("double")
    return both.select("a", "b", F.round((F.col("k") * F.col("xy") - F.col("s_a") * F.col("s_b")) / F.sqrt(spread("a") * spread("b")), 6).alias("r"))


@query("g43_fractional_end_counts", "SELECT chrom, p // 1000 * 1000 AS bs0, COUNT(*) * 0.5::DOUBLE AS n FROM (SELECT chrom, start0 AS p FROM f_inserts UNION ALL SELECT chrom, end1 - 1 FROM f_inserts) GROUP BY 1, 2")
def g43(inserts):
    ends = inserts.select("chrom", F.explode(F.array(F.col("start0"), F.col("end1") - 1)).alias("p"))
    return ends.groupBy("chrom", sc.bin_start(F.col("p")).alias("bs0")).agg((F.count("*") * F.lit(0.5)).alias("n"))


@query("g44_chrom_correlation", "SELECT chrom, ROUND(CORR(x, y), 6) AS r FROM (SELECT chrom, n % 11 - 5 AS x, bp % 7 - 3 AS y FROM f_track) GROUP BY 1")
def g44(track):
    return track.groupBy("chrom").agg(F.round(F.corr((F.col("n") % 11 - 5).cast("double"), (F.col("bp") % 7 - 3).cast("double")), 6).alias("r"))


@query("g46_peak_counts_by_chrom", "SELECT c.chrom, COUNT(r.name) AS n FROM (SELECT DISTINCT chrom FROM f_bins UNION SELECT 'chr9') AS c(chrom) LEFT JOIN f_regions r ON r.chrom = c.chrom GROUP BY 1")
def g46(spark, bins, regions):
    """Every chromosome of the genome, and one without any peak."""
    grid = bins.select("chrom").distinct().union(spark.createDataFrame([("chr9",)], "chrom string"))
    return grid.join(regions.groupBy("chrom").agg(F.count("*").alias("n")), "chrom", "left").fillna(0, ["n"])


@query("g49_gc_fraction", "SELECT doc_id, ROUND((LENGTH(seq) - LENGTH(regexp_replace(seq, '[GCgc]', '', 'g'))) / LENGTH(seq), 4) AS gc FROM f_seq WHERE LENGTH(seq) > 0")
def g49(seq):
    return seq.where(F.length("seq") > 0).select("doc_id", sc.gc_fraction(F.col("seq")).alias("gc"))


@query("g53_group_mean_ci", "WITH g AS (SELECT chrom, peak_set, COUNT(*) AS n, COUNT(DISTINCT name) AS names, AVG(end1 - start0) AS mean, STDDEV_SAMP(end1 - start0) / SQRT(COUNT(*)) AS se, CORR(end1 - start0, score) AS r FROM f_regions WHERE peak_set <> '1-URGENT' GROUP BY 1, 2) SELECT chrom, peak_set, n, names, ROUND(mean, 6) AS mean, ROUND(se, 6) AS se, ROUND(mean - 1.96 * se, 5) AS lo, ROUND(mean + 1.96 * se, 5) AS hi, ROUND(r, 6) AS r, ROUND(r * r, 6) AS r2 FROM g")
def g53(regions):
    """By chromosome and set, without the baseline set: mean size with its bounds, distinct names, size against score."""
    own = regions.where("peak_set <> '1-URGENT'")
    g = own.groupBy("chrom", "peak_set").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"), F.avg(size()).alias("mean"), (F.stddev_samp(size()) / F.sqrt(F.count("*"))).alias("se"), F.corr(size().cast("double"), "score").alias("r"))
    mean, se, r = F.col("mean"), F.col("se"), F.col("r")
    return g.select("chrom", "peak_set", "n", "names", F.round(mean, 6).alias("mean"), F.round(se, 6).alias("se"), F.round(mean - 1.96 * se, 5).alias("lo"), F.round(mean + 1.96 * se, 5).alias("hi"), F.round(r, 6).alias("r"), F.round(r * r, 6).alias("r2"))


@query("w1_quantile_bins", "WITH q AS (SELECT chrom, QUANTILE_CONT(CAST(score AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS b FROM f_regions GROUP BY 1) SELECT r.name, CAST(1 + len(list_filter(q.b, lambda x: x < CAST(r.score AS DOUBLE))) AS INTEGER) AS quantile FROM f_regions r JOIN q ON q.chrom = r.chrom")
def w1(regions):
    own = regions.withColumn("v", F.col("score").cast("double"))
    cuts = cut_points(own, ["chrom"], F.col("v"), [0.2, 0.4, 0.6, 0.8])
    return sized_join(own, cuts, "chrom").select("name", interval_of(F.col("v"), F.col("b")).alias("quantile"))


@query("w2_ecdf_of_reference", f"WITH {DENSE_SQL}, v AS (SELECT sample, n_obs, COUNT(*) FILTER (WHERE chrom <> 'chrX') AS e FROM d GROUP BY 1, 2) SELECT sample, n_obs, ROUND(SUM(e) OVER (PARTITION BY sample ORDER BY n_obs) / SUM(e) OVER (PARTITION BY sample), 6) AS ecdf FROM v")
def w2(inserts, bins):
    # Distinct values first: the window sees as many rows as there are values.
    v = dense(inserts, bins).groupBy("sample", "n_obs").agg(F.count_if(F.col("chrom") != "chrX").alias("e"))
    w = Window.partitionBy("sample")
    return v.select("sample", "n_obs", F.round(F.sum("e").over(w.orderBy("n_obs").rangeBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum("e").over(w), 6).alias("ecdf"))


@query("w3_robust_z", f"WITH {DENSE_SQL}, s AS (SELECT sample, MEDIAN(n_obs) AS m, STDDEV_SAMP(n_obs) AS sd FROM d WHERE chrom <> 'chrX' GROUP BY 1) SELECT d.sample, d.chrom, d.start0, ROUND((d.n_obs - s.m) / s.sd, 6) AS z FROM d JOIN s ON s.sample = d.sample")
def w3(inserts, bins):
    d = dense(inserts, bins)
    counts = written(d.where("chrom <> 'chrX'").groupBy("sample", "n_obs").agg(F.count("*").alias("c")), "counts")
    n, s1, s2 = F.sum("c"), F.sum(F.col("c") * F.col("n_obs")), F.sum(F.col("c") * F.col("n_obs") * F.col("n_obs"))
    s = counts.groupBy("sample").agg(F.sqrt((n * s2 - s1 * s1) / (n * (n - 1))).alias("sd")).join(medians(counts, ["sample"], F.col("n_obs"), "m", F.col("c")), "sample")
    return sized_join(d, s, "sample").select("sample", "chrom", "start0", F.round((F.col("n_obs") - F.col("m")) / F.col("sd"), 6).alias("z"))


@query("w4_clamp_quantiles", "WITH q AS (SELECT sample, QUANTILE_CONT(CAST(wgt AS DOUBLE), 0.01) AS lo, QUANTILE_CONT(CAST(wgt AS DOUBLE), 0.99) AS hi FROM f_inserts GROUP BY 1) SELECT i.sample, ROUND(SUM(LEAST(GREATEST(CAST(i.wgt AS DOUBLE), q.lo), q.hi)), 3) AS w FROM f_inserts i JOIN q ON q.sample = i.sample GROUP BY 1")
def w4(inserts):
    own = inserts.select("sample", F.col("wgt").cast("double").alias("w"))
    q = quantiles(own, ["sample"], F.col("w"), {"lo": 0.01, "hi": 0.99})
    return sized_join(own, q, "sample").groupBy("sample").agg(F.round(F.sum(F.least(F.greatest("w", "lo"), F.col("hi"))), 3).alias("w"))


@query("w7_cumulative_share", f"WITH {MERS}, t AS (SELECT lang, nonamer, n, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY n DESC, nonamer) AS rank FROM k) SELECT lang, nonamer, rank, ROUND(SUM(n) OVER (PARTITION BY lang ORDER BY rank) / SUM(n) OVER (PARTITION BY lang), 6) AS share FROM t")
def w7(seq):
    w = Window.partitionBy("lang")
    order = w.orderBy(F.desc("n"), "nonamer")
    k = mers(seq)
    return k.select("lang", "nonamer", F.row_number().over(order).cast("long").alias("rank"), F.round(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum("n").over(w), 6).alias("share"))


@query("w8_argmax", f"WITH {COUNTS} SELECT name, stage AS top_stage FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY name ORDER BY n DESC, k) AS r FROM c) WHERE r = 1")
def w8(regions, inserts, samples):
    return stage_counts(regions, inserts, samples).groupBy("name").agg(F.max_by("stage", F.struct("n", (-F.col("k")).alias("m"))).alias("top_stage"))


@query("w10_source_priority_dedup", "SELECT chrom, strand, locus, source, name FROM (SELECT *, start0 // 5000 AS locus, ROW_NUMBER() OVER (PARTITION BY chrom, strand, start0 // 5000 ORDER BY CASE source WHEN 'Brand#11' THEN 0 WHEN 'Brand#12' THEN 1 ELSE 2 END, CAST(SUBSTR(name, 2) AS BIGINT)) AS k FROM f_genes) WHERE k = 1")
def w10(genes):
    """One record for each locus: source Brand#11 first, then Brand#12, then the others; then the lowest number of the name."""
    rank = F.when(F.col("source") == "Brand#11", 0).when(F.col("source") == "Brand#12", 1).otherwise(2)
    order = F.struct(rank.alias("rank"), F.substring("name", 2, 20).cast("long").alias("version"))
    best = genes.groupBy("chrom", "strand", F.floor(F.col("start0") / 5000).alias("locus")).agg(F.min_by(F.struct("source", "name"), order).alias("s"))
    return best.select("chrom", "strand", "locus", "s.source", "s.name")


@query("w12_standardise_rows", f"WITH {COUNTS} SELECT name, stage, ROUND((n - AVG(n) OVER (PARTITION BY name)) / STDDEV_SAMP(n) OVER (PARTITION BY name), 6) AS z FROM c QUALIFY STDDEV_SAMP(n) OVER (PARTITION BY name) > 0")
def w12(regions, inserts, samples):
    w = Window.partitionBy("name")
    c = stage_counts(regions, inserts, samples).withColumn("sd", F.stddev_samp("n").over(w)).withColumn("m", F.avg("n").over(w))
    return c.where("sd > 0").select("name", "stage", F.round((F.col("n") - F.col("m")) / F.col("sd"), 6).alias("z"))
