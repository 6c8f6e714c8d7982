"""Queries of filters, scalars, sorts and samples."""

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import intervals as iv, scalars as sc
from ..operators.quantiles import quantiles
from ..operators.running import running, stretch
from .registry import query

LEVEL_SQL = "CASE " + " ".join(f"WHEN end1-start0 >= {x} THEN {x}" for x in reversed(sc.LEVELS)) + " ELSE 0 END"
COUNTS = "c AS (SELECT r.name AS name, s.stage AS stage, s.staging_order AS k, COUNT(*) AS n FROM f_regions r JOIN f_inserts i ON i.chrom = r.chrom AND i.start0 < r.end1 AND r.start0 < i.end1 JOIN f_samples s ON s.sample = i.sample GROUP BY 1, 2, 3)"


@query("p1_filter_flags", "SELECT COUNT(*) AS n, CAST(SUM(flag) AS BIGINT) AS flags FROM (SELECT start0 % 4096 AS flag, end1 % 61 AS mapq FROM f_inserts) WHERE (flag & 1804) = 0 AND mapq >= 30")
def p1(inserts):
    rows = inserts.select((F.col("start0") % 4096).alias("flag"), (F.col("end1") % 61).alias("mapq"))
    return rows.where(sc.keep_flags(F.col("flag"), F.col("mapq"))).agg(F.count("*").alias("n"), F.sum("flag").alias("flags"))


@query("p2_proper_fragments", "SELECT COUNT(*) AS n, CAST(SUM(flag) AS BIGINT) AS flags FROM (SELECT start0 % 4096 AS flag FROM f_inserts) WHERE (flag & 2048) = 0 AND ((flag & 1) = 0 OR ((flag & 2) <> 0 AND (flag & 16) = 0))")
def p2(inserts):
    return inserts.select((F.col("start0") % 4096).alias("flag")).where(sc.proper(F.col("flag"))).agg(F.count("*").alias("n"), F.sum("flag").alias("flags"))


@query("p3_cigar_ref_span", "SELECT sample, CAST(SUM(start0 % 90 + 1 + start0 % 7 + end1 % 60 + 1) AS BIGINT) AS span FROM f_inserts GROUP BY 1")
def p3(inserts):
    text = F.concat((F.col("start0") % 90 + 1).cast("string"), F.lit("M"), (F.col("start0") % 7).cast("string"), F.lit("D3I"), (F.col("end1") % 60 + 1).cast("string"), F.lit("M5S"))
    return inserts.select("sample", text.alias("cigar")).groupBy("sample").agg(F.sum(sc.cigar_span(F.col("cigar"))).alias("span"))


@query("p4_fragment_bed3", "SELECT sample, COUNT(*) AS n, CAST(SUM(pos - 1) AS BIGINT) AS s, CAST(SUM(pos + tlen - 1) AS BIGINT) AS e FROM (SELECT sample, start0 AS pos, end1 - start0 + 20 - start0 % 40 AS tlen FROM f_inserts) WHERE tlen BETWEEN 35 AND 650 GROUP BY 1")
def p4(inserts):
    rows = inserts.select("sample", F.col("start0").alias("pos"), (F.col("end1") - F.col("start0") + 20 - F.col("start0") % 40).alias("tlen")).where("tlen BETWEEN 35 AND 650")
    return rows.groupBy("sample").agg(F.count("*").alias("n"), F.sum(F.col("pos") - 1).alias("s"), F.sum(F.col("pos") + F.col("tlen") - 1).alias("e"))


@query("p5_nuclear_chroms", "SELECT chrom, COUNT(*) AS n FROM f_inserts WHERE chrom IN ('chr1','chr2','chrX') AND NOT regexp_matches(chrom, '_|chrM|chrEBV') GROUP BY 1")
def p5(inserts):
    return inserts.where(F.col("chrom").isin("chr1", "chr2", "chrX") & ~F.col("chrom").rlike("_|chrM|chrEBV")).groupBy("chrom").agg(F.count("*").alias("n"))


@query("p6_insert_size_level", f"SELECT sample, CAST({LEVEL_SQL} AS INTEGER) AS isl, COUNT(*) AS n FROM f_inserts GROUP BY 1, 2")
def p6(inserts):
    return inserts.select("sample", sc.insert_size_level(F.col("end1") - F.col("start0")).alias("isl")).groupBy("sample", "isl").agg(F.count("*").alias("n"))


@query("p7_bin_start", "SELECT chrom, CAST(start0 // 1000 * 1000 AS BIGINT) AS bs0, COUNT(*) AS n FROM f_inserts GROUP BY 1, 2")
def p7(inserts):
    return inserts.select("chrom", sc.bin_start(F.col("start0")).alias("bs0")).groupBy("chrom", "bs0").agg(F.count("*").alias("n"))


@query("p8_composite_name", "SELECT chrom || '-' || genome AS composite, chrom, genome, COUNT(*) AS n FROM f_inserts GROUP BY 1, 2, 3")
def p8(inserts):
    named = inserts.select(F.concat_ws("-", "chrom", "genome").alias("composite"))
    part = F.split("composite", "-")
    return named.groupBy("composite", part[0].alias("chrom"), part[1].alias("genome")).agg(F.count("*").alias("n"))


@query("p9_pad_intervals", "SELECT name, chrom, start0 - 500 AS start0, end1 + 300 AS end1 FROM f_regions WHERE start0 >= 500")
def p9(regions):
    return regions.where("start0 >= 500").select("name", "chrom", (F.col("start0") - 500).alias("start0"), (F.col("end1") + 300).alias("end1"))


@query("p10_bin_eligibility", "SELECT chrom, COUNT(*) AS n, CAST(SUM(CASE WHEN chrom IN ('chrX','chrY') THEN 1 ELSE 2 END) AS BIGINT) AS alleles, CAST(SUM(CASE WHEN chrom NOT IN ('chrX','chrY') AND n > 0 AND (bp % 100) / 100.0 BETWEEN 0.3 AND 0.6 THEN 1 ELSE 0 END) AS BIGINT) AS eligible FROM f_track GROUP BY 1")
def p10(track):
    gc = (F.col("bp") % 100) / 100.0
    ok = ~F.col("chrom").isin("chrX", "chrY") & (F.col("n") > 0) & gc.between(0.3, 0.6)
    return track.groupBy("chrom").agg(F.count("*").alias("n"), F.sum(F.when(F.col("chrom").isin("chrX", "chrY"), 1).otherwise(2)).alias("alleles"), F.sum(ok.cast("long")).alias("eligible"))


@query("p12_above_line", "SELECT sample, COUNT(*) AS n FROM f_inserts WHERE end1 - start0 > 100 + (start0 % 1000 - 0) * (500 - 100) / 1000.0 GROUP BY 1")
def p12(inserts):
    return inserts.where(sc.above_line(F.col("start0") % 1000, F.col("end1") - F.col("start0"), (0, 100), (1000, 500))).groupBy("sample").agg(F.count("*").alias("n"))


@query("p13_compartment_label", "SELECT chrom, CASE WHEN v > 0 THEN 'A' WHEN v < 0 THEN 'B' END AS compartment, COUNT(*) AS n FROM (SELECT chrom, n % 7 - 3 AS v FROM f_track) GROUP BY 1, 2")
def p13(track):
    v = F.col("n") % 7 - 3
    return track.groupBy("chrom", F.when(v > 0, "A").when(v < 0, "B").alias("compartment")).agg(F.count("*").alias("n"))


def stage_counts(regions, inserts, samples):
    """Inserts of each stage that overlap each region, long; counted without pairs. As many columns on the way as samples."""
    stages = samples.select("sample", "stage", F.col("staging_order").alias("k")).collect()
    own = inserts.select("sample", "chrom", "start0", "end1")
    told = iv.overlap_sums(regions.select("name", "chrom", "start0", "end1"), own, {f"n{i}": F.col("sample") == s.sample for i, s in enumerate(stages)})
    per = told.groupBy("name").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(len(stages))))
    each = F.array(*(F.struct(F.lit(s.stage).alias("stage"), F.lit(s.k).alias("k"), F.col(f"n{i}").alias("n")) for i, s in enumerate(stages)))
    return per.select("name", F.explode(F.filter(each, lambda e: e["n"] > 0)).alias("e")).select("name", "e.*")


@query("p14_dynamic_regions", f"WITH {COUNTS} SELECT name, CAST(hi AS BIGINT) AS hi, CAST(lo AS BIGINT) AS lo FROM (SELECT name, MAX(n) AS hi, CASE WHEN COUNT(*) < 7 THEN 0 ELSE MIN(n) END AS lo FROM c GROUP BY 1) WHERE hi >= 2 AND (hi - lo) / hi >= 0.75")
def p14(regions, inserts, samples):
    per = stage_counts(regions, inserts, samples).groupBy("name").agg(F.max("n").alias("hi"), F.when(F.count("*") < 7, 0).otherwise(F.min("n")).cast("long").alias("lo"))
    return per.where("hi >= 2 AND (hi - lo) / hi >= 0.75")


@query("p15_size_class", "SELECT sample, CASE WHEN z < 147 THEN 'sub' WHEN z > 147 AND z <= 320 THEN 'mono' WHEN z > 320 AND z <= 485 THEN 'di' END AS class, COUNT(*) AS n FROM (SELECT sample, end1 - start0 AS z FROM f_inserts) GROUP BY 1, 2")
def p15(inserts):
    return inserts.groupBy("sample", sc.size_class(F.col("end1") - F.col("start0")).alias("class")).agg(F.count("*").alias("n"))


@query("p16_fragment_geometry", "SELECT sample, CAST(SUM(start0 + 1 + (end1 - start0) / 2.0) AS DOUBLE) AS mid, CAST(SUM(end1 - start0) AS BIGINT) AS size FROM f_inserts WHERE end1 - start0 <= 500 GROUP BY 1")
def p16(inserts):
    size = F.col("end1") - F.col("start0")
    return inserts.where(size <= 500).groupBy("sample").agg(F.sum(F.col("start0") + 1 + size / 2).alias("mid"), F.sum(size).alias("size"))


@query("p17_flooring_log10", "SELECT name, CASE WHEN x < 0.001 THEN -3.0 ELSE CAST(TRUNC(LOG10(x) * 100 + 0.5) AS BIGINT) / 100 END AS v FROM (SELECT name, CAST(start0 % 5000 AS DOUBLE) / 1000000 AS x FROM f_regions)")
def p17(regions):
    return regions.select("name", sc.floored_log10((F.col("start0") % 5000).cast("double") / 1000000).alias("v"))


@query("p18_motif_midpoint", "SELECT name, chrom, strand, start0 + (end1 - start0) // 2 + 1 AS pos1 FROM f_genes")
def p18(genes):
    return genes.select("name", "chrom", "strand", (F.col("start0") + F.floor((F.col("end1") - F.col("start0")) / 2) + 1).alias("pos1"))


@query("p19_clip_to_chrom", "SELECT name, chrom, start0, LEAST(end1, CASE chrom WHEN 'chr1' THEN 900000 WHEN 'chr2' THEN 800000 ELSE 1000000 END) AS end1 FROM f_regions")
def p19(spark, regions):
    sizes = spark.createDataFrame([("chr1", 900000), ("chr2", 800000), ("chr3", 1000000), ("chr4", 1000000), ("chrX", 1000000)], "chrom string, length long")
    return regions.join(F.broadcast(sizes), "chrom").select("name", "chrom", "start0", F.least("end1", "length").alias("end1"))


@query("p20_gene_filters", "WITH m AS (SELECT source, AVG(end1 - start0) AS v FROM f_genes WHERE name <> 'g7' GROUP BY 1) SELECT source, ROUND(v, 6) AS v FROM m WHERE v > (SELECT QUANTILE_CONT(v, 0.25) FROM m)")
def p20(genes):
    means = genes.where("name <> 'g7'").groupBy("source").agg(F.avg(F.col("end1") - F.col("start0")).alias("v"))
    cut = quantiles(means, [], F.col("v"), {"cut": 0.25})
    return means.crossJoin(F.broadcast(cut)).where("v > cut").select("source", F.round("v", 6).alias("v"))


@query("p21_sample_filter", "SELECT s.sample, s.stage, s.staging_order, COUNT(*) AS n FROM f_samples s JOIN f_inserts i ON i.sample = s.sample WHERE s.stage_type = 'elong' GROUP BY 1, 2, 3")
def p21(samples, inserts):
    return inserts.join(F.broadcast(samples.where("stage_type = 'elong'")), "sample").groupBy("sample", "stage", "staging_order").agg(F.count("*").alias("n"))


@query("p22_canonical_genes", "SELECT name, chrom, end1 - start0 AS size FROM f_genes WHERE chrom IN ('chr1','chr2','chr3','chr4','chrX') AND end1 - start0 >= 1000")
def p22(genes):
    return genes.where(F.col("chrom").isin("chr1", "chr2", "chr3", "chr4", "chrX") & (F.col("end1") - F.col("start0") >= 1000)).select("name", "chrom", (F.col("end1") - F.col("start0")).alias("size"))


@query("p23_select_regions", "SELECT name, chrom, ROW_NUMBER() OVER (PARTITION BY chrom ORDER BY start0, name) AS region_i FROM f_regions WHERE peak_set = '1-URGENT' AND end1 % 7 <> 0 AND score BETWEEN 50000 AND 250000")
def p23(regions):
    """Regions of one stage that passed, within bounds of rpkm (end1 % 7 and score here), numbered anew by chromosome."""
    own = sc.select_regions(regions.withColumn("passed", F.col("end1") % 7 != 0), F.col("peak_set") == "1-URGENT", "score", low=50000, high=250000)
    told = running(stretch(own, F.col("start0")), ("chrom",), ["start0", "name"], {"region_i": ("sum", F.lit(1))})
    return told.select("name", "chrom", F.col("region_i").cast("long").alias("region_i"))


STAGES = ("early_RS", "int_RS", "late_RS", "earliest_ES", "early_ES", "int_ES", "late_ES")
STAGE_COLUMNS = ", ".join(f"ROUND(COALESCE(MAX(CASE WHEN c.stage = '{s}' THEN c.n END), 0) * 1e9 / t.t / (MAX(r.end1) - MAX(r.start0)) / 2, 6) AS {s}_rpkm" for s in STAGES)


@query("p24_region_display_table", f"WITH {COUNTS}, t AS (SELECT COUNT(*) AS t FROM f_inserts) SELECT r.name, list_extract([{', '.join(repr(s) for s in STAGES)}], CAST(MAX(r.start0) % 7 + 1 AS INTEGER)) AS stage, CAST(FLOOR(MAX(r.score) / 50000) AS BIGINT) AS score_class, {STAGE_COLUMNS} FROM f_regions r LEFT JOIN c ON c.name = r.name, t GROUP BY r.name, t.t")
def p24(regions, inserts, samples):
    """A stage index as the stage's name, the score's class, and the rpkm of each stage in a column of its own."""
    wide = stage_counts(regions, inserts, samples).groupBy("name").pivot("stage", list(STAGES)).agg(F.max("n"))
    total = inserts.agg(F.count("*").alias("t"))
    shown = regions.select("name", "score", "start0", (F.col("end1") - F.col("start0")).alias("z")).join(wide, "name", "left").crossJoin(F.broadcast(total))
    rpkm = [F.round(F.coalesce(s, F.lit(0)) * 1e9 / F.col("t") / F.col("z") / 2, 6).alias(f"{s}_rpkm") for s in STAGES]
    return shown.select("name", F.element_at(F.array(*map(F.lit, STAGES)), (F.col("start0") % 7 + 1).cast("int")).alias("stage"), F.floor(F.col("score") / 50000).alias("score_class"), *rpkm)


@query("p25_user_filter", "SELECT name, early_rpkm, late_rpkm FROM (SELECT name, start0 % 100 AS early_rpkm, end1 % 100 AS late_rpkm FROM f_regions) WHERE early_rpkm > 50 AND late_rpkm < early_rpkm / 2")
def p25(regions):
    """One expression that holds, and two that are none and give no rows."""
    own = regions.select("name", (F.col("start0") % 100).alias("early_rpkm"), (F.col("end1") % 100).alias("late_rpkm"))
    given = ("early > 50 AND late < early / 2", "early > AND", "unknown_column > 1")
    return reduce(DataFrame.unionByName, [sc.user_filter(own, text, ("early", "late")) for text in given])


@query("t1_genomic_sort", "SELECT chrom, start0, end1, sample FROM f_inserts ORDER BY 1, 2, 3, 4")
def t1(inserts):
    return inserts.select("chrom", "start0", "end1", "sample").orderBy("chrom", "start0", "end1", "sample")


@query("t2_head_tail_of_rank", "(SELECT name, score FROM f_regions ORDER BY score DESC, name LIMIT 100) UNION ALL (SELECT name, score FROM f_regions ORDER BY score, name DESC LIMIT 101)")
def t2(regions):
    own = regions.select("name", "score")
    return own.orderBy(F.desc("score"), "name").limit(100).union(own.orderBy("score", F.desc("name")).limit(101))


@query("t3_top_n_by_group", "SELECT chrom, name, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY chrom ORDER BY score DESC, name) AS k FROM f_regions) WHERE k <= 20")
def t3(regions):
    return regions.withColumn("k", F.row_number().over(Window.partitionBy("chrom").orderBy(F.desc("score"), "name"))).where("k <= 20").select("chrom", "name", "score")


@query("t4_slice_head", "SELECT name, score FROM f_regions ORDER BY chrom, start0, name LIMIT 500")
def t4(regions):
    return regions.orderBy("chrom", "start0", "name").limit(500).select("name", "score")


@query("t5_sample_rows", "SELECT name, chrom FROM f_regions ORDER BY (CAST(SUBSTR(name, 2) AS BIGINT) * 2654435761 + 11) % 4294967296, name LIMIT 300")
def t5(regions):
    return regions.orderBy(sc.hash_order(F.substring("name", 2, 20).cast("long"), 11), "name").limit(300).select("name", "chrom")


@query("t6_nearest_point", "SELECT name, start0, score FROM f_regions ORDER BY POWER((start0 - 500000) / 1000.0, 2) + POWER((CAST(score AS DOUBLE) - 150000) / 1000.0, 2), name LIMIT 1")
def t6(regions):
    d = F.pow((F.col("start0") - 500000) / 1000.0, 2) + F.pow((F.col("score").cast("double") - 150000) / 1000.0, 2)
    return regions.orderBy(d, "name").limit(1).select("name", "start0", "score")
