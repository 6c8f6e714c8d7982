"""Queries of interval set algebra and of sources."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import intervals as iv, scalars as sc
from .registry import query

SIZES_SQL = "sizes AS (SELECT chrom, CAST(1000000 AS BIGINT) AS length FROM (VALUES ('chr1'),('chr2'),('chr3'),('chr4'),('chrX'),('chrY')) AS c(chrom))"
MARK = "SELECT *, CASE WHEN start0 <= MAX(end1) OVER (PARTITION BY chrom ORDER BY start0, end1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS new FROM {of}"


def merged(of: str, name: str, gap: int = 0) -> str:
    return f"{name}_1 AS ({MARK.format(gap=gap, of=of)}), {name}_2 AS (SELECT *, SUM(new) OVER (PARTITION BY chrom ORDER BY start0, end1 ROWS UNBOUNDED PRECEDING) AS k FROM {name}_1), {name} AS (SELECT chrom, MIN(start0) AS start0, MAX(end1) AS end1, COUNT(*) AS n FROM {name}_2 GROUP BY chrom, k)"


def sizes(spark):
    return spark.createDataFrame([(c, 1_000_000) for c in ("chr1", "chr2", "chr3", "chr4", "chrX", "chrY")], "chrom string, length long")


@query("i1_make_windows", "SELECT chrom, CAST(w AS BIGINT) AS start0, CAST(LEAST(w + 3000, top) AS BIGINT) AS end1 FROM (SELECT chrom, top, UNNEST(range(0, top, 3000)) AS w FROM (SELECT chrom, MAX(end1) AS top FROM f_regions GROUP BY 1))")
def i1(regions):
    return iv.make_windows(regions.groupBy("chrom").agg(F.max("end1").alias("length")), 3000)


@query("i2_merge_intervals", f"WITH {merged('f_regions', 'm', 100)} SELECT chrom, start0, end1, n FROM m")
def i2(regions):
    return iv.merge_intervals(regions, 100, [F.count("*").alias("n")])


@query("i3_complement", f"WITH {SIZES_SQL}, {merged('f_regions', 'm')}, e AS (SELECT chrom, end1 AS start0, LEAD(start0) OVER (PARTITION BY chrom ORDER BY start0) AS end1 FROM m UNION ALL SELECT chrom, 0, MIN(start0) FROM m GROUP BY 1) SELECT s.chrom, COALESCE(e.start0, 0) AS start0, COALESCE(e.end1, s.length) AS end1 FROM sizes s LEFT JOIN e ON e.chrom = s.chrom WHERE COALESCE(e.start0, 0) < COALESCE(e.end1, s.length)")
def i3(spark, regions):
    return iv.complement(regions, sizes(spark))


@query("i4_split_at_bins", "SELECT name, GREATEST(start0, w * 1000) AS start0, LEAST(end1, (w + 1) * 1000) + 34 AS end1 FROM (SELECT *, UNNEST(range(start0 // 1000, (end1 - 1) // 1000 + 1)) AS w FROM f_regions)")
def i4(regions):
    return iv.split_at_bins(regions, 1000, 34).select("name", "start0", "end1")


@query("i5_length_filter", f"WITH {SIZES_SQL}, {merged('f_regions', 'm')}, e AS (SELECT chrom, end1 AS start0, LEAD(start0) OVER (PARTITION BY chrom ORDER BY start0) AS end1 FROM m UNION ALL SELECT chrom, 0, MIN(start0) FROM m GROUP BY 1) SELECT s.chrom, COALESCE(e.start0, 0) AS start0, COALESCE(e.end1, s.length) AS end1 FROM sizes s LEFT JOIN e ON e.chrom = s.chrom WHERE COALESCE(e.end1, s.length) - COALESCE(e.start0, 0) >= 50")
def i5(spark, regions):
    return iv.complement(regions, sizes(spark)).where("end1 - start0 >= 50")


@query("i6_reduce_union", f"WITH u AS (SELECT chrom, start0, end1 FROM f_regions WHERE peak_set IN ('1-URGENT', '2-HIGH', '3-MEDIUM')), {merged('u', 'm')} SELECT chrom || ':' || CAST(start0 AS VARCHAR) AS id, chrom, start0, end1, n FROM m ORDER BY start0 * 2654435761 % 4294967296, chrom LIMIT 65000")
def i6(regions):
    """The sets in one; at most 65,000 of the merged regions by a hash of their places; a region's id is its place."""
    sets = [regions.where(F.col("peak_set") == name).select("chrom", "start0", "end1") for name in ("1-URGENT", "2-HIGH", "3-MEDIUM")]
    union = iv.merge_intervals(reduce(DataFrame.unionByName, sets), 0, [F.count("*").alias("n")])
    drawn = union.orderBy(sc.hash_order(F.col("start0")), "chrom").limit(65_000)
    return drawn.select(F.concat_ws(":", "chrom", "start0").alias("id"), "chrom", "start0", "end1", "n")


@query("i7_jaccard", f"WITH {merged('f_regions', 'r')}, {merged('f_genes', 'g')}, x AS (SELECT CAST(SUM(LEAST(r.end1, g.end1) - GREATEST(r.start0, g.start0)) AS BIGINT) AS i FROM r JOIN g ON r.chrom = g.chrom AND r.start0 < g.end1 AND g.start0 < r.end1), t AS (SELECT CAST(SUM(end1 - start0) AS BIGINT) AS s FROM (SELECT start0, end1 FROM r UNION ALL SELECT start0, end1 FROM g)) SELECT i AS intersection_bp, s - i AS union_bp, ROUND(i / (s - i), 9) AS jaccard FROM x, t")
def i7(regions, genes):
    return iv.jaccard(regions, genes).withColumn("jaccard", F.round("jaccard", 9))


@query("i8_run_length_group", "WITH v AS (SELECT *, n // 5 % 3 AS v FROM f_track), c AS (SELECT *, CASE WHEN LAG(v) OVER (PARTITION BY chrom ORDER BY start0) = v THEN 0 ELSE 1 END AS c FROM v), k AS (SELECT *, SUM(c) OVER (PARTITION BY chrom ORDER BY start0 ROWS UNBOUNDED PRECEDING) AS k FROM c) SELECT chrom, v, MIN(start0) AS start0, MAX(end1) AS end1, COUNT(*) AS n FROM k GROUP BY chrom, v, k")
def i8(track):
    own = track.select("chrom", "start0", "end1", (F.floor(F.col("n") / 5) % 3).alias("v"))
    return iv.run_length_group(own, "v", [F.count("*").alias("n")])


@query("i9_overlap_groups", f"WITH {merged('f_regions', 'm', -1)} SELECT chrom, start0, end1, n FROM m")
def i9(regions):
    return iv.merge_intervals(regions, -1, [F.count("*").alias("n")])


@query("i10_masked_windows", "SELECT COUNT(*) AS n FROM f_inserts i WHERE EXISTS (SELECT 1 FROM f_genes g WHERE g.chrom = i.chrom AND g.start0 - 50 <= i.start0 AND i.start0 < g.end1 + 50)")
def i10(inserts, genes):
    points = inserts.select("sample", "chrom", "start0", (F.col("start0") + 1).alias("end1"), F.col("end1").alias("stop"))
    wide = iv.merge_intervals(genes.select("chrom", (F.col("start0") - 50).alias("start0"), (F.col("end1") + 50).alias("end1")))
    return iv.overlap_semi(points, wide).agg(F.count("*").alias("n"))


@query("i11_tss_flanks", "SELECT name, side, CASE WHEN (strand = '+') = (side = 'up') THEN p - 1000 ELSE p END AS start0, CASE WHEN (strand = '+') = (side = 'up') THEN p ELSE p + 1000 END AS end1, CASE WHEN strand = '+' THEN start0 + 1 ELSE end1 END AS tss1 FROM (SELECT *, CASE WHEN strand = '+' THEN start0 ELSE end1 END AS p FROM f_genes) CROSS JOIN (VALUES ('up'), ('down')) AS s(side)")
def i11(genes):
    return iv.tss_flanks(genes).select("name", "side", "start0", "end1", "tss1")


@query("i12_concat_genomes", "SELECT chrom || '-prm' AS chrom, COUNT(*) AS n FROM f_regions GROUP BY 1 UNION ALL SELECT chrom || '-spk' AS chrom, COUNT(*) AS n FROM f_genes GROUP BY 1")
def i12(regions, genes):
    one = regions.select(F.concat("chrom", F.lit("-prm")).alias("chrom"), "start0", "end1")
    return one.unionByName(genes.select(F.concat("chrom", F.lit("-spk")).alias("chrom"), "start0", "end1")).groupBy("chrom").agg(F.count("*").alias("n"))


@query("i13_dedup_fragments", "SELECT sample, COUNT(*) AS n FROM (SELECT DISTINCT sample, chrom, start0, end1 FROM (SELECT * FROM f_inserts UNION ALL SELECT * FROM f_inserts WHERE start0 % 4 = 0)) GROUP BY 1")
def i13(inserts):
    twice = inserts.unionByName(inserts.where("start0 % 4 = 0"))
    return twice.dropDuplicates(["sample", "chrom", "start0", "end1"]).groupBy("sample").agg(F.count("*").alias("n"))


@query("i14_overlap_set_sizes", "SELECT (SELECT COUNT(*) FROM f_regions) AS n_a, (SELECT COUNT(*) FROM f_genes) AS n_b, (SELECT COUNT(*) FROM f_regions a WHERE EXISTS (SELECT 1 FROM f_genes b WHERE a.chrom = b.chrom AND a.start0 < b.end1 AND b.start0 < a.end1)) AS n_both")
def i14(regions, genes):
    a, b = regions.agg(F.count("*").alias("n_a")), genes.agg(F.count("*").alias("n_b"))
    return a.crossJoin(b).crossJoin(iv.overlap_semi(regions, genes).agg(F.count("*").alias("n_both")))


@query("i15_region_coverage", f"WITH {merged('f_regions', 'm')} SELECT CAST(SUM(end1 - start0) AS BIGINT) AS bp, ROUND(SUM(end1 - start0) / 5000000, 9) AS fraction FROM m")
def i15(regions):
    return iv.covered(regions).select("bp", F.round(F.col("bp") / 5000000, 9).alias("fraction"))


@query("i16_distinct_union", "SELECT DISTINCT chrom, start0 // 10000 AS slot FROM (SELECT chrom, start0 FROM f_regions UNION ALL SELECT chrom, start0 FROM f_genes)")
def i16(regions, genes):
    return regions.select("chrom", "start0").unionByName(genes.select("chrom", "start0")).select("chrom", F.floor(F.col("start0") / 10000).alias("slot")).distinct()


@query("s11_merge_sorted_groups", "SELECT s.stage_type, i.chrom, COUNT(*) AS n, ROUND(SUM(i.wgt), 4) AS wgt FROM f_inserts i JOIN f_samples s ON s.sample = i.sample WHERE s.stage_type IS NOT NULL GROUP BY 1, 2")
def s11(inserts, samples):
    from ..sources import tables

    own = inserts.withColumn("n", F.lit(1).cast("long"))
    return tables.merge_sorted_groups(own, samples.where("stage_type IS NOT NULL"), "sample", "stage_type", ["chrom"], ["n", "wgt"]).withColumn("wgt", F.round("wgt", 4))
