"""Queries of readers and writers (S1-S10, S12, S13): derived tables as text files and back.

Files go to the folder that the session's executors share, a new one for each call.
"""

from pyspark.sql import functions as F

from ..operators.shared import folder
from ..sources import tables
from .registry import query


def lines(df, name, *fields, head=None):
    """The fields of each row as one tab-separated line of text files, whose path is returned; `head` is a line more."""
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    rows = df.select(F.concat_ws("\t", *fields).alias("value"))
    if head:
        rows = rows.unionByName(spark.range(1).select(F.lit(head).alias("value")))
    rows.write.text(path)
    return path


@query("s1_read_bed", "SELECT chrom, start0, end1, CASE WHEN peak_set = '1-URGENT' THEN '.' ELSE name END AS name, CASE WHEN peak_set IN ('1-URGENT', '2-HIGH') THEN 0.0 ELSE score END AS score, CASE WHEN peak_set IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN '.' ELSE '+' END AS strand FROM f_regions")
def s1(spark, regions):
    """Lines of 3, 4, 5 and 6 columns in one set of files, with a header."""
    has = lambda least: F.col("peak_set") >= least
    more = (F.when(has("2"), F.col("name")), F.when(has("3"), F.col("score").cast("string")), F.when(has("4"), F.lit("+")))
    return tables.read_bed(spark, lines(regions, "bed", "chrom", "start0", "end1", *more, head="chrom\tstart\tend"), header=True)


@query("s2_read_samples", "SELECT sample, CAST(SUBSTR(sample, 2) AS BIGINT) AS staging_order, COUNT(*) AS n FROM f_inserts GROUP BY 1, 2")
def s2(spark, inserts):
    """The sheet's first line starts with a byte order mark."""
    path = folder(spark, "sheet")
    sheet = inserts.groupBy("sample").agg(F.count("*").alias("n"))
    sheet.select(F.col("sample").alias("﻿sample"), F.substring("sample", 2, 9).alias("staging_order"), "n").write.csv(path, header=True)
    return tables.read_samples(spark, path).select("sample", F.col("staging_order").cast("long").alias("staging_order"), F.col("n").cast("long").alias("n"))


@query("s3_read_alignments", "SELECT sample || ':' || CAST(start0 AS VARCHAR) AS qname, CAST(start0 % 4096 AS INTEGER) AS flag, chrom AS rname, start0 + 1 AS pos, CAST(end1 % 61 AS INTEGER) AS mapq, CAST(end1 - start0 AS VARCHAR) || 'M' AS cigar, '=' AS rnext, end1 - 34 AS pnext, end1 - start0 AS tlen, '*' AS seq, '*' AS qual FROM f_inserts")
def s3(spark, inserts):
    at, end = F.col("start0"), F.col("end1")
    fields = (F.concat_ws(":", "sample", at), at % 4096, "chrom", at + 1, end % 61, F.concat(end - at, F.lit("M")), F.lit("="), end - 34, end - at, F.lit("*"), F.lit("*"))
    return tables.read_alignments(spark, lines(inserts, "sam", *fields, head="@HD\tVN:1.6"))


@query("s4_read_sequence", "SELECT 'd' || CAST(doc_id AS VARCHAR) AS chrom, o AS \"offset\", SUBSTR(s, o + 1, 1012) AS seq FROM (SELECT doc_id, s, UNNEST(range(0, GREATEST(0, LENGTH(s) - 13) + 1, 1000)) AS o FROM (SELECT doc_id, regexp_replace(COALESCE(seq, ''), '[^ACGT]', '', 'g') AS s FROM f_seq))")
def s4(spark, seq):
    """Each document is a record, in lines of 60 bases."""
    bases = F.regexp_replace(F.regexp_replace(F.coalesce("seq", F.lit("")), "[^ACGT]", ""), "(.{60})", "$1\n")
    path = lines(seq, "fasta", F.concat(F.lit(">d"), "doc_id", F.lit(" record\n"), bases))
    return tables.read_sequence(spark, path, 1000, 12).select("chrom", F.col("offset").cast("long").alias("offset"), "seq")


@query("s5_read_gtf_genes", "SELECT chrom, start0, end1, name || '/' || source AS name, 0.0::DOUBLE AS score, strand FROM f_genes WHERE start0 % 7 <> 0")
def s5(spark, genes):
    """Every gene has a transcript, which goes, and every seventh start lies on an unplaced contig, whose genes go."""
    chrom = F.when(F.col("start0") % 7 == 0, F.concat(F.lit("chrUn_"), "chrom")).otherwise(F.col("chrom"))
    info = F.concat(F.lit('gene_id "'), "name", F.lit('"; gene_name "'), "source", F.lit('";'))
    both = genes.withColumn("feature", F.explode(F.array(F.lit("gene"), F.lit("transcript"))))
    return tables.read_gtf_genes(spark, lines(both, "gtf", chrom, F.lit("made"), "feature", F.col("start0") + 1, "end1", F.lit("."), "strand", F.lit("."), info, head="#!genome"))


@query("s6_read_gaps", "SELECT chrom, start0, end1 FROM f_regions")
def s6(spark, regions):
    return tables.read_gaps(spark, lines(regions, "gaps", F.lit("585"), "chrom", "start0", "end1", F.lit("1"), F.lit("N")))


@query("s7_read_track", "SELECT chrom, start0, end1, CAST(n AS DOUBLE) AS value FROM f_track")
def s7(spark, track):
    return tables.read_track(spark, lines(track, "track", "chrom", "start0", "end1", "n"))


@query("s8_read_narrowpeak", "SELECT chrom, start0, end1, name, CAST(start0 % 1000 AS DOUBLE) AS score, '.' AS strand, score AS signal_value, -1.0::DOUBLE AS p_value, -1.0::DOUBLE AS q_value, (end1 - start0) // 2 AS peak FROM f_regions")
def s8(spark, regions):
    peak = F.floor((F.col("end1") - F.col("start0")) / 2)
    return tables.read_narrowpeak(spark, lines(regions, "peaks", "chrom", "start0", "end1", "name", F.col("start0") % 1000, F.lit("."), F.col("score").cast("string"), F.lit("-1"), F.lit("-1"), peak))


@query("s9_write_inserts", "SELECT sample, chrom, start0, end1 FROM f_inserts WHERE sample IN ('s1', 's3')")
def s9(spark, inserts):
    """Reads two samples' folders of those that were written."""
    path = folder(spark, "inserts")
    tables.write_inserts(inserts.select("sample", "chrom", "start0", "end1"), path)
    return spark.read.parquet(path).where("sample IN ('s1', 's3')").select("sample", "chrom", "start0", "end1")


@query("s10_read_region", "SELECT chrom, start0, end1, name FROM f_regions WHERE chrom = 'chr2' AND start0 < 300000 AND end1 > 100000")
def s10(spark, regions):
    path = folder(spark, "sorted")
    tables.write_sorted_regions(regions.select("chrom", "start0", "end1", "name"), path)
    return tables.read_region(spark, path, "chr2", 100000, 300000)


@query("s12_export_scores", "SELECT b.chrom, b.start0, b.end1, s.cpm FROM f_bins b LEFT JOIN (SELECT chrom, start0 // 1000 * 1000 AS start0, ROUND(COUNT(*) * 1e6 / MAX(t), 6) AS cpm FROM f_inserts, (SELECT COUNT(*) AS t FROM f_inserts) GROUP BY 1, 2) s ON s.chrom = b.chrom AND s.start0 = b.start0")
def s12(spark, inserts, bins):
    """As compressed text with a header, read back."""
    per = inserts.groupBy("chrom", (F.floor(F.col("start0") / 1000) * 1000).alias("start0")).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("t"))
    scores = per.crossJoin(F.broadcast(total)).select("chrom", "start0", F.round(F.col("n") * 1e6 / F.col("t"), 6).alias("cpm"))
    path = folder(spark, "scores")
    tables.write_scores(tables.export_scores(scores, bins, ["chrom", "start0"]).select("chrom", "start0", "end1", "cpm"), path, header=True)
    return spark.read.csv(path, sep="\t", header=True, schema="chrom string, start0 long, end1 long, cpm double")


@query("s13_region_library", "SELECT 'genes' AS library, chrom, start0, end1, name, 0.0::DOUBLE AS score FROM f_genes UNION ALL SELECT 'peaks', chrom, start0, end1, name, score FROM f_regions WHERE peak_set = '1-URGENT'")
def s13(spark, genes, regions):
    """Two sets made once; the second call reads what the first one wrote."""
    library = tables.RegionLibrary()
    library.add("genes", lambda: genes.withColumn("score", F.lit(0.0)))
    library.add("peaks", lambda: regions.where("peak_set = '1-URGENT'"))
    path = folder(spark, "library")
    library.build(path, ["genes"])
    made = library.build(path, ["genes", "peaks"])
    return made["genes"].withColumn("library", F.lit("genes")).unionByName(made["peaks"].withColumn("library", F.lit("peaks")))
