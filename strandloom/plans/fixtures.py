"""Interval tables derived from the driver's tables, as SQL text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("orders", "lineitem", "part", "documents")

VIEWS = {
    "f_inserts": """SELECT CONCAT('s', CAST(l_linenumber AS STRING)) AS sample, CASE l_suppkey % 5 WHEN 0 THEN 'chr1' WHEN 1 THEN 'chr2' WHEN 2 THEN 'chr3' WHEN 3 THEN 'chr4' ELSE 'chrX' END AS chrom, CASE WHEN l_partkey % 10 = 9 THEN 'spk' ELSE 'prm' END AS genome, (l_orderkey*7919 + l_partkey*104729 + l_linenumber*13) % 999000 AS start0, (l_orderkey*7919 + l_partkey*104729 + l_linenumber*13) % 999000 + 35 + (l_partkey*31 + l_suppkey*17 + l_linenumber*7) % 616 AS end1, 0.5 + l_discount*10 AS wgt FROM lineitem""",
    "f_regions": """SELECT CONCAT('r', CAST(o_orderkey AS STRING)) AS name, CASE o_custkey % 5 WHEN 0 THEN 'chr1' WHEN 1 THEN 'chr2' WHEN 2 THEN 'chr3' WHEN 3 THEN 'chr4' ELSE 'chrX' END AS chrom, (o_orderkey*6151 + o_custkey*97) % 998000 AS start0, (o_orderkey*6151 + o_custkey*97) % 998000 + 200 + (o_custkey*13) % 1800 AS end1, o_orderpriority AS peak_set, o_totalprice AS score FROM orders""",
    "f_genes": """SELECT CONCAT('g', CAST(p_partkey AS STRING)) AS name, CASE p_partkey % 5 WHEN 0 THEN 'chr1' WHEN 1 THEN 'chr2' WHEN 2 THEN 'chr3' WHEN 3 THEN 'chr4' ELSE 'chrX' END AS chrom, (p_partkey*49999) % 980000 AS start0, (p_partkey*49999) % 980000 + 500 + p_size*100 AS end1, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, p_brand AS source FROM part""",
    "f_bins": """SELECT c.chrom AS chrom, t.id*1000 AS start0, t.id*1000 + 1000 AS end1 FROM (VALUES ('chr1'),('chr2'),('chr3'),('chr4'),('chrX')) AS c(chrom) CROSS JOIN range(0, 1000) AS t(id)""",
    "f_seq": """SELECT doc_id, lang, translate(text, 'eoinshrlacgt', 'ACGTACGTACGT') AS seq FROM documents""",
    "f_samples": """SELECT * FROM (VALUES ('s1','early_RS',1,'round'),('s2','int_RS',2,'round'),('s3','late_RS',3,'round'),('s4','earliest_ES',4,NULL),('s5','early_ES',5,'elong'),('s6','int_ES',6,'elong'),('s7','late_ES',7,NULL)) AS v(sample, stage, staging_order, stage_type)""",
}

#: Each bin with the number of inserts that start in it and their bases.
VIEWS["f_track"] = f"SELECT b.chrom AS chrom, b.start0 AS start0, b.end1 AS end1, COALESCE(i.n, 0) AS n, COALESCE(i.bp, 0) AS bp FROM ({VIEWS['f_bins']}) b LEFT JOIN (SELECT chrom, start0 - start0 % 1000 AS bs0, COUNT(*) AS n, CAST(SUM(end1 - start0) AS BIGINT) AS bp FROM ({VIEWS['f_inserts']}) x GROUP BY 1, 2) i ON i.chrom = b.chrom AND i.bs0 = b.start0"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view `name` over the tables of sf_dir."""
    text = VIEWS[name]
    for table in TABLES:
        if f"FROM {table}" in text:
            text = text.replace(f"FROM {table}", f"FROM parquet.`{sf_dir}/{table}.parquet`")
    return spark.sql(text)


def oracle(sql: str) -> str:
    """sql with the views that it names as common table expressions."""
    used = [n for n in VIEWS if n in sql]
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in used)
    if not used:
        return sql
    if sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {sql[15:]}"
    return f"WITH {head}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {head} {sql}"
