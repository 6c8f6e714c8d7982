"""The corpus pipeline: quality rules, near-duplicate join, secret scan, mixing, packing.

Every stage but the last returns the columns of the documents that it was given, all of them and no others, for the rows
it keeps; a row travels as one struct, so that no column of the table can clash with a column of a stage.

Cases: null and empty texts fail the base rules of the first stage and go; very long texts are handled whole. Rows that
share a doc_id are one document to the join: all of its different texts stay or go together, and of those of its rows
that have the same text the one with the smallest hash of its columns stays. Of near duplicates that tie, the smallest
doc_id decides. Rows without a doc_id are near duplicates of nothing. Rows that are equal in every column are mixed and
packed as rows of their own. An empty table gives no row at any stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandloom.llm import common, mixing, ngram_join, packing, quality, secret_scan, tokens

#: What a secret becomes.
MASK = "[secret]"


def structs(docs: DataFrame) -> DataFrame:
    """docs as one column `row`."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def row_hash() -> F.Column:
    """A hash of all columns of `row`, nulls told apart from what is not null."""
    return F.xxhash64(F.to_json("row", {"ignoreNullFields": "false"}))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the log-likelihood ratio reject go."""
    verdicts = quality.judged(common.texts(docs), quality.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    gone = common.stash(verdicts.where("NOT kept").select("k1", "k2"), "gone")
    rows = structs(docs).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("text"))
    return common.small_join(quality.keyed(rows).select("row", "k1", "k2"), gone, ["k1", "k2"], "left_anti").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id stays."""
    classes = ngram_join.near_duplicates(docs)
    gone = common.stash(classes.where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct(), "gone")
    rows = structs(docs).select("row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64("row.text").alias("h"))
    kept = common.small_join(rows, gone, "id", "left_anti")
    often = common.stash(kept.where("id IS NOT NULL").groupBy("id", "h").agg(F.count("*").alias("n"), F.min(row_hash()).alias("first")).where("n > 1"), "repeated")
    told = common.small_join(kept, often, ["id", "h"], "left")
    first = told.where("n IS NOT NULL").where(row_hash() == F.col("first")).groupBy("id", "h").agg(F.first("row").alias("row"))
    return told.where("n IS NULL").select("row").unionByName(first.select("row")).select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of the scan is masked in its text; n_chars, if there, counts the new text."""
    found = secret_scan.scan(structs(docs).select("row", F.col("row.text").cast("string").alias("text")), keep=("row",))
    text = F.when(F.col("spans") == "", F.col("row.text")).otherwise(masked("row.text", "spans"))
    new = [text.alias("text") if c == "text" else F.when(F.col("spans") == "", F.col(f"row.`{c}`")).otherwise(F.length(text).cast(docs.schema[c].dataType)).alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return found.select(*new)


def masked(text: str, spans: str) -> F.Column:
    """The text with its spans replaced; of spans that overlap, all are covered by one mask."""

    @F.pandas_udf("string")
    def run(texts, found):
        out = []
        for t, s in zip(texts, found):
            places = sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in (s or "").split(",") if x))
            parts, at = [], 0
            for a, b in places:
                if b <= at:
                    continue
                if a >= at:
                    parts += [t[at:a], MASK]
                at = b
            out.append("".join([*parts, t[at:]]) if places else t)
        return texts.__class__(out, dtype=object)

    return run(text, spans)


def identified(docs: DataFrame) -> DataFrame:
    """(row, id): an id made of the row's content, and for rows with one and the same hash of their place among them."""
    rows = common.stash(structs(docs).withColumn("id", row_hash()), "hashed")
    often = common.stash(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", "n"), "repeated")
    told = common.small_join(rows, often, "id", "left")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.to_json("row")))
    again = told.where("n IS NOT NULL").select("row", F.xxhash64("id", place).alias("id"))
    return told.where("n IS NULL").select("row", "id").unionByName(again)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents that it takes no copy of go."""
    rows = common.stash(identified(docs), "identified")
    own = rows.select(F.col("id").alias("doc_id"), F.col("row.text").cast("string").alias("text"), F.col("row.source").cast("string").alias("source"))
    taken = mixing.mix(own).where("taken > 0").select(F.col("doc_id").alias("id"), F.expr("cast(taken div size AS int)").alias("copies"))
    return rows.join(taken, "id").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences."""
    return packing.pack_documents(docs, tokens.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scan", secrets),
    ("mixing", mixing_weights),
    ("best_fit_packing", best_fit_packing),
]

#: SQL expresses neither the log-likelihood ratio's hashes nor the automata; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    base = f"{common.shared_dir(spark).rstrip('/')}/strandloom/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
