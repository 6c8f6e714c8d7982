"""Readers and writers of interval text files and region tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.shared import sized_join, written

BED = ("chrom", "start0", "end1", "name", "score", "strand")


def read_bed(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """3 to 6 columns; a missing name is '.', a missing score 0."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).where("value <> '' AND NOT startswith(value, '#')").select(p.alias("p"))
    if header:
        rows = rows.where(F.col("p")[1].rlike("^[0-9]+$"))
    get = lambda i: F.get("p", F.lit(i))
    return rows.select(get(0).alias("chrom"), get(1).cast("long").alias("start0"), get(2).cast("long").alias("end1"), F.coalesce(get(3), F.lit(".")).alias("name"), F.coalesce(get(4).cast("double"), F.lit(0.0)).alias("score"), F.coalesce(get(5), F.lit(".")).alias("strand"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV sample sheet, byte order mark or not, by staging_order."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
    return df.orderBy("staging_order") if "staging_order" in df.columns else df


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """S3: SAM text lines."""
    p = F.split("value", "\t")
    return spark.read.text(path).where("NOT startswith(value, '@')").select(*(p[i].cast(t).alias(n) for i, (n, t) in enumerate((("qname", "string"), ("flag", "int"), ("rname", "string"), ("pos", "long"), ("mapq", "int"), ("cigar", "string"), ("rnext", "string"), ("pnext", "long"), ("tlen", "long"), ("seq", "string"), ("qual", "string")))))


def chunked(sequences: DataFrame, chunk: int, overlap: int, name: str = "chrom", seq: str = "seq") -> DataFrame:
    """(name, offset, seq) pieces that overlap by `overlap`, so that no k-mer of overlap + 1 is lost."""
    last = F.greatest(F.lit(0), F.length(seq) - overlap - 1)
    return sequences.select(name, seq, F.explode(F.sequence(F.lit(0), last, F.lit(chunk))).alias("offset")).select(name, "offset", F.substr(seq, F.col("offset") + 1, F.lit(chunk + overlap)).alias("seq"))


def _cut(lines: Iterable[tuple], chunk: int, overlap: int) -> Iterator[tuple]:
    """The chunks of lines (file, block, line) that stand in their splits' order, as rows of CUT.

    A chunk is done if its split holds all of it. What a split has before its first header (record 0) comes in segments
    of `chunk` bases, and what its last record holds since the last chunk is left open: another split may go on with it.
    """
    split, record, chrom, at, held, size = None, 0, None, 0, [], 0
    row = lambda text, done: (*split, record, chrom, at, at + len(text), text, done)
    for file, block, line in lines:
        if split != (file, block):
            if split and (record or size):
                yield row("".join(held), False)
            split, record, chrom, at, held, size = (file, block), 0, None, 0, [], 0
        if line.startswith(">"):
            # A chunk that holds no more than the overlap of the one before it is none, but for the first.
            if (at == 0 or size > overlap) if record else size:
                yield row("".join(held), bool(record))
            record, chrom, at, held, size = record + 1, re.split(r"[ \t\n\x0b\f\r]", line[1:], maxsplit=1)[0], 0, [], 0
            continue
        held.append(line)
        size += len(line)
        most = chunk + overlap if record else chunk
        if size >= most:
            text, begin = "".join(held), 0
            while size >= most:
                yield row(text[begin : begin + most], bool(record))
                at, begin, size = at + chunk, begin + chunk, size - chunk
            held = [text[begin:]]
    if split and (record or size):
        yield row("".join(held), False)


#: What _cut makes: the split and the number of the record's header in it, its name, and its bases from `at` to `to`.
CUT = "file string, block long, record int, chrom string, at long, to long, seq string, done boolean"

#: Bases of a batch of rows of CUT.
BATCH_BASES = 1 << 22


def _cut_batches(chunk: int, overlap: int) -> Callable:
    def run(batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in CUT.split(", "))])
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        lines = (line for b in batches for line in zip(*(c.to_pylist() for c in b.columns)))
        rows, room = [], 0
        for row in _cut(lines, chunk, overlap):
            rows.append(row)
            room += len(row[6])
            if room >= BATCH_BASES:
                yield batch(rows)
                rows, room = [], 0
        if rows:
            yield batch(rows)

    return run


def read_sequence(spark: SparkSession, path: str, chunk: int = 1_000_000, overlap: int = 12) -> DataFrame:
    """FASTA records as overlapping chunks (chrom, offset, seq), read line by line: no record is one value.

    A task goes through the lines of its splits and cuts chunks as it goes, without an order or a shuffle of lines. Only
    what reaches over a split's ends is told its record and the bases before it, by a row for each split, and meets there.
    Names end at white space; a record without bases is one empty chunk; text before the first record is left out.
    """
    value = F.make_valid_utf8(F.rtrim(F.col("value"), F.lit("\r")))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), value.alias("value"))
    cut = written(lines.where("value <> ''").mapInArrow(_cut_batches(chunk, overlap), CUT), "chunks")
    rest = cut.where("NOT done").drop("done")
    # The last record of each split, and the bases that splits add to their last records up to there.
    ends = rest.groupBy("file", "block").agg(F.max(F.struct("record", "to", "chrom")).alias("end"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("sum", F.coalesce(F.sum("end.to").over(before), F.lit(0)))
    begun = F.last(F.when(F.col("end.record") > 0, F.struct("block", "end.record", "end.chrom", "sum")), ignorenulls=True).over(before)
    ends = ends.select("file", "block", "sum", begun.alias("begun"))
    own = F.col("record") > 0
    owner = F.when(own, F.struct("block", "record", "chrom", "at")).when(F.col("begun").isNotNull(), F.struct("begun.block", "begun.record", "begun.chrom", (F.col("at") + F.col("sum") - F.col("begun.sum")).alias("at")))
    known = sized_join(rest, ends, ["file", "block"]).select("file", "seq", own.alias("own"), owner.alias("o")).where("o IS NOT NULL").select("file", "own", "seq", "o.*")
    # The chunks before a record's own open one are done.
    first = F.when(F.col("own"), F.floor(F.col("at") / chunk)).otherwise(F.greatest(F.lit(0), F.floor((F.col("at") - overlap) / chunk)))
    last = F.greatest(first, F.floor((F.col("at") + F.length("seq") - 1) / chunk))
    by = ("file", "block", "record", "chrom", "chunk")
    pieces = known.select("*", F.explode(F.sequence(first, last)).alias("chunk"))
    low = F.greatest("at", F.col("chunk") * chunk)
    pieces = pieces.select(*by, low.alias("from"), F.substr("seq", low - F.col("at") + 1, F.greatest(F.lit(0), (F.col("chunk") + 1) * chunk + overlap - low)).alias("piece"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("from", "piece"))), lambda p: p["piece"])
    made = pieces.groupBy(*by).agg(F.concat_ws("", parts).alias("seq")).where((F.col("chunk") == 0) | (F.length("seq") > overlap))
    made = made.select("chrom", (F.col("chunk") * chunk).cast("int").alias("offset"), "seq")
    return cut.where("done").select("chrom", F.col("at").cast("int").alias("offset"), "seq").unionByName(made)


def read_gtf_genes(spark: SparkSession, path: str) -> DataFrame:
    """Gene features of the numbered, X and Y chromosomes as BED rows."""
    p = F.split("value", "\t")
    g = spark.read.text(path).where("NOT startswith(value, '#')").select(p.alias("p")).where((F.col("p")[2] == "gene") & F.col("p")[0].rlike(r"^chr(\d+|X|Y)$"))
    name = F.concat_ws("/", F.regexp_extract(F.col("p")[8], 'gene_id "([^"]+)"', 1), F.regexp_extract(F.col("p")[8], 'gene_name "([^"]+)"', 1))
    return g.select(F.col("p")[0].alias("chrom"), (F.col("p")[3].cast("long") - 1).alias("start0"), F.col("p")[4].cast("long").alias("end1"), name.alias("name"), F.lit(0.0).alias("score"), F.col("p")[6].alias("strand"))


def read_gaps(spark: SparkSession, path: str) -> DataFrame:
    """Columns 2 to 4 of a gap table."""
    return spark.read.csv(path, sep="\t").select(F.col("_c1").alias("chrom"), F.col("_c2").cast("long").alias("start0"), F.col("_c3").cast("long").alias("end1"))


def read_track(spark: SparkSession, path: str) -> DataFrame:
    """A headerless value track of 4 columns."""
    return spark.read.csv(path, sep="\t", schema="chrom string, start0 long, end1 long, value double")


def read_narrowpeak(spark: SparkSession, path: str) -> DataFrame:
    """10-column peaks."""
    return spark.read.csv(path, sep="\t", schema="chrom string, start0 long, end1 long, name string, score double, strand string, signal_value double, p_value double, q_value double, peak long")


def write_inserts(df: DataFrame, path: str) -> None:
    """One folder for each sample."""
    df.write.mode("overwrite").partitionBy("sample").parquet(path)


def write_sorted_regions(df: DataFrame, path: str, parts: int | None = None) -> None:
    """Sorted by place, so that reads of a range skip row groups."""
    by = ("chrom", "start0")
    (df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)).sortWithinPartitions(*by, "end1").write.mode("overwrite").parquet(path)


def read_region(spark: SparkSession, path: str, chrom: str, start: int, end: int) -> DataFrame:
    return spark.read.parquet(path).where((F.col("chrom") == chrom) & (F.col("start0") < end) & (F.col("end1") > start))


def merge_sorted_groups(df: DataFrame, groups: DataFrame, on: str, group: str, keys: list[str], sums: list[str]) -> DataFrame:
    """Rows of samples as rows of their groups, tallies added up."""
    return df.join(F.broadcast(groups.select(on, group)), on).groupBy(group, *keys).agg(*(F.sum(c).alias(c) for c in sums))


def export_scores(scores: DataFrame, bins: DataFrame, on: list[str] = ("chrom", "start0", "end1")) -> DataFrame:
    """Every bin with its scores."""
    return bins.join(scores, list(on), "left")


def write_scores(df: DataFrame, path: str, header: bool = False) -> None:
    """Tab-separated, compressed; without a header the first columns make it a BED-like track."""
    df.write.csv(path, sep="\t", header=header, compression="gzip")


class RegionLibrary:
    """Region sets by name, each a function that makes (chrom, start0, end1, name, score)."""

    def __init__(self):
        self.made: dict[str, Callable[[], DataFrame]] = {}

    def add(self, name: str, make: Callable[[], DataFrame]) -> None:
        self.made[name] = make

    def build(self, folder: str, names: list[str], force: bool = False) -> dict[str, DataFrame]:
        out = {}
        for name in names:
            df = self.made[name]()
            spark, path = df.sparkSession, f"{folder}/{name}"
            df.select("chrom", "start0", "end1", "name", "score").write.mode("overwrite" if force else "ignore").parquet(path)  # what is there stays
            out[name] = spark.read.parquet(path)
        return out
