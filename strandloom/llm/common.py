"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A side with at most so many rows of a few numbers each (some 16 bytes a row) may be broadcast.
BROADCAST_ROWS = 1_000_000

#: The six characters that end a word in the text operators.
SPACES = "\x20\x09-\x0d"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is set only where the session names none."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        made = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    else:
        made = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/strandloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone (null text: empty), whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def small_join(df: DataFrame, side: DataFrame, on: list[str] | str, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join; side is broadcast only if a count shows that it has at most limit rows, else both sides are shuffled."""
    return df.join(F.broadcast(side) if side.limit(limit + 1).count() <= limit else side, on, how)


#: A key with more rows than this is hot: its rows are not dealt by key.
HOT_ROWS = 512


def hot_join(big: DataFrame, small: DataFrame, on: str, rows: str) -> DataFrame:
    """Inner join of big with small, which has one row for each key and says in `rows` how many rows of big the key has.

    Hot keys, of which there are at most one in HOT_ROWS rows of big, are broadcast and their rows stay where they are; the
    others are shuffled. If even the hot keys are too many to broadcast, their rows are dealt by salts.
    """
    hot = stash(small.where(F.col(rows) > HOT_ROWS), "hot")
    if hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        near = big.join(F.broadcast(hot), on)
        rest = big.join(F.broadcast(hot.select(on)), on, "left_anti")
        return near.unionByName(rest.join(small.where(F.col(rows) <= HOT_ROWS), on))
    salt = F.pmod(F.xxhash64(*big.columns), F.lit(64))
    return big.withColumn("_salt", salt).join(small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")))), [on, "_salt"]).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every id in edges (src, dst): the smallest id reachable.

    Labels spread over edges and then jump to their label's label, so that long chains need few rounds; each round is
    written to the shared folder. Group minima are combined before the shuffle, and neither a hub nor the label of a
    large class is a hot key: labels are broadcast if a count shows that they are few, else hot keys go by hot_join.
    """
    own = edges.where("src <> dst")
    both = stash(own.select("src", "dst").union(own.select("dst", "src")).distinct(), "edges")
    degree = stash(both.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("rows"), F.min("src").alias("m")), "degree")
    labels = degree.select("id", F.least("id", "m").alias("label"))
    few = degree.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    while True:
        if few:
            near = both.join(F.broadcast(labels.select(F.col("id").alias("dst"), "label")), "dst")
        else:
            near = hot_join(both, labels.join(degree, "id").select(F.col("id").alias("dst"), "label", "rows"), "dst", "rows")
        near = near.groupBy(F.col("src").alias("id")).agg(F.min("label").alias("near"))
        hop = stash(labels.join(near, "id").select("id", F.least("label", "near").alias("new"), F.col("label").alias("old")), "hop")
        # What a label's own label is; one row for each label that has moved on.
        used = hop.groupBy("new").agg(F.count("*").alias("rows"))
        via = stash(used.join(hop.select(F.col("id").alias("new"), F.col("new").alias("next")), "new").where("next <> new"), "via")
        moved = hot_join(hop, via, "new", "rows").select("id", F.col("next").alias("label"), "old")
        stay = small_join(hop, via.select("new"), "new", "left_anti").select("id", F.col("new").alias("label"), "old")
        step = stash(moved.unionByName(stay), "labels")
        changed = step.where("label <> old").limit(1).count()
        labels = step.select("id", "label")
        if not changed:
            return labels.select("id", F.col("label").alias("component_id"))


def batches_of_runs(batches: Iterator, key: str) -> Iterator:
    """Regroup record batches sorted by key into one Arrow table for each run of equal keys."""
    import pyarrow as pa
    import pyarrow.compute as pc

    kept: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = table[key].combine_chunks()
        cuts = pc.indices_nonzero(pc.not_equal(keys[1:], keys[:-1])).to_pylist() if len(keys) > 1 else []
        at = [0, *(x + 1 for x in cuts), len(keys)]
        for i, (a, b) in enumerate(zip(at, at[1:])):
            part = table.slice(a, b - a)
            if i == 0 and kept and kept[-1][key][0] != part[key][0]:
                yield pa.concat_tables(kept)
                kept = []
            kept.append(part)
            if i < len(at) - 2:
                yield pa.concat_tables(kept)
                kept = []
    if kept:
        yield pa.concat_tables(kept)
