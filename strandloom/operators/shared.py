"""Tables written to the folder that driver and executors share, where a plan's lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A side of a join with at most so many rows may be broadcast.
BROADCAST_ROWS = 200_000


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; only a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")
        base = "file://" + tempfile.mkdtemp(prefix="spark-files-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_files"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/strandloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read again."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized_join(df: DataFrame, side: DataFrame, on, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join; side is broadcast only if a count shows that it has at most `limit` rows, else both sides are shuffled."""
    return df.join(F.broadcast(side) if side.limit(limit + 1).count() <= limit else side, on, how)
