"""Rows with the values of a keyed table, whatever the table's size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

#: Bytes of a table that may be sent to every task.
BROADCAST_BYTES = 32 << 20
#: What a row and a value of fixed width take at most.
ROW_BYTES, VALUE_BYTES = 32, 16


def table_bytes(table: DataFrame) -> int:
    """A bound of what the table takes in memory: its rows, values of fixed width, and the letters or values that others have."""
    sized = {"string": F.octet_length, "binary": F.octet_length}
    wide = [sized[f.dataType.typeName()](f"`{f.name}`") if f.dataType.typeName() in sized else F.lit(VALUE_BYTES) * F.size(f"`{f.name}`") for f in table.schema if f.dataType.typeName() in ("string", "binary", "array", "map")]
    letters = F.sum(reduce(lambda a, b: a + b, (F.coalesce(w, F.lit(0)) for w in wide), F.lit(0)))
    n, more = table.agg(F.count("*"), letters).first()
    return n * (ROW_BYTES + VALUE_BYTES * len(table.columns)) + (more or 0)


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], unmatched: str | dict = "keep", most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """rows with the other columns of table, which has one row for each key.

    A key that the table lacks (or that holds a null) keeps its row with nulls, or with the values of a dict by column, or
    drops it, or fails the job. Columns of rows that the table has too are the table's from here on. The table is sent to
    the tasks only if its bytes, counted first, allow it; else both sides are dealt by key, hot keys by Spark's skew join.
    A key that the table has twice is an error.
    """
    if not (isinstance(unmatched, dict) or unmatched in ("keep", "drop", "fail")):
        raise ValueError(f"unmatched is keep, drop, fail or a dict of values, not {unmatched!r}")
    twice = table.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1").drop("n").limit(3).collect()
    if twice:
        raise ValueError(f"keys with more than one row: {[tuple(t) for t in twice]}")
    values = [c for c in table.columns if c not in on]
    side = table.select(*on, F.struct(*(f"`{c}`" for c in values)).alias("_v"))
    side = F.broadcast(side) if table_bytes(table) <= most_bytes else side
    joined = rows.drop(*values).join(side, on, "inner" if unmatched == "drop" else "left")
    if unmatched == "fail":
        shown = F.concat_ws(", ", *(F.col(c).cast("string") for c in on))
        joined = joined.withColumn("_v", F.coalesce("_v", F.raise_error(F.concat(F.lit("no row for "), shown)).cast(joined.schema["_v"].dataType)))
    given = unmatched if isinstance(unmatched, dict) else {}
    found = {c: F.col(f"_v.`{c}`") for c in values}
    # A value that is null in the table stays null: the dict is for keys that it lacks.
    found = {c: F.when(F.col("_v").isNull(), F.lit(given[c])).otherwise(v) if c in given else v for c, v in found.items()}
    return joined.withColumns(found).drop("_v")
