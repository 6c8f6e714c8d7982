"""Embedding near-duplicates by an epsilon grid order join.

Vectors are scaled to length 1, so that cosine >= c means a distance of at most e = sqrt(2 - 2c). They are turned to
their principal axes (an orthonormal turn keeps distances), and sorted by the grid cells of side e of the leading
axes. Runs of INTERVAL vectors in that order are intervals. Two intervals meet in a task only if their boxes on the
leading axes come within e of each other; in the task the two sequences are halved again and again, pairs of parts
whose boxes are further apart than e are skipped, and small parts are compared by cosine in double precision.
Equal vectors collapse to the smallest vec_id first, and count as many times as they occur.

Cases: null, zero, null-holding and non-finite vectors, and vectors of another length than most, link with nothing or
only with vectors of their own length; rows that share a vec_id are one node; a null vec_id gets a null class and
kept null; an empty table gives no row; labels and other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

COSINE = 0.95
#: Leading axes whose cells make the order and the boxes.
AXES = 6
INTERVAL = 4096
PART = 256
#: Slack on distances between boxes, far above rounding errors and far below e.
SLACK = 1e-6


def _moments(dim: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((dim + 1, dim))
        for batch in batches:
            x = np.asarray(batch.column("v").flatten(), np.float64).reshape(-1, dim)
            total[:dim] += x.T @ x
            total[dim] += x.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1)), pa.array(list(total))], ["row", "sums"])

    return run


def _axes(unit: DataFrame, dim: int, axes: int):
    """The leading principal axes, as a (dim, axes) array; each task sends dim + 1 sums of vectors."""
    import numpy as np

    parts = unit.select("v").mapInArrow(_moments(dim), "row long, sums array<double>")
    added = parts.select("row", F.posexplode("sums")).groupBy("row", "pos").agg(F.sum("col").alias("s")).collect()
    total = np.zeros((dim + 1, dim))
    for r in added:
        total[r[0], r[1]] = r[2]
    n = max(1, unit.count())
    mean = total[dim] / n
    values, vectors = np.linalg.eigh(total[:dim] / n - np.outer(mean, mean))
    return vectors[:, ::-1][:, : min(axes, dim)]


def _turned(axes, eps: float):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = np.asarray(batch.column("v").flatten(), np.float64).reshape(-1, len(axes))
            p = x @ axes
            cells = np.floor(p / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "n", "v")), pa.array(list(p)), pa.array(list(cells))], ["vec_id", "n", "v", "p", "cells"])

    return run


class Parts:
    """A sequence of vectors in grid order, as halves of halves with their boxes."""

    def __init__(self, ids, counts, x, p):
        import numpy as np

        self.ids, self.counts, self.x, self.p = ids, counts, x, p
        self.boxes: dict = {}

    def box(self, i: int, j: int):
        if (i, j) not in self.boxes:
            own = self.p[i:j]
            self.boxes[i, j] = own.min(0), own.max(0)
        return self.boxes[i, j]


def spanning(on):
    """(row, column) links that connect what the marked places of a table connect: at most a link for each row and column."""
    import numpy as np

    if np.count_nonzero(on) <= 512:
        yield from zip(*(z.tolist() for z in np.nonzero(on)))
        return
    rows_left, cols_left = on.any(1), np.ones(on.shape[1], bool)
    while rows_left.any():
        rows = np.array([rows_left.argmax()])
        rows_left[rows] = False
        while len(rows):
            cols = np.flatnonzero(on[rows].any(0) & cols_left)
            if not len(cols):
                break
            cols_left[cols] = False
            yield from zip(rows[on[np.ix_(rows, cols)].argmax(0)].tolist(), cols.tolist())
            new = np.flatnonzero(on[:, cols].any(1) & rows_left)
            rows_left[new] = False
            yield from zip(new.tolist(), cols[on[np.ix_(new, cols)].argmax(1)].tolist())
            rows = new


def order_join(a: Parts, b: Parts, same: bool, cosine: float, eps: float):
    """(links of each vector of a, of b, weighted by counts; spanning links between ids)."""
    import numpy as np

    na, nb = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    root: dict = {}

    def top(k):
        while root.setdefault(k, k) != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    links = []
    todo = [(0, len(a.ids), 0, len(b.ids))]
    while todo:
        i, j, k, m = todo.pop()
        if i >= j or k >= m or same and k + m < i + j:
            continue
        (lo, hi), (lo2, hi2) = a.box(i, j), b.box(k, m)
        gap = np.maximum(0, np.maximum(lo - hi2, lo2 - hi))
        if float(gap @ gap) > (eps + SLACK) ** 2:
            continue
        if j - i > PART or m - k > PART:
            h, g = (i + j + 1) // 2, (k + m + 1) // 2
            if same and (i, j) == (k, m):
                todo += [(i, h, i, h), (h, j, h, j), (i, h, h, j)]
            else:
                todo += [(i, h, k, g), (i, h, g, m), (h, j, k, g), (h, j, g, m)]
            continue
        on = a.x[i:j] @ b.x[k:m].T >= cosine
        diagonal = same and (i, j) == (k, m)
        if diagonal:
            np.fill_diagonal(on, False)
        na[i:j] += on @ b.counts[k:m]
        if not diagonal:
            nb[k:m] += a.counts[i:j] @ on
        for u, v in spanning(np.triu(on) if diagonal else on):
            p, q = top(int(a.ids[i + u])), top(int(b.ids[k + v]))
            if p != q:
                root[p] = q
                links.append((int(a.ids[i + u]), int(b.ids[k + v])))
    return na, nb, links


def _join(cosine: float, eps: float, dim: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for t in common.batches_of_runs(batches, "pair"):
            side = t["side"].to_numpy()
            same = side.min() == side.max()

            def part(s):
                own = t.filter(pa.array(side == s))
                x = np.asarray(own["v"].combine_chunks().flatten(), np.float64).reshape(-1, dim)
                p = np.asarray(own["p"].combine_chunks().flatten(), np.float64).reshape(len(x), -1)
                cells = np.asarray(own["cells"].combine_chunks().flatten()).reshape(len(x), -1)
                ids = own["vec_id"].to_numpy()
                order = np.lexsort((ids, *cells.T[::-1]))
                return Parts(ids[order], own["n"].to_numpy()[order], x[order], p[order])

            a = part(0)
            b = a if same else part(1)
            na, nb, links = order_join(a, b, same, cosine, eps)
            ids = [a.ids] if same else [a.ids, b.ids]
            n = na + nb if same else np.concatenate([na, nb])
            ids = np.concatenate(ids)
            some = n > 0
            src, dst = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), pa.array(n[some], pa.int64()), pa.nulls(int(some.sum()), pa.int64())], ["vec_id", "links", "dst"])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array([0] * len(src), pa.int64()), pa.array(dst, pa.int64())], ["vec_id", "links", "dst"])

    return run


def _one_length(unit: DataFrame, dim: int, cosine: float) -> DataFrame:
    """(vec_id, links, dst) between distinct unit vectors (vec_id, n, v) of dim numbers."""
    spark = unit.sparkSession
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))
    axes = _axes(unit, dim, AXES)
    k = axes.shape[1]
    turned = unit.mapInArrow(_turned(axes, max(eps, 1e-9)), "vec_id long, n long, v array<double>, p array<double>, cells array<int>")
    cells = [F.col("cells")[i] for i in range(k)]
    ranged = common.stash(turned.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *cells, "vec_id").sortWithinPartitions(*cells, "vec_id").mapInArrow(_parted, "vec_id long, n long, v array<double>, p array<double>, cells array<int>, part int, at long"), "ordered")
    # One number for each partition, to make ranks of places.
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy("part").agg(F.count("*")).collect())
    before, total = {}, 0
    for part, rows in sizes:
        before[part] = total
        total += rows
    offsets = spark.createDataFrame(list(before.items()), "part int, before long")
    placed = ranged.join(F.broadcast(offsets), "part").withColumn("interval", F.floor((F.col("before") + F.col("at")) / INTERVAL)).drop("part", "at", "before")
    bounds = placed.groupBy("interval").agg(*(f(F.col("p")[i]).alias(f"{name}{i}") for i in range(k) for f, name in ((F.min, "lo"), (F.max, "hi"))))
    bounds = common.stash(bounds, "boxes")
    # Boxes meet through the cells of side 4e that they span on the first axis.
    wide = max(4 * eps, 1e-6)
    slots = bounds.withColumn("slot", F.explode(F.sequence(F.floor((F.col("lo0") - eps) / wide), F.floor((F.col("hi0") + eps) / wide))))
    other = slots.select(*(F.col(c).alias(f"o_{c}") for c in slots.columns if c != "slot"), "slot")
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"lo{i}") - F.col(f"o_hi{i}"), F.col(f"o_lo{i}") - F.col(f"hi{i}")), 2) for i in range(1, k)), F.pow(F.greatest(F.lit(0.0), F.col("lo0") - F.col("o_hi0"), F.col("o_lo0") - F.col("hi0")), 2))
    pairs = slots.join(other, "slot").where(F.col("interval") <= F.col("o_interval")).where(gap <= (eps + SLACK) ** 2).select("interval", "o_interval").distinct()
    pairs = common.stash(pairs.withColumn("pair", F.col("interval") * 4_294_967_296 + F.col("o_interval")), "pairs")
    sides = pairs.select("pair", "interval", F.lit(0).alias("side")).union(pairs.where("interval <> o_interval").select("pair", "o_interval", F.lit(1)))
    rows = placed.join(F.broadcast(sides) if sides.count() <= common.BROADCAST_ROWS else sides, "interval")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("pair", "side", "vec_id", "n", "v", "p", "cells").repartition(n, "pair").sortWithinPartitions("pair").mapInArrow(_join(cosine, eps, dim), "vec_id long, links long, dst long")


def _parted(batches):
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(np.arange(batch.num_rows) + at)], [*batch.schema.names, "part", "at"])
        at += batch.num_rows


def near_vectors(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of embeddings (vec_id, embedding)."""
    spark = embeddings.sparkSession
    v = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fine = rows.where(F.expr("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf')) AND exists(v, x -> x <> 0)"))
    # The largest number is divided out first, so that squares neither vanish nor overflow.
    scaled = fine.withColumn("big", F.expr("array_max(transform(v, x -> abs(x)))")).withColumn("v", F.expr("transform(v, x -> x / big)")).withColumn("norm", F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + x * x))"))
    unit = common.stash(scaled.select("vec_id", F.expr("transform(v, x -> x / norm + 0D)").alias("v")), "unit")
    groups = common.stash(unit.groupBy("v").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("n")), "distinct")
    alike = unit.join(groups.where("n > 1"), "v").select(F.col("vec_id").alias("src"), F.col("rep").alias("dst"), "n").distinct()
    alike = common.stash(alike, "alike")
    out = None
    reps = groups.select(F.col("rep").alias("vec_id"), "n", "v")
    # One pass for each length of vectors; tables have one as a rule.
    for (dim,) in groups.select(F.size("v")).distinct().collect():
        part = _one_length(reps.where(F.size("v") == dim), dim, cosine)
        out = part if out is None else out.union(part)
    if out is None:
        found = spark.createDataFrame([], "vec_id long, links long, dst long")
    else:
        found = common.stash(out, "found")
    counts = found.where("dst IS NULL").groupBy("vec_id").agg(F.sum("links").alias("links"))
    per = groups.select(F.col("rep").alias("vec_id"), "n").join(counts, "vec_id", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    copied = alike.where("src <> dst").join(per.withColumnRenamed("vec_id", "dst"), "dst").select(F.col("src").alias("vec_id"), "n_links")
    n_links = per.union(copied).groupBy("vec_id").agg(F.max("n_links").alias("n_links"))
    edges = found.where("dst IS NOT NULL").select(F.col("vec_id").alias("src"), "dst").union(alike.select("src", "dst"))
    linked = common.components(common.stash(edges, "edges")).withColumnRenamed("id", "vec_id")
    ids = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"))
    joined = ids.join(n_links, "vec_id", "left").join(linked, "vec_id", "left")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
