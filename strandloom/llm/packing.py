"""Best-fit packing of token pieces into sequences, with dual-feasible lower bounds and exchange between partitions.

Pieces are dealt to partitions by hash. Each partition packs its pieces by best-fit decreasing and compares its
bin count with a lower bound from dual-feasible functions. A partition whose count exceeds its bound gives up its
emptiest bins; every partition gives up the one bin that rounding its bound up may cost. What they give up meets
in fewer partitions and is packed again, until one round has one partition or nothing improves.

Cases: a null or empty text is one piece of the end id alone; repeated rows and doc_ids give a piece for each row;
an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, tokens

CAPACITY = 2048
END_ID = 0
#: Pieces that one partition packs: some MB in a task.
PARTITION_PIECES = 20_000
ROUNDS = 4

PIECES = "key long, doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit_decreasing(sizes, capacity: int) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, place of each item in its bin, free room of each bin); equal rooms: the latest bin."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    of, at, free = [0] * len(sizes), [0] * len(sizes), []
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in order:
        size = sizes[i]
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            b, room = len(free), capacity
            free.append(capacity)
        of[i], at[i] = b, capacity - room
        room -= size
        free[b] = room
        rooms[room].append(b)
        mask |= 1 << room
    return of, at, free


def lower_bound(sizes, capacity: int) -> int:
    """The largest of the bounds given by two families of dual-feasible functions over the counts of sizes."""
    import numpy as np

    n = np.bincount(np.asarray(sizes, dtype=np.int64), minlength=capacity + 1)
    x = np.arange(capacity + 1)
    best = math.ceil(int((n * x).sum()) / capacity)
    # Threshold: sizes over capacity - e count as whole bins, those under e as nothing.
    many, mass = np.cumsum(n[::-1])[::-1], np.cumsum(n * x)
    for e in range(1, capacity // 2 + 1):
        whole = int(many[capacity - e + 1])
        best = max(best, whole + math.ceil(int(mass[capacity - e] - mass[e - 1]) / capacity))
    # Rounding to k-ths.
    for k in range(1, 21):
        y = (k + 1) * x
        f = np.where(y % capacity == 0, x * k, (y // capacity) * capacity)
        best = max(best, math.ceil(int((n * f).sum()) / (capacity * k)))
    return best


def _pieces(vocabulary: str, capacity: int):
    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, key, end = tokens.encoder(vocabulary), TaskContext.get().partitionId() << 40, np.array([END_ID], "<u4")
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            names, rows = batch.column("doc_id").to_pylist(), batch.column("text")
            for i in range(0, len(names), 256):
                out = []
                for name, ids in zip(names[i : i + 256], encoder.encode(rows.slice(i, 256).to_pylist())):
                    ids = np.concatenate([ids, end])
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        out.append((key, name, piece, start, len(own), zlib.crc32(own.tobytes())))
                        key += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["key", "doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def cut(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document of at most `capacity` ids, the end id included; key is unique."""
    return common.texts(docs).mapInArrow(_pieces(vocabulary, capacity), PIECES)


PACKED = "key long, length long, sequence_id long, offset long, given boolean, bins long, bound long"


def _pack(capacity: int, turn: int, last: bool):
    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("key")
        sizes = pdf["length"].tolist()
        of, at, free = best_fit_decreasing(sizes, capacity)
        bound = lower_bound(sizes, capacity)
        spare = 0 if last else min(len(free), 4 * max(0, len(free) - bound) + 2)
        out = set(sorted((b for b in range(len(free)) if free[b]), key=lambda b: (-free[b], b))[:spare])
        group = int(pdf["grp"].iloc[0])
        return pd.DataFrame({"key": pdf["key"].to_numpy(), "length": sizes, "sequence_id": np.array(of, dtype=np.int64) + ((turn << 58) | (group << 28)), "offset": at, "given": [b in out for b in of], "bins": len(free), "bound": bound})

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """(key, sequence_id, offset) of pieces (key, length), each at most `capacity` long."""
    full = pieces.where(F.col("length") >= capacity).select("key", (F.lit(-1) - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_, done = pieces.where(F.col("length") < capacity).select("key", "length"), [full]
    before = None
    for turn in range(1, rounds + 1):
        groups = math.ceil(open_.count() / partition_pieces)
        if not groups:
            break
        last = turn == rounds or (turn > 1 and groups == 1) or groups == before == 1
        dealt = open_.withColumn("grp", F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(groups)))
        packed = common.stash(dealt.groupBy("grp").applyInPandas(_pack(capacity, turn, last or groups == 1), PACKED), "packed")
        done.append(packed.where("not given").select("key", "sequence_id", "offset"))
        open_, before = packed.where("given").select("key", "length"), groups
        if last or groups == 1:
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    pieces = common.stash(cut(docs, vocabulary, capacity), "pieces")
    placed = pack(pieces, capacity)
    return pieces.join(placed, "key").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.documents(spark, sf_dir), tokens.vocabulary("word_bpe_49k.json"))
