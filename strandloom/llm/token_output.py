"""Token-id output: blocks of ids as byte or bit planes, each plane compressed with zstandard, with a chunk index.

Cases: a null text is empty and gives the end id alone; equal doc_ids are ordered by their text; a null doc_id
comes first; an empty table gives no chunk and no row; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common, tokens

#: Ids in a block: the unit that is transposed.
BLOCK_IDS = 65_536
#: A chunk takes whole documents until it has so many ids.
CHUNK_IDS = 262_144
LEVEL = 3
END_ID = 0

CHUNKS = "part int, chunk long, first_id long, n_ids long, doc_ids array<long>, lengths array<long>, block_ids array<int>, plane_sizes array<int>, planes binary"


def to_planes(ids, unit: str = "byte") -> list[bytes]:
    """The planes of one block of unsigned 32-bit ids: 4 byte planes, or 32 bit planes."""
    import numpy as np

    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    return [np.packbits(raw[:, k // 8] >> (k % 8) & 1).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, unit: str = "byte"):
    import numpy as np

    raw = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        if unit == "byte":
            raw[:, k] = np.frombuffer(plane, np.uint8)
        else:
            raw[:, k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n) << (k % 8)
    return raw.reshape(-1).view("<u4")


def _chunks(vocabulary: str, block: int, chunk: int, unit: str, level: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        encoder, press = tokens.encoder(vocabulary), zstandard.ZstdCompressor(level=level)
        part, end = TaskContext.get().partitionId(), np.array([END_ID], "<u4")
        state = {"k": 0, "first": 0}
        held: list = []

        def row():
            ids = np.concatenate([x for _, x in held])
            sizes, blocks, out = [], [], []
            for i in range(0, len(ids), block):
                own = ids[i : i + block]
                blocks.append(len(own))
                for plane in to_planes(own, unit):
                    out.append(press.compress(plane))
                    sizes.append(len(out[-1]))
            made = (part, state["k"], state["first"], len(ids), [d for d, _ in held], [len(x) for _, x in held], blocks, sizes, b"".join(out))
            state.update(k=state["k"] + 1, first=state["first"] + len(ids))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(made, [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()])], ["part", "chunk", "first_id", "n_ids", "doc_ids", "lengths", "block_ids", "plane_sizes", "planes"])

        n = 0
        for batch in batches:
            names, rows = batch.column("doc_id").to_pylist(), batch.column("text")
            for i in range(0, len(names), 64):
                for name, ids in zip(names[i : i + 64], encoder.encode(rows.slice(i, 64).to_pylist())):
                    held.append((name, np.concatenate([ids, end])))
                    n += len(ids) + 1
                    if n >= chunk:
                        yield row()
                        n = 0
        if held:
            yield row()

    return run


def write_ids(docs: DataFrame, path: str, vocabulary: str, block: int = BLOCK_IDS, chunk: int = CHUNK_IDS, unit: str = "byte", level: int = LEVEL, parts: int | None = None) -> None:
    """Encode docs, ordered by doc_id, and write chunk rows under path/chunks and the totals of the parts under path/parts.

    Each part is one range of doc_ids. A chunk holds whole documents; its row is the index of what it holds.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = common.texts(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(_chunks(vocabulary, block, chunk, unit, level), CHUNKS).write.option("compression", "none").parquet(f"{path}/chunks")
    totals = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals.select("part", "n_ids", before.alias("ids_before")).write.parquet(f"{path}/parts")


def _documents(unit: str):
    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        import zstandard

        press, planes = zstandard.ZstdDecompressor(), 4 if unit == "byte" else 32
        for batch in batches:
            for r in batch.to_pylist():
                at, got, sizes = 0, [], iter(r["plane_sizes"])
                for n in r["block_ids"]:
                    own = []
                    for _ in range(planes):
                        size = next(sizes)
                        own.append(press.decompress(r["planes"][at : at + size]))
                        at += size
                    got.append(from_planes(own, n, unit))
                raw, start, starts, crcs = np.concatenate(got).tobytes(), 0, [], []
                for n in r["lengths"]:
                    starts.append(r["first_id"] + start)
                    crcs.append(zlib.crc32(raw[4 * start : 4 * (start + n)]))
                    start += n
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * len(starts), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(r["lengths"], pa.int64()), pa.array(crcs, pa.int64())], ["part", "doc_id", "in_part", "n_tokens", "ids_crc32"])

    return run


def read_ids(spark: SparkSession, path: str, unit: str = "byte") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the chunks."""
    rows = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").mapInArrow(_documents(unit), "part int, doc_id long, in_part long, n_tokens long, ids_crc32 long")
    parts = spark.read.schema("part int, n_ids long, ids_before long").parquet(f"{path}/parts")
    # One row for each part, of which there are as many as shuffle partitions.
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("ids_before") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark).rstrip('/')}/strandloom/ids-{uuid.uuid4().hex}"
    write_ids(common.documents(spark, sf_dir), path, tokens.vocabulary("byte_bpe_50k.json"))
    return read_ids(spark, path)
