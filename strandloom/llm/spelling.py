"""Spelling variants: words within one edit of each other, found by Gram matrices of letter counts in blocks.

One inserted or deleted letter changes the letter counts by one in one place, a replaced letter by one in two places: the
squared distance of the counts is then 1 or 2. Words of one length are blocks, and letters are dealt into GROUPS sets, so
that a length falls into cells by how many letters of each set a word has. An edit leads into the same cell, into one
where a letter has moved between two sets, or into one of the next length with a letter more in one set; no other pair of
cells is ever compared. Cells of more than PART words are dealt into parts, so no task's matrix grows with the data. The
product of two parts' count matrices (each with its norms in two more columns) gives all squared distances at once;
pairs at most two apart are verified letter by letter.

Every pair of parts meets once, so the numbers of near words add up, and what a word learns of its near words is their
number and the best of them: pairs are never written.

Cases: a null or empty text has no words; a null doc_id is written as an empty text before the colon; very long texts are
read whole and very long runs are words like others (their blocks hold fewer words); repeated rows count as often as they
occur; near words of equal n tie by code points; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

#: A word has at least so many code points and occurrences; the drill deletes a letter of one run in DRILL.
LEAST_LETTERS, LEAST_N, DRILL = 7, 2, 31
#: A form occurs at least so many times as often as its variant.
TIMES = 10
GROUPS = 6
#: Words and letters that one block holds.
PART, PART_LETTERS = 512, 1_000_000
#: Distinct words that a counting task holds before it hands them on.
HELD = 200_000

RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LETTERS},}}")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Letters that can stand in a lower-cased word, as bytes of Latin-1.
LETTERS = bytes([*range(97, 123), *range(192, 256)])


def shortened(doc_id, run: str) -> str:
    """The lower-cased run, without one letter if the drill says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % DRILL:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches):
    from collections import Counter

    import pyarrow as pa

    def rows(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    held: Counter = Counter()
    for batch in batches:
        names = batch.column("doc_id").to_pylist()
        for k in range(0, batch.num_rows, 256):
            for name, text in zip(names[k : k + 256], batch.column("text").slice(k, 256).to_pylist()):
                for run, n in Counter(RUN.findall(text)).items():
                    word = shortened(name, run.lower() if run.isascii() else run.translate(LOWER))
                    if len(word) >= LEAST_LETTERS:
                        held[word] += n
            if len(held) > HELD:
                yield rows(held)
                held.clear()
    if held:
        yield rows(held)


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of every word; counts are combined in each task before they are shuffled."""
    counts = common.texts(docs).mapInArrow(_counted, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_N)


def lettered(found: DataFrame, groups: int = GROUPS) -> bytes:
    """The group of each letter of LETTERS, dealt so that groups are about as frequent (at most 90 counts reach the driver)."""
    letter = F.explode(F.split("word", "")).alias("letter")
    load, of = [0] * groups, bytearray(256)
    for row in found.select(letter).where("letter <> ''").groupBy("letter").count().orderBy(F.desc("count"), "letter").collect():
        least = load.index(min(load))
        of[ord(row["letter"])] = least
        load[least] += row["count"]
    return bytes(of)


def _celled(of: bytes, groups: int):
    def run(batches):
        import pyarrow as pa

        kinds = [bytes([g]) for g in range(groups)]
        for batch in batches:
            cells = []
            for word in batch.column("word").to_pylist():
                dealt = word.encode("latin-1").translate(of)
                cells.append(",".join(str(dealt.count(g)) for g in kinds))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(cells, pa.string())], ["word", "n", "cell"])

    return run


def neighbours(cell: str) -> list[str]:
    """The cells that an edit leads to from this one; of two cells, one alone names the other."""
    at = list(map(int, cell.split(",")))
    found = []
    for i in range(len(at)):
        more = at.copy()
        more[i] += 1
        found.append(more)
        for j in range(i + 1, len(at)):
            if at[j]:
                moved = more.copy()
                moved[j] -= 1
                found.append(moved)
    return [",".join(map(str, x)) for x in found]


def _met(batches):
    import pyarrow as pa

    for batch in batches:
        cells = batch.column("cell").to_pylist()
        beside = [neighbours(c) for c in cells]
        arrays = [pa.array([c for c, x in zip(cells, beside) for _ in x]), pa.array([p for p, x in zip(batch.column("parts").to_pylist(), beside) for _ in x], pa.int32()), pa.array([o for x in beside for o in x], pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["cell", "parts", "other"])


def _blocked(batches):
    """Sorted words of one (cell, part) after the other to one row each: the words' bytes and their counts."""
    import pyarrow as pa

    for t in common.batches_of_runs(batches, "block"):
        names = t["word"].to_pylist()
        yield pa.RecordBatch.from_arrays(
            [t["block"].combine_chunks().slice(0, 1), pa.array([len(names[0])], pa.int32()), pa.array(["".join(names).encode("latin-1")], pa.binary()), pa.array([t["n"].to_pylist()], pa.list_(pa.int64()))],
            ["block", "length", "letters", "n"],
        )


def count_matrix(block):
    """Letter counts of each word of a block (rows of letters, as Latin-1 bytes)."""
    import numpy as np

    size, length = block.shape
    column = np.zeros(256, np.int64)
    column[list(LETTERS)] = np.arange(len(LETTERS))
    flat = (np.arange(size)[:, None] * len(LETTERS) + column[block]).ravel()
    exact = np.float32 if length < 2000 else np.float64  # whole numbers up to 2 ** 24, or 2 ** 53
    return np.bincount(flat, minlength=size * len(LETTERS)).reshape(size, len(LETTERS)).astype(exact)


def edited(a, b):
    """Which rows of a and b (letters; b's may have one more) differ by exactly one edit."""
    import numpy as np

    length = a.shape[1]
    if b.shape[1] == length:
        return (a != b).sum(1) == 1
    ends = np.ones((len(a), 1), bool)
    front = np.argmax(np.hstack([a != b[:, :length], ends]), 1)
    back = np.argmax(np.hstack([(a != b[:, 1:])[:, ::-1], ends]), 1)
    return front + back >= length


def near_pairs(one, two, left, right, same: bool):
    """Positions (in one, in two) of the words one edit apart. one, two: letters; left, right: their counts of letters."""
    import numpy as np

    def wide(x, scale, norm_first):
        norm, ones = (x * x).sum(1, keepdims=True), np.ones((len(x), 1), x.dtype)
        return np.hstack([x * x.dtype.type(scale), *((norm, ones) if norm_first else (ones, norm))])

    squared = wide(left, -2, True) @ wide(right, 1, False).T
    i, j = np.nonzero(squared <= 2)
    if same:
        i, j = i[i < j], j[i < j]
    step = max(1, 2_000_000 // one.shape[1])
    good = [edited(one[i[k : k + step]], two[j[k : k + step]]) for k in range(0, len(i), step)]
    keep = np.concatenate(good) if good else np.zeros(0, bool)
    return i[keep], j[keep]


class Learnt:
    """What the words of one block learn of their near words: how many there are, and the best one."""

    def __init__(self, letters, n):
        import numpy as np

        #: A row of bytes for each word, and how often it occurs.
        self.letters, self.n = letters, n
        self.near = np.zeros(len(n), np.int64)
        self.best: dict[int, tuple[int, bytes]] = {}

    def add(self, i, other, j):
        import numpy as np

        if not len(i):
            return
        self.near += np.bincount(i, minlength=len(self.n))
        order = np.lexsort((-other.n[j], i))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        top = np.repeat(other.n[j[first]], np.diff(np.r_[first, len(i)]))
        for p, q in zip(*(x[other.n[j] == top].tolist() for x in (i, j))):
            got = (-int(other.n[q]), other.letters[q].tobytes())
            if p not in self.best or got < self.best[p]:
                self.best[p] = got

    def rows(self):
        import pyarrow as pa

        at = sorted(self.best)
        text = lambda raw: raw.decode("latin-1")
        arrays = [pa.array([text(self.letters[i].tobytes()) for i in at], pa.string()), pa.array(self.near[at], pa.int64()), pa.array([-self.best[i][0] for i in at], pa.int64()), pa.array([text(self.best[i][1]) for i in at], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["word", "n_near", "best_n", "best"])


def _near(batches):
    """Rows of one block after the other, its own first (side 0), then those that it meets."""
    import numpy as np

    def read(row):
        letters = np.frombuffer(row["letters"], np.uint8).reshape(-1, row["length"])
        return Learnt(letters, np.asarray(row["n"], np.int64)), count_matrix(letters)

    at, own, counts = None, None, None
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if row["side"] == 0:
                if own is not None and own.best:
                    yield own.rows()
                at, (own, counts) = row["at"], read(row)
                i, j = near_pairs(own.letters, own.letters, counts, counts, True)
                own.add(np.r_[i, j], own, np.r_[j, i])
                continue
            if row["at"] != at:
                continue  # a part that the hash has left empty has no words to compare
            other, beside = read(row)
            if counts.dtype != beside.dtype:
                i, j = near_pairs(own.letters, other.letters, counts.astype(np.float64), beside.astype(np.float64), False)
            else:
                i, j = near_pairs(own.letters, other.letters, counts, beside, False)
            own.add(i, other, j)
            other.add(j, own, i)
            if other.best:
                yield other.rows()
    if own is not None and own.best:
        yield own.rows()


def near_words(found: DataFrame, groups: int = GROUPS, part: int = PART) -> DataFrame:
    """(word, n_near, best_n, best) of every word of found (word, n) that has a near word."""
    spark = found.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    celled = common.stash(found.mapInArrow(_celled(lettered(found, groups), groups), "word string, n long, cell string"), "cells")
    need = F.greatest(F.ceil(F.count("*") / part), F.ceil(F.sum(F.length("word")) / PART_LETTERS)).cast("int")
    cells = common.stash(celled.groupBy("cell").agg(need.alias("parts")), "parts")
    name = lambda cell, at: F.concat_ws("#", cell, at)
    dealt = common.small_join(celled, cells, "cell").select(name("cell", F.pmod(F.xxhash64("word"), F.col("parts"))).alias("block"), "word", "n")
    blocks = common.stash(dealt.repartition(partitions, "block").sortWithinPartitions("block").mapInArrow(_blocked, "block string, length int, letters binary, n array<long>"), "blocks")
    # Every pair of parts of one cell, and of two cells that an edit connects.
    upto = lambda first, end: F.explode(F.when(F.col(end) > F.col(first) if first else F.lit(True), F.sequence(F.col(first) if first else F.lit(0), F.col(end) - 1)))
    own = cells.select("cell", "parts", upto(None, "parts").alias("a")).withColumn("b0", F.col("a") + 1)
    own = own.where("b0 < parts").select(name("cell", "a").alias("at"), upto("b0", "parts").alias("b"), "cell").select("at", name("cell", "b").alias("block"))
    other = cells.select(F.col("cell").alias("other"), F.col("parts").alias("others"))
    beside = cells.mapInArrow(_met, "cell string, parts int, other string").join(other, "other")
    beside = beside.select("cell", "other", "others", upto(None, "parts").alias("a")).select("cell", "a", "other", upto(None, "others").alias("b")).select(name("cell", "a").alias("at"), name("other", "b").alias("block"))
    meetings = own.union(beside).join(blocks, "block").select("at", F.lit(1).alias("side"), "block", "length", "letters", "n")
    rows = blocks.select(F.col("block").alias("at"), F.lit(0).alias("side"), "block", "length", "letters", "n").union(meetings)
    learnt = rows.repartition(partitions, "at").sortWithinPartitions("at", "side").mapInArrow(_near, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return learnt.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of forms (word, form): the last of the chain of forms. A form is TIMES as frequent, so chains are short."""
    known = common.stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        used = known.groupBy("root").agg(F.count("*").alias("rows"))
        further = common.stash(used.join(known.select(F.col("word").alias("root"), F.col("root").alias("next")), "root"), "further")
        if not further.limit(1).count():
            return known
        moved = common.hot_join(known, further, "root", "rows").select("word", F.col("next").alias("root"))
        stay = common.small_join(known, further.select("root"), "root", "left_anti").select("word", "root")
        known = common.stash(moved.unionByName(stay), "roots")


def variants(docs: DataFrame, groups: int = GROUPS, part: int = PART) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs: near words, the form of a word and the end of its chain."""
    found = common.stash(words(docs), "words")
    learnt = near_words(found, groups, part)
    often = F.col("best_n") >= TIMES * F.col("n")
    held = common.stash(found.join(learnt, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(often, F.col("best")).alias("form"), F.when(often, F.col("best_n")).alias("form_n")), "near")
    last = roots(held.where("form IS NOT NULL"))
    return held.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(common.documents(spark, sf_dir))
