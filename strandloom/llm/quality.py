"""Quality rules: an n-gram log-likelihood ratio between a trusted target and the raw corpus, by DataFrame functions alone.

Words and word pairs are hashed into two tables of cells and counted over the trusted documents (labelled quality 1) and
over all documents. The number of cells of a table grows with the square root of the corpus, as vocabularies do, so the
tables gather more as the input grows and stay far smaller than it. An occurrence of an n-gram weighs
log((target + SMOOTH) / (expected + SMOOTH)), where expected is the raw count times the trusted share of all n-grams, both
without the occurrence itself: trusted documents don't vouch for themselves, and what occurs once says nothing. A
document's score is the mean weight of its n-grams. It is kept if the base rules pass and its score is at least that
which KEPT of the trusted documents that pass them reach.

The weights reach the tasks as arrays, at most TURN_CELLS cells of each table in one turn; larger tables take several
turns over the documents, whose sums are added.

Cases: a null or empty text has no words and fails the base rules; very long texts are read whole in one row; repeated
rows count and return as often as they occur, and rows that tie at the threshold are all kept; labels may repeat a doc_id
(the best label holds), hold null doc_ids (unused) or be empty (then scores are 0 and the base rules decide); an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

#: Added to the counts in the target and to those expected.
SMOOTH = 1.0
#: Cells of a table for each square root of the corpus's characters.
CELLS = 16
#: Cells of each table that one turn hands to the tasks: 8 bytes each.
TURN_CELLS = 1 << 22
BLOCK = 1024
#: The share of the trusted documents that the threshold lets pass, and the width of the histogram it is read from.
KEPT, STEP = 0.99, 1e-4
MIN_WORDS = 50

SPACE = "\\x20\\x09-\\x0D"
BLANKS = " \t\n\x0b\x0c\r"


def words() -> F.Column:
    bare = F.btrim("text", F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+"))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with k1 and k2, which stand for a document while its words are apart: rows with the same doc_id and text are one."""
    return docs.withColumns({"k1": F.coalesce("doc_id", F.lit(0)), "k2": F.xxhash64("text", F.col("doc_id").isNull())})


def marked(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """docs with t, 1 for the trusted ones. trusted: distinct doc_ids."""
    side = trusted.select(F.col("doc_id").alias("t_id"), F.lit(1).alias("t"))
    return common.small_join(docs.withColumn("t_id", F.col("doc_id")), side, "t_id", "left").drop("t_id").withColumn("t", F.coalesce("t", F.lit(0)))


def table_cells(docs: DataFrame) -> int:
    """Cells of each table: a power of two near CELLS times the square root of the corpus's characters."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(BLOCK, 1 << math.ceil(math.log2(CELLS * math.sqrt(chars) + 1)))


def ngrams(x: DataFrame, cells: int) -> DataFrame:
    """x (words, any others) with a row for each word: `at`, its place, its cell c1, and c2, that of it and the next word (null for the last)."""
    x = x.select("*", F.posexplode_outer("words").alias("at", "word"))
    mask = lambda h: h.bitwiseAND(cells - 1).cast("int")
    following = F.get("words", F.col("at") + 1)
    return x.withColumns({"c1": F.when(F.col("at").isNotNull(), mask(F.xxhash64("word"))), "c2": F.when(following.isNotNull(), mask(F.xxhash64("word", following)))})


def weights(docs: DataFrame, cells: int) -> DataFrame:
    """(block, own, others): the weights of each block of cells, for n-grams of trusted documents and of others.

    docs: text, t. Blocks of words come first, then those of pairs.
    """
    x = ngrams(docs.select("t", words().alias("words")), cells)
    cell = F.explode(F.array("c1", F.col("c2") + cells)).alias("cell")
    counts = x.select("t", cell).where("cell IS NOT NULL").groupBy("cell").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    counts = common.stash(counts, "counts")
    # One number for each table.
    share = {r[0]: (r[1] or 0) / r[2] for r in counts.groupBy((F.col("cell") >= cells).alias("pairs")).agg(F.sum("target"), F.sum("raw")).collect()}
    of = F.when(F.col("cell") >= cells, float(share.get(True, 0.0))).otherwise(float(share.get(False, 0.0)))
    expected = (F.col("raw") - 1) * of + SMOOTH
    weight = lambda target: F.log((target + SMOOTH) / expected).cast("float") if any(share.values()) else F.lit(0.0).cast("float")
    both = counts.select("cell", weight(F.greatest(F.col("target") - 1, F.lit(0))).alias("own"), weight(F.col("target")).alias("others"))
    grid = docs.sparkSession.range(2 * cells).select(F.col("id").alias("cell")).join(both, "cell", "left").fillna(0.0)
    place = F.shiftright("cell", int(math.log2(BLOCK))).alias("block")
    rows = grid.groupBy(place).agg(F.sort_array(F.collect_list(F.struct("cell", "own", "others"))).alias("c"))
    return common.stash(rows.select("block", F.expr("transform(c, x -> x.own)").alias("own"), F.expr("transform(c, x -> x.others)").alias("others")), "weights")


def summed(x: DataFrame, table: DataFrame, cells: int, low: int, turn: int) -> F.Column:
    """The weight of a row's c1 and c2, as far as they lie in the cells from low on."""
    bits, total = int(math.log2(BLOCK)), F.lit(0.0)
    for name, first in (("c1", 0), ("c2", cells)):
        begin, n = (first + low) >> bits, turn >> bits
        part = table.where((F.col("block") >= begin) & (F.col("block") < begin + n))

        def weight(kind: str) -> F.Column:
            # One row: `turn` numbers of 4 bytes, in blocks. A subquery's value, unlike a joined column, is not copied into every row.
            whole = part.agg(F.transform(F.sort_array(F.collect_list(F.struct("block", kind))), lambda b: b[kind])).scalar()  # noqa: B023
            at = F.col(name) - low
            return F.get(F.get(whole, F.shiftright(at, bits)), at.bitwiseAND(BLOCK - 1))

        inside = (F.col(name) >= low) & (F.col(name) < low + turn)
        total = total + F.when(inside, F.when(F.col("t") == 1, weight("own")).otherwise(weight("others"))).otherwise(F.lit(0.0))
    return total


def measured(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(k1, k2) and FIGURES of each distinct pair of doc_id and text. docs: doc_id, text without nulls."""
    cells = table_cells(docs)
    rows = marked(keyed(docs), trusted)
    table = weights(rows.select("text", "t"), cells)
    x = rows.withColumn("words", words())
    x = x.withColumn("n_words", F.size("words").cast("long"))
    x = x.withColumn("word_chars", (F.length("text") - F.regexp_count("text", F.lit(f"[{SPACE}]"))).cast("long"))
    x = x.withColumn("n_symbols", F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long"))
    x = x.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != ""))
    x = x.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    x = x.withColumn("h3", F.expr("CASE WHEN size(words) > 3 THEN transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) ELSE cast(array() AS array<bigint>) END"))
    # Only texts with a repeated window need its places: equal windows are neighbours once sorted.
    x = x.withColumn("windows", F.expr("CASE WHEN size(array_distinct(h3)) < size(h3) THEN sort_array(transform(h3, (h, i) -> struct(h, i))) END"))
    again = "filter(zip_with(windows, slice(windows, 2, size(windows)), (a, b) -> CASE WHEN a.h = b.h THEN array(a.i, a.i + 1, a.i + 2, b.i, b.i + 1, b.i + 2) END), p -> p IS NOT NULL)"
    x = x.withColumn("n_repeat_words", F.expr(f"CASE WHEN windows IS NULL THEN 0L ELSE cast(size(array_distinct(flatten({again}))) AS bigint) END"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    turn = min(cells, TURN_CELLS)
    once = F.coalesce(F.col("at"), F.lit(0)) == 0
    parts = None
    for low in range(0, cells, turn):
        # A document's figures come with its first word; the others would only make the groups' keys wide.
        n = F.count("c1") + F.count("c2")
        of = ngrams(x.select("k1", "k2", "t", "words", *(base if not low else ())), cells)
        own = of.groupBy("k1", "k2").agg(F.sum(summed(of, table, cells, low, turn)).alias("total"), n.alias("n"), F.max("t").alias("t"), *((F.max(F.when(once, F.col(c))) if not low else F.lit(None).cast("long")).alias(c) for c in base))
        part = own if turn == cells else common.stash(own, "turn")
        parts = part if parts is None else parts.union(part)
    if turn < cells:
        parts = parts.groupBy("k1", "k2").agg(F.sum("total").alias("total"), F.max("n").alias("n"), F.max("t").alias("t"), *(F.max(c).alias(c) for c in base))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    score = F.round(F.when(F.col("n") > 0, F.col("total") / F.when(F.col("n") > 0, F.col("n"))).otherwise(F.lit(0.0)), 9)
    return parts.select("k1", "k2", *base, failed.alias("base_failed"), score.alias("score"), (F.col("t") == 1).alias("trusted"))


def threshold(figures: DataFrame) -> float:
    """The score that KEPT of the trusted documents reach, of those that pass the base rules; without any, the least of all."""
    bars = figures.where("trusted AND NOT base_failed").groupBy(F.floor(F.col("score") / STEP).alias("bar")).count().collect()
    left = sum(b["count"] for b in bars) * (1 - KEPT)
    for bar, n in sorted(map(tuple, bars)):
        left -= n
        if left < 0:
            return bar * STEP
    return float("-inf")


def kept(least: float) -> F.Column:
    return ~F.col("base_failed") & (F.col("score") >= least)


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("q")).where("q = 1 AND doc_id IS NOT NULL").select("doc_id")


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "trusted")


def judged(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(k1, k2), the base figures, base_failed, score, trusted and kept of each distinct pair of doc_id and text, written."""
    figures = common.stash(measured(docs, trusted), "figures")
    return figures.withColumn("kept", kept(threshold(figures)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.texts(common.documents(spark, sf_dir))
    x = judged(docs, trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return keyed(docs).select("doc_id", "k1", "k2").join(x, ["k1", "k2"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
