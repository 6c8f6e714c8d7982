"""Benchmark decontamination: a positional inverted index of the documents' words, by DataFrame functions alone.

The index holds (document, term, position) of every occurrence of a term that the benchmark has, written in the order of
the texts; how many postings each term has is counted over all documents. A phrase is looked up from its rarest term on:
that term's list, its positions less the term's offset in the phrase, gives the candidate starts; they are intersected
with the offset-adjusted list of the second rarest term, and what is left with the lists of the other terms, of documents
with candidates alone. Lists meet by document and position, so a frequent term or a long document is no hot key.
`phrase_matches` returns the starts of exact matches; `near_matches` those occurrences of a phrase's rarest term around
which all of its other terms lie within some words, in any order.

Terms and phrases go by 64-bit hashes of their own in the index's joins; a corpus word is compared with the benchmark's
words letter by letter before it gets one.

Cases: a null or empty text has no words (of an item: no phrase); very long texts are read whole; rows with the same doc_id
and text are one document of the index and each returned; rows of one item_id are one item, a null item_id is an item
whose id is written as an empty text; items that share a window are all counted; equally rare terms are taken by offset;
an empty benchmark hits nothing, an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common
from .quality import keyed

#: Words of a window; an item with fewer words is one window.
WINDOW = 10
#: How far the other terms of a phrase may lie from its rarest one for a proximity match.
NEAR = 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words.
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

DOC = ["k1", "k2"]


def words(text: str = "text") -> F.Column:
    return F.array_remove(F.split(F.translate(F.col(text), UPPER, LOWER), BREAK, -1), "")


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, phrase, words) of each window of each item. items: item_id, text."""
    if not 1 <= window <= 62:
        raise ValueError("a window has 1 to 62 words")
    x = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words().alias("w")).where("size(w) > 0")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))).alias("at")
    x = x.select("item_id", "w", starts).select("item_id", F.slice("w", F.col("at"), window).alias("words")).distinct()
    return x.select("item_id", F.xxhash64("words").alias("phrase"), "words")


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The index (k1, k2, term, pos), written: every occurrence of one of the terms (column word), or of any word. docs: doc_id, text, no null text."""
    x = keyed(docs).select(*DOC, F.posexplode(words()).alias("pos", "word"))
    if terms is not None:
        x = common.small_join(x, terms.select("word"), "word")
    return common.stash(x.select(*DOC, F.xxhash64("word").alias("term"), "pos"), "postings")


def plans(found: DataFrame, index: DataFrame) -> DataFrame:
    """(phrase, n, steps) of the phrases whose terms are all in the index; steps: (rows, offset, term), the rarest first."""
    lists = index.groupBy("term").agg(F.count("*").alias("rows"))
    each = found.select("phrase", "words").dropDuplicates(["phrase"]).select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("offset", "word"))
    each = each.select("phrase", "n", "offset", F.xxhash64("word").alias("term")).join(lists, "term")
    steps = each.groupBy("phrase", "n").agg(F.sort_array(F.collect_list(F.struct("rows", "offset", "term"))).alias("steps"))
    return common.stash(steps.where(F.size("steps") == F.col("n")), "plans")


def anchored(index: DataFrame, planned: DataFrame) -> DataFrame:
    """(k1, k2, at, phrase): each posting of a phrase's rarest term, `at` less the term's offset."""
    first = F.element_at("steps", 1)
    side = planned.select("phrase", first["term"].alias("term"), first["offset"].alias("offset"))
    return common.small_join(index, side, "term").select(*DOC, (F.col("pos") - F.col("offset")).alias("at"), "phrase").where("at >= 0")


def looked_up(spots: DataFrame, index: DataFrame, planned: DataFrame, low: int, high: int) -> DataFrame:
    """The spots (k1, k2, at, phrase) where the terms of the steps low to high (from 0, high excluded) stand at their offsets."""
    part = planned.select("phrase", F.slice("steps", low + 1, high - low).alias("steps"))
    terms = part.select(F.explode("steps.term").alias("term")).distinct()
    lists = common.small_join(index, terms, "term", "left_semi").select(*DOC, "pos", "term")
    want = common.small_join(spots, part, "phrase").select(*DOC, "at", "phrase", F.size("steps").alias("need"), F.posexplode_outer("steps").alias("step", "s"))
    want = want.select(*DOC, "at", "phrase", "need", "step", F.coalesce(F.col("at") + F.col("s.offset"), "at").alias("pos"), F.col("s.term").alias("term"))
    met = want.where("need > 0").join(lists, [*DOC, "pos", "term"], "left_semi")
    if high - low == 1:
        return met.select(*DOC, "at", "phrase").unionByName(want.where("need = 0").select(*DOC, "at", "phrase"))
    # Repeated rows of the table give repeated postings: a step counts once.
    seen = met.groupBy(*DOC, "at", "phrase").agg(F.bit_or(F.expr("shiftleft(1L, step)")).alias("seen"), F.max("need").alias("need"))
    return seen.where("seen = shiftleft(1L, need) - 1").select(*DOC, "at", "phrase").unionByName(want.where("need = 0").select(*DOC, "at", "phrase"))


def phrase_matches(index: DataFrame, planned: DataFrame) -> DataFrame:
    """(k1, k2, at, phrase, n) of every place where a phrase's words stand consecutively, written."""
    spots = common.stash(looked_up(anchored(index, planned), index, planned, 1, 2).distinct(), "spots")
    own = common.small_join(index, spots.select(*DOC).distinct(), DOC, "left_semi")
    rest = looked_up(spots, own, planned, 2, WINDOW + 53)
    return common.stash(common.small_join(rest.distinct(), planned.select("phrase", "n"), "phrase"), "matches")


def near_matches(index: DataFrame, planned: DataFrame, near: int = NEAR) -> DataFrame:
    """(k1, k2, at, phrase): the postings of a phrase's rarest term with an occurrence of each of its terms at most `near` words away."""
    slot = lambda at: F.floor(at / near)
    terms = planned.select("phrase", F.element_at("steps", 1).alias("first"), F.array_distinct("steps.term").alias("terms"))
    start = terms.select("phrase", F.col("first.term").alias("term"))
    spots = common.small_join(index, start, "term").select(*DOC, F.col("pos").alias("at"), "phrase").distinct()
    for low, high in ((1, 2), (2, 62)):
        part = terms.select("phrase", F.slice("terms", low + 1, high - low).alias("terms"))
        lists = common.small_join(index, part.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi").select(*DOC, "pos", "term", slot(F.col("pos")).alias("slot"))
        want = common.small_join(spots, part, "phrase").select(*DOC, "at", "phrase", F.size("terms").alias("need"), F.posexplode_outer("terms").alias("step", "term"))
        slots = F.explode(F.sequence(slot(F.col("at")) - 1, slot(F.col("at")) + 1)).alias("slot")
        met = want.where("need > 0").select("*", slots).join(lists, [*DOC, "slot", "term"]).where(F.abs(F.col("pos") - F.col("at")) <= near)
        seen = met.groupBy(*DOC, "at", "phrase").agg(F.bit_or(F.expr("shiftleft(1L, step)")).alias("seen"), F.max("need").alias("need")).where("seen = shiftleft(1L, need) - 1")
        spots = common.stash(seen.select(*DOC, "at", "phrase").unionByName(want.where("need = 0").select(*DOC, "at", "phrase")), "near")
    return spots


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of docs."""
    rows = common.texts(docs)
    found = common.stash(phrases(benchmark, window), "phrases")
    index = postings(rows, found.select(F.explode("words").alias("word")).distinct())
    matches = phrase_matches(index, plans(found, index))
    covered = matches.select(*DOC, F.explode(F.expr("sequence(at, at + n - 1)")).alias("pos")).distinct()
    hits = covered.groupBy(*DOC).agg(F.count("*").alias("n_hit"))
    held = common.small_join(matches.select(*DOC, "phrase").distinct(), found.select("phrase", "item_id"), "phrase").select(*DOC, "item_id").distinct()
    items = held.groupBy(*DOC).agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("items"))
    hit = common.stash(hits.join(items, DOC), "hits")
    counted = keyed(rows).select("doc_id", *DOC, F.size(words()).cast("long").alias("n_words"))
    ids = F.sha2(F.concat_ws(",", F.coalesce("items", F.array().cast("array<string>"))).cast("binary"), 256)
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return common.small_join(counted, hit, DOC, "left").select("doc_id", "n_words", zero("n_hit"), zero("n_items"), ids.alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminated(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_CLASS}'), []) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_CLASS}') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS p FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM g) WHERE len(w) >= n),
m AS (SELECT s.r, s.i, s.n, g.item_id FROM (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS p FROM s) s JOIN g ON g.p = s.p AND g.n = s.n),
h AS (SELECT r, COUNT(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS q FROM m) GROUP BY 1),
t AS (SELECT r, COUNT(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, COALESCE(h.n_hit, 0) AS n_hit, COALESCE(t.n_items, 0) AS n_items, sha256(COALESCE(t.ids, '')) AS items_sha256, h.r IS NOT NULL AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""
