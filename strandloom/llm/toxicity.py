"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Labelled rows whose crc32(doc_id) modulo 5 is 1 or 2 give the lexicon: words whose log-odds of occurring in toxic texts
are high, and significant by a likelihood-ratio test at a false-discovery rate. Those with 3 fit the trees, and those with 4 the calibration, so that no stage learns from
rows that an earlier one has seen; those with 0 are held out. Each fit takes a sample of at most SAMPLE rows, the ones
with the smallest hashes. Every text is then scored whole.

Features: densities of lexicon words (weighted and not, with and without obfuscation undone),
lexicon hits near second-person words, second-person density, capitals, punctuation, obfuscation, lengths.

Cases: null and empty texts have all-zero features and get the score of such; a very long text is scored whole; equal
texts tie in score, and so do all texts in one step of the calibration; repeated rows return as often as they
occur; a doc_id with several labels counts as toxic if one of them is; without labels of both classes every score is
the share of toxic labels, or 0; an empty table gives no row; other columns, lang and source are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

SAMPLE = 40_000
#: A lexicon word needs so many texts, so large a log-odds ratio, and a place under this false-discovery rate.
LEXICON_TEXTS, LEXICON_ODDS, LEXICON_FDR = 3, 1.0, 0.05
#: The lexicon's bound: like the samples of labelled rows that it is learnt from, it does not grow with the corpus.
LEXICON_WORDS = 20_000
NEAR = 4
TREES, DEPTH = 30, 4

#: Words of the second person.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine euch tu te toi ton ta tes vous votre usted tú ti tuyo".split())
#: Marks and digits that stand for letters.
UNDO = str.maketrans("013457@$!*", "oieastasi.")

TOKEN = re.compile("[^\x20\x09-\x0d]+")
EDGE = "\"'.,;:!?()[]{}<>*#%&|$-_"
ODD = re.compile(r"[A-Za-z][0-9@$!*]+[A-Za-z]")
RUN = re.compile(r"[!?]{2,}")
FEATURES = ("hits", "weight", "density", "weight_density", "undone", "undone_density", "near", "near_density", "second_density", "any", "capitals", "shouted", "marks", "runs", "odd_density", "log_words")


def plain_words(text: str) -> list[str]:
    return [w.strip(EDGE) for w in TOKEN.findall(text.lower())]


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    raw = TOKEN.findall(text)
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    words = [w.lower().strip(EDGE) for w in raw]
    at = [i for i, w in enumerate(words) if w in lexicon]
    weight = sum(lexicon[words[i]] for i in at)
    odd = [i for i, w in enumerate(raw) if ODD.search(w)] if ODD.search(text) else []
    undone = sum(u in lexicon or u.replace(".", "") in lexicon for u in (words[i].translate(UNDO) for i in odd) if u)
    second = [i for i, w in enumerate(words) if w in SECOND]
    places = set(second)
    near = sum(any(j in places for j in range(i - NEAR, i + NEAR + 1)) for i in at)
    letters = sum(map(len, words)) or 1
    capitals = sum(map(str.isupper, text))
    shouted = sum(len(w) > 2 and w.isupper() for w in raw)
    marks = sum(text.count(c) for c in "!?*#$%&@")
    return [float(len(at)), weight, len(at) / n, weight / n, float(undone), undone / n, float(near), near / n, len(second) / n, float(bool(at)), capitals / letters, shouted / n, marks / n, len(RUN.findall(text)) / n, len(odd) / n, math.log1p(n)]


def _words(batches):
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([sorted({w for w in plain_words(t) if w}) for t in batch.column("text").to_pylist()], pa.list_(pa.string()))], ["toxic", "words"])


def lexicon(rows: DataFrame) -> dict[str, float]:
    """Words that toxic texts hold more often: word -> log-odds, at most LEXICON_WORDS. rows: text, toxic."""
    total = rows.agg(F.count("*"), F.sum("toxic")).first()
    if not total[1] or total[0] == total[1]:
        return {}
    bad, good = float(total[1]), float(total[0] - total[1])
    counts = rows.select("toxic", "text").mapInArrow(_words, "toxic int, words array<string>").select("toxic", F.explode("words").alias("w")).groupBy("w").agg(F.sum("toxic").alias("b"), F.sum(1 - F.col("toxic")).alias("g"))
    b, g = F.col("b") + 0.5, F.col("g") + 0.5
    odds = F.log(b / (bad - F.col("b") + 0.5)) - F.log(g / (good - F.col("g") + 0.5))
    # G² of the table word x toxic; it is finite and high for words that no clean text holds.
    seen = F.col("b") + F.col("g")
    part = lambda o, e: F.when(o > 0, 2 * o * F.log(o / e)).otherwise(0.0)
    n = bad + good
    g2 = part(F.col("b"), seen * bad / n) + part(F.col("g"), seen * good / n) + part(bad - F.col("b"), (n - seen) * bad / n) + part(good - F.col("g"), (n - seen) * good / n)
    tested = common.stash(counts.where(seen >= LEXICON_TEXTS).select("w", odds.alias("odds"), g2.alias("g2")), "tested")
    # Benjamini-Hochberg over slots of G²; the number of slots is bounded by the size of the sample.
    slots = sorted(tuple(r) for r in tested.groupBy(F.floor(F.col("g2") * 4), (F.col("odds") > 0).cast("int")).count().collect())
    total, above, cut = sum(r[2] for r in slots), 0, None
    for slot, high, k in reversed(slots):
        above += k * high
        if slot and above and total * math.erfc(math.sqrt(slot / 8)) <= LEXICON_FDR * above:
            cut = slot / 4
    if cut is None:
        return {}
    kept = tested.where((F.col("odds") >= LEXICON_ODDS) & (F.col("g2") >= cut))
    return {r[0]: r[1] for r in kept.orderBy(F.desc("g2"), "w").limit(LEXICON_WORDS).select("w", "odds").collect()}


def _features(known: dict[str, float]):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rest = [c for c in batch.schema.names if c != "text"]
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                rows = [features(t, known) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)), pa.array(np.array(rows, dtype=np.float64).ravel()))], [*rest, "values"])

    return run


def fold() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """At most `most` rows, the ones with the smallest hashes of doc_id."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs. labels: doc_id, toxic."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    rows = common.texts(docs)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").withColumn("fold", fold()).where("fold > 0")
    chosen = None
    for k in ((1, 2), (3,), (4,)):
        own = sampled(marks.where(F.col("fold").isin(*k)), sample)
        chosen = own if chosen is None else chosen.union(own)
    # At most three samples of ids: their size is bounded.
    train = common.stash(rows.join(F.broadcast(chosen), "doc_id"), "train")
    known = lexicon(train.where("fold <= 2"))
    turn = _features(known)
    fitted = common.stash(train.where("fold > 2").mapInArrow(turn, "doc_id long, toxic int, fold long, values array<double>"), "features").select("fold", F.col("toxic").cast("double").alias("label"), array_to_vector("values").alias("features"))
    every = rows.mapInArrow(turn, "doc_id long, values array<double>").select("doc_id", array_to_vector("values").alias("features"))
    held = F.coalesce(fold() == 0, F.lit(False))
    shares = fitted.where("fold = 3").agg(F.count("*"), F.sum("label")).first()
    if not shares[0] or shares[1] in (0.0, float(shares[0])):
        base = shares[1] / shares[0] if shares[0] else 0.0
        plain = every.withColumn("score", F.lit(float(base)))
    else:
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.15, minInstancesPerNode=10, seed=7, maxBins=32).fit(fitted.where("fold = 3").coalesce(4))
        raw = lambda df: trees.transform(df).withColumn("p", vector_to_array("probability")[1])
        tuned = common.stash(raw(fitted.where("fold = 4")).select("p", "label"), "tuned")
        if tuned.limit(1).count():
            model = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="score").fit(tuned)
            plain = model.transform(raw(every).select("doc_id", "p"))
        else:
            plain = raw(every).select("doc_id", F.col("p").alias("score"))
    return plain.select("doc_id", held.alias("held_out"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
