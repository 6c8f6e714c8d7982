"""Mixing sources to target weights by entropy balancing, by DataFrame functions alone.

Sizes are words. Sources, in order of code points with null last, weigh WEIGHTS in turn and share the words of all
documents; a target stops at CAP times its source's size, and the excess goes to the others by weight.

Entropy balancing finds document rates closest to 1 in relative entropy whose expected words meet the targets. Its
convex dual has one multiplier for each source, and the rates are tilted exponentially: rate = min(CAP, exp(m * x)),
where x is the document's size over its source's mean size, bent as x / (1 + x) so that a long text is not tilted
without bound. Each Newton step is one aggregation over counts of (source, size), bracketed so that it converges.

Rates become copies in cells of about CELL documents of one source: by falling size, a document takes the whole number
of copies below or above its rate, whichever keeps the words taken so far closest to the words due. A cell's error is
at most about half of its smallest texts, and no source, however large, is handled by one task.

Cases: null and empty texts have size 0 and take 0 words; a source without words has target 0; repeated rows are
documents of their own, and equal ones are ordered by content; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common

WEIGHTS = (1, 2, 3)
#: No document, and so no source, is taken more often than this.
CAP = 3
CELL = 128
STEPS = 60
#: Largest relative miss of a target by the rates.
MISS = 1e-7


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double"))
    # Filled from the source that reaches its cap first: what is left over for the rest rises as long as one is capped.
    w = w.withColumn("limit", F.col("source_size") * float(cap)).withColumn("ratio", F.col("limit") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(Window.partitionBy()) - before) / rest
    w = w.withColumn("level", level).withColumn("rank", F.row_number().over(order))
    # The first source that stays below its cap has the level of all that do.
    w = w.withColumn("open_level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("rank", "level"))).over(Window.partitionBy())["level"])
    return w.select("source", "source_size", F.when(F.col("ratio") <= F.col("level"), F.col("limit")).otherwise(F.col("weight") * F.col("open_level")).alias("target"))


def tilts(counts: DataFrame, wanted: DataFrame, cap: int = CAP) -> DataFrame:
    """wanted (source, source_size, target) with the multiplier of each source. counts: source, size, n."""
    mean = counts.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    x = F.col("size") / F.col("mean")
    points = common.stash(counts.where("size > 0").alias("c").join(mean.alias("a"), F.col("c.source").eqNullSafe(F.col("a.source"))).select("c.source", "size", "n", (x / (1 + x)).alias("x")), "points")
    state = common.stash(wanted.withColumns({"m": F.lit(0.0), "low": F.lit(-1e6), "high": F.lit(1e6), "miss": F.lit(1.0)}), "tilts")
    for _ in range(STEPS):
        now = state.alias("s").join(points.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")), "left").withColumn("rate", F.least(F.lit(float(cap)), F.exp(F.least(F.lit(50.0), F.col("m") * F.col("x")))))
        words = F.col("n") * F.col("size") * F.col("rate")
        sums = now.groupBy("s.source", "source_size", "target", "m", "low", "high").agg(F.coalesce(F.sum(words), F.lit(0.0)).alias("got"), F.coalesce(F.sum(F.when(F.col("rate") < cap, words * F.col("x"))), F.lit(0.0)).alias("slope"))
        gap = F.col("target") - F.col("got")
        sums = sums.withColumn("low", F.when(gap > 0, F.greatest("low", "m")).otherwise(F.col("low"))).withColumn("high", F.when(gap < 0, F.least("high", "m")).otherwise(F.col("high")))
        step = F.when(F.col("slope") > 0, F.col("m") + F.greatest(F.lit(-4.0), F.least(F.lit(4.0), gap / F.when(F.col("slope") > 0, F.col("slope"))))).otherwise(F.col("m") + F.signum(gap))
        inside = (step > F.col("low")) & (step < F.col("high"))
        # Targets at 0 or at the cap have no finite multiplier; the bracket's end does.
        free = (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - MISS))
        miss = F.when(free, F.abs(gap) / F.when(F.col("target") > 0, F.col("target"))).otherwise(F.lit(0.0))
        new = F.when(F.col("target") <= 0, F.lit(-1e6)).when(~free, F.lit(1e6)).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2)
        state = common.stash(sums.select("source", "source_size", "target", new.alias("m"), "low", "high", miss.alias("miss")), "tilts")
        if not state.where(F.col("miss") > MISS).limit(1).count():
            break
    return state.alias("s").join(mean.alias("a"), F.col("s.source").eqNullSafe(F.col("a.source")), "left").select("s.source", "source_size", "target", "m", "mean")


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """docs with size, source_size, target, copies and taken; docs needs the columns doc_id, text and source."""
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long"))
    counts = common.stash(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    per = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    wanted = common.stash(targets(per.select("source", "source_size"), weights, cap), "targets")
    solved = tilts(counts, wanted, cap).alias("t").join(per.select(F.col("source").alias("s2"), "docs"), F.col("t.source").eqNullSafe(F.col("s2")))
    solved = common.stash(solved.select(F.col("t.source").alias("mix_source"), "source_size", "target", "m", "mean", "docs"), "solved")
    side = F.broadcast(solved) if solved.count() <= common.BROADCAST_ROWS else solved
    x = sized.join(side, sized["source"].eqNullSafe(F.col("mix_source")))
    z = F.col("size") / F.when(F.col("mean") > 0, F.col("mean"))
    rate = F.when(F.col("size") > 0, F.least(F.lit(float(cap)), F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(50.0), F.col("m") * z / (1 + z)))))).otherwise(F.lit(0.0))
    return x.withColumn("rate", rate)


def rounded(x: DataFrame, cap: int = CAP) -> DataFrame:
    """x (doc_id, source, size, rate, docs, name: what orders equal rows) with taken, a whole number of copies of size."""
    cell = F.pmod(F.xxhash64("doc_id", "name"), F.ceil(F.col("docs") / CELL))
    cells = x.groupBy("source", cell.alias("cell"), "source_size", "target").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("minus"), "name", "doc_id", "rate"))).alias("rows"))
    # due: words that the rates ask for so far, less the words taken; a copy more is taken if it lowers the error.
    base = "cast(floor(r.rate + 1e-9) AS bigint)"
    more = f"(s.due + (r.rate - {base}) * -r.minus >= -r.minus / 2D AND r.rate - {base} > 1e-9)"
    taken = f"-r.minus * ({base} + CASE WHEN {more} THEN 1 ELSE 0 END)"
    fold = f"aggregate(rows, struct(0D AS due, cast(array() AS array<bigint>) AS taken), (s, r) -> struct(s.due + r.rate * -r.minus - {taken} AS due, concat(s.taken, array({taken})) AS taken), s -> s.taken)"
    flat = cells.withColumn("taken", F.expr(fold)).select("source", "source_size", "target", F.explode(F.arrays_zip("rows", "taken")).alias("r"))
    return flat.select(F.col("r.rows.doc_id").alias("doc_id"), F.col("r.rows.name").alias("name"), (-F.col("r.rows.minus")).cast("long").alias("size"), "source", F.col("source_size").cast("long").alias("source_size"), "target", F.least(F.col("r.taken"), -F.col("r.rows.minus") * cap).cast("long").alias("taken"))


def named(docs: DataFrame) -> DataFrame:
    return docs.withColumn("name", F.xxhash64("text", F.coalesce("source", F.lit("")), F.col("source").isNull()))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of each row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    return rounded(named(mixed(own, weights, cap)), cap).drop("name")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")
