"""Resampling and combined tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .counts_model import normal_quantile
from .quantiles import ranked_values, value_counts
from .scalars import PRIME, hash_order, mixed
from .shared import BROADCAST_ROWS, sized_join, written


#: Replicates that are computed together.
BATCH = 500


#: Slots of the hash range in which an equal sample looks for its cut.
SLOTS = 65_536


def equal_sample(rows: DataFrame, by: list[str], n: int, order: Column, ties: list[str]) -> DataFrame:
    """Exactly n rows of each group (all of a smaller one): those first by `order`, a hash below 2^32, and then by ties.

    Counts by slots of the hash tell in which slot a group's cut lies. Slots below it are taken whole; only that slot's
    rows, a SLOTS-th of the group, are ranked. Rows without an order are left out.
    """
    own = rows.withColumn("_h", order).where("_h IS NOT NULL").withColumn("_slot", F.floor(F.col("_h") / (2**32 // SLOTS)))
    counts = own.groupBy(*by, "_slot").agg(F.count("*").alias("_c"))
    # A window over at most SLOTS counts of a group.
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("_slot"))
    cut = counts.withColumn("_to", upto).where(F.col("_to") >= n).groupBy(*by).agg(F.min(F.struct("_slot", (n - F.col("_to") + F.col("_c")).alias("need"))).alias("_cut"))
    told = sized_join(own, cut, by, "left")
    whole = told.where("_cut IS NULL OR _slot < _cut._slot")
    last = told.where("_slot = _cut._slot").withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("_h", *ties))).where("_k <= _cut.need").drop("_k")
    return whole.unionByName(last).drop("_h", "_slot", "_cut")


def bootstrap_median_ci(rows: DataFrame, by: str, value: str, key: str, sample: int = 1000, replicates: int = 1000) -> DataFrame:
    """(by, n, median, low, high): the median of at most `sample` rows of each group, with its 95 % percentile interval.

    The rows are those whose key comes first in hash order (a bounded sample is the feature). The j-th draw of a
    replicate takes the row at the mixed hash of both, modulo the rows; all replicates are computed where the group's
    array lies, so nothing is shuffled but the sample. Rows without a value are left out.
    """
    first = Window.partitionBy(by).orderBy(hash_order(F.col(key), 11), key)
    own = rows.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("v"), F.row_number().over(first).alias("k")).where(F.col("k") <= sample)
    groups = own.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("vs"))

    @F.pandas_udf("array<double>")
    def interval(groups):
        import numpy as np

        out = []
        for vs in groups:
            v, found = np.asarray(vs), []
            j = np.arange(len(v), dtype=np.int64)
            for at in range(0, replicates, BATCH):
                r = np.arange(at, min(at + BATCH, replicates), dtype=np.int64)[:, None]
                x = (j * 48271 + r * 69621) % PRIME
                h = x * x % PRIME
                found.append(np.median(v[h * h % PRIME * x % PRIME % len(v)], axis=1))
            out.append(np.quantile(np.concatenate(found), [0.025, 0.975]))
        return groups.__class__(out, dtype=object)

    size = F.size("vs")
    s = F.sort_array("vs")
    median = (s[F.floor((size - 1) / 2).cast("int")] + s[F.floor(size / 2).cast("int")]) / 2
    return groups.withColumn("q", interval("vs")).select(by, size.alias("n"), median.alias("median"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def _differences(replicates: int):
    """(d) of each relabelling of a batch. Rows: batch, and rows, an array of (v, k, a) sorted by v."""

    def run(frames):
        import numpy as np
        import pandas as pd

        for pdf in frames:
            for batch, rows in zip(pdf["batch"], pdf["rows"]):
                v = np.array([r["v"] for r in rows], dtype=float)
                k = np.array([r["k"] % PRIME for r in rows], dtype=np.int64)
                na = sum(r["a"] for r in rows)
                order = np.lexsort((v, [r["k"] for r in rows]))
                middle = lambda x: (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2
                out = []
                for r in range(batch * BATCH + 1, min((batch + 1) * BATCH, replicates) + 1):
                    x = (k * 48271 + r * 69621) % PRIME
                    h = x * x % PRIME
                    h = h * h % PRIME * x % PRIME
                    cut = np.partition(h, na - 1)[na - 1]
                    own = h < cut
                    level = order[h[order] == cut]
                    own[level[: na - int(own.sum())]] = True
                    out.append(middle(v[own]) - middle(v[~own]))
                yield pd.DataFrame({"d": out}, dtype=float)

    return run


#: Rows of a part, relabellings that a task draws for it, slots around the cut, relabellings that are finished together.
PART, DRAWN, CUT_SLOTS, FINISHED = 65_536, 12_500, 64, 50
#: Rows that are hashed for one relabelling after the other, and levels of those that are counted one by one.
CHUNK, FEW_LEVELS = 131_072, 128
#: Distinct values, and rows beside one cut, up to which relabellings are counted.
LEVELS, BESIDE = 1024, 10_000


def _hashes(k):
    """r -> mixed(r, k) for each of k, in an array that the next call changes.

    The hash is a polynomial of the fifth degree in r, modulo PRIME = 2^31 - 1: the next r takes five additions of its
    differences, the last of which is one number for all k. Any other r starts anew.
    """
    import numpy as np

    own, p, last = k % PRIME * 48271 % PRIME, np.uint32(PRIME), [None]
    high = np.empty(len(own), dtype=np.uint32)
    d: list = []

    def whole(r: int):
        x = (own + r % PRIME * 69621) % PRIME
        h = x * x % PRIME
        return h * h % PRIME * x % PRIME

    def draw(r: int):
        if r - 1 != last[0]:
            at, d[:] = [whole(r + i) for i in range(6)], []
            while at:
                d.append(at[0].astype(np.uint32))
                at = [(y - x) % PRIME for x, y in zip(at, at[1:])]
            d[5] = d[5][0] if len(own) else p
        else:
            for i in range(5):
                np.add(d[i], d[i + 1], out=d[i])
                # Below the prime the difference wraps to a large number.
                np.minimum(d[i], np.subtract(d[i], p, out=high), out=d[i])
        last[0] = r
        return d[0]

    return draw


def _rare(mask):
    """Where a mask is true; for few places, eight are looked at together."""
    import numpy as np

    if len(mask) % 8:
        return np.flatnonzero(mask)
    words = np.flatnonzero(mask.view(np.uint64) != 0)
    at = np.flatnonzero(mask.reshape(-1, 8)[words].ravel())
    return words[at >> 3] * 8 + (at & 7)


def _near_cut(low: int, width: int, replicates: int):
    """(r, n): how many hashes lie below the window [low, low + width), and in each of its slots. Rows: a part, for some relabellings."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        drawn = range(int(pdf["draw"].iloc[0]) * DRAWN + 1, min((int(pdf["draw"].iloc[0]) + 1) * DRAWN, replicates) + 1)
        k, out = pdf["k"].to_numpy(), np.zeros((len(drawn), 1 + CUT_SLOTS), dtype=np.int32)
        first, reach = np.uint32(low), np.uint32(width)
        for at in range(0, len(k), CHUNK):
            draw = _hashes(k[at : at + CHUNK])
            for i, r in enumerate(drawn):
                h = draw(r)
                inside = h[_rare(h - first < reach)].astype(np.int64) - low
                out[i, 0] += np.count_nonzero(h < first)
                out[i, 1:] += np.bincount(inside * CUT_SLOTS // width, minlength=CUT_SLOTS)
        return pd.DataFrame({"r": drawn, "n": list(out)})

    return run


def _cut_slot(na: int, low: int, width: int):
    """(r, cut_low, cut_high, need, beside): the slot in which each relabelling's cut lies, how many of its rows have the label, and its rows."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        out = []
        for r, of in pdf.groupby("r")["n"]:
            n = np.sum([np.asarray(x, dtype=np.int64) for x in of], axis=0)
            upto = n.cumsum()
            s = int(np.searchsorted(upto, na))
            # The cut is below the window or behind it: no slot.
            found = 0 < s <= CUT_SLOTS
            ends = [low + -(-k * width // CUT_SLOTS) for k in (s - 1, s)]
            out.append((r, *ends, na - upto[s - 1] if found else 0, n[s] if found else BESIDE + 1))
        return pd.DataFrame(out, columns=["r", "cut_low", "cut_high", "need", "beside"])

    return run


def _labelled(levels: int):
    """(r, n, h, k, level): rows of each level that have the label for sure, and the rows beside the cut. Rows: a part, and its relabellings' cuts."""

    def run(pdf, cuts):
        import numpy as np
        import pandas as pd

        if pdf.empty:
            return pd.DataFrame({"r": [], "n": [], "h": [], "k": [], "level": []})
        pdf, cuts = pdf.sort_values("level", kind="stable"), cuts.sort_values("r")
        every, level = pdf["k"].to_numpy(), pdf["level"].to_numpy()
        n, beside = np.zeros((len(cuts), levels), dtype=np.int32), [[] for _ in range(len(cuts))]
        cut = list(zip(cuts["r"], cuts["cut_low"].to_numpy(dtype=np.uint32), (cuts["cut_high"] - cuts["cut_low"]).to_numpy(dtype=np.uint32)))
        for at in range(0, len(every), CHUNK):
            k, own = every[at : at + CHUNK], level[at : at + CHUNK]
            some, first = np.unique(own, return_index=True)
            spans = list(zip(some.tolist(), first.tolist(), [*first[1:].tolist(), len(own)]))
            draw = _hashes(k)
            for i, (r, low, width) in enumerate(cut):
                h = draw(r)
                sure = h < low
                if len(spans) <= FEW_LEVELS:
                    for x, start, end in spans:
                        n[i, x] += np.count_nonzero(sure[start:end])
                else:
                    n[i, some] += np.add.reduceat(sure.view(np.uint8), first, dtype=np.int32)
                here = _rare(h - low < width)
                if len(here):
                    beside[i].append((h[here].astype(np.int64), k[here], own[here]))
        joined = [[np.concatenate([x[c] for x in of]) if of else np.zeros(0, dtype=np.int64) for of in beside] for c in range(3)]
        return pd.DataFrame({"r": cuts["r"].to_numpy(), "n": list(n), "h": joined[0], "k": joined[1], "level": joined[2]})

    return run


def _medians_of_levels(values: list[float], totals: list[int]):
    def run(pdf):
        import numpy as np
        import pandas as pd

        v, every, out = np.array(values), np.array(totals), []
        middle = lambda n: (v[np.searchsorted(n.cumsum(), (n.sum() - 1) // 2, side="right")] + v[np.searchsorted(n.cumsum(), n.sum() // 2, side="right")]) / 2
        for _, of in pdf.groupby("r"):
            n = np.sum([np.asarray(x, dtype=np.int64) for x in of["n"]], axis=0)
            h, k, level = (np.concatenate([np.asarray(x, dtype=np.int64) for x in of[c]]) for c in ("h", "k", "level"))
            n = n + np.bincount(level[np.lexsort((level, k, h))[: int(of["need"].iloc[0])]], minlength=len(v))
            out.append(middle(n) - middle(every - n))
        return pd.DataFrame({"d": out}, dtype=float)

    return run


def counted_relabellings(own: DataFrame, na: int, n: int, replicates: int) -> DataFrame | None:
    """(d) as relabelled returns it, from counts; None if the values or the rows beside a cut are too many for that.

    Rows are dealt to parts and a task hashes a part for some relabellings, twice: to count hashes around the cut, and to
    count the labelled rows of each value. Only the few rows in the cut's slot travel, so no row is ever shuffled for a
    relabelling, and a task holds a part however many rows there are.
    """
    counts = own.groupBy("v").agg(F.count("*").alias("n")).orderBy("v").limit(LEVELS + 1).collect()
    if len(counts) > LEVELS:
        return None
    # At most LEVELS numbers.
    codes = F.broadcast(own.sparkSession.createDataFrame([(c.v, i) for i, c in enumerate(counts)], "v double, level long"))
    parts = -(-n // PART)
    dealt = own.join(codes, "v").select("k", "level", F.pmod(F.xxhash64("k", "v"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit((replicates - 1) // DRAWN).cast("long"))).alias("draw"))
    share = na / n
    reach = 8 * (share * (1 - share) / n) ** 0.5
    low, high = max(0, int((share - reach) * PRIME)), min(PRIME, int((share + reach) * PRIME) + 1)
    near = dealt.groupBy("part", "draw").applyInPandas(_near_cut(low, high - low, replicates), "r long, n array<int>")
    batch = F.floor(F.col("r") / FINISHED)
    cuts = near.groupBy(batch.alias("_batch")).applyInPandas(_cut_slot(na, low, high - low), "r long, cut_low long, cut_high long, need long, beside long")
    cuts = written(cuts, "cuts")
    if cuts.where(F.col("beside") > BESIDE).limit(1).count():
        return None
    told = cuts.select("r", "cut_low", "cut_high", F.floor((F.col("r") - 1) / DRAWN).alias("draw"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    found = dealt.groupBy("part", "draw").cogroup(told.groupBy("part", "draw")).applyInPandas(_labelled(len(counts)), "r long, n array<int>, h array<long>, k array<long>, level array<long>")
    return found.join(cuts.select("r", "need"), "r").groupBy(batch.alias("_batch")).applyInPandas(_medians_of_levels([c.v for c in counts], [c.n for c in counts]), "d double")


def relabelled(own: DataFrame, na: int, n: int, replicates: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(d): the difference of medians under each relabelling. own: a, v, k without nulls, n rows, na of them with the label.

    Up to `limit` rows travel as one array to the tasks, each of which computes BATCH relabellings; nothing is sorted or
    shuffled for a replicate. More rows are counted by part and value; only where values or equal hashes are too many for
    that, rows are ordered for each replicate in a window.
    """
    if n <= limit:
        whole = own.agg(F.sort_array(F.collect_list(F.struct("v", "k", "a"))).alias("rows"))
        batches = own.sparkSession.range(-(-replicates // BATCH)).withColumnRenamed("id", "batch")
        spread = batches.repartition(min(-(-replicates // BATCH), 4 * own.sparkSession.sparkContext.defaultParallelism), "batch")
        return spread.crossJoin(F.broadcast(whole)).mapInPandas(_differences(replicates), "d double")
    if (counted := counted_relabellings(own, na, n, replicates)) is not None:
        return counted
    gap = lambda a: F.median(F.when(a, F.col("v"))) - F.median(F.when(~a, F.col("v")))
    order = Window.partitionBy("r").orderBy(mixed(F.col("r"), F.col("k")), "k", "v")
    reps = own.withColumn("r", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(replicates).cast("long")))).withColumn("place", F.row_number().over(order))
    return reps.groupBy("r").agg(gap(F.col("place") <= na).alias("d")).select("d")


def permutation_median_diff(rows: DataFrame, first: str, value: str, key: str, replicates: int = 99_999, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(diff, p): the difference of two groups' medians and its two-sided p-value, 2 min of the one-sided (1 + #) / (1 + R).

    A relabelling orders the rows by a hash of its number and their key (ties: by key, then value) and gives the first n
    the label. Rows with a null label, value or key are left out; where a group has no rows, both results are null.
    """
    own = rows.select(F.col(first).alias("a"), F.col(value).cast("double").alias("v"), F.col(key).cast("long").alias("k")).dropna()
    own = written(own, "labelled")
    seen = own.agg(F.count_if("a").alias("na"), F.count("*").alias("n"), (F.median(F.when(F.col("a"), F.col("v"))) - F.median(F.when(~F.col("a"), F.col("v")))).alias("diff")).first()
    if not 0 < seen.na < seen.n:
        return own.sparkSession.createDataFrame([(None, None)], "diff double, p double")
    d = F.col("d")
    tails = relabelled(own, seen.na, seen.n, replicates, limit).agg(F.count_if(d >= seen.diff).alias("up"), F.count_if(d <= seen.diff).alias("down"))
    return tails.select(F.lit(seen.diff).alias("diff"), F.least(F.lit(1.0), 2 * (1 + F.least("up", "down")) / (1 + replicates)).alias("p"))


def upper_gamma(a: float, x: float) -> float:
    """Q(a, x), the regularised upper incomplete gamma function, by its series or its continued fraction."""
    import math

    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def brown_combined(p_values: DataFrame, pairs: DataFrame) -> DataFrame:
    """(statistic, scale, df, p) of dependent tests. p_values: p; pairs: rho of each pair of tests, once."""
    tests = p_values.agg(F.sum(-2 * F.log("p")).alias("x"), F.count("*").alias("k"))
    rho = F.col("rho")
    shared = pairs.agg(F.coalesce(F.sum(3.263 * rho + 0.710 * rho * rho + 0.027 * rho * rho * rho), F.lit(0.0)).alias("cov"))
    both = tests.join(F.broadcast(shared)).withColumn("variance", 4.0 * F.col("k") + 2 * F.col("cov"))
    scaled = both.select(F.col("x").alias("statistic"), (F.col("variance") / (4 * F.col("k"))).alias("scale"), (8.0 * F.col("k") * F.col("k") / F.col("variance")).alias("df"))

    @F.pandas_udf("double")
    def tail(x, df):
        return x.combine(df, lambda u, v: upper_gamma(v / 2, u / 2))

    return scaled.withColumn("p", tail(F.col("statistic") / F.col("scale"), F.col("df")))


def qq_points(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, n, expected): each distinct value with its number and its normal quantile at the middle of its ranks.

    Ranks are running sums over slices of the counted values; null and NaN values have none.
    """
    ranks = ranked_values(written(value_counts(rows, [by], F.col(value)), "values"), [by])
    p = (F.col("_to") - F.col("_n") + F.col("_n") / 2) / F.col("_all")
    return ranks.select(by, F.col("_v").cast(rows.schema[value].dataType).alias(value), F.col("_n").alias("n"), normal_quantile(p).alias("expected"))
