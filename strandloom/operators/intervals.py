"""Half-open genomic intervals (chrom, start0, end1): overlap joins and interval set algebra.

Overlap joins deal both sides to buckets of positions and join on (keys, bucket), so that the join is an equi
join on many keys; a pair is found in the bucket that holds the larger of the two starts, so it appears once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .running import previous, running, stretch
from .shared import BROADCAST_ROWS, sized_join, written

BUCKET = 2048

#: Positions that a task of a look-up holds, and rows that it lets pass, on average.
PART_PLACES, PART_ROWS = 500_000, 2_000_000


def _buckets(start: str, end: str, bucket: int) -> Column:
    """The buckets that a row reaches over; that of its start is the first."""
    return F.sequence(F.floor(F.col(start) / bucket), F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / bucket))


def _roles(df: DataFrame, start: str, end: str, bucket: int, point: bool, prefix: str) -> DataFrame:
    """df once as a point, in the bucket of its start, and once in each bucket that it reaches over; `point` is what _point says of the former."""
    at = lambda k, is_point: F.struct(k.alias(f"{prefix}bucket"), F.lit(is_point).alias(f"{prefix}point"))
    reach = F.transform(_buckets(start, end, bucket), lambda k: at(k, not point))
    return df.withColumn("_roles", F.explode(F.concat(F.array(at(F.floor(F.col(start) / bucket), point)), reach))).select(*(f"`{c}`" for c in df.columns), "_roles.*")


def _met(left: DataFrame, right: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows with equal keys, both sides dealt by them: with many pairs for a row, work is spread by keys, not by the files that the rows are in."""
    return left.hint("merge").join(right, reduce(lambda x, y: x & y, [F.col(k) == F.col(v) for k, v in on.items()]))


def _hit() -> Column:
    return (F.col("start0") < F.col("b_end1")) & (F.col("b_start0") < F.col("end1"))


def overlap_pairs(a: DataFrame, b: DataFrame, keys: tuple = ("chrom",), bucket: int = BUCKET) -> DataFrame:
    """Every overlapping pair, once: the columns of a, those of b as b_<name>, and the bases they share.

    Of a pair, the start of one row lies in the other: the later start is a point, looked up among the rows that reach
    over its bucket. Points of a meet rows of b that start before, points of b rows of a that start there or before.
    """
    left = _roles(a, "start0", "end1", bucket, True, "_")
    right = _roles(b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns)), "b_start0", "b_end1", bucket, False, "_b_")
    joined = _met(left, right, {k: f"b_{k}" for k in keys} | {"_bucket": "_b_bucket", "_point": "_b_point"})
    later = (F.col("b_start0") < F.col("start0")) == F.col("_point")
    return joined.where(_hit() & later).drop("_bucket", "_b_bucket", "_point", "_b_point").withColumn("overlap_bp", F.least("end1", "b_end1") - F.greatest("start0", "b_start0"))


def overlap_semi(a: DataFrame, b: DataFrame, keys: tuple = ("chrom",)) -> DataFrame:
    """The rows of a that overlap some row of b, each as often as a has it. No pair is made."""
    return overlap_count(a, b, keys=keys, name="_overlaps").where("_overlaps > 0").drop("_overlaps")


def overlap_anti(a: DataFrame, sets: list[DataFrame], keys: tuple = ("chrom",)) -> DataFrame:
    """The rows of a that overlap no row of any of the sets, each as often as a has it; a row with a null key overlaps none."""
    union = reduce(DataFrame.unionByName, [s.select(*keys, "start0", "end1") for s in sets])
    return overlap_count(a, union, keys=keys, name="_overlaps").where("_overlaps = 0").drop("_overlaps")


def overlap_left(a: DataFrame, b: DataFrame, keys: tuple = ("chrom",)) -> DataFrame:
    """Every row of a with each row of b that it overlaps, or with nulls and 0 bases. Rows of a need no key of their own."""
    pairs = overlap_pairs(a, b, keys)
    alone = overlap_anti(a, [b], keys).withColumn("overlap_bp", F.lit(0).cast(pairs.schema["overlap_bp"].dataType))
    return pairs.unionByName(alone, allowMissingColumns=True)


def overlap_sums(a: DataFrame, b: DataFrame, kinds: dict[str, Column], keys: tuple = ("chrom",)) -> DataFrame:
    """a with a sum for each of kinds over the rows of b that it overlaps: name -> which rows count, or a whole number of each; every row of a returns once, whatever repeats.

    No pair is made: the rows of b that start before a row's end, less those that end at its start or before, are what
    it overlaps. b is counted by position first, both numbers are running sums over the positions of both sides, and
    the rows of a look up their two ends, so work grows with the rows and a window holds a stretch's positions at most.
    Rows of a are not sorted: a task holds the positions of its part, whose number grows with both tables, and lets the
    rows pass. Rows of both sides are not empty.
    """
    event = lambda at, end: F.struct(F.col(at).cast("long").alias("_at"), F.lit(end).alias("_end"))
    names = [f"_k{i}" for i in range(len(kinds))]
    told = b.dropna(subset=[*keys, "start0", "end1"]).select(*keys, *(F.coalesce(k.cast("long"), F.lit(0)).alias(n) for n, k in zip(names, kinds.values())), F.explode(F.array(event("start0", False), event("end1", True))).alias("_e"))
    told = told.select(*keys, "_e._at", *(F.when(F.col("_e._end") == end, F.col(n)).otherwise(0).alias(n + "se"[end]) for n in names for end in (False, True)), F.lit(0).cast("long").alias("_asked"))
    # The positions that rows of a have are bits of 64 at a time, so that a task need not hold each of them.
    asked = a.select(*keys, F.explode(F.array(F.col("start0").cast("long"), F.col("end1").cast("long"))).alias("_at")).dropna()
    asked = asked.groupBy(*keys, F.floor(F.col("_at") / 64).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(pmod(_at, 64) AS INT))")).alias("_bits"), F.count("*").alias("_n"))
    asked = asked.select(*keys, "_word", "_n", F.posexplode(F.expr("filter(sequence(0, 63), i -> getbit(_bits, i) = 1)")).alias("_i", "_bit"))
    asked = asked.select(*keys, (F.col("_word") * 64 + F.col("_bit")).alias("_at"), *(F.lit(0).cast("long").alias(n + e) for n in names for e in "se"), F.when(F.col("_i") == 0, F.col("_n")).otherwise(0).alias("_asked"))
    places = told.unionByName(asked).repartition(*keys, "_at").groupBy(*keys, "_at").agg(*(F.sum(c).alias(c) for c in (*(n + e for n in names for e in "se"), "_asked")))
    places = written(places, "places")
    sums = running(stretch(places, F.col("_at")), keys, ["_at"], {f"{n}{e}_": ("sum", F.col(n + e)) for n in names for e in "se"})
    # Starts before a position, ends up to it.
    sums = written(sums.select(*keys, "_at", "_asked", *((F.col(f"{n}s_") - F.col(f"{n}s")).alias(f"{n}s") for n in names), *(F.col(f"{n}e_").alias(f"{n}e") for n in names)), "sums")
    size = sums.agg(F.count("*").alias("places"), F.coalesce(F.sum("_asked"), F.lit(0)).alias("ends")).first()
    few = size["places"] <= BROADCAST_ROWS
    parts = max(a.sparkSession.sparkContext.defaultParallelism, -(-size["places"] // PART_PLACES), -(-size["ends"] // (2 * PART_ROWS)))
    side = lambda at, e: sums.select(*keys, F.col("_at").alias(at), F.struct(*(n + e for n in names)).alias(f"_{e}"))
    both = a.withColumns({"_from": F.col("start0").cast("long"), "_to": F.col("end1").cast("long")})
    for at, e in (("_from", "e"), ("_to", "s")):
        own, told = (both, F.broadcast(side(at, e))) if few else (both.repartition(parts, *keys, at), side(at, e).hint("shuffle_hash"))
        both = own.join(told, [*keys, at], "left")
    # A row without keys or ends overlaps nothing.
    return both.select(*(f"`{c}`" for c in a.columns), *(F.coalesce(F.col(f"_s.{n}s") - F.col(f"_e.{n}e"), F.lit(0)).cast("long").alias(k) for n, k in zip(names, kinds)))


def overlap_count(a: DataFrame, b: DataFrame, keys: tuple = ("chrom",), name: str = "n") -> DataFrame:
    """A with the number of rows of b that each row overlaps; every row of a returns once, whatever repeats."""
    return overlap_sums(a, b, {name: F.lit(True)}, keys)


def overlap_first(a: DataFrame, b: DataFrame, by: list[str], order: list[str], keys: tuple = ("chrom",)) -> DataFrame:
    """The key of each overlapping row of a with the first row of b in the given order.

    In an order by start0 first, no pair is made: of the rows of b that end behind a row's start the first one starts
    before the row's end, or none does. It is a running minimum from the last end on, over one row for each end.
    """
    if order[0] != "start0":
        pairs = overlap_pairs(a, b, keys)
        return pairs.groupBy(*by).agg(F.min(F.struct(*(F.col(f"b_{c}") for c in order))).alias("first")).select(*by, "first.*")
    value = F.struct(*(F.col(c).alias(f"b_{c}") for c in order))
    told = b.dropna(subset=[*keys, "start0", "end1"]).groupBy(*keys, (-F.col("end1")).cast("long").alias("_at")).agg(F.min(value).alias("_v"))
    asked = a.dropna(subset=[*keys, "start0", "end1"]).select(*keys, (-F.col("start0")).cast("long").alias("_at")).distinct()
    places = stretch(asked.withColumn("_asked", F.lit(True)).join(told, [*keys, "_at"], "full"), F.col("_at"))
    # Ends at a row's start are not behind it.
    first = running(places, keys, ["_at"], {"_first": ("min", F.col("_v"))}, inclusive=False).where("_asked AND _first IS NOT NULL").select(*keys, "_at", "_first")
    hit = a.withColumn("_at", (-F.col("start0")).cast("long")).join(first, [*keys, "_at"]).where("_first.b_start0 < end1")
    return hit.groupBy(*by).agg(F.min("_first").alias("first")).select(*by, "first.*")


#: Positions of a tile in which rows that reach over a position are looked up.
REACH_TILE = 4096


def _reaching(keys: tuple):
    def run(asked, rows):
        import numpy as np

        asked = asked.sort_values("_a", kind="stable")
        s, e, n = (rows[c].to_numpy() for c in ("_s", "_e", "_n"))
        order = np.argsort(s, kind="stable")
        s, e, n = s[order], e[order], n[order]
        out, last, cum, some = [], None, None, None
        for a, rank in zip(asked["_a"].to_numpy(), asked["_rank"].to_numpy()):
            if a != last:
                low, high = np.searchsorted(s, [a - int((e - s).max()), a])
                some = low + np.flatnonzero(e[low:high] > a)
                last, cum = a, n[some].cumsum()
            out.append(s[some[np.searchsorted(cum, rank, side="right")]])
        return asked.assign(_p=out)[[*keys, "_a", "_rank", "_p"]]

    return run


def overlap_median(a: DataFrame, b: DataFrame, name: str = "median", keys: tuple = ("chrom",)) -> DataFrame:
    """a with `n`, the number of rows of b that each row overlaps, and the median of their starts less the row's (null: none). No pair is made.

    By start, the rows of b that reach over a row's start come first, then those that start in it. In the order of all
    starts of b the latter stand together, from the number of ends up to the row's start on, so the rows at the middle
    are looked up by rank. Where the middle falls among the former, as for rows shorter than those of b, a tile with
    equal rows of b counted finds them. Rows of both sides are not empty.
    """
    own = a.dropna(subset=[*keys, "start0", "end1"]).select(*keys, F.col("start0").cast("long").alias("start0"), F.col("end1").cast("long").alias("end1")).distinct()
    given = b.dropna(subset=[*keys, "start0", "end1"]).select(*keys, F.col("start0").cast("long").alias("_s"), F.col("end1").cast("long").alias("_e"))
    event = lambda c, end: F.struct(F.col(c).alias("_at"), F.lit(end).alias("_end"))
    counts = given.select(*keys, F.explode(F.array(event("_s", 0), event("_e", 1))).alias("_x")).groupBy(*keys, "_x._at").agg(F.count_if(F.col("_x._end") == 0).alias("s"), F.count_if(F.col("_x._end") == 1).alias("e"))
    asked = own.select(*keys, F.explode(F.array("start0", "end1")).alias("_at")).distinct()
    places = stretch(asked.join(counts, [*keys, "_at"], "full").fillna(0, ["s", "e"]), F.col("_at"))
    # Up to a place: starts, ends.
    sums = written(running(places, keys, ["_at"], {"_st": ("sum", F.col("s")), "_en": ("sum", F.col("e"))}).select(*keys, "_at", "s", "_st", "_en"), "sums")
    at_start = sums.select(*keys, F.col("_at").alias("start0"), (F.col("_st") - F.col("s")).alias("_sa"), F.col("_en").alias("_ea"))
    at_end = sums.select(*keys, F.col("_at").alias("end1"), (F.col("_st") - F.col("s")).alias("_sb"))
    told = own.join(at_start, [*keys, "start0"]).join(at_end, [*keys, "end1"]).select(*keys, "start0", "end1", "_ea", (F.col("_sb") - F.col("_ea")).alias("n"), (F.col("_sa") - F.col("_ea")).alias("_over"))
    told = written(told.where("n > 0").withColumn("_rank", F.explode(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2")))), "ranks")
    # Ranks from 0 among all starts: the last place with no more starts before it holds it.
    by_rank = told.where("_rank >= _over").withColumn("_r", F.col("_ea") + F.col("_rank"))
    within = asof_backward(by_rank, sums.where("s > 0").select(*keys, (F.col("_st") - F.col("s")).alias("_r"), "_at"), ["_at"], keys, at="_r", b_at="_r").select(*keys, "start0", "end1", "n", F.col("b__at").alias("_p"))
    over = told.where("_rank < _over")
    tile = lambda c: F.floor(c / REACH_TILE)
    wanted = over.select(*keys, F.col("start0").alias("_a"), "_rank").distinct().withColumn("_tile", tile(F.col("_a")))
    rows = given.groupBy(*keys, "_s", "_e").agg(F.count("*").alias("_n")).withColumn("_tile", F.explode(F.sequence(tile(F.col("_s") + 1), tile(F.col("_e") - 1)))).where("_s + 1 < _e")
    rows = rows.join(wanted.select(*keys, "_tile").distinct(), [*keys, "_tile"], "left_semi")
    kind = ", ".join([*(f"`{k}` {own.schema[k].dataType.simpleString()}" for k in keys), "_a long, _rank long, _p long"])
    found = wanted.groupBy(*keys, "_tile").cogroup(rows.groupBy(*keys, "_tile")).applyInPandas(_reaching(keys), kind)
    reached = over.withColumn("_a", F.col("start0")).join(found, [*keys, "_a", "_rank"]).select(*keys, "start0", "end1", "n", "_p")
    middle = within.unionByName(reached).groupBy(*keys, "start0", "end1").agg(F.max("n").alias("n"), (F.avg("_p") - F.col("start0")).alias(name))
    return a.join(middle, [*keys, "start0", "end1"], "left").fillna(0, ["n"])


#: Positions of a tile in which largest values are found.
TILE = 65_536


def _blocks(df: DataFrame, keys: tuple) -> DataFrame:
    """df once for each of the two blocks of 2^_k positions from _p on that cover its part of a tile."""
    own = df.dropna(subset=[*keys, "start0", "end1"]).where("start0 < end1")
    own = own.withColumn("_tile", F.explode(F.sequence(F.floor(F.col("start0") / TILE), F.floor((F.col("end1") - 1) / TILE))))
    low, high = F.greatest(F.col("start0") - F.col("_tile") * TILE, F.lit(0)), F.least(F.col("end1") - F.col("_tile") * TILE, F.lit(TILE))
    own = own.withColumns({"_low": low, "_high": high}).withColumn("_k", F.length(F.bin(F.col("_high") - F.col("_low"))) - 1)
    return own.withColumn("_p", F.explode(F.array_distinct(F.array(F.col("_low"), F.col("_high") - F.expr("shiftleft(1L, _k)"))))).drop("_low", "_high")


def _largest(values: list[str], keys: tuple):
    def run(pdf):
        import numpy as np

        k, p, told = pdf["_k"].to_numpy(), pdf["_p"].to_numpy(), pdf["_told"].to_numpy()
        want = pdf[~told]
        out = want[[*keys, "_tile", "_k", "_p"]].astype({c: object for c in keys})
        for v in values:
            x = pdf[v].to_numpy(dtype=float)
            top = int(k.max())
            level = np.full(TILE, -np.inf)
            # Each block's value goes to its halves, down to single positions.
            for j in range(top, -1, -1):
                here = told & (k == j) & ~np.isnan(x)
                np.maximum.at(level, p[here], x[here])
                if j:
                    half, lower = 1 << (j - 1), level.copy()
                    lower[half:] = np.maximum(lower[half:], level[: TILE - half])
                    level = lower
            found, wk, wp = np.full(len(want), -np.inf), want["_k"].to_numpy(), want["_p"].to_numpy()
            for j in range(top + 1):
                here = wk == j
                found[here] = level[wp[here]]
                level = np.concatenate([np.maximum(level[: TILE - (1 << j)], level[1 << j :]), level[TILE - (1 << j) :]])
            out[v] = [None if f == -np.inf else f for f in found]
        return out

    return run


def overlap_max(a: DataFrame, b: DataFrame, by: list[str], values: dict[str, Column], keys: tuple = ("chrom",)) -> DataFrame:
    """(by, a double for each of values): the largest known value of the rows of b that overlap a's rows; only where some row does.

    No pair is made: rows are not empty, so they overlap if they share a position. Each side is cut at tiles into blocks
    of a power of two, of which a tile has as many as it has positions, times their sizes. b's values go down to single
    positions, and a's rows look up the largest value of their blocks. Null and NaN values are left out.
    """
    told = _blocks(b.select(*keys, "start0", "end1", *(F.nanvl(v.cast("double"), F.lit(None).cast("double")).alias(n) for n, v in values.items()), F.lit(0.0).alias("_hit")), keys)
    at, names = [*keys, "_tile", "_k", "_p"], [*values, "_hit"]
    rows = _blocks(a.select(*dict.fromkeys([*by, *keys, "start0", "end1"])), keys)
    told = told.groupBy(*at).agg(*(F.max(n).alias(n) for n in names)).withColumn("_told", F.lit(True))
    both = told.unionByName(rows.select(*at).distinct().withColumn("_told", F.lit(False)), allowMissingColumns=True)
    kind = ", ".join(f"`{c}` {both.schema[c].dataType.simpleString()}" for c in [*at, *names])
    found = both.groupBy(*keys, "_tile").applyInPandas(_largest(names, keys), kind).where("_hit IS NOT NULL")
    met = rows.select(*dict.fromkeys([*by, *at])).join(found, at)
    return met.groupBy(*by).agg(*(F.max(n).alias(n) for n in values))


def overlap_within(a: DataFrame, b: DataFrame, keys: tuple = ("chrom",)) -> DataFrame:
    """Pairs in which the row of a lies wholly in that of b, so that a's start is in a bucket that b's row reaches over."""
    left = a.withColumn("_bucket", F.floor(F.col("start0") / BUCKET))
    right = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns)).withColumn("_b_bucket", F.explode(_buckets("b_start0", "b_end1", BUCKET)))
    joined = _met(left, right, {k: f"b_{k}" for k in keys} | {"_bucket": "_b_bucket"})
    return joined.where(_hit() & F.expr("b_start0 <= start0 AND end1 <= b_end1")).drop("_bucket", "_b_bucket").withColumn("overlap_bp", F.least("end1", "b_end1") - F.greatest("start0", "b_start0"))


def overlap_clip(a: DataFrame, b: DataFrame, keys: tuple = ("chrom",)) -> DataFrame:
    """The shared piece of each pair."""
    return overlap_pairs(a, b, keys).withColumn("start0", F.greatest("start0", "b_start0")).withColumn("end1", F.least("end1", "b_end1"))


def asof_backward(a: DataFrame, b: DataFrame, value: list[str], keys: tuple = ("chrom",), at: str = "start0", b_at: str = "start0", strict: bool = False) -> DataFrame:
    """Each row of a with the columns `value` of the latest row of b at or before it (before it: strict).

    Of rows of b at one place the one with the largest value holds, so the latest is the running maximum of (place, value).
    """
    side = F.struct(F.col(b_at).cast("long").alias("_at"), F.struct(*(F.col(c) for c in value)).alias("v"))
    kind = b.select(side).schema[0].dataType
    left = a.withColumn("_at", F.col(at).cast("long")).withColumn("_rank", F.lit(0 if strict else 1)).withColumn("_v", F.lit(None).cast(kind)).withColumn("_row", F.lit(True))
    right = b.select(*keys, F.col(b_at).cast("long").alias("_at"), F.lit(1 if strict else 0).alias("_rank"), side.alias("_v"), F.lit(False).alias("_row"))
    both = stretch(left.unionByName(right, allowMissingColumns=True), F.col("_at"))
    last = running(both, keys, ["_at", "_rank"], {"_last": ("max", F.col("_v"))})
    return last.where("_row").select(*a.columns, *(F.col(f"_last.v.{c}").alias(f"b_{c}") for c in value))


def pairs_within_distance(a: DataFrame, at: str, most: int, keys: tuple = ("chrom",)) -> DataFrame:
    """Ordered pairs (a, b) of one chromosome with 0 < distance < most, found in neighbouring buckets of `most`."""
    left = a.withColumn("_bucket", F.explode(F.array(F.floor(F.col(at) / most), F.floor(F.col(at) / most) + 1)))
    right = a.select(*(F.col(c).alias(f"b_{c}") for c in a.columns)).withColumn("_b_bucket", F.floor(F.col(f"b_{at}") / most))
    gap = F.col(f"b_{at}") - F.col(at)
    joined = _met(left, right, {k: f"b_{k}" for k in keys} | {"_bucket": "_b_bucket"})
    return joined.where((gap > 0) & (gap < most)).drop("_bucket", "_b_bucket").withColumn("distance", gap)


def sums_within_distance(a: DataFrame, at: str, most: int, keys: tuple = ("chrom",)) -> DataFrame:
    """A with `n`, the number of its rows with 0 < distance < most behind each, and `distance`, the sum of those; no pair is made."""
    place = F.col(at).cast("long")
    spans = a.withColumns({"_row": F.struct(*(f"`{c}`" for c in a.columns)), "start0": place + 1, "end1": place + max(most, 1)}).select(*keys, "_row", "start0", "end1")
    points = a.select(*keys, place.alias("start0"), (place + 1).alias("end1"))
    told = overlap_sums(spans, points, {"_n": F.lit(True), "_d": F.col("start0")}, keys)
    return told.select("_row.*", F.col("_n").alias("n"), F.coalesce(F.col("_d") - F.col("_n") * (F.col("start0") - 1), F.lit(0)).alias("distance"))


def viewport(df: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Rows of one window; on sorted Parquet the filter prunes row groups."""
    return df.where((F.col("chrom") == chrom) & (F.col("start0") < end) & (F.col("end1") > start))


def liftover_points(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """Points (chrom, pos) through chain blocks (chrom, start0, end1, t_chrom, t_start0, t_strand). A point is dealt once, to its bucket."""
    spans = points.withColumn("start0", F.col("pos")).withColumn("end1", F.col("pos") + 1)
    pairs = overlap_within(spans, blocks)
    off = F.col("pos") - F.col("b_start0")
    size = F.col("b_end1") - F.col("b_start0")
    return pairs.select(*points.columns, F.col("b_t_chrom").alias("t_chrom"), F.when(F.col("b_t_strand") == "-", F.col("b_t_start0") + size - 1 - off).otherwise(F.col("b_t_start0") + off).alias("t_pos"))


def make_windows(sizes: DataFrame, width: int) -> DataFrame:
    """Fixed windows of each chromosome (chrom, length); the last one is clipped."""
    return sizes.where("length > 0").select("chrom", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(width))).alias("start0")).select("chrom", F.col("start0").cast("long").alias("start0"), F.least(F.col("start0") + width, F.col("length")).cast("long").alias("end1"))


def islands(df: DataFrame, gap: int = 0, keys: tuple = ("chrom",)) -> DataFrame:
    """df with `island`, counted within keys: rows join while start0 <= the largest end so far + gap (gap -1: overlap only)."""
    order = ["start0", "end1"]
    reach = running(stretch(df, F.col("start0")), keys, order, {"_reach": ("max", F.col("end1"))}, inclusive=False)
    new = F.when(F.col("_reach").isNull() | (F.col("start0") > F.col("_reach") + gap), 1).otherwise(0)
    return running(reach.withColumn("_new", new), keys, order, {"island": ("sum", F.col("_new"))}).drop("_new", "_reach", "_stretch")


def merge_intervals(df: DataFrame, gap: int = 0, aggs: list[Column] = (), keys: tuple = ("chrom",)) -> DataFrame:
    """Merged intervals with aggregates over what each holds."""
    return islands(df, gap, keys).groupBy(*keys, "island").agg(F.min("start0").alias("start0"), F.max("end1").alias("end1"), *aggs).drop("island")


def complement(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """The gaps between merged regions, both ends of each chromosome and whole chromosomes without a region.

    The ends are empty regions of their own; before each region lies a gap from the largest end so far.
    """
    ends = sizes.select("chrom", F.explode(F.array(F.lit(0).cast("long"), F.col("length").cast("long"))).alias("start0")).withColumn("end1", F.col("start0"))
    both = df.join(sizes, "chrom", "left_semi").select("chrom", "start0", "end1").union(ends.select("chrom", "start0", "end1"))
    reach = running(stretch(both, F.col("start0")), ("chrom",), ["start0", "end1"], {"_reach": ("max", F.col("end1"))}, inclusive=False)
    inside = reach.join(sizes, "chrom").select("chrom", F.col("_reach").alias("start0"), F.least("start0", "length").alias("end1"))
    return inside.where("start0 < end1")


def split_at_bins(df: DataFrame, width: int, extend: Column | int = 0) -> DataFrame:
    """I4: each run cut at bin borders; each piece's end is then extended."""
    slot = F.explode(F.sequence(F.floor(F.col("start0") / width), F.floor((F.col("end1") - 1) / width)))
    cut = df.where("start0 < end1").withColumn("_slot", slot)
    ext = F.lit(extend) if isinstance(extend, int) else extend
    return cut.withColumn("_s", F.greatest("start0", F.col("_slot") * width)).withColumn("end1", F.least("end1", (F.col("_slot") + 1) * width) + ext).withColumn("start0", F.col("_s")).drop("_s", "_slot")


def covered(df: DataFrame) -> DataFrame:
    """One row: bases covered."""
    return merge_intervals(df.select("chrom", "start0", "end1")).agg(F.coalesce(F.sum(F.col("end1") - F.col("start0")), F.lit(0)).alias("bp"))


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: shared bases, bases of either, and their ratio."""
    one, two = (merge_intervals(x.select("chrom", "start0", "end1")) for x in (a, b))
    both = overlap_pairs(one, two).agg(F.coalesce(F.sum("overlap_bp"), F.lit(0)).alias("intersection_bp"))
    total = one.union(two).agg(F.coalesce(F.sum(F.col("end1") - F.col("start0")), F.lit(0)).alias("sum_bp"))
    union = F.col("sum_bp") - F.col("intersection_bp")
    return both.crossJoin(total).select("intersection_bp", union.alias("union_bp"), F.when(union > 0, F.col("intersection_bp") / union).alias("jaccard"))


def run_length_group(df: DataFrame, value: str, aggs: list[Column], keys: tuple = ("chrom",), order: str = "start0") -> DataFrame:
    """I8: consecutive rows with one value collapse to their range."""
    known = previous(stretch(df, F.col(order)), keys, [order], "_prev", F.col(value))
    change = F.when(F.col("_prev").isNotNull() & F.col("_prev.v").eqNullSafe(F.col(value)), 0).otherwise(1)
    runs = running(known.withColumn("_c", change), keys, [order], {"_run": ("sum", F.col("_c"))})
    return runs.groupBy(*keys, "_run", value).agg(F.min("start0").alias("start0"), F.max("end1").alias("end1"), *aggs).drop("_run")


def tss_flanks(genes: DataFrame, length: int = 1000) -> DataFrame:
    """Windows of `length` before the start of each gene and in its body, mirrored on the minus strand; tss1 is 1-based."""
    plus = F.col("strand") == "+"
    up = F.struct(F.lit("up").alias("side"), F.when(plus, F.col("start0") - length).otherwise(F.col("end1")).alias("w_start0"), F.when(plus, F.col("start0")).otherwise(F.col("end1") + length).alias("w_end1"))
    down = F.struct(F.lit("down").alias("side"), F.when(plus, F.col("start0")).otherwise(F.col("end1") - length).alias("w_start0"), F.when(plus, F.col("start0") + length).otherwise(F.col("end1")).alias("w_end1"))
    tss1 = F.when(plus, F.col("start0") + 1).otherwise(F.col("end1"))
    return genes.withColumn("_w", F.explode(F.array(up, down))).select("name", "chrom", "strand", F.col("_w.side").alias("side"), F.col("_w.w_start0").alias("start0"), F.col("_w.w_end1").alias("end1"), tss1.alias("tss1"))
