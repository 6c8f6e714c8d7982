"""Chains of dinucleosomes (M11): two positioned nucleosomes about an open gap, placed best first and merged into chains.

Spark counts events by position, finds the tiles that can hold a candidate at all, and scores the chains of every stage
with joins. Candidates, choices and placements are made tile by tile, each tile with what lies within reach of its ends,
so a group is bounded by a tile's length, however deep the sequencing is and however dense the candidates are.

Best first is a matter of neighbours. A choice forbids what lies within CHOICE_REACH of it, so the best candidate within
that reach will be chosen whatever happens elsewhere: each round, tiles decide all that the candidates beyond their ends
leave certain, and the next round goes on with what is known by then. The same holds for what counts are left for a
choice: of two choices that overlap, the one that comes first in the order of the search is known from the choices
between them, and a choice is settled once those before it are. The globally best open candidate is always certain, so
every round settles some; placements equal those of one search over whole chromosomes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import intervals as iv
from .running import previous, running, stretch
from .shared import written

# Fixed values of the model: lengths in bases, steps and weights.
FLANK, NUCLEOSOME = 75, 147
LARGEST_MONO, LARGEST_DI = 320, 485
SHORTEST_GAP, LONGEST_GAP, GAP_STEP = 51, 351, 4
POSITION_STEP = 3
NUCLEOSOME_WEIGHT = 2
COLLISION = 10
SCREENED = 792

GAPS = np.arange(SHORTEST_GAP, LONGEST_GAP + 1, GAP_STEP)
REACH = FLANK + NUCLEOSOME + (LONGEST_GAP - 1) // 2
#: Half of the span that a placement blocks, beside half of its gap.
BLOCK = NUCLEOSOME + (SHORTEST_GAP - 1) // 2
#: A candidate's counts lie in its own cell and the two beside it.
CELL = 400
#: Bases of a tile; how far a choice forbids others; how far apart choices can overlap.
TILE = 16_384
CHOICE_REACH, OVERLAP_REACH = 510, 2 * REACH
OPEN, YES, NO = 0, 1, 2
KEYS = ("stage", "chrom")
CHAIN = "stage string, chrom string, start0 long, end1 long, nucleosomes array<long>, merges string, dinuc_scores string"


def events(inserts: DataFrame) -> DataFrame:
    """(stage, chrom, start0, end1, ends, mono, di): the counts at each position that has any, as intervals of one base."""
    size = F.col("end1") - F.col("start0")
    middle = F.col("start0") + F.floor(size / 2)
    one = lambda p, kind: F.struct(p.cast("long").alias("start0"), F.lit(kind).alias("kind"))
    centers = F.when((size > NUCLEOSOME) & (size <= LARGEST_MONO), one(middle, "mono")).when((size > LARGEST_MONO) & (size <= LARGEST_DI), one(middle, "di"))
    each = inserts.select(*KEYS, F.explode(F.array_compact(F.array(one(F.col("start0"), "ends"), one(F.col("end1") - 1, "ends"), centers))).alias("e")).select(*KEYS, "e.*")
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("ends", "mono", "di")]
    return each.groupBy(*KEYS, "start0").agg(*counts).withColumn("end1", F.col("start0") + 1)


def thresholds(inserts: DataFrame, least: int) -> DataFrame:
    """(stage, floor): the least score of a stage, in proportion to its inserts; `least` for the stage with the fewest."""
    n = inserts.groupBy("stage").agg(F.count("*").alias("n"))
    fewest = n.agg(F.min("n").alias("fewest"))
    return n.crossJoin(F.broadcast(fewest)).select("stage", F.floor(F.lit(float(least)) * F.col("n") / F.col("fewest")).alias("floor"))


def able_tiles(counted: DataFrame, floors: DataFrame, tile: int) -> DataFrame:
    """(stage, chrom, tile, floor) of each tile with a cell whose counts, with those of its neighbours, can reach the floor."""
    cell = F.floor(F.col("start0") / CELL)
    n = counted.groupBy(*KEYS, cell.alias("cell")).agg(F.sum(F.col("ends") + F.col("mono") + F.col("di")).alias("n"))
    near = n.select(*KEYS, F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"), "n").groupBy(*KEYS, "cell").agg(F.sum("n").alias("n"))
    # A cell may lie in two tiles.
    first, last = F.floor(F.col("cell") * CELL / tile), F.floor((F.col("cell") * CELL + CELL - 1) / tile)
    return near.join(F.broadcast(floors), "stage").where("n >= floor").select(*KEYS, F.explode(F.sequence(first, last)).alias("tile"), "floor").distinct()


def tiled(df: DataFrame, at: str, reach: int, tile: int) -> DataFrame:
    """df with a row for each tile within reach of a position."""
    return df.withColumn("tile", F.explode(F.sequence(F.floor((F.col(at) - reach) / tile), F.floor((F.col(at) + reach) / tile))))


def candidates(at: np.ndarray, open_sums: np.ndarray, mono_sums: np.ndarray, origin: int, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, scores and gaps of the centers in `at` whose best gap reaches the floor; of equal gaps the longest."""
    between = lambda sums, a, b: sums[b - origin] - sums[a - origin]
    screened = between(open_sums + mono_sums, at - REACH, at - REACH + SCREENED)
    at = at[screened >= floor]
    best, best_gap = np.full(len(at), -1 << 40), np.zeros(len(at), int)
    for gap in GAPS:
        half = (gap - 1) // 2
        inner, outer = half + NUCLEOSOME, half + NUCLEOSOME + FLANK
        nucleosomes = lambda sums: between(sums, at - inner, at - half) + between(sums, at + half + 1, at + inner + 1)
        score = between(open_sums, at - outer, at + outer + 1) - nucleosomes(open_sums) + NUCLEOSOME_WEIGHT * nucleosomes(mono_sums) - (gap - SHORTEST_GAP)
        better = score >= best
        best[better], best_gap[better] = score[better], gap
    keep = best >= floor
    return at[keep], best[keep], best_gap[keep]


def choose(at, score, gap, state, own, first: int, stop: int):
    """The states of candidates by what is certain within one tile. state: OPEN or YES at first; own: those that the tile decides.

    From the best down (of equal scores the last): a candidate that a choice forbids goes; one within reach of a better one
    that is not decided stays open; any other is chosen. Indices count steps from `first` within [first, stop).
    """
    index = (at - first) // POSITION_STEP
    steps = -(-(stop - first) // POSITION_STEP)
    half = (gap - 1) // 2
    left, right = np.maximum(at - first - NUCLEOSOME - half, 0), at - first + NUCLEOSOME + half
    blocked = (BLOCK + half) // POSITION_STEP
    state = state.copy()
    state[(state == OPEN) & ~((left > 0) & (right < steps * POSITION_STEP + BLOCK + COLLISION))] = NO

    def forbid(k):
        a, b = np.searchsorted(at, (at[k] - CHOICE_REACH, at[k] + CHOICE_REACH + 1))
        low, high = min(index[k] + blocked[k] + 1, steps), index[k] - blocked[k]
        after = (index[a:b] >= low) & (left[a:b] > max(0, low * POSITION_STEP - BLOCK - COLLISION))
        before = (index[a:b] < high) & (right[a:b] < high * POSITION_STEP + BLOCK + COLLISION)
        state[a:b][(state[a:b] == OPEN) & ~after & ~before] = NO

    for k in np.flatnonzero(state == YES):
        forbid(k)
    unsure: np.ndarray = np.zeros(len(at), bool)
    for k in np.lexsort((-index, -score)):
        if state[k] != OPEN:
            continue
        a, b = np.searchsorted(at, (at[k] - CHOICE_REACH, at[k] + CHOICE_REACH + 1))
        if not own[k] or unsure[a:b].any():
            unsure[k] = True
            continue
        state[k] = YES
        forbid(k)
    return state


def settle(at, score, gap, state, own, opened, mono, origin: int, floor: int):
    """The states of choices by what is certain within one tile: YES if what earlier placements leave of the counts is enough.

    Of two choices the right one is the earlier if it is the best of all from the left one to it, else the left one is.
    The rest, carried up to the whole length, must reach half of the floor.
    """
    state, half = state.copy(), (gap - 1) // 2
    outer = half + NUCLEOSOME + FLANK
    while True:
        changed = False
        for k in np.flatnonzero((state == OPEN) & own):
            covers, known = [], True
            best, wall = k, False
            for x in range(k - 1, -1, -1):
                if at[k] - at[x] > OVERLAP_REACH:
                    break
                # Does x come before k? Not if k is the best of all from x to k.
                best = best if (score[best], best) > (score[x], x) else x
                if best != k and at[x] + outer[x] >= at[k] - outer[k]:
                    known &= wall or state[x] != OPEN
                    covers += [x] if state[x] == YES else []
                # What lies beyond a placement covers nothing that the placement does not.
                wall |= state[x] == YES and best != k
            best, wall = k, False
            for x in range(k + 1, len(at)):
                if at[x] - at[k] > OVERLAP_REACH:
                    break
                best = best if (score[best], best) > (score[x], x) else x
                if best == x and at[x] - outer[x] <= at[k] + outer[k]:
                    known &= wall or state[x] != OPEN
                    covers += [x] if state[x] == YES else []
                wall |= state[x] == YES and best == x
            if not known:
                continue
            h, center = int(half[k]), int(at[k]) - origin
            weights = np.ones(2 * int(outer[k]) + 1, int)
            weights[FLANK:FLANK + NUCLEOSOME] = weights[-FLANK - NUCLEOSOME:-FLANK] = 0
            span = slice(center - int(outer[k]), center + int(outer[k]) + 1)
            free = np.ones(len(weights), bool)
            for x in covers:
                a, b = at[x] - outer[x] - (at[k] - outer[k]), at[x] + outer[x] + 1 - (at[k] - outer[k])
                free[max(0, a):max(0, b)] = False
            rest = int(((opened[span] * weights + NUCLEOSOME_WEIGHT * mono[span] * (1 - weights)) * free).sum())
            bases = int(free.sum())
            state[k] = YES if bases and int(rest / bases * len(weights)) >= floor // 2 else NO
            changed = True
        if not changed:
            return state


def chained(placed: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, list[int], list[int], list[int]]]:
    """(start0, end1, nucleosome starts, merge kinds, scores) of the chains that placements make.

    A first nucleosome that overlaps the last one of the chain becomes one with it, at the mean of their starts weighted
    by score (kind 1); one that begins up to a longest gap behind it lengthens the chain (kind 0). A chain's first score
    is without the penalty for its gap, as the weights are; later scores are as searched.
    """
    chain = None
    for center, score, gap in placed:
        h = (gap - 1) // 2
        starts, outer = (center - h - NUCLEOSOME, center + h + 1), h + NUCLEOSOME + FLANK
        if chain and starts[0] < chain[2][-1] + NUCLEOSOME:
            w = chain[4][-1]
            chain[2][-1:] = [int((chain[2][-1] * w + starts[0] * score) / (w + score)), starts[1]]
            chain[3].append(1)
            chain[4].append(score)
        elif chain and starts[0] <= chain[2][-1] + NUCLEOSOME + LONGEST_GAP:
            chain[2].extend(starts)
            chain[3].append(0)
            chain[4].append(score)
        else:
            if chain:
                yield tuple(chain)
            chain = [center - outer, 0, list(starts), [], [score + gap - SHORTEST_GAP]]
        chain[1] = center + outer + 1
    if chain:
        yield tuple(chain)


PLACED = "stage string, chrom string, floor long, low long, high long, at long, score long, gap long, state int"


def _counts(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Open and mono counts of a tile's positions and some beyond, and the position of the first."""
    origin, length = int(pdf.start0.min()) - 3 * REACH, int(pdf.start0.max() - pdf.start0.min()) + 6 * REACH
    opened, mono = np.zeros(length, np.int64), np.zeros(length, np.int64)
    np.add.at(opened, pdf.start0.to_numpy() - origin, (pdf.ends + pdf.di).to_numpy())
    np.add.at(mono, pdf.start0.to_numpy() - origin, pdf.mono.to_numpy())
    return opened, mono, origin


def _range(low, high) -> tuple[int, int]:
    """The positions of a chromosome's search, [first, stop), in whole steps."""
    return (int(low) + REACH) // POSITION_STEP * POSITION_STEP, (int(high) - REACH) // POSITION_STEP * POSITION_STEP


def _found(tile: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        opened, mono, origin = _counts(pdf)
        first, stop = _range(row.low, row.high)
        a, b = max(first, origin + 2 * REACH, int(row.tile) * tile), min(stop, origin + len(opened) - 2 * REACH, (int(row.tile) + 1) * tile)
        at = np.arange(-(-a // POSITION_STEP) * POSITION_STEP, b, POSITION_STEP)
        sums = [np.concatenate([[0], np.cumsum(c)]) for c in (opened, mono)]
        at, score, gap = candidates(at, *sums, origin, int(row.floor))
        return pd.DataFrame({"stage": row.stage, "chrom": row.chrom, "floor": row.floor, "low": row.low, "high": row.high, "at": at, "score": score, "gap": gap, "state": OPEN})

    return run


def _own(pdf: pd.DataFrame, tile: int) -> np.ndarray:
    return (pdf["at"] // tile == pdf["tile"]).to_numpy()


def _chosen(tile: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, row = pdf.sort_values("at"), pdf.iloc[0]
        own = _own(pdf, tile)
        state = choose(*(pdf[c].to_numpy() for c in ("at", "score", "gap", "state")), own, *_range(row.low, row.high))
        return pdf.assign(state=state)[own].drop(columns="tile")

    return run


def _settled(tile: int):
    def run(pdf: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pdf.drop(columns="tile")
        pdf = pdf.sort_values("at")
        own = _own(pdf, tile)
        if own.any():
            opened, mono, origin = _counts(counts)
            pdf = pdf.assign(state=settle(*(pdf[c].to_numpy() for c in ("at", "score", "gap", "state")), own, opened, mono, origin, int(pdf["floor"].iloc[0])))
        return pdf[own].drop(columns="tile")

    return run


def placed(inserts: DataFrame, least: int = 42, tile: int = TILE) -> DataFrame:
    """(stage, chrom, at, score, gap): the center, score and gap of each placement."""
    counted = events(inserts)
    able = able_tiles(counted, thresholds(inserts, least), tile)
    ends = inserts.groupBy(*KEYS).agg(F.min("start0").alias("low"), F.max("end1").alias("high"))
    # The counts that a mask of a tile's candidate can reach.
    counts = written(tiled(counted, "start0", 3 * REACH, tile).join(able, [*KEYS, "tile"]).join(ends, list(KEYS)).select(*KEYS, "tile", "floor", "low", "high", "start0", "ends", "mono", "di"), "counts")
    by = [*KEYS, "tile"]
    rows = written(counts.groupBy(*by).applyInPandas(_found(tile), PLACED), "candidates")
    while rows.where(F.col("state") == OPEN).limit(1).count():
        near = tiled(rows, "at", CHOICE_REACH, tile)
        rows = written(near.groupBy(*by).applyInPandas(_chosen(tile), PLACED).where(F.col("state") != NO), "choices")
    rows = rows.withColumn("state", F.lit(OPEN))
    while rows.where(F.col("state") == OPEN).limit(1).count():
        near = tiled(rows, "at", OVERLAP_REACH, tile)
        rows = written(near.groupBy(*by).cogroup(counts.groupBy(*by)).applyInPandas(_settled(tile), PLACED), "settled")
    return rows.where(F.col("state") == YES).select(*KEYS, "at", "score", "gap")


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """The one chain that a group of placements makes."""
    row = pdf.iloc[0]
    join = lambda xs: ",".join(map(str, xs))
    made = chained(sorted(zip(pdf["at"].tolist(), pdf["score"].tolist(), pdf["gap"].tolist())))
    rows = [(row.stage, row.chrom, s, e, nucs, join(kinds), join(scores)) for s, e, nucs, kinds, scores in made]
    return pd.DataFrame(rows, columns=["stage", "chrom", "start0", "end1", "nucleosomes", "merges", "dinuc_scores"])


def dinuc_chains(inserts: DataFrame, least: int = 42, tile: int = TILE) -> DataFrame:
    """The chains of each stage, from inserts (stage, chrom, start0, end1). Empty inserts give no chain.

    Whether a placement lengthens a chain depends on the one before it alone, so chains are numbered by running sums; a
    group is one chain, which is one row.
    """
    known = stretch(placed(inserts, least, tile), F.col("at"))
    half = F.floor((F.col("gap") - 1) / 2)
    last = previous(known, KEYS, ["at"], "_last", F.col("at") + half + 1)
    new = F.when(F.col("at") - half - NUCLEOSOME <= F.col("_last.v") + NUCLEOSOME + LONGEST_GAP, 0).otherwise(1)
    numbered = running(last.withColumn("_new", new), KEYS, ["at"], {"chain": ("sum", F.col("_new"))})
    return numbered.select(*KEYS, "chain", "at", "score", "gap").groupBy(*KEYS, "chain").applyInPandas(_joined, CHAIN)


def chain_scores(chains: DataFrame, inserts: DataFrame) -> DataFrame:
    """(stage, chrom, start0, end1, in_stage, nfr, nuc, score, n_ends): each chain in every stage that has counts within it."""
    pairs = iv.overlap_pairs(events(inserts), chains.select(*KEYS, "start0", "end1", "nucleosomes"))
    inside = F.exists("b_nucleosomes", lambda s: (F.col("start0") >= s) & (F.col("start0") < s + NUCLEOSOME))
    nfr = F.sum(F.when(inside, 0).otherwise(F.col("ends") + F.col("di")))
    nuc = F.sum(F.when(inside, NUCLEOSOME_WEIGHT * F.col("mono")).otherwise(0))
    by = [F.col("b_stage").alias("of_stage"), "chrom", F.col("b_start0").alias("from0"), F.col("b_end1").alias("to1"), F.col("stage").alias("in_stage")]
    told = pairs.groupBy(*by).agg(nfr.alias("nfr"), nuc.alias("nuc"), F.sum("ends").alias("n_ends"))
    return told.select(F.col("of_stage").alias("stage"), "chrom", F.col("from0").alias("start0"), F.col("to1").alias("end1"), "in_stage", F.col("nfr").cast("long").alias("nfr"), F.col("nuc").cast("long").alias("nuc"), (F.col("nfr") + F.col("nuc")).cast("long").alias("score"), "n_ends")


def chain_groups(chains: DataFrame, inserts: DataFrame) -> DataFrame:
    """(chrom, start0, end1, in_stage, n_ends): where chains of any stages overlap, with each stage's ends there."""
    groups = iv.merge_intervals(chains.select("chrom", "start0", "end1"), -1)
    pairs = iv.overlap_pairs(events(inserts), groups)
    told = pairs.groupBy("chrom", F.col("b_start0").alias("from0"), F.col("b_end1").alias("to1"), F.col("stage").alias("in_stage")).agg(F.sum("ends").alias("n_ends"))
    return told.select("chrom", F.col("from0").alias("start0"), F.col("to1").alias("end1"), "in_stage", "n_ends")
