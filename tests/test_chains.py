"""Chains of dinucleosomes against a plain version over whole chromosomes."""

import random

import numpy as np

from strandloom.operators import chains as ch


def plain_chains(inserts, floor):
    """The placements of one stage and chromosome with explicit masks and recursion."""
    ends, mono, di = (np.zeros(40_000, int) for _ in range(3))
    for a, b in inserts:
        ends[a] += 1
        ends[b - 1] += 1
        size = b - a
        if 147 < size <= 320:
            mono[a + size // 2] += 1
        elif 320 < size <= 485:
            di[a + size // 2] += 1
    mask = {g: np.array([1] * 75 + [0] * 147 + [1] * g + [0] * 147 + [1] * 75) for g in range(51, 352, 4)}
    inner = {g: np.array([0] * 75 + [1] * 147 + [0] * g + [1] * 147 + [0] * 75) for g in mask}
    opened = ends + di

    def score(i, g, free=None):
        h = (g - 1) // 2 + 222
        span = slice(i - h, i + h + 1)
        values = opened[span] * mask[g] + 2 * mono[span] * inner[g]
        return int(values.sum()) if free is None else int((values * free[span]).sum())

    first, stop = ((min(a for a, _ in inserts) + 397) // 3 * 3), ((max(b for _, b in inserts) - 397) // 3 * 3)
    best = []
    for i in range(first, stop, 3):
        if (opened + mono)[i - 397:i + 395].sum() < floor:
            best.append((-999, 351))
        else:
            best.append(max((score(i, g) - (g - 51), g) for g in mask))
    free, placed = np.ones(40_000, int), []

    def search(low, high):
        options = []
        for k in range(low, high):
            s, g = best[k]
            h = 147 + (g - 1) // 2
            fits = max(0, 3 * k - h) > max(0, 3 * low - 182) and 3 * k + h < 3 * high + 182
            options.append((s if fits else 0, k))
        if not options or max(options)[0] < floor:
            return
        s, k = max(options)
        g, i = best[k][1], first + 3 * k
        h = (g - 1) // 2
        span = slice(i - h - 222, i + h + 223)
        if free[span].sum() and int(score(i, g, free) / free[span].sum() * (444 + g)) >= floor // 2:
            placed.append((i, s, g))
            free[span] = 0
        search(low, max(k - (172 + h) // 3, 0))
        search(min(k + (172 + h) // 3 + 1, len(best)), high)

    search(0, len(best))
    return sorted(placed)


def sample(seed):
    """Clusters of inserts with empty stretches between them."""
    draw, out = random.Random(seed), []
    for center in (3000, 9000, 10_100, 18_000):
        for _ in range(draw.choice((60, 120, 200))):
            a = int(center + draw.gauss(0, 350))
            out.append((a, a + draw.randint(36, 480)))
    return [*out, (1000, 1100), (25_000, 25_100)]


def test_chains_equal_a_plain_run_over_whole_chromosomes(spark):
    by = {("a", "c1"): sample(1), ("a", "c2"): sample(2), ("b", "c1"): sample(3)}
    rows = [(s, c, x, y) for (s, c), own in by.items() for x, y in own]
    inserts = spark.createDataFrame(rows, "stage string, chrom string, start0 long, end1 long")
    n = {s: sum(r[0] == s for r in rows) for s in "ab"}
    chains = ch.dinuc_chains(inserts)
    got = sorted((r.stage, r.chrom, r.start0, r.end1, list(r.nucleosomes), r.merges, r.dinuc_scores) for r in chains.collect())
    want = []
    for (s, c), own in by.items():
        for a, b, nucs, kinds, scores in ch.chained(plain_chains(own, int(42 * n[s] / min(n.values())))):
            want.append((s, c, a, b, nucs, ",".join(map(str, kinds)), ",".join(map(str, scores))))
    assert got == sorted(want) and len(got) >= 6

    told = {(r.stage, r.chrom, r.start0, r.in_stage): (r.score, r.n_ends) for r in ch.chain_scores(chains, inserts).collect()}
    for s, c, a, b, nucs, _, _ in got:
        for stage in {s for s, chrom in by if chrom == c}:
            inside = lambda p: any(x <= p < x + 147 for x in nucs)
            score = count = 0
            for x, y in by[stage, c]:
                for p in (x, y - 1):
                    count += a <= p < b
                    score += a <= p < b and not inside(p)
                mid, size = x + (y - x) // 2, y - x
                if a <= mid < b and 147 < size <= 320 and inside(mid):
                    score += 2
                if a <= mid < b and 320 < size <= 485 and not inside(mid):
                    score += 1
            assert told.get((s, c, a, stage), (0, 0)) == (score, count)
    groups = ch.chain_groups(chains, inserts).select("chrom", "start0", "end1").distinct().collect()
    assert sum(g.end1 - g.start0 for g in groups) == sum(len(set().union(*(range(a, b) for _, k, a, b, *_ in got if k == c))) for c in ("c1", "c2"))


def dense(seed):
    """Inserts all along 20,000 bases, so that candidates leave no gap between tiles."""
    draw, out = random.Random(seed), []
    for _ in range(1500):
        a = draw.randrange(1500, 21_000)
        a -= int(25 * np.sin(a / 60))
        out.append((a, a + draw.choice((40, 60, 120, 180, 200, 330, 400, 480))))
    return out


def test_dense_chromosomes_in_tiles_equal_a_plain_run(spark):
    by = {("a", "c1"): dense(4), ("b", "c1"): dense(5), ("b", "c2"): [(x, y) for x, y in dense(6) if x < 9000]}
    rows = [(s, c, x, y) for (s, c), own in by.items() for x, y in own]
    inserts = spark.createDataFrame(rows, "stage string, chrom string, start0 long, end1 long")
    n = {s: sum(r[0] == s for r in rows) for s in "ab"}
    want = sorted((s, c, *p) for (s, c), own in by.items() for p in plain_chains(own, int(42 * n[s] / min(n.values()))))
    assert len(want) > 60
    for tile in (1024, 5000, ch.TILE):
        assert sorted(map(tuple, ch.placed(inserts, tile=tile).collect())) == want, tile


def test_rounds_settle_every_choice():
    """Tiles of a few hundred bases, one after the other in rounds, choose what one tile chooses."""
    draw = np.random.default_rng(2)
    at = np.unique(draw.integers(500, 9000, 1500)) * 3
    score, gap = draw.integers(40, 90, len(at)), 51 + 4 * draw.integers(0, 76, len(at))
    whole = ch.choose(at, score, gap, np.zeros(len(at), int), np.ones(len(at), bool), 900, 28_000)
    assert set(whole.tolist()) == {ch.YES, ch.NO}
    state = np.zeros(len(at), int)
    for rounds in range(50):
        after = state.copy()
        for t in range(0, 30_000, 300):
            near = np.flatnonzero((at >= t - ch.CHOICE_REACH) & (at < t + 300 + ch.CHOICE_REACH) & (state != ch.NO))
            own = (at[near] >= t) & (at[near] < t + 300)
            after[near[own]] = ch.choose(at[near], score[near], gap[near], state[near], own, 900, 28_000)[own]
        state = after
        if (state != ch.OPEN).all():
            break
    assert rounds > 1 and (state == whole).all()


def test_merges_and_empty_tables(spark):
    near = list(ch.chained([(1000, 100, 51), (1150, 50, 51), (1700, 60, 51), (4000, 70, 71)]))
    assert near == [(1000 - 247, 1700 + 248, [828, int((1026 * 100 + 978 * 50) / 150), 1176, 1528, 1726], [1, 0], [100, 50, 60]), (4000 - 257, 4000 + 258, [3818, 4036], [], [90])]
    none = spark.createDataFrame([], "stage string, chrom string, start0 long, end1 long")
    assert ch.dinuc_chains(none).count() == 0
