"""Look-ups, equal samples, lags and sequences read by lines, against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import intervals as iv, lookup, profiles as pr, resampling as rs, scalars as sc
from strandloom.sources import tables


def test_lookups_of_small_and_large_tables(spark):
    table = spark.createDataFrame([("a", 1, 2.5, "x"), ("a", 2, None, "y"), (None, 1, 9.0, "z")], "k string, j long, v double, `odd name` string")
    rows = spark.createDataFrame([(0, "a", 1, 7.0), (1, "a", 2, 7.0), (2, "b", 1, 7.0), (3, None, 1, 7.0), (4, "a", 1, 7.0)], "i long, k string, j long, v double")
    at = lambda **how: {r.i: (r.v, r["odd name"]) for r in lookup.looked_up(rows, table, ["k", "j"], **how).collect()}
    kept = {0: (2.5, "x"), 1: (None, "y"), 2: (None, None), 3: (None, None), 4: (2.5, "x")}
    for most in (1 << 30, 0):
        assert at(most_bytes=most) == kept
        assert at(most_bytes=most, unmatched="drop") == {i: kept[i] for i in (0, 1, 4)}
        # A null in the table is no missing key.
        assert at(most_bytes=most, unmatched={"v": 0.0}) == kept | {2: (0.0, None), 3: (0.0, None)}
        with pytest.raises(Exception, match="no row for b, 1"):
            lookup.looked_up(rows.where("i < 3"), table, ["k", "j"], "fail", most).collect()
    assert at(unmatched="keep") == kept and lookup.looked_up(rows, table.where("false"), ["k", "j"], "drop").count() == 0
    with pytest.raises(ValueError, match="more than one row"):
        lookup.looked_up(rows, table, ["j"])
    with pytest.raises(ValueError, match="unmatched"):
        lookup.looked_up(rows, table, ["k", "j"], "none")


def test_large_tables_are_not_broadcast(spark):
    rows = spark.range(100).withColumnRenamed("id", "k")
    table = rows.select("k", F.repeat(F.lit("é"), 1000).alias("s"))
    assert 200_000 < lookup.table_bytes(table) < 220_000
    plan = lambda most: lookup.looked_up(rows, table, ["k"], most_bytes=most)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(300_000) and "broadcast" not in plan(100_000)


def test_equal_samples_are_exact(spark):
    r = random.Random(4)
    # A hot group, ties of the hash, whole rows repeated, a group smaller than n.
    rows = [("hot", r.randrange(500), r.randrange(3)) for _ in range(4000)] + [("few", k, 0) for k in range(30)] + [("mid", k % 90, k % 2) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, k long, t long")
    order = sc.hash_order(F.col("k"), 11)
    for n in (0, 1, 120, 299):
        got: dict = {}
        for x in rs.equal_sample(df, ["g"], n, order, ["k", "t"]).collect():
            got.setdefault(x.g, []).append((x.k, x.t))
        for g in ("hot", "few", "mid"):
            own = sorted((k * 2654435761 + 11) % 4294967296 for g2, k, _ in rows if g2 == g)
            want = sorted(((k * 2654435761 + 11) % 4294967296, k, t) for g2, k, t in rows if g2 == g)[:n]
            assert len(own) >= len(want) and sorted(got.get(g, [])) == sorted((k, t) for _, k, t in want), (g, n)


def test_lags_equal_all_pairs(spark):
    r = np.random.default_rng(1)
    rows = []
    for chrom, n in (("a", 150), ("b", 40), ("c", 1)):
        for _ in range(n):
            v = r.poisson(4, 5).astype(float)
            rows.append((chrom, float(r.integers(0, 60_000)), float(r.normal()), v.tolist()))
    rows += [("a", 500.0, 1.0, [2.0] * 5), ("a", 900.0, 1.0, [math.inf, 1.0, 2.0, 3.0, 4.0]), ("a", 700.0, None, [1.0, 2.0, 3.0, 4.0, 5.0]), (None, 1.0, 1.0, [1.0] * 5), rows[0]]
    df = spark.createDataFrame(rows, "chrom string, at double, x double, vector array<double>")
    sums: dict = {}
    own = [q for q in rows if q[0] and q[2] is not None]
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            d = abs(a[1] - b[1])
            if a[0] == b[0] and 0 < d < 30_000:
                fine = all(np.isfinite(q[3]).all() and np.std(q[3]) > 0 for q in (a, b))
                sums.setdefault(round(math.log10(d) * 10), []).append((abs(a[2] - b[2]), np.corrcoef(a[3], b[3])[0, 1] if fine else None))
    want = {lag: q for lag, q in sums.items() if len(q) >= 20}
    for tile, part in ((1000, 3), (10_000, 1024), (1_000_000, 16)):
        got = {q.lag: q for q in pr.lag_profiles(df, 30_000, 20, tile, part).collect()}
        assert set(got) == set(want)
        for lag, q in want.items():
            d, c = np.array([x for x, _ in q]), np.array([x for _, x in q if x is not None])
            g = got[lag]
            assert g.n == len(q) and np.allclose([g.mean_corr, g.sd_corr, g.semivariance, g.mean_abs, g.sd_abs], [c.mean(), c.std(ddof=1), (d * d).sum() / len(d) / 2, d.mean(), d.std(ddof=1)])
    assert pr.lag_profiles(df.where("false")).count() == 0


def test_lags_without_pairs(spark):
    """A tile of 100,000 rows, all of whose pairs fill no task: rows at each place from 0 on, values that grow with them."""
    n = 100_000
    df = spark.range(n).select(F.lit("a").alias("chrom"), F.col("id").cast("double").alias("at"), (F.col("id") / 10).alias("x"), F.array((F.col("id") % 2).cast("double"), F.lit(0.5)).alias("vector"))
    got = {q.lag: q for q in pr.lag_profiles(df, part=n).collect()}
    d = np.arange(1, n)
    lags = np.rint(np.log10(d) * 10).astype(int)
    assert set(got) == set(lags[n - d >= 100].tolist())
    for lag, g in got.items():
        own = d[lags == lag]
        pairs = n - own
        mean, corr = (own * pairs).sum() / 10 / pairs.sum(), (np.where(own % 2, -1, 1) * pairs).sum() / pairs.sum()
        assert g.n == pairs.sum() and np.allclose([g.mean_abs, g.mean_corr, g.semivariance], [mean, corr, (own * own / 100 * pairs).sum() / pairs.sum() / 2])
    odd = spark.createDataFrame([("a", float(k), math.nan if k == 0 else 1.0, [1.0, 2.0]) for k in range(12)] + [("a", math.inf, 1.0, [1.0, 2.0])], "chrom string, at double, x double, vector array<double>")
    got = {q.lag: q for q in pr.lag_profiles(odd, least=1).collect()}
    assert sum(q.n for q in got.values()) == 66 and all(math.isnan(q.mean_abs) for q in got.values())


def test_sequences_by_lines(spark, tmp_path):
    r = random.Random(3)
    base = lambda n: "".join(r.choice("ACGTN") for _ in range(n))
    records = [("one", base(1003), 60), ("two", base(100), 7), ("none", "", 60), ("last", base(41), 1000), ("edge", base(90), 10)]
    for name, ends in (("a.fa", "\n"), ("b.fa", "\r\n")):
        body = ["left out before the first record"]
        for chrom, seq, width in records:
            body += [f">{name}-{chrom} more words", *(seq[k : k + width] for k in range(0, len(seq), width)), ""]
        (tmp_path / name).write_bytes(ends.join(body).encode())
    whole = spark.createDataFrame([(f"{f}-{c}", s) for f in ("a.fa", "b.fa") for c, s, _ in records], "chrom string, seq string")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        for chunk, overlap in ((100, 12), (30, 0), (10, 25), (5000, 12)):
            got = sorted(map(tuple, tables.read_sequence(spark, str(tmp_path), chunk, overlap).collect()))
            assert got == sorted(map(tuple, tables.chunked(whole, chunk, overlap).collect())), (chunk, overlap)
            assert max(len(s) for _, _, s in got) <= chunk + overlap
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def shuffled_rows(spark):
    """Rows that all stages so far have written for shuffles."""
    own, jvm = spark.sparkContext, spark.sparkContext._jvm
    own._jsc.sc().listenerBus().waitUntilEmpty()
    stages = own._jsc.sc().statusStore().stageList(None, False, False, own._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_lines_of_sequences_are_not_shuffled(spark, tmp_path):
    """Chunks are cut where a split's lines are; only what its ends leave open is dealt and ordered."""
    r = random.Random(8)
    seqs = [("one", "".join(r.choice("ACGT") for _ in range(300_000))), ("empty", ""), ("two", "".join(r.choice("ACGT") for _ in range(90_013)))]
    (tmp_path / "g.fa").write_text("".join(f">{n}\n" + "".join(s[k : k + 60] + "\n" for k in range(0, len(s), 60)) for n, s in seqs))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        so_far = shuffled_rows(spark)
        got = sorted(map(tuple, tables.read_sequence(spark, str(tmp_path), 1000, 12).collect()))
        moved = shuffled_rows(spark) - so_far
        assert got == sorted(map(tuple, tables.chunked(spark.createDataFrame(seqs, "chrom string, seq string"), 1000, 12).collect()))
        assert moved < 6502 / 2  # lines
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_correlations_of_near_rows(spark):
    """Pairs are dealt by place, and the parts of their correlations are made once for a row; a constant row has none."""
    r = random.Random(5)
    rows = [(f"r{k}", r.choice("ab"), r.randrange(2000), [r.randrange(9) for _ in range(5)]) for k in range(60)] + [("flat", "a", 1000, [3] * 5)]
    df = spark.createDataFrame(rows, "name string, chrom string, start0 long, counts array<long>")
    pairs = iv.pairs_within_distance(pr.pearson_parts(df, "counts", 5), "start0", 300).select("name", "b_name", pr.pair_pearson(5).alias("r"))
    want = {(x[0], y[0]): None if "flat" in (x[0], y[0]) else np.corrcoef(x[3], y[3])[0, 1] for x in rows for y in rows if x[1] == y[1] and 0 < y[2] - x[2] < 300}
    got = {(q[0], q[1]): q[2] for q in pairs.collect()}
    assert got.keys() == want.keys() and all(got[k] is None if v is None else abs(got[k] - v) < 1e-12 for k, v in want.items())
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_vectors_of_a_place_are_folded_before_tiles_meet(spark, monkeypatch):
    """Many rows at few places meet as one row for each place, in any cut; tiles meet with a row's place and x only."""
    r = np.random.default_rng(25)
    rows = [("a", float(r.integers(0, 30)) * 400, float(r.normal()), r.poisson(4, 5).astype(float).tolist()) for _ in range(600)]
    df = spark.createDataFrame(rows, "chrom string, at double, x double, vector array<double>")
    want = {q.lag: q for q in pr.lag_profiles(df, 30_000, 20).collect()}
    at, x, v = (np.array([q[k] for q in rows]) for k in (1, 2, 3))
    i, j = np.triu_indices(len(rows), 1)
    i, j = i[at[i] != at[j]], j[at[i] != at[j]]
    lags, c = np.rint(np.log10(np.abs(at[i] - at[j])) * 10).astype(int), np.corrcoef(v)[i, j]
    for lag, q in want.items():
        own = c[lags == lag]
        assert q.n == len(own) and np.allclose([q.mean_corr, q.sd_corr, q.mean_abs], [own.mean(), own.std(ddof=1), np.abs(x[i] - x[j])[lags == lag].mean()])
    assert set(want) == {k for k in set(lags.tolist()) if (lags == k).sum() >= 20}
    monkeypatch.setattr(pr, "PLACE_SUMS", 3)
    cut = {q.lag: q for q in pr.lag_profiles(df, 30_000, 20, 4000, 40).collect()}
    assert set(cut) == set(want) and all(np.allclose(list(cut[k]), list(want[k])) for k in want)
    so_far = shuffled_rows(spark)
    pr.lag_profiles(df, 30_000, 20, 12_000, 40).count()
    # 600 rows in 15 tiles at least: as two units they would be dealt 32 times each.
    assert shuffled_rows(spark) - so_far < 600 * 20
