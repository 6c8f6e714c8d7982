import random

from pyspark.sql import functions as F

from strandloom.operators import intervals as iv, scalars as sc, viterbi
from strandloom.sources import tables


def frame(spark, rows):
    return spark.createDataFrame(rows, "name string, chrom string, start0 long, end1 long")


def made(n, seed, far=40_000):
    r = random.Random(seed)
    out = []
    for k in range(n):
        s = r.randrange(far)
        out.append((f"{seed}_{k}", r.choice(["c1", "c2"]), s, s + r.choice([1, 5, 300, 9000])))
    return out


def test_overlap_pairs_equal_the_naive_join(spark):
    a, b = made(120, 1), made(90, 2)
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    A, B = frame(spark, a), frame(spark, b)
    got = sorted((r[0], r[1]) for r in iv.overlap_pairs(A, B, bucket=512).select("name", "b_name").collect())
    assert got == want
    hit = {x for x, _ in want}
    assert {r[0] for r in iv.overlap_semi(A, B).collect()} | {r[0] for r in iv.overlap_anti(A, [B]).collect()} == {x[0] for x in a}
    assert {r[0] for r in iv.overlap_semi(A, B).collect()} == hit
    assert iv.overlap_count(A, B).agg(F.sum("n")).first()[0] == len(want)


def test_bookended_and_nested(spark):
    df = frame(spark, [("a", "c", 0, 10), ("b", "c", 10, 20)])
    assert iv.overlap_pairs(df.where("name = 'a'"), df.where("name = 'b'")).count() == 0
    assert iv.merge_intervals(df, 0).count() == 1 and iv.merge_intervals(df, -1).count() == 2
    nested = frame(spark, [("a", "c", 0, 100), ("b", "c", 10, 20), ("c", "c", 50, 150)])
    assert [tuple(r) for r in iv.merge_intervals(nested).select("start0", "end1").collect()] == [(0, 150)]


def test_complement_twice_is_the_merge(spark):
    sizes = spark.createDataFrame([("c1", 60_000), ("c2", 60_000), ("c9", 10)], "chrom string, length long")
    df = frame(spark, made(60, 3))
    once = iv.complement(df, sizes)
    assert [tuple(r) for r in once.where("chrom = 'c9'").select("start0", "end1").collect()] == [(0, 10)]
    both = sorted(map(tuple, iv.complement(once, sizes).select("chrom", "start0", "end1").collect()))
    assert both == sorted(map(tuple, iv.merge_intervals(df).select("chrom", "start0", "end1").collect()))


def test_split_at_bins(spark):
    got = sorted(map(tuple, iv.split_at_bins(frame(spark, [("a", "c", 1990, 2010)]), 1000, 34).select("start0", "end1").collect()))
    assert got == [(1990, 2034), (2000, 2044)]


def test_scalars(spark):
    df = spark.createDataFrame([(34,), (35,), (39,), (40,), (650,)], "z int")
    assert [r[0] for r in df.select(sc.insert_size_level(F.col("z"))).collect()] == [0, 35, 35, 40, 300]
    one = spark.createDataFrame([("10M2D3I5M", 0.0009, 0.0267)], "c string, x double, y double")
    r = one.select(sc.cigar_span(F.col("c")), sc.floored_log10(F.col("x")), sc.floored_log10(F.col("y")), sc.divided(F.lit(5.0), F.lit(0.0)), sc.divided(F.lit(0.0), F.lit(0.0))).first()
    assert r[0] == 17 and r[1] == -3 and r[2] == -1.56 and r[3] == float("inf") and r[4] != r[4]
    mers = spark.createDataFrame([(1, "AACNNGTTNNCCG")], "doc_id long, seq string")
    assert [x.nonamer for x in sc.kmer_sites(mers).collect()] == ["AACGTTCCG"]


def test_counted_mers_are_the_sites_of_each_group(spark):
    """Counts come from coded texts; a place for every letter (kmer_sites) gives the same."""
    import random

    r = random.Random(5)
    texts = ["".join(r.choice("ACGTACGTN\U0001d538é") for _ in range(n)) for n in (0, 12, 13, 14, 700, 5000)] + [None, "ACGT" * 600]
    rows = [(None if g == 3 else f"g{g}", t) for g in range(20) for t in texts]
    df = spark.createDataFrame(rows, "lang string, seq string").repartition(2)
    want = sc.kmer_sites(df, by=["lang"]).groupBy("lang", "nonamer").agg(F.count("*").alias("n"))
    counts = sc.kmer_counts(df)
    assert sorted(map(str, counts.collect())) == sorted(map(str, want.collect()))
    assert "Generate" not in counts._jdf.queryExecution().executedPlan().toString()


def test_overlap_median_by_ranks(spark):
    """Medians of starts among overlapping rows without pairs, against a plain loop; short rows have theirs before their start."""
    import random
    import statistics

    r = random.Random(4)
    span = lambda top, most: (lambda s: (r.choice("cd"), s, s + r.randint(1, most)))(r.randrange(top))
    a = [*(span(70_000, 900) for _ in range(150)), *(span(70_000, 8) for _ in range(150)), ("c", 4096, 4100), ("e", 5, 9)]
    b = [span(70_000, 400) for _ in range(4000)] + [("c", 4000, 4399)] * 9 + [("c", 4095, 4097)] * 4
    schema = "chrom string, start0 long, end1 long"
    pairs_of = iv.overlap_pairs
    iv.overlap_pairs = None
    try:
        got = {(x.chrom, x.start0, x.end1): (x.n, x.median) for x in iv.overlap_median(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()}
    finally:
        iv.overlap_pairs = pairs_of
    for c, s, e in a:
        hit = [y - s for d, y, z in b if d == c and y < e and s < z]
        assert got[c, s, e] == (len(hit), statistics.median(hit) if hit else None), (c, s, e)


def test_flanks_of_a_minus_gene(spark):
    g = spark.createDataFrame([("g", "c", 5000, 9000, "-")], "name string, chrom string, start0 long, end1 long, strand string")
    got = {r.side: (r.start0, r.end1, r.tss1) for r in iv.tss_flanks(g).collect()}
    assert got == {"up": (9000, 10000, 9000), "down": (8000, 9000, 9000)}


def test_viterbi_stays_or_switches(spark):
    import math

    rows = [("c", i, [math.log(0.9), math.log(0.1)] if i < 2 else [math.log(0.1), math.log(0.9)]) for i in range(4)]
    df = spark.createDataFrame(rows, "chrom string, start0 long, emissions array<double>")
    path = lambda p: [r.state for r in sorted(viterbi.viterbi_by_key(df, ["chrom"], "start0", p).collect(), key=lambda r: r.start0)]
    assert path(0.3) == [1, 1, 2, 2] and len(set(path(1e-6))) == 1


def test_sources(spark, tmp_path):
    (tmp_path / "a.bed").write_text("c1\t5\t9\nc1\t1\t3\tx\t2\t+\n")
    got = sorted(map(tuple, tables.read_bed(spark, str(tmp_path / "a.bed")).collect()))
    assert got == [("c1", 1, 3, "x", 2.0, "+"), ("c1", 5, 9, ".", 0.0, ".")]
    (tmp_path / "s.csv").write_text("﻿class,staging_order\nb,2\na,1\n")
    assert [r["class"] for r in tables.read_samples(spark, str(tmp_path / "s.csv")).collect()] == ["a", "b"]
    (tmp_path / "g.fa").write_text(">c1 x\nACGTAC\nGTAA\n>c2\nTT\n")
    seq = {(r.chrom, r.offset): r.seq for r in tables.read_sequence(spark, str(tmp_path / "g.fa"), 4, 2).collect()}
    assert seq[("c1", 0)] == "ACGTAC" and seq[("c1", 4)] == "ACGTAA" and seq[("c2", 0)] == "TT"
    df = tables.read_bed(spark, str(tmp_path / "a.bed"))
    tables.write_sorted_regions(df, str(tmp_path / "out"), 2)
    assert tables.read_region(spark, str(tmp_path / "out"), "c1", 0, 4).count() == 1


def test_joins_of_rows_without_keys_of_their_own(spark):
    """Repeated rows, null chromosomes and clashing values: each row returns as often as it is there."""
    a = spark.createDataFrame([("x", "c", 0, 10), ("x", "c", 0, 10), ("x", "c", 50, 60), (None, "c", 5, 7), ("n", None, 0, 10)], "name string, chrom string, start0 long, end1 long")
    b = spark.createDataFrame([("p", "c", 5, 20), ("q", "c", 9, 12), ("r", None, 0, 10)], "name string, chrom string, start0 long, end1 long")
    count = lambda df, *cols: sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
    assert count(iv.overlap_semi(a, b), "name", "start0") == sorted([("x", 0), ("x", 0), (None, 5)], key=str)
    assert count(iv.overlap_anti(a, [b]), "name", "start0") == sorted([("x", 50), ("n", 0)], key=str)
    left = count(iv.overlap_left(a, b), "name", "start0", "b_name", "overlap_bp")
    assert left == sorted([("x", 0, "p", 5), ("x", 0, "p", 5), ("x", 0, "q", 1), ("x", 0, "q", 1), (None, 5, "p", 2), ("x", 50, None, 0), ("n", 0, None, 0)], key=str)
    assert iv.overlap_left(a, b.where("false")).count() == 5 and iv.overlap_left(a.where("false"), b).count() == 0


def test_counts_by_kind_make_no_pairs(spark):
    a, b = made(150, 5), made(200, 6)
    A, B = frame(spark, a), frame(spark, b)
    kinds = {"short": F.col("end1") - F.col("start0") <= 5, "long": F.col("end1") - F.col("start0") > 5}
    got = {r["name"]: (r["short"], r["long"]) for r in iv.overlap_sums(A, B, kinds).collect()}
    hits = lambda x, of: sum(x[1] == y[1] and x[2] < y[3] and y[2] < x[3] and of(y[3] - y[2]) for y in b)
    assert got == {x[0]: (hits(x, lambda z: z <= 5), hits(x, lambda z: z > 5)) for x in a}
    # An unknown start overlaps nothing; 25 million pairs at one place are counted, not made.
    assert iv.overlap_count(frame(spark, [("n", "c1", None, 90_000)]), B).first()["n"] == 0
    many = spark.range(5000).selectExpr("CAST(id AS STRING) AS name", "'c' AS chrom", "0L AS start0", "10 + id AS end1")
    assert "Join" not in iv.overlap_count(many, many)._jdf.queryExecution().optimizedPlan().toString().replace("Join LeftOuter", "")
    assert [tuple(r) for r in iv.overlap_count(many, many).agg(F.min("n"), F.max("n")).collect()] == [(5000, 5000)]


def test_first_and_largest_without_pairs(spark):
    a, b = made(150, 7, far=150_000), [x + (None if k % 9 == 0 else float(k * 37 % 101),) for k, x in enumerate(made(200, 8, far=150_000))]
    A, B = frame(spark, a), spark.createDataFrame(b, "name string, chrom string, start0 long, end1 long, v double")
    hits = {x[0]: [y for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3]] for x in a}
    first = iv.overlap_first(A, B, ["name"], ["start0", "end1", "name"])
    assert {r["name"]: (r["b_start0"], r["b_end1"], r["b_name"]) for r in first.collect()} == {k: min((y[2], y[3], y[0]) for y in ys) for k, ys in hits.items() if ys}
    most = iv.overlap_max(A, B, ["name"], {"v": F.col("v"), "one": F.lit(1)})
    assert {r["name"]: (r["v"], r["one"]) for r in most.collect()} == {k: (max((y[4] for y in ys if y[4] is not None), default=None), 1.0) for k, ys in hits.items() if ys}
    assert "BroadcastNestedLoopJoin" not in most._jdf.queryExecution().toString()


def test_pairs_are_dealt_by_place(spark):
    """Few rows with many pairs are spread by their places, not sent whole to the tasks that read the other side."""
    rows = [("a", s, s + n, f"{s}/{n}") for s in (0, 5, 2047, 2048, 4095, 4100) for n in (0, 1, 3, 2048, 5000, -2)]
    df = spark.createDataFrame(rows * 2, "chrom string, start0 long, end1 long, name string")
    hit = [(x[3], y[3], x[1] >= y[1] and x[2] <= y[2]) for x in rows * 2 for y in rows * 2 if x[1] < y[2] and y[1] < x[2]]
    for pairs, want in ((iv.overlap_pairs(df, df), [h[:2] for h in hit]), (iv.overlap_within(df, df), [h[:2] for h in hit if h[2]])):
        assert sorted(map(tuple, pairs.select("name", "b_name").collect())) == sorted(want)
        assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_counts_do_not_sort_rows(spark):
    """Rows that look up many positions pass by them unsorted, in parts that grow with the tables; a count is exact wherever its positions lie."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = spark.range(150_000).select(F.lit("c").alias("chrom"), (F.col("id") * 7).alias("start0"), (F.col("id") * 7 + 9).alias("end1"))
        got = iv.overlap_count(many, many)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("ShuffledHashJoin") == 2
        assert {r[0]: r[1] for r in got.groupBy("n").count().collect()} == {2: 2, 3: 149_998}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    draw = lambda n, most: [(random.choice("ab"), at := random.randrange(-200, 200), at + 1 + random.randrange(most)) for _ in range(n)]
    random.seed(4)
    a, b = draw(80, 90), draw(60, 70)
    a += a[:5] + [(None, 1, 5), ("a", None, 5), ("a", 1, None)]
    kind = "chrom string, start0 long, end1 long"
    got = iv.overlap_sums(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), {"n": F.lit(True), "odd": F.col("start0") % 2 != 0})
    hits = lambda x: [y for y in b if None not in x and x[0] == y[0] and y[1] < x[2] and x[1] < y[2]]
    want = [(*x, len(hits(x)), sum(y[1] % 2 != 0 for y in hits(x))) for x in a]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_sums_over_overlaps_and_distances_make_no_pairs(spark):
    """j8's bases and j13's distances come from sums by position: equal to the pairs', and no join meets rows by bucket."""
    a, b = made(150, 11), made(130, 12) + made(2, 12)
    got = {r.name: (r.n, r.bp) for r in iv.overlap_sums(frame(spark, a), frame(spark, b), {"n": F.lit(True), "bp": F.col("end1") - F.col("start0")}).collect()}
    met = {x[0]: [y[3] - y[2] for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3]] for x in a}
    assert got == {k: (len(v), sum(v)) for k, v in met.items()}
    own = a + [("null", None, 5, 6), ("same", a[0][1], a[0][2], a[0][3]), (a[0][0], *a[0][1:])]
    near = sorted((r.name, r.n, r.distance) for r in iv.sums_within_distance(frame(spark, own), "start0", 500).collect())
    far = lambda x: [y[2] - x[2] for y in own if x[1] and x[1] == y[1] and 0 < y[2] - x[2] < 500]
    assert near == sorted((x[0], len(far(x)), sum(far(x))) for x in own)
    assert iv.sums_within_distance(frame(spark, own), "start0", 1).agg(F.sum("n")).first()[0] == 0
    from strandloom.plans import catalog

    for name in ("j8_overlap_stranded", "j13_pairs_within_distance"):
        assert "bucket" not in catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_points_are_lifted_from_one_bucket_each(spark):
    """A point is dealt once; both strands, places at a block's ends and in several blocks."""
    r = random.Random(16)
    points = [(f"p{k}", r.choice(["c1", "c2"]), r.randrange(30_000)) for k in range(80)] + [("s", "c1", 4096), ("e", "c1", 8191), ("x", "c1", 8192), ("n", None, 5)]
    blocks = [(c, s, s + r.choice([1, 700, 9000]), f"{c}n", s + 50, r.choice("+-")) for c in ("c1", "c2") for s in (r.randrange(30_000) for _ in range(25))] + [("c1", 4096, 8192, "c1m", 7, "-")]
    lifted = iv.liftover_points(spark.createDataFrame(points, "name string, chrom string, pos long"), spark.createDataFrame(blocks, "chrom string, start0 long, end1 long, t_chrom string, t_start0 long, t_strand string"))
    want = sorted((n, t, t0 + (e - s - 1 - (p - s) if d == "-" else p - s)) for n, c, p in points for b, s, e, t, t0, d in blocks if b == c and s <= p < e)
    assert sorted((q.name, q.t_chrom, q.t_pos) for q in lifted.collect()) == want
    plan = lifted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(") == 1
