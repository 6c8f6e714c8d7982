"""Near-duplicate classes by exact Jaccard similarity of word shingles, found with signature trees.

Shingle sets stand for hashes of 64 bits. Copies with equal sets collapse to their smallest doc_id first. Each
remaining set shows some of its hashes, and sets meet in buckets by the hashes that they show:

* By default it shows its SKETCH smallest hashes, and meets others by the (SKETCH - COMMON + 1) rarest of them. Two sets
  with similarity 0.75 or more have at least COMMON of the union's SKETCH smallest hashes in common: the chance of fewer,
  by the binomial tail, is below 1e-10 for a pair on the threshold and far lower above it; sets with at most SKETCH
  shingles show all of them and lose nothing. A passage that very many texts share makes a bucket only for texts that
  mostly consist of it.
* With exact=True it shows the first n - ceil(0.75 n) + 1 of its n shingles in one order of all shingles (by hash, those
  that a sample shows to be frequent last). Linked sets have ceil(0.75 n) shingles in common for either n, so they show
  one in common whatever the order is, and no link can be lost; there are several times as many candidates.

Within a bucket each set is a leaf with its size and a bitmap of its shingles (a power of two of bits, at least twice
the shingles, folded to the smaller of two when compared). Nodes hold the size range, the OR of the bitmaps and the
largest number of shingles that share a bit; two nodes are walked down only if the largest possible overlap can reach
the threshold. Classes are built in two turns of such walks: first the tree of a bucket's most central set against trees
of the sets that choose it; then, of buckets that still hold several classes, all trees, where buckets of more than BLOCK
sets are dealt to tasks as pairs of blocks. Every link is verified on the whole texts.

Cases: null and empty texts have no shingles and link with nothing; a very long text is read whole; rows that share a
doc_id are one node of the links, and each row is returned; of sets that tie as the most central the smallest doc_id
leads; a null doc_id gets a null class; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

WORDS = 5
#: Similarity times 100.
PERCENT = 75
SKETCH = 64
COMMON = 24
#: For exact buckets, one text in SAMPLE tells which shingles are frequent: those in OFTEN of them, at most MOST_FREQUENT; links don't depend on it.
SAMPLE, OFTEN, MOST_FREQUENT = 64, 4, 1_000_000
#: Sets of a bucket that one task takes as one block.
BLOCK = 1024
#: Members of a bundle that one task verifies against one set.
BUNDLE = 256
LEAF = 8

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text: str, words: int = WORDS):
    """Sorted distinct 64-bit hashes of the text's shingles."""
    import numpy as np
    import xxhash

    got = WORD.findall(text.translate(LOWER) if not text.isascii() else text.lower())
    if not got:
        return np.empty(0, np.uint64)
    ids = {w: xxhash.xxh3_64_intdigest(w) for w in set(got)}
    h = np.fromiter(map(ids.__getitem__, got), np.uint64, len(got))
    n = max(1, len(h) - words + 1)
    out = np.full(n, min(len(h), words), np.uint64)
    for k in range(min(words, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def bitmap(hashes) -> bytes:
    """One bit for each shingle, by the hash's high bits, so that halves fold by OR of neighbours."""
    import numpy as np

    bits = max(6, int(2 * len(hashes) - 1).bit_length())
    on = np.zeros(1 << bits, np.uint8)
    on[(hashes >> np.uint64(64 - bits)).astype(np.int64)] = 1
    return np.packbits(on).tobytes()


def _sampled(words: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                sets = [shingles(t, words) for t in batch.column("text").slice(i, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    return run


def frequent(docs: DataFrame, words: int):
    """The shingles that many texts of a sample hold, the rarest first; texts are drawn by a hash of what they say, once each."""
    import numpy as np

    drawn = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    counts = drawn.mapInArrow(_sampled(words), "h long").groupBy("h").count().where(F.col("count") >= OFTEN)
    rows = counts.orderBy(F.desc("count"), "h").limit(MOST_FREQUENT).select("h").collect()
    return np.array([r[0] for r in reversed(rows)], np.int64).view(np.uint64)


def _signatures(words: int, percent: int, hot):
    """The shown hashes are the SKETCH smallest if hot is None, else the first in the order that has hot last."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        order = None if hot is None else np.argsort(hot)
        ordered = None if hot is None else hot[order]
        for batch in batches:
            rows = batch.column("text")
            names = batch.column("doc_id")
            for i in range(0, len(rows), 512):
                n, keys, shown, maps = [], [], [], []
                for text in rows.slice(i, 512).to_pylist():
                    h = shingles(text, words)
                    n.append(len(h))
                    keys.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                    take = SKETCH if hot is None else len(h) + (-percent * len(h) // 100) + 1 if len(h) else 0
                    if hot is not None and len(hot) and len(h):
                        at = np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)
                        often = ordered[at] == h
                        h2 = np.concatenate([h[~often], h[often][np.argsort(order[at[often]])]])
                    else:
                        h2 = h
                    shown.append(h2[:take].view(np.int64))
                    maps.append(bitmap(h) if len(h) else b"")
                ends = np.cumsum([0, *map(len, shown)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([names.slice(i, 512), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(shown))), pa.array(maps, pa.binary())], ["doc_id", "n_shingles", "key", "shown", "bits"])

    return run


SIGNED = "doc_id long, n_shingles long, key binary, shown array<long>, bits binary"


def fold(raw: bytes, size: int):
    """The bitmap as bytes of `size`, OR-folded."""
    import numpy as np

    x = np.frombuffer(raw, np.uint8)
    while len(x) > size:
        # Two neighbouring bits become one, in the order of the hash.
        b = np.unpackbits(x).reshape(-1, 2)
        x = np.packbits(b[:, 0] | b[:, 1])
    return x


class Tree:
    """A signature tree over sets ordered by size and bitmap: levels of LEAF-fold nodes."""

    def __init__(self, ids, sizes, maps, classes):
        import numpy as np

        width = min(len(m) for m in maps)
        flat = np.stack([fold(m, width) for m in maps])
        order = np.lexsort((flat[:, 0], sizes))
        self.order = order
        self.ids, self.sizes, self.classes = ids[order], sizes[order], classes[order]
        self.maps = flat[order]
        self.slack = self.sizes - np.bitwise_count(self.maps).sum(1, dtype=np.int64)
        #: (bitmaps, smallest sizes, largest sizes, slack, smallest class, largest class) of each level, leaves first.
        self.levels = [(self.maps, self.sizes, self.sizes, self.slack, self.classes, self.classes)]
        while len(self.levels[-1][0]) > 1:
            m, lo, hi, sl, c0, c1 = self.levels[-1]
            at = np.arange(0, len(m), LEAF)
            self.levels.append((np.bitwise_or.reduceat(m, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(sl, at), np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at)))


def tree_pairs(a: Tree, b: Tree, percent: int, same: bool):
    """Arrays of leaf positions (in a, in b) of the pairs whose largest possible overlap reaches the threshold.

    Both trees are walked from the root a level at a time; pairs of nodes that hold one and the same class are skipped.
    """
    import numpy as np

    width = min(a.maps.shape[1], b.maps.shape[1])
    levels_a, levels_b = a.levels, b.levels
    ka, kb = len(levels_a) - 1, len(levels_b) - 1
    x, y = np.zeros(1, np.int64), np.zeros(1, np.int64)
    narrow: dict = {}

    def maps(tree, name, k):
        if (name, k) not in narrow:
            m = tree.levels[k][0]
            narrow[name, k] = m if m.shape[1] == width else np.stack([fold(r.tobytes(), width) for r in m])
        return narrow[name, k]

    def slack(tree, name, k):
        if tree.maps.shape[1] == width:
            return tree.levels[k][3]
        if (name, "s", k) not in narrow:
            s = tree.sizes - np.bitwise_count(maps(tree, name, 0)).sum(1, dtype=np.int64)
            for _ in range(k):
                s = np.maximum.reduceat(s, np.arange(0, len(s), LEAF))
            narrow[name, "s", k] = s
        return narrow[name, "s", k]

    while True:
        _, lo_a, hi_a, _, c0a, c1a = levels_a[ka]
        _, lo_b, hi_b, _, c0b, c1b = levels_b[kb]
        keep = (hi_a[x] * 100 >= percent * lo_b[y]) & (hi_b[y] * 100 >= percent * lo_a[x])
        keep &= ~((c0a[x] == c1a[x]) & (c0b[y] == c1b[y]) & (c0a[x] == c0b[y]))
        if same and ka == kb:
            keep &= x <= y if ka else x < y
        x, y = x[keep], y[keep]
        ok = np.empty(len(x), bool)
        ma, mb = maps(a, "a", ka), maps(b, "b", kb)
        sa, sb = slack(a, "a", ka), slack(b, "b", kb)
        step = max(1, 16_000_000 // width)
        for i in range(0, len(x), step):
            p, q = x[i : i + step], y[i : i + step]
            shared = np.bitwise_count(ma[p] & mb[q]).sum(1, dtype=np.int64)
            most = np.minimum(np.minimum(sa[p], sb[q]) + shared, np.minimum(hi_a[p], hi_b[q]))
            # overlap >= percent * union, union = sizes - overlap
            ok[i : i + step] = most * (100 + percent) >= percent * (lo_a[p] + lo_b[q])
        x, y = x[ok], y[ok]
        if not ka and not kb or not len(x):
            return x, y
        down_a, down_b = (ka >= kb, kb >= ka)
        if down_a:
            ka -= 1
            n = len(levels_a[ka][1])
            x = (x[:, None] * LEAF + np.arange(LEAF)).ravel()
            y = np.repeat(y, LEAF)
            x, y = x[x < n], y[x < n]
        if down_b:
            kb -= 1
            n = len(levels_b[kb][1])
            y = (y[:, None] * LEAF + np.arange(LEAF)).ravel()
            x = np.repeat(x, LEAF)
            x, y = x[y < n], y[y < n]


def _bucket_pairs(percent: int, led: bool = False):
    """From rows of one (hash, block pair) after the other to candidate pairs; a row's side is 0 or 1.

    The smaller id of a pair comes first, or, if the buckets are led by side 0, the id of that side.

    A pair that shares several buckets comes from the first of them alone: `before` holds a set's earlier buckets.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        out_a, out_b = [], []

        def tree(t):
            return Tree(t["doc_id"].to_numpy(), t["n_shingles"].to_numpy(), t["bits"].to_pylist(), t["class"].to_numpy())

        for t in common.batches_of_runs(batches, "bucket"):
            side = t["side"].to_numpy()
            both = side.min() != side.max()
            left = tree(t.filter(pa.array(side == 0)) if both else t)
            right = tree(t.filter(pa.array(side == 1))) if both else left
            x, y = tree_pairs(left, right, percent, not both)
            differ = left.classes[x] != right.classes[y]
            x, y = x[differ], y[differ]
            before = [frozenset(b) for b in t["before"].to_pylist()]
            one, two = ([b for b, s in zip(before, side) if s == 0], [b for b, s in zip(before, side) if s == 1]) if both else (before, before)
            new = np.fromiter((one[i].isdisjoint(two[j]) for i, j in zip(left.order[x].tolist(), right.order[y].tolist())), bool, len(x))
            p, q = left.ids[x][new], right.ids[y][new]
            out_a.append(p if led else np.minimum(p, q))
            out_b.append(q if led else np.maximum(p, q))
            if sum(map(len, out_a[-64:])) > 50_000 or len(out_a) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])
                out_a, out_b = [], []
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return run


def _verify(words: int, percent: int):
    """Rows of one bundle after the other: the first set of a bundle (lead) against the others."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for t in common.batches_of_runs(batches, "bundle"):
            rows = t.to_pydict()
            sets: dict = {}
            for lead, doc, text in zip(rows["a"], rows["doc_id"], rows["text"]):
                if lead == doc:
                    sets.setdefault(lead, []).append(shingles(text, words))
            found: list = []
            for lead, doc, text in zip(rows["a"], rows["doc_id"], rows["text"]):
                if lead != doc and lead in sets:
                    two = shingles(text, words)
                    for one in sets[lead]:
                        both = len(np.intersect1d(one, two, assume_unique=True))
                        if both and 100 * both >= percent * (len(one) + len(two) - both):
                            found.append((lead, doc))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["src", "dst"])

    return run


def verified(pairs: DataFrame, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose whole texts link. Each bundle has one text a and up to some BUNDLE texts b."""
    spark = docs.sparkSession
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(BUNDLE)))
    size = dealt.groupBy("a").agg(F.count("*").alias("n"))
    dealt = common.hot_join(dealt, size, "a", "n").select("a", "b", F.pmod("salt", F.ceil(F.col("n") / BUNDLE)).alias("part"))
    members = dealt.select("a", "part", F.col("b").alias("doc_id"))
    want = common.stash(members.union(dealt.select("a", "part", F.col("a").alias("doc_id")).distinct()), "wanted")
    own = common.small_join(docs, want.select("doc_id").distinct(), "doc_id")
    rows = own.join(want, "doc_id").select(F.xxhash64("a", "part").alias("bundle"), "a", "doc_id", "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "bundle").sortWithinPartitions("bundle").mapInArrow(_verify(words, percent), "src long, dst long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, exact: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs; exact: buckets that cannot lose a link (see above)."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = common.texts(docs)
    signed = common.stash(source.mapInArrow(_signatures(words, percent, frequent(source, words) if exact else None), SIGNED), "signatures")
    named = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")

    # Equal sets: the smallest doc_id stands for all of them.
    reps = common.stash(named.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "representatives")
    copies = common.hot_join(named.select("doc_id", "key"), reps.where("rows > 1"), "key", "rows").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    # A doc_id may stand for several sets (rows that share it); then it has several signatures.
    first = named.groupBy("key").agg(F.min(F.struct("doc_id", "n_shingles", "shown", "bits")).alias("s")).select("key", "s.*")
    first = common.stash(first, "sets")

    # Buckets by the shown shingles that more than one set shows, the rarest first.
    shown = first.select("key", F.explode("shown").alias("h"))
    many = common.stash(shown.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    ranked = common.hot_join(shown, many, "h", "df").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("common"))
    # Hashes that only this set shows are the rarest; they use up the first places and make no bucket.
    need = F.least(F.lit(COMMON), F.ceil(F.col("n_shingles") * percent / 100)).cast("int")
    take = F.size("common") if exact else F.size("common") - need + 1
    kept = first.join(ranked, "key").withColumn("take", F.least(F.size("common"), F.greatest(F.lit(0), take))).where("take > 0")
    kept = common.stash(kept.select("key", "doc_id", "n_shingles", "bits", F.expr("slice(common, 1, take)").alias("buckets"), F.expr("aggregate(common, 0D, (s, x) -> s + log2(x.df))").alias("central")), "prefixes")

    # First turn: the most central set of a bucket against the others; each set names one such lead.
    spots = kept.select("doc_id", "central", F.explode("buckets").alias("x")).select("doc_id", "central", "x.h")
    leads = spots.groupBy("h").agg(F.max(F.struct("central", (-F.col("doc_id")).alias("m"))).alias("best"), F.count("*").alias("rows")).select("h", F.col("best.central").alias("lead_central"), (-F.col("best.m")).alias("lead"), "rows")
    votes = common.hot_join(spots, leads, "h", "rows").where("doc_id <> lead").groupBy("doc_id", "lead").agg(F.count("*").alias("votes"), F.max("lead_central").alias("lead_central"))
    chosen = common.stash(votes.groupBy("doc_id").agg(F.max(F.struct("votes", "lead_central", (-F.col("lead")).alias("m"))).alias("best")).select((-F.col("best.m")).alias("a"), F.col("doc_id").alias("b")), "chosen")
    texts_of = source.where("doc_id IS NOT NULL")
    links = common.stash(verified(common.stash(led_pairs(chosen, kept, percent), "led"), texts_of, words, percent), "links")
    classes = common.components(links)

    # Second turn: whatever the trees leave between different classes.
    held = kept.join(classes.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", "bits", "buckets", F.coalesce("component_id", "doc_id").alias("class"))
    held = common.stash(held, "held")
    spots = held.select("doc_id", "class", F.explode("buckets.h").alias("h"))
    mixed = spots.groupBy("h").agg(F.min("class").alias("c0"), F.max("class").alias("c1"), F.count("*").alias("n")).where("c0 <> c1").select("h", "n")
    placed = common.stash(common.hot_join(spots, mixed, "h", "n").select("doc_id", "h", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "placed")
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    # A block meets itself and every other block of its bucket once.
    dealt = placed.withColumn("own", block).select("doc_id", "h", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    dealt = dealt.select("doc_id", "h", F.xxhash64("h", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    earlier = F.expr("slice(buckets.h, 1, cast(array_position(buckets.h, h) AS int) - 1)").alias("before")
    rows = dealt.join(held, "doc_id").select("doc_id", "bucket", "side", "n_shingles", "bits", "class", earlier)
    found = rows.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_pairs(percent), "a long, b long").distinct()
    more = common.stash(verified(common.stash(found, "candidates"), texts_of, words, percent), "links")

    linked = common.components(common.stash(links.union(more).union(copies), "all_links"))
    return signed.select("doc_id", "n_shingles").join(linked.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def led_pairs(chosen: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of chosen that the trees leave: that of the lead a against those of up to some BUNDLE sets b."""
    n = int(chosen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = chosen.groupBy("a").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / BUNDLE)
    dealt = common.hot_join(chosen, size, "a", "n").select("a", "b", F.pmod(F.xxhash64("b"), parts).alias("part"))
    leads = size.select("a", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    sides = dealt.select("a", "part", F.col("b").alias("doc_id"), F.lit(1).alias("side")).union(leads.select("a", "part", F.col("a").alias("doc_id"), F.lit(0).alias("side")))
    rows = sides.join(sets, "doc_id").select("doc_id", F.xxhash64("a", "part").alias("bucket"), "side", "n_shingles", "bits", F.col("doc_id").alias("class"), F.array().cast("array<long>").alias("before"))
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_pairs(percent, led=True), "a long, b long").distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
