"""Ranked lexical search by MaxScore with bounds for pairs of terms.

The index is made of blocks of documents, each one row with the inverted lists of the queries' terms in its documents.
Once the numbers of documents and occurrences are known over all blocks, lists get impacts, and each block is given what
makes it skippable: the highest impact of each term, and for pairs of terms the intersection of their lists with its
joint maximum, the largest sum of both impacts in one document. An item's terms are matched to pairs by how rare they
are. What a pair can add to a document is at most the larger of its joint maximum and its terms' own maxima, which is
less than their sum wherever the documents in which the terms are strongest differ; these bounds are combined over the
item's pairs.

The joint impacts of short intersections, summed over an item's pairs, are scores that documents reach at least; each block
keeps the best of them, and those of all blocks give each item a first threshold. A task then goes through its blocks: a block whose
combined bound is below an item's threshold is skipped; else pairs whose bounds together stay below it are not essential,
documents are gathered from the lists of the others alone, and the rest is added for those which can still reach the
threshold. Tasks keep the best documents of each item over their blocks, and the best of all tasks are ranked.

Queries are taken BLOCK_TERMS terms at a time, so what a task is given is bounded however many items there are.

Cases: a null or empty text has no terms and is never returned (an item without terms, or whose terms no document holds,
returns nothing); very long texts are read whole; rows that share a doc_id are ranked each on its own; equal scores rank
by doc_id, a null doc_id first; rows of one item_id are one item; empty tables give no row; other columns are ignored.
"""

from __future__ import annotations

import array
import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common, decontamination

TOP = 50
#: Documents and postings of one block of the index.
BLOCK_DOCS, BLOCK_POSTINGS = 2048, 500_000
#: Terms of items, repeats between items counted, that one turn looks for.
BLOCK_TERMS = 200_000
#: Documents of an intersection that counts as short.
SHORT = 64

#: Bytes to bytes: A-Z to a-z, and what stands between words to spaces; bytes of longer characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

BLOCKS = "doc_ids array<long>, sizes array<long>, terms array<int>, ends array<int>, docs array<int>, tfs array<long>, holders long, total long"
INDEX = "doc_ids array<long>, terms array<int>, ends array<int>, docs array<int>, impacts array<long>, joint array<long>, seed_items array<int>, seeds array<long>"


def _inverted(vocabulary: dict[bytes, int], block_docs: int):
    def run(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        names, sizes, terms, docs, tfs = [], array.array("q"), array.array("i"), array.array("i"), array.array("q")

        def block():
            order = np.argsort(np.asarray(terms, np.int32), kind="stable")
            found, firsts = np.unique(np.asarray(terms, np.int32)[order], return_index=True)
            ends = np.append(firsts[1:], len(order)) if len(found) else firsts
            size = np.asarray(sizes, np.int64)
            lists = [pa.array(names, pa.int64()), size, found, ends.astype(np.int32), np.asarray(docs, np.int32)[order], np.asarray(tfs, np.int64)[order]]
            return pa.RecordBatch.from_arrays([*map(one_row, lists), pa.array([int((size > 0).sum())], pa.int64()), pa.array([int(size.sum())], pa.int64())], names=[f.split()[0] for f in BLOCKS.split(", ")])

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            ids = batch.column("doc_id").to_pylist()
            for k, name in enumerate(ids):
                got = texts[k].as_py().translate(FOLD).split()
                at = len(names)
                names.append(name)
                sizes.append(len(got))
                for word, n in Counter(got).items():
                    term = vocabulary.get(word)
                    if term is not None:
                        terms.append(term)
                        docs.append(at)
                        tfs.append(n)
                if len(names) >= block_docs or len(terms) >= BLOCK_POSTINGS:
                    yield block()
                    names, sizes, terms, docs, tfs = [], array.array("q"), array.array("i"), array.array("i"), array.array("q")
        if names:
            yield block()

    return run


def one_row(values):
    """An Arrow list column of one row that holds the values."""
    import numpy as np
    import pyarrow as pa

    flat = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array(np.array([0, len(flat)], np.int32)), flat)


def read(row: dict, *names: str):
    """Columns of one row as NumPy arrays."""
    return [row[n].values.to_numpy(zero_copy_only=False) for n in names]


def rows_of(batches):
    """Each row of the batches as a dict of Arrow scalars."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(name)[k] for name in batch.schema.names}


def matched(items: list[list[int]], rarity: dict[int, int]) -> tuple[list[tuple[int, int]], list[list[tuple[int, int, int]]]]:
    """The distinct pairs of terms, and for each item its units (first term, second term or -1, pair or -1).

    Neighbours in the order of rarity make a pair, so that the lists of a pair are about as long; an odd term stays alone.
    """
    pairs: dict[tuple[int, int], int] = {}
    units = []
    for terms in items:
        order = sorted((t for t in terms if t in rarity), key=lambda t: (rarity[t], t))
        own = []
        for k in range(0, len(order) - 1, 2):
            pair = (min(order[k : k + 2]), max(order[k : k + 2]))
            own.append((*pair, pairs.setdefault(pair, len(pairs))))
        if len(order) % 2:
            own.append((order[-1], -1, -1))
        units.append(own)
    return list(pairs), units


def impacts(weights, terms, ends, docs, tfs, sizes, n_docs: int, total: int):
    """The impact of each posting, in whole numbers."""
    import numpy as np

    m = 50 + (50 * sizes * n_docs) // total
    of = np.repeat(terms, np.diff(ends, prepend=0))
    return weights[of] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[docs]))


def _paired(weights, n_docs: int, total: int, pairs, units, top: int):
    """From blocks to index blocks: impacts, joint maxima of the pairs, and the best scores that short intersections prove."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for row in rows_of(batches):
            sizes, terms, ends, docs, tfs = read(row, "sizes", "terms", "ends", "docs", "tfs")
            value = impacts(weights, terms, ends, docs, tfs, sizes, n_docs, total)
            place = np.full(len(weights), -1)
            place[terms] = np.arange(len(terms))
            begin = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            spread, joint, short = np.zeros(len(sizes), np.int64), np.zeros(len(pairs), np.int64), {}
            for p, (a, b) in enumerate(pairs):
                i, j = place[a], place[b]
                if i < 0 or j < 0:
                    continue
                if ends[i] - begin[i] > ends[j] - begin[j]:
                    i, j = j, i
                one, two = slice(begin[i], ends[i]), slice(begin[j], ends[j])
                spread[docs[two]] = value[two]
                other = spread[docs[one]]
                both = other > 0
                if both.any():
                    sums = value[one][both] + other[both]
                    joint[p] = sums.max()
                    if len(sums) <= SHORT:
                        short[p] = docs[one][both], sums
                spread[docs[two]] = 0
            seed_items, seeds = [], []
            for item, own in enumerate(units):
                lists = [short[p] for _, _, p in own if p in short]
                for at, sums in lists:
                    spread[at] += sums
                if lists:
                    at = np.unique(np.concatenate([x[0] for x in lists]))
                    best = np.sort(spread[at])[::-1][:top]
                    seed_items.append(np.full(len(best), item, np.int32))
                    seeds.append(best)
                    spread[at] = 0
            flat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
            arrays = [row["doc_ids"].values, terms, ends, docs, value, joint, flat(seed_items, np.int32), flat(seeds, np.int64)]
            yield pa.RecordBatch.from_arrays(list(map(one_row, arrays)), names=[f.split()[0] for f in INDEX.split(", ")])

    return run


class Best:
    """The best documents of each item so far, and what a document must reach to be one of them."""

    def __init__(self, first, top: int):
        import numpy as np

        self.top, self.least = top, np.array(first, np.int64)
        empty = np.zeros(0, np.int64)
        #: Scores, ids to rank by, and whether the id is not null.
        self.held = [(empty, empty, np.zeros(0, bool)) for _ in first]

    def add(self, item: int, scores, ids, named):
        import numpy as np

        if not len(scores):
            return
        scores, ids, named = (np.concatenate(x) for x in zip(self.held[item], (scores, ids, named)))
        order = np.lexsort((ids, named, -scores))[: self.top]
        self.held[item] = scores[order], ids[order], named[order]
        if len(order) == self.top:
            self.least[item] = max(self.least[item], scores[order[-1]])


def search_block(units, terms, ends, docs, value, joint, ids, named, best: Best, paired: bool = True) -> int:
    """Take one block's documents into best; how many postings were added up. Without paired, bounds are sums of the terms' own."""
    import numpy as np

    place = {t: k for k, t in enumerate(terms.tolist())}
    begin = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    highest = np.maximum.reduceat(value, begin).tolist() if len(ends) else []
    begin, ends, joint, added = begin.tolist(), ends.tolist(), joint.tolist(), 0
    spread = np.zeros(len(ids), np.int64)
    for item, own in enumerate(units):
        bounded = []
        for a, b, p in own:
            lists = [place[t] for t in (a, b) if t in place]
            if lists:
                singly = [highest[k] for k in lists]
                bounded.append((max(*singly, joint[p]) if paired and len(lists) == 2 else sum(singly), lists))
        left, least = sum(x for x, _ in bounded), int(best.least[item])
        if left < least or not left:
            continue
        # Units, the rarest first, are essential until what follows cannot reach the threshold alone.
        k, seen = 0, []
        while k < len(bounded) and (left >= least or not seen):
            bound, lists = bounded[k]
            for x in lists:
                part = slice(begin[x], ends[x])
                spread[docs[part]] += value[part]
                seen.append(docs[part])
                added += ends[x] - begin[x]
            left -= bound
            k += 1
        at = np.unique(np.concatenate(seen))
        score = spread[at]
        spread[at] = 0
        for bound, lists in [*bounded[k:], (0, [])]:
            if len(score) >= best.top:
                least = max(least, int(np.partition(score, len(score) - best.top)[len(score) - best.top]))
            keep = score + left >= least
            at, score = at[keep], score[keep]
            if not len(at):
                break
            for x in lists:
                part = docs[begin[x] : ends[x]]
                spot = np.minimum(np.searchsorted(part, at), len(part) - 1)
                score = score + np.where(part[spot] == at, value[begin[x] : ends[x]][spot], 0)
                added += len(at)
            left -= bound
        full = score > 0
        best.add(item, score[full], ids[at[full]], named[at[full]])
    return added


def _searched(units, first, top: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        best = Best(first, top)
        for row in rows_of(batches):
            terms, ends, docs, value, joint = read(row, "terms", "ends", "docs", "impacts", "joint")
            names = row["doc_ids"].values
            search_block(units, terms, ends, docs, value, joint, names.fill_null(0).to_numpy(), names.is_valid().to_numpy(zero_copy_only=False), best)
        for item, (scores, ids, named) in enumerate(best.held):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), item, np.int32)), pa.array(ids, mask=~named), pa.array(scores)], ["item", "doc_id", "score"])

    return run


def ranked(found: DataFrame, key: str, *order, top: int) -> DataFrame:
    """found with rank, from 1, of the first `top` rows of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return found.withColumn("rank", place).where(F.col("rank") <= top)


def search_turn(docs: DataFrame, items: list, top: int, block_docs: int) -> DataFrame:
    """(item, rank, doc_id, score) for items, lists of terms, by their places in the list. docs: doc_id, text without nulls."""
    import numpy as np

    vocabulary = {t: k for k, t in enumerate(sorted({t for terms in items for t in terms}))}
    coded = {t.encode(): k for t, k in vocabulary.items()}
    blocks = common.stash(docs.mapInArrow(_inverted(coded, block_docs), BLOCKS), "blocks")
    n_docs, total = (int(x or 0) for x in blocks.agg(F.sum("holders"), F.sum("total")).first())
    lists = F.posexplode(F.transform(F.arrays_zip("terms", "ends"), lambda x: x)).alias("at", "x")
    lengths = blocks.select("ends", lists).select(F.col("x.terms").alias("term"), (F.col("x.ends") - F.coalesce(F.get("ends", F.col("at") - 1), F.lit(0))).alias("n"))
    # One number for each of the turn's terms, whose number is bounded.
    rarity = {r["term"]: int(r["df"]) for r in lengths.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    weights = np.zeros(max(1, len(vocabulary)), np.int64)
    for term, df in rarity.items():
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    pairs, units = matched([[vocabulary[t] for t in terms] for terms in items], rarity)
    index = common.stash(blocks.mapInArrow(_paired(weights, n_docs, max(1, total), pairs, units, top), INDEX), "index")
    seeds = index.select(F.explode(F.arrays_zip("seed_items", "seeds")).alias("x")).select("x.seed_items", "x.seeds")
    first = [0] * len(units)
    # One threshold for each of the turn's items.
    for r in ranked(seeds, "seed_items", F.desc("seeds"), top=top).where(F.col("rank") == top).collect():
        first[r["seed_items"]] = r["seeds"]
    return ranked(index.mapInArrow(_searched(units, first, top), "item int, doc_id long, score long"), "item", F.desc("score"), F.asc_nulls_first("doc_id"), top=top)


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, block_docs: int = BLOCK_DOCS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score) of the `top` best documents for each item. docs: doc_id, text; benchmark: item_id, text."""
    spark = docs.sparkSession
    kind = benchmark.schema["item_id"].dataType.simpleString()
    terms = benchmark.select("item_id", F.explode(decontamination.words()).alias("term")).distinct()
    terms = common.stash(terms.groupBy("item_id").agg(F.collect_list("term").alias("terms")), "items")
    turns = max(1, math.ceil((terms.agg(F.sum(F.size("terms"))).first()[0] or 0) / block_terms))
    rows = common.texts(docs)
    found = None
    for turn in range(turns):
        own = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(turns)) == turn).orderBy("item_id").collect()
        names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(own)], f"item int, item_id {kind}")
        hits = search_turn(rows, [r["terms"] for r in own], top, block_docs)
        part = common.small_join(hits, names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        part = common.stash(part, "ranked") if turns > 1 else part
        found = part if found is None else found.unionByName(part)
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = f"regexp_extract_all(translate(text, '{decontamination.UPPER}', '{decontamination.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
c AS (SELECT COUNT(*) AS nd, SUM(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, n, term, COUNT(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, COUNT(*) AS df FROM p GROUP BY 1),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
s AS (SELECT item_id, r, doc_id, SUM(floor(1000 * ln((2 * nd + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l))))::BIGINT AS score
FROM q JOIN f USING (term) JOIN p USING (term) CROSS JOIN c GROUP BY 1, 2, 3),
o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= {TOP}"""
