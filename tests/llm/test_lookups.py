"""Decontamination, spelling variants and ranked search against brute force, with the awkward cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import common, decontamination as dec, ranked_search as rank, spelling

SCHEMA = "doc_id long, text string, lang string, source string, score string, item_id long, term string, word string, pos string, at string"
R = random.Random(12)
#: Few words, so that phrases recur and scores tie; letters beyond ASCII, of both cases.
COMMON = ["the", "of", "élan", "Ünder", "is", "naïve"]
RARE = ["".join(R.choice("abcdefgh") for _ in range(6)) for _ in range(60)]


def text(n):
    return R.choice([" ", ", ", "--"]).join(R.choice(COMMON) if R.random() < 0.5 else R.choice(RARE) for _ in range(n))


ITEMS = [(i, text(n)) for i, n in enumerate((24, 15, 10, 9, 3, 1, 40))] + [(7, None), (8, ""), (9, "-- ??"), (None, text(12)), (2, text(11)), (10, "the of is the of is the of is the of is")]
ITEMS += [(11, ITEMS[0][1]), (12, ITEMS[0][1].upper())]


def corpus():
    texts = [text(R.randrange(1, 200)) for _ in range(60)]
    texts += [f"{text(20)} {t.upper()} {text(5)}" for _, t in ITEMS[:7]] + [ITEMS[0][1] + " " + ITEMS[0][1], ITEMS[6][1][:80], None, "", " \n ", "?!", "the " * 30_000, "of is the " * 40, "É" * 50_000]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[1], rows[61], (None, texts[62]), (None, texts[62]), (5, texts[63])] + [(1000 + k, texts[64]) for k in range(40)]
    return rows


DOCS = corpus()


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", None, "s", 1, "t", "w", "p", "a") for d, t in rows], SCHEMA)


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "item_id long, text string, word string, n_words string")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(lower(t))


def cleaned_by_hand(docs, bench):
    windows = []
    for i, t in bench:
        w = words(t)
        windows += [("" if i is None else str(i), tuple(w[k : k + 10])) for k in range(max(1, len(w) - 9))] if w else []
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        places = defaultdict(list)
        for k, x in enumerate(w):
            places[x].append(k)
        for i, p in set(windows):
            for k in places.get(p[0], ()):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found.add(i)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def test_decontamination_equals_brute_force(spark):
    got = dec.decontaminated(table(spark, DOCS), items(spark, ITEMS))
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = cleaned_by_hand(DOCS, ITEMS)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert any(w[3] > 2 for w in want) and not all(w[5] for w in want)


def test_decontamination_by_shuffles_alone(spark, monkeypatch):
    """The same rows if no side is small enough to broadcast, and with shorter windows."""
    monkeypatch.setattr(common.small_join, "__defaults__", ("inner", 0))
    some, bench = DOCS[40:80], ITEMS[:5]
    got = dec.decontaminated(table(spark, some), items(spark, bench)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(cleaned_by_hand(some, bench), key=key)


def test_decontamination_of_empty_tables(spark):
    assert dec.decontaminated(table(spark, []), items(spark, ITEMS)).count() == 0
    alone = dec.decontaminated(table(spark, DOCS[:5]), items(spark, [])).collect()
    assert len(alone) == 5 and all(r.n_hit == 0 and not r.contaminated and r.items_sha256 == hashlib.sha256(b"").hexdigest() for r in alone)
    with pytest.raises(ValueError, match="62"):
        dec.phrases(items(spark, ITEMS), 63)


def test_proximity_matches(spark):
    docs, near = DOCS[:70], 6
    found = dec.phrases(items(spark, ITEMS[:6]), 3).cache()
    index = dec.postings(common.texts(table(spark, docs)).where("doc_id IS NOT NULL"))
    plans = dec.plans(found, index).cache()
    names = {r.phrase: tuple(r.words) for r in found.collect()}
    anchors = {r.phrase: names[r.phrase][r.steps[0].offset] for r in plans.collect()}
    got = {(r.k1, r["at"], names[r.phrase]) for r in dec.near_matches(index, plans, near).collect()}
    want = set()
    for d, t in docs:
        w = words(t)
        for p, first in anchors.items():
            for k, x in enumerate(w):
                around = set(w[max(0, k - near) : k + near + 1])
                if x == first and set(names[p]) <= around:
                    want.add((d, k, names[p]))
    assert got == want and len(want) > 20
    # An index of all words holds each word of each text.
    assert index.count() == sum(len(words(t)) for _, t in docs)
    exact = {(r.k1, r["at"], names[r.phrase]) for r in dec.phrase_matches(index, plans).collect()}
    assert exact == {(d, k, tuple(p)) for d, t in docs for w in [words(t)] for p in {names[q] for q in anchors} for k in range(len(w) - len(p) + 1) if tuple(w[k : k + len(p)]) == p}


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def variants_by_hand(docs):
    count = Counter()
    for d, t in docs:
        for run in RUN.findall(t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 7 and c >= 2}

    def apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and v != w and apart(v, w)] for w in n}
    form = {w: v for w, vs in near.items() if vs for v in [min(vs, key=lambda x: (-n[x], x))] if n[v] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), c, len(near[w]), n.get(form.get(w))) for w, c in n.items()), len(form)


def spelled():
    r = random.Random(9)
    base = ["kindness", "überfahrt", "Étranger", "remember", "aaaaaaaa", "aaaaaaab", "ñandúes", "señorita", "k" * 3000, "k" * 2999 + "m"]
    pool = list(base)
    for w in base * 5:
        k = r.randrange(len(w))
        pool.append(r.choice([w[:k] + r.choice("aexéß") + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + r.choice("bñ") + w[k:]]))
    # One chain: each word ten times as frequent as the last.
    chain = ["mountain"] * 800 + ["mountein"] * 50 + ["mounteim"] * 4
    draws = [pool[min(int(r.expovariate(0.25)), len(pool) - 1)] for _ in range(3000)] + pool * 2 + chain
    r.shuffle(draws)
    docs = [(k, " ".join(x.upper() if r.random() < 0.1 else x for x in draws[k * 40 : k * 40 + 40])) for k in range(len(draws) // 40 + 1)]
    return docs + [(None, "mountain kindness"), (None, None), (7000, ""), (7001, "7 12 ~"), docs[0], docs[3], (7002, "remember×remember÷kindness_kindness ſkindness")]


def test_spelling_variants_equal_brute_force(spark):
    docs = spelled()
    want, n_forms = variants_by_hand(docs)
    got = spelling.variants(table(spark, docs))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == want
    assert n_forms > 10 and any(w[1] and w[2] != w[1] for w in want)
    assert spelling.variants(table(spark, [])).count() == 0


def test_blocks_of_one_cell_meet_once(spark):
    """Hot cells dealt to parts of a few words find the same near words, each pair once."""
    docs = spelled()[:60]
    want, _ = variants_by_hand(docs)
    found = spelling.words(table(spark, docs))
    for groups, part in ((1, 3), (4, 2), (8, 512)):
        got = {r.word: r.n_near for r in spelling.near_words(found, groups, part).collect()}
        assert got == {w[0]: w[4] for w in want if w[4]}


def test_edits():
    a = np.frombuffer(b"abcdef" * 5, np.uint8).reshape(5, 6)
    same = np.frombuffer(b"abcdef" b"abcxef" b"bacdef" b"abcdex" b"xbcdef", np.uint8).reshape(5, 6)
    assert spelling.edited(a, same).tolist() == [False, True, False, True, True]
    more = np.frombuffer(b"abcdefg" b"xabcdef" b"abccdef" b"abdcxef" b"bacdefg", np.uint8).reshape(5, 7)
    assert spelling.edited(a, more).tolist() == [True, True, True, False, False]
    assert sorted(spelling.neighbours("1,0")) == ["1,1", "2,0"] and "2,0" in spelling.neighbours("1,1")


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def ranked_by_hand(docs, bench, top):
    counted = [(d, Counter(map(lower, TERM.findall(t or "")))) for d, t in docs]
    size = [sum(c.values()) for _, c in counted]
    n, total = sum(s > 0 for s in size), sum(size)
    df = Counter(t for _, c in counted for t in c)
    wanted = defaultdict(set)
    for i, t in bench:
        wanted[i] |= set(map(lower, TERM.findall(t or "")))
    out = []
    for i, terms in wanted.items():
        hits = []
        for (d, c), s in zip(counted, size):
            m = 50 + (50 * s * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                hits.append((-score, (d is not None, d or 0), d))
        out += [(i, k, d, -s) for k, (s, _, d) in enumerate(sorted(hits, key=lambda h: h[:2])[:top], 1)]
    return sorted(out, key=key)


def test_ranked_search_equals_brute_force(spark):
    docs, bench = table(spark, DOCS), items(spark, ITEMS)
    for top, block_docs, block_terms in ((50, 2048, 200_000), (5, 7, 30), (1, 1, 200_000)):
        got = rank.search(docs, bench, top, block_docs, block_terms)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=key) == ranked_by_hand(DOCS, ITEMS, top), (top, block_docs)
    for d, i in (([], ITEMS), (DOCS, [])):
        assert rank.search(table(spark, d), items(spark, i)).count() == 0


def test_pair_bounds_skip_more_and_lose_nothing():
    """Blocks of skewed lists: the same best documents whether bounds are joint or single, with fewer postings added up."""
    r = np.random.default_rng(5)
    n_docs, n_terms, top, added, found = 400, 40, 10, {}, {}
    items_ = [sorted(r.choice(n_terms, 8, replace=False).tolist()) for _ in range(20)]
    blocks = []
    for _ in range(12):
        sizes = r.integers(20, 400, n_docs)
        lists = [np.flatnonzero(r.random(n_docs) < 0.4 / (1 + t % 10)) for t in range(n_terms)]
        docs, terms = np.concatenate(lists), np.repeat(np.arange(n_terms), [len(x) for x in lists])
        blocks.append((sizes, terms, docs, r.geometric(0.4, len(docs))))
    rarity = {t: sum(int((b[1] == t).sum()) for b in blocks) for t in range(n_terms)}
    weights = np.array([math.floor(1000 * math.log((2 * 4800 + 2) / (2 * rarity[t] + 1))) for t in range(n_terms)])
    pairs, units = rank.matched(items_, rarity)
    assert {t for own in units for a, b, _ in own for t in (a, b)} - {-1} <= set(range(n_terms)) and all(len(own) == 4 for own in units)
    for paired in (True, False):
        best, work = rank.Best([0] * len(units), top), 0
        for k, (sizes, terms, docs, tfs) in enumerate(blocks):
            names, ends = np.unique(terms), np.searchsorted(terms, np.unique(terms), side="right")
            value = rank.impacts(weights, names, ends, docs, tfs, sizes, 4800, int(sizes.sum()) * 12)
            joint = np.zeros(len(pairs), np.int64)
            for p, (a, b) in enumerate(pairs):
                one, two = (dict(zip(docs[terms == t].tolist(), value[terms == t].tolist())) for t in (a, b))
                joint[p] = max((one[d] + two[d] for d in one.keys() & two.keys()), default=0)
            work += rank.search_block(units, names, ends, docs, value, joint, np.arange(n_docs) + k * n_docs, np.ones(n_docs, bool), best, paired)
        added[paired], found[paired] = work, [(s.tolist(), i.tolist()) for s, i, _ in best.held]
    assert found[True] == found[False]
    assert added[True] < 0.97 * added[False], added
