"""Secret scan: base patterns, and probabilistic automata inferred from the credentials that they label.

The base patterns find labelled credentials: their values with their kind. From a bounded sample of the distinct
values of each kind a prefix tree of character classes is built in a task of its own; rare prefixes of one length share a
state. States are merged where they end and move on alike and all that follows does (tests of two shares, blue states
against red ones), never where too few words pass to tell. A contrast automaton is fitted in the same way on a bounded
sample of the other candidates, less those that a credential automaton likes as well as its own values; further ones on
made numbers, times and unique identifiers. Every candidate token of every text, whole, is then scored by its mean
log-likelihood under the best credential automaton less that under the likeliest contrast; a token that scores at least
THRESHOLD, and is at most SLACK less likely than all values learnt but the ODD share, is a span of kind `format`. A token
with = or / in it that does not is scored part by part.

Both passes read the texts and keep no more than their batch; nothing but the samples is shuffled.

Cases: null and empty texts have no spans; a very long text is read whole, in time linear in its length and hits; of
spans that tie at one start the order of KINDS decides; repeated rows return as often as they occur; a kind with fewer
than LEAST distinct values trains nothing and adds nothing; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, spans

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

KINDS = ("assign", "access", "hex", "format")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}")
PART = re.compile(r"[^=/]{12,}")
#: Distinct values of each kind that an automaton is fitted on: the ones with the smallest hashes, of at most FIT_LENGTH characters.
SAMPLE, FIT_LENGTH = 400, 256
#: Of a kind's own values, the share that fit it less well than what the contrast may not learn from.
DOUBT = 0.1
#: Visits that a state needs for a test, and distinct values that a kind needs to be learnt.
LEAST = 20
#: Two shares that differ by more standard deviations keep two states apart.
DEVIATIONS = 3.0
#: Mean log-likelihood ratio for each symbol.
THRESHOLD = 0.5
#: Of the values that an automaton was fitted on, the share that is taken for odd ones, and how far below all others a
#: token may lie in mean log-likelihood.
ODD, SLACK = 0.05, 0.1


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, str]]]:
    """(spans, labelled credentials) of one text."""
    found, values = [], []
    low = text.lower() if ":" in text or "=" in text else ""
    if low and any(k in low for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 12:
                found.append(("assign", m.start(), m.end()))
                values.append(("assign", m[2]))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            found.append(("access", m.start(), m.end()))
            values.append(("access", m[0]))
    for m in HEX.finditer(text):
        found.append(("hex", m.start(), m.end()))
        values.append(("hex", m[0]))
    return found, values


def _classes() -> dict[int, str]:
    """0 digits, f letters a-f, g other small ones, F and G capitals alike; marks stay themselves."""
    own = {ord(c): "0" for c in "0123456789"}
    for k in range(26):
        own[97 + k], own[65 + k] = ("f", "F") if k < 6 else ("g", "G")
    return own


CLASSES = _classes()


def symbols(token: str) -> str:
    """The character classes of a token."""
    return token.translate(CLASSES)


def candidates(text: str, found: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The tokens that may be secrets, by start, outside of the spans found."""
    return spans.outside(found, [m.span() for m in CANDIDATE.finditer(text)])


class Automaton:
    """State i: visits[i], ends[i], and moves[i] from a symbol to [state, count].

    A prefix that fewer than `least` words begin with has no state of its own: such prefixes of one length share a state,
    so that every state has enough visits for a test, as far as the words are many, and lengths are kept.
    """

    def __init__(self, words: list[str], least: int = LEAST):
        self.visits, self.ends, self.moves, self.least = [0], [0], [{}], least
        prefixes = Counter(w[:k] for w in words for k in range(1, len(w) + 1))
        longer = Counter(k for w in words for k in range(1, len(w) + 1) if prefixes[w[:k]] < least)
        #: The length from which on even the shared states have too few visits and are one.
        last = max((k for k, n in longer.items() if n >= least), default=0) + 1
        known: dict[object, int] = {}
        for w in words:
            s = 0
            self.visits[0] += 1
            for k, c in enumerate(w, 1):
                key = w[:k] if prefixes[w[:k]] >= least else min(k, last)
                if key not in known:
                    known[key] = len(self.visits)
                    self.visits.append(0)
                    self.ends.append(0)
                    self.moves.append({})
                self.moves[s].setdefault(c, [known[key], 0])[1] += 1
                s = known[key]
                self.visits[s] += 1
            self.ends[s] += 1
        self.into = list(range(len(self.visits)))

    def root(self, s: int) -> int:
        """The state that s has been merged into."""
        while self.into[s] != s:
            self.into[s] = self.into[self.into[s]]
            s = self.into[s]
        return s

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        """Whether two shares differ by more than DEVIATIONS standard deviations of their difference were they one."""
        if n1 == 0 or n2 == 0:
            return False
        both = (f1 + f2) / (n1 + n2)
        return abs(f1 / n1 - f2 / n2) > DEVIATIONS * math.sqrt(both * (1 - both) * (1 / n1 + 1 / n2))

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b, and the states that follow both by the same symbols, end and move on alike; b has enough visits."""
        if self.visits[b] < self.least or self.visits[a] < self.least:
            return False
        todo, seen = [(a, b)], set()
        while todo:
            p, q = (self.root(x) for x in todo.pop())
            if p == q or (p, q) in seen:
                continue
            seen.add((p, q))
            n1, n2 = self.visits[p], self.visits[q]
            if self._differ(self.ends[p], n1, self.ends[q], n2):
                return False
            one, two = self.moves[p], self.moves[q]
            for c in one.keys() | two.keys():
                x, y = one.get(c), two.get(c)
                if self._differ(x[1] if x else 0, n1, y[1] if y else 0, n2):
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Make a and b one state, and with them what follows both by the same symbols."""
        todo = [(a, b)]
        while todo:
            p, q = (self.root(x) for x in todo.pop())
            if p == q:
                continue
            self.into[q] = p
            self.visits[p] += self.visits[q]
            self.ends[p] += self.ends[q]
            for c, (s, n) in self.moves[q].items():
                if c in self.moves[p]:
                    self.moves[p][c][1] += n
                    todo.append((self.moves[p][c][0], s))
                else:
                    self.moves[p][c] = [s, n]

    def merge(self) -> "Automaton":
        """Red states are settled; each blue state next to them joins the first compatible red one or turns red."""
        red = [0]
        at = 0
        while at < len(red):
            r = red[at]
            blue = next((b for _, m in sorted(self.moves[r].items()) if (b := self.root(m[0])) not in red), None) if self.root(r) == r else None
            if blue is None:
                at += 1
                continue
            for other in red:
                if self.root(other) == other and self.compatible(other, blue):
                    self.fold(other, blue)
                    at = 0
                    break
            else:
                red.append(blue)
        return self

    def table(self) -> dict:
        """For each state that is reached: symbol -> (next, log-probability), the log-probability of ending, and what an unseen symbol costs and leads to."""
        new, order = {0: 0}, [0]
        for s in order:
            for _, (t, _) in sorted(self.moves[s].items()):
                if self.root(t) not in new:
                    new[self.root(t)] = len(order)
                    order.append(self.root(t))
        out = {"moves": [], "ends": [], "other": [], "usual": []}
        for s in order:
            n = self.visits[s] + 1
            out["moves"].append({c: (new[self.root(t)], math.log(k / n)) for c, (t, k) in self.moves[s].items()})
            out["ends"].append(math.log((self.ends[s] + 0.1) / n))
            out["other"].append(math.log(0.01 / n))
            _, t = max(((k, -new[self.root(t)]) for t, k in self.moves[s].values()), default=(0, -new[s]))
            out["usual"].append(-t)
        return out


def fitted(words: list[str]) -> dict:
    """The table of the automaton merged from words of symbols, and `floor`, the least log-likelihood that fits it."""
    table = Automaton(words).merge().table()
    return table | {"floor": sorted(log_likelihood(table, w) for w in words)[int(ODD * len(words))] - SLACK}


def ratio(good: list[dict], contrast: list[dict], word: str) -> float:
    """The best log-likelihood among the formats that the word fits at all, less the best contrast; without any, minus infinity."""
    best = max((x for a in good if (x := log_likelihood(a, word)) >= a["floor"]), default=-math.inf)
    return best - max((log_likelihood(a, word) for a in contrast), default=-2.0) if best > -math.inf else best


def log_likelihood(table: dict, word: str) -> float:
    """Mean for each symbol; an unseen symbol costs its state's floor and leads where most words go from there."""
    s, total = 0, 0.0
    for c in word:
        move = table["moves"][s].get(c)
        if move is None:
            total += table["other"][s]
            s = table["usual"][s]
        else:
            s = move[0]
            total += move[1]
    return (total + table["ends"][s]) / (len(word) + 1)


def ordinary(n: int = 100) -> dict[str, list[str]]:
    """Made words of formats that are no secrets: whole numbers, times, and universally unique identifiers, n of each form."""
    import hashlib

    digest = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(n)]
    number = [str(int(d, 16)) for d in digest]
    day = [f"20{int(d[:4], 16) % 100:02}-{int(d[4:8], 16) % 12 + 1:02}-{int(d[8:12], 16) % 28 + 1:02}" for d in digest]
    clock = [[f"{int(d[k : k + 4], 16) % m:02}" for k, m in ((12, 24), (16, 60), (20, 60))] for d in digest]
    times = [d + t for d, c in zip(day, clock) for t in ("T" + "-".join(c), "T" + "".join(c) + "Z", "_" + "-".join(c), "-" + "-".join(c))] + [d.replace("-", "") + "T" + "".join(c) for d, c in zip(day, clock)]
    unique = ["-".join((d[:8], d[8:12], d[12:16], d[16:20], d[20:32])) for d in digest]
    return {"number": [x[:k] for x in number for k in range(12, 33)], "time": times, "unique": unique + [u.upper() for u in unique]}


def _samples(sample: int):
    """(kind, token, h) of the `sample` distinct values of each kind with the smallest hashes in a task."""

    def run(batches):
        import heapq

        import pyarrow as pa
        import xxhash

        least: dict[str, dict[int, str]] = {k: {} for k in (*KINDS[:3], "plain")}
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                for text in batch.column("text").slice(i, 1024).to_pylist():
                    found, values = base_spans(text)
                    for kind, token in [*values, *(("plain", text[s:e]) for s, e in candidates(text, found))]:
                        if len(token) <= FIT_LENGTH:
                            least[kind][xxhash.xxh64_intdigest(token) >> 1] = token
                for kind, own in least.items():
                    if len(own) > 4 * sample:
                        least[kind] = {h: own[h] for h in heapq.nsmallest(sample, own)}
        rows = [(k, own[h], h) for k, own in least.items() for h in heapq.nsmallest(sample, own)]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["kind", "token", "h"])

    return run


def _fit(pdf):
    import json

    import pandas as pd

    words = sorted(symbols(t) for t in pdf["token"])
    if len(words) < LEAST and pdf["kind"].iloc[0] in KINDS:
        return pd.DataFrame({"kind": [pdf["kind"].iloc[0]], "automaton": [None], "doubt": [None]})
    table = fitted(words)
    own = sorted(log_likelihood(table, w) for w in words)
    return pd.DataFrame({"kind": [pdf["kind"].iloc[0]], "automaton": [json.dumps(table)], "doubt": [own[int(DOUBT * len(own))]]})


def _fit_plain(known: dict[str, tuple[dict, float]]):
    def run(pdf):
        unlike = pdf["token"].map(lambda t: all(log_likelihood(a, symbols(t)) < doubt for a, doubt in known.values()))
        return _fit(pdf[unlike] if unlike.any() else pdf)

    return run


FITTED = "kind string, automaton string, doubt double"


def automata(docs: DataFrame, sample: int = SAMPLE) -> dict[str, dict]:
    """One automaton for each kind with labelled values, `plain` for the other candidates, and those of `ordinary`. docs: text."""
    import json

    # At most `sample` values of a kind and task, written so that the texts are read once for all kinds, and of those as many of a kind in all.
    drawn = common.stash(docs.select("text").mapInArrow(_samples(sample), "kind string, token string, h long").distinct(), "drawn")
    first = None
    for kind in (*KINDS[:3], "plain"):
        own = drawn.where(F.col("kind") == kind).orderBy("h", "token").limit(sample).select("kind", "token")
        first = own if first is None else first.union(own)
    first = common.stash(first, "sample")
    good = {r[0]: (json.loads(r[1]), r[2]) for r in first.where("kind <> 'plain'").groupBy("kind").applyInPandas(_fit, FITTED).where("automaton IS NOT NULL").collect()}
    plain = first.where("kind = 'plain'").groupBy("kind").applyInPandas(_fit_plain(good), FITTED).collect() if good else []
    made = {k: fitted(sorted(map(symbols, words))) for k, words in ordinary().items()} if good else {}
    return {k: a for k, (a, _) in good.items()} | {r[0]: json.loads(r[1]) for r in plain} | made


def formats(text: str, found: list[tuple[str, int, int]], score, threshold: float) -> list[tuple[str, int, int]]:
    """Spans of kind `format`: candidates whose score reaches the threshold, or else parts of them that do."""
    out = []
    for s, e in candidates(text, found):
        if score(text[s:e]) >= threshold:
            out.append(("format", s, e))
        elif "=" in text[s:e] or "/" in text[s:e]:
            out += [("format", s + m.start(), s + m.end()) for m in PART.finditer(text[s:e]) if score(m[0]) >= threshold]
    return out


def _score(known: dict[str, dict], threshold: float, keep: list[str]):
    def run(batches):
        import pyarrow as pa

        good, plain = [t for k, t in known.items() if k in KINDS], [t for k, t in known.items() if k not in KINDS]
        seen: dict[str, float] = {}

        def score(token: str) -> float:
            w = symbols(token)
            if w not in seen:
                if len(seen) > 100_000:
                    seen.clear()
                seen[w] = ratio(good, plain, w)
            return seen[w]

        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch, out = whole.slice(i, 1024), []
                for text in batch.column("text").to_pylist():
                    own, _ = base_spans(text)
                    base = spans.joined(own, KINDS)
                    every = spans.joined(own + formats(text, own, score, threshold), KINDS) if good else base
                    out.append((*(sum(k == kind for k, _, _ in own) for kind in KINDS[:3]), spans.digest(base), every))
                cols = list(zip(*out)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], [*keep, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan(docs: DataFrame, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and n_assign, n_access, n_hex, base_sha256, spans of each row. docs: text, and what is kept."""
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return rows.mapInArrow(_score(automata(rows), threshold, list(keep)), f"{kinds}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.texts(common.documents(spark, sf_dir)))
