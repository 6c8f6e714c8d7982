"""Personal data: base patterns, and bootstrapped contextual extraction of further identifiers.

The base patterns give seed entities. Every seed, and every other token that may be an identifier (it holds a digit or
an @, or follows a colon or an equals sign), is an instance with two lexical patterns: the two words or marks before it,
and the one before it with the one after it. Spark scores the pattern-instance graph in turns: a pattern's confidence is
the smoothed share of its occurrences whose instance is a seed or was taken in an earlier turn; an instance's belief is
the noisy-or over its patterns; instances with a belief of at least BELIEF are taken. After TURNS turns every occurrence
of a candidate next to a pattern that is confident and has enough support is a span of kind `id`.

Cases: null and empty texts have no spans; a very long text is read whole, in time linear in its length and hits; of
spans that tie at one start the order of KINDS decides; repeated rows return as often as they occur; a table without
seeds takes nothing; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, spans

KINDS = ("email", "ip", "card", "phone", "id")
#: The base patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){11,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

#: What may be an identifier, unless it has neither a digit nor an @ and follows no colon or equals sign.
TOKEN = re.compile(r"[A-Za-z0-9@._%+/#-]*[A-Za-z0-9@][A-Za-z0-9@._%+/#-]*")
SIGN = re.compile("[0-9@]")
#: Words and marks of a context.
LEXICAL = re.compile(r"\w+|[^\w\s]")
TURNS = 3
BELIEF = 0.8
#: A pattern needs so much confidence and so many different taken instances to yield spans.
CONFIDENCE = 0.6
SUPPORT = 5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str):
    """Matches of a local part, @ and a domain of two labels or more, leftmost first: each @ has at most one."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return found
    if text.count(".") > 2:
        found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def candidates(text: str, found: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The tokens that may be identifiers, by start, outside of the spans found."""
    places = []
    labels = ":" in text or "=" in text
    if labels or SIGN.search(text):
        for m in TOKEN.finditer(text):
            s, e = m.span()
            named = labels and (text[s - 1 : s] in (":", "=") if s and text[s - 1] != " " else s > 1 and text[s - 2] in ":=")
            if named or SIGN.search(m[0]):
                while e > s and text[e - 1] in ".-/":
                    e -= 1
                if e > s:
                    places.append((s, e))
    return spans.outside(found, places)


def contexts(text: str):
    """A function from (start, end) to the lexical patterns around it: the two before, and the one before with the one after."""
    words = [m.span() for m in LEXICAL.finditer(text)]
    starts, ends = [s for s, _ in words], [e for _, e in words]

    def of(start: int, end: int) -> list[str]:
        i, j = bisect_right(ends, start), bisect_left(starts, end)
        word = lambda k: text[starts[k] : ends[k]].lower() if 0 <= k < len(words) else ""
        return [f"{word(i - 2)} {word(i - 1)} _", f"{word(i - 1)} _ {word(j)}"]

    return of


def _scan(batches):
    import pyarrow as pa

    place = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("seed", pa.bool_()), ("token", pa.string()), ("patterns", pa.list_(pa.string()))])
    for batch in batches:
        names, rows = batch.column("doc_id"), batch.column("text")
        for i in range(0, len(rows), 1024):
            base, cands, counts = [], [], []
            for text in rows.slice(i, 1024).to_pylist():
                found = base_spans(text)
                base.append(spans.joined(found, KINDS))
                counts.append([sum(k == kind for k, _, _ in found) for kind in KINDS[:4]])
                own = [(s, e, True) for _, s, e in found] + [(s, e, False) for s, e in candidates(text, found)]
                of = contexts(text) if own else None
                cands.append([{"start": s, "end": e, "seed": seed, "token": text[s:e], "patterns": of(s, e)} for s, e, seed in own])
            yield pa.RecordBatch.from_arrays([names.slice(i, 1024), pa.array(base, pa.string()), pa.array(counts, pa.list_(pa.int64())), pa.array(cands, pa.list_(place))], ["doc_id", "base", "counts", "cands"])


def confident(edges: DataFrame, turns: int = TURNS) -> DataFrame:
    """(pattern) of the patterns that hold. edges: pattern, instance (a hash), seed, n (occurrences)."""
    taken = edges.groupBy("instance").agg(F.max("seed").alias("seed")).where("seed").select("instance", F.lit(True).alias("hit"))
    for turn in range(turns):
        known = edges.join(taken, "instance", "left")
        hits = F.when(F.col("hit"), F.col("n")).otherwise(F.lit(0))
        held = known.groupBy("pattern").agg(F.sum(hits).alias("good"), F.sum("n").alias("all"), F.sum(F.when(F.col("hit"), 1).otherwise(0)).alias("support"))
        held = common.stash(held.select("pattern", "support", (F.col("good") / (F.col("all") + 1)).alias("conf")).where(F.col("conf") >= CONFIDENCE / 2), "patterns")
        if turn < turns - 1:
            belief = edges.join(held.where(F.col("support") > 1), "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("conf")))))).alias("belief"), F.max("seed").alias("seed"))
            seeds = edges.where("seed").select("instance").distinct()
            taken = common.stash(belief.where(F.col("belief") >= BELIEF).select("instance").union(seeds).distinct().withColumn("hit", F.lit(True)), "taken")
    return held.where((F.col("conf") >= CONFIDENCE) & (F.col("support") >= SUPPORT)).select("pattern")


def _finish(batches):
    import pyarrow as pa

    for batch in batches:
        out = []
        for base, counts, own in zip(batch.column("base").to_pylist(), batch.column("counts").to_pylist(), batch.column("own").to_pylist()):
            found = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in base.split(",") if x)]
            added = [("id", c["start"], c["end"]) for c in own or ()]
            out.append((*counts, spans.digest(base), spans.joined(found + added, KINDS)))
        cols = list(zip(*out)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row."""
    place = "struct<start:long,end:long,seed:boolean,token:string,patterns:array<string>>"
    scanned = common.stash(common.texts(docs).mapInArrow(_scan, f"doc_id long, base string, counts array<long>, cands array<{place}>").withColumn("row", F.monotonically_increasing_id()), "scanned")
    edges = scanned.select(F.explode("cands").alias("c")).select(F.explode("c.patterns").alias("pattern"), F.xxhash64("c.token").alias("instance"), "c.seed").groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    good = confident(common.stash(edges, "edges"))
    open_ = scanned.select("row", F.explode("cands").alias("c")).where("NOT c.seed").select("row", "c.start", "c.end", F.explode("c.patterns").alias("pattern"))
    hits = common.stash(common.small_join(open_, good, "pattern").select("row", "start", "end").distinct(), "hits")
    added = hits.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("own"))
    rows = scanned.select("row", "doc_id", "base", "counts")
    # The hits are counted, not their rows: each is three numbers.
    side = F.broadcast(added) if hits.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS else added
    return rows.join(side, "row", "left").select("doc_id", "base", "counts", "own").mapInArrow(_finish, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))
