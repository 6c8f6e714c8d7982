"""Filters and per-row values of fragments, alignments, bins and genes."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, functions as F

#: Floors of the insert size levels.
LEVELS = [35, 40, 45, 50, 55, 60, 65, 70, 75, 80, 90, 100, 120, 140, 160, 180, 200, 225, 250, 300]

#: Positions of a sequence in one piece.
PIECE = 200


def keep_flags(flag: Column, mapq: Column, exclude: int = 1804, min_mapq: int = 30) -> Column:
    """P1."""
    return (flag.bitwiseAND(exclude) == 0) & (mapq >= min_mapq)


def proper(flag: Column) -> Column:
    """No supplementary read; of pairs only proper forward reads."""
    paired = flag.bitwiseAND(1) != 0
    return (flag.bitwiseAND(2048) == 0) & (~paired | ((flag.bitwiseAND(2) != 0) & (flag.bitwiseAND(16) == 0)))


def cigar_span(cigar: Column) -> Column:
    """Bases of the reference that M and D cover."""
    sizes = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MD]"), F.lit(1))
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))


def insert_size_level(size: Column, levels: list[int] = LEVELS) -> Column:
    """The largest level up to size, or 0."""
    out = F.lit(0)
    for level in levels:
        out = F.when(size >= level, level).otherwise(out)
    return out.cast("int")


def bin_start(pos: Column, width: int = 1000) -> Column:
    """P7."""
    return (F.floor(pos / width) * width).cast("long")


def size_class(size: Column) -> Column:
    """P15."""
    return F.when(size < 147, "sub").when((size > 147) & (size <= 320), "mono").when((size > 320) & (size <= 485), "di")


def floored_log10(x: Column, least: float = 0.001, digits: int = 100) -> Column:
    """-3 below `least`, else log10 rounded as int(x * digits + 0.5), which truncates toward zero."""
    return F.when(x < least, F.lit(-3.0)).otherwise((F.log10(F.greatest(x, F.lit(least))) * digits + 0.5).cast("bigint") / digits)


def divided(a: Column, b: Column) -> Column:
    """a / b with infinity and NaN instead of errors."""
    return F.when(b != 0, a / F.when(b != 0, b)).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))


def above_line(x: Column, y: Column, p1: tuple, p2: tuple) -> Column:
    """P12."""
    slope = (p2[1] - p1[1]) / (p2[0] - p1[0])
    return y > p1[1] + (x - p1[0]) * slope


def kmer_sites(sequences: DataFrame, seq: str = "seq", by: list[str] = ("doc_id",), span: int = 13) -> DataFrame:
    """The discontiguous 9-mer at every position of each sequence, without those that hold other letters."""
    # Short pieces first: a place in a long text costs as many steps as lie before it.
    pieces = sequences.where(F.length(seq) >= span).select(*by, seq, F.explode(F.sequence(F.lit(0), F.length(seq) - span, F.lit(PIECE))).alias("offset"))
    pieces = pieces.select(*by, "offset", F.substr(seq, F.col("offset") + 1, F.lit(PIECE + span - 1)).alias("piece"))
    at = pieces.select(*by, "offset", "piece", F.explode(F.sequence(F.lit(1), F.length("piece") - (span - 1))).alias("at"))
    mer = F.concat(F.substr("piece", F.col("at"), F.lit(3)), F.substr("piece", F.col("at") + 5, F.lit(3)), F.substr("piece", F.col("at") + 10, F.lit(3)))
    return at.select(*by, (F.col("offset") + F.col("at")).alias("pos"), mer.alias("nonamer")).where(F.col("nonamer").rlike("^[ACGT]{9}$"))


#: Letters of texts that are coded at once, and groups whose counts a task holds.
CODED, HELD = 1 << 20, 16


def mer_codes(texts: list[str]):
    """The code, below 4^9, of the 9-mer at each position of the joined texts (-1: other letters or too close to an end), and where each text begins."""
    import numpy as np

    gap = "." * 13
    letters = np.frombuffer((gap.join(texts) + gap).encode("utf-32-le"), dtype="<u4")
    known = np.full(128, -64, dtype=np.int32)
    known[[ord(c) for c in "ACGT"]] = range(4)
    one = known[np.minimum(letters, 127)]
    three = one[:-2] * 16 + one[1:-1] * 4 + one[2:]
    a, b, c = three[:-10], three[5:-5], three[10:]
    first = np.cumsum([0] + [len(t) + len(gap) for t in texts])[:-1]
    return np.where((a >= 0) & (b >= 0) & (c >= 0), a * 4096 + b * 64 + c, -1), first


def mer_text(code: Column) -> Column:
    """The letters of a code."""
    return F.concat(*(F.substring(F.lit("ACGT"), F.shiftright(code, 2 * k).bitwiseAND(3).cast("int") + 1, F.lit(1)) for k in range(8, -1, -1)))


def mer_code(text: Column) -> Column:
    """The code of a 9-mer."""
    return F.conv(F.translate(text, "ACGT", "0123"), 4, 10).cast("int")


def _counted_mers(by: list[str], seq: str, schema):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: dict = {}

        def told():
            for key, n in held.items():
                at = np.flatnonzero(n)
                values = [pa.array([v] * len(at), t) for v, t in zip(key, schema)]
                yield pa.RecordBatch.from_arrays([*values, pa.array(at.astype(np.int32)), pa.array(n[at])], names=[*by, "code", "n"])

        for batch in batches:
            texts: dict = {}
            for text, *key in zip(batch[seq].to_pylist(), *(batch[c].to_pylist() for c in by)):
                texts.setdefault(tuple(key), []).append(text)
            for key, of in texts.items():
                if key not in held and len(held) == HELD:
                    yield from told()
                    held.clear()
                n = held.setdefault(key, np.zeros(4**9, dtype=np.int64))
                while of:
                    size, some = 0, []
                    while of and size < CODED:
                        some.append(of.pop())
                        size += len(some[-1])
                    codes, _ = mer_codes(some)
                    n += np.bincount(codes[codes >= 0], minlength=4**9)
        yield from told()

    return run


def kmer_counts(sequences: DataFrame, seq: str = "seq", by: list[str] = ("lang",)) -> DataFrame:
    """(by, nonamer, n): how often each discontiguous 9-mer of A, C, G and T occurs in the sequences of a group.

    A task codes texts as arrays and hands on one row for each 9-mer and group that it has seen, so no position is a row.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    own = sequences.where(F.length(seq) >= 13).select(*by, F.col(seq).alias("_seq"))
    kinds = [own.schema[c].dataType for c in by]
    kind = ", ".join([*(f"`{c}` {t.simpleString()}" for c, t in zip(by, kinds)), "code int, n long"])
    counts = own.mapInArrow(_counted_mers(list(by), "_seq", [to_arrow_type(t) for t in kinds]), kind)
    return counts.groupBy(*by, "code").agg(F.sum("n").alias("n")).select(*by, mer_text(F.col("code")).alias("nonamer"), "n")


def gc_fraction(seq: Column) -> Column:
    """G49."""
    return F.when(F.length(seq) > 0, F.round((F.length(seq) - F.length(F.regexp_replace(seq, "[GCgc]", ""))) / F.length(seq), 4))


def hash_order(key: Column, seed: int = 0) -> Column:
    """T5: an order that SQL repeats exactly; keys beyond 2^31 are taken modulo it, so that no product overflows."""
    return (F.pmod(key.cast("long"), F.lit(2147483648)) * 2654435761 + seed) % 4294967296


#: A prime whose group of units has no fifth root of one but 1, so that fifth powers are a permutation.
PRIME = 2_147_483_647


def mixed(rep: Column, key: Column) -> Column:
    """A hash below PRIME of a replicate's number and a key, repeated exactly by SQL; distinct keys below PRIME never tie.

    Orders by a product alone are turns of one ring for all replicates; the fifth power breaks the ring up.
    """
    x = (F.pmod(key, F.lit(PRIME)) * 48271 + F.pmod(rep, F.lit(PRIME)) * 69621) % PRIME
    fourth = ((x * x % PRIME) * (x * x % PRIME)) % PRIME
    return fourth * x % PRIME


def mixed_sql(rep: str, key: str) -> str:
    """The same as SQL over keys from 0 on."""
    x = f"(({key} % {PRIME} * 48271 + {rep} % {PRIME} * 69621) % {PRIME})"
    return f"(((({x} * {x} % {PRIME}) * ({x} * {x} % {PRIME})) % {PRIME}) * {x} % {PRIME})"


def select_regions(regions: DataFrame, stage: Column, rpkm: str, include_unpassed: bool = False, low: float | None = None, high: float | None = None, chrom: str | None = None) -> DataFrame:
    """Regions of a stage by their flag `passed`, the bounds of rpkm (both inclusive) and one chromosome."""
    wanted = [stage, *([] if include_unpassed else [F.col("passed")]), *([] if low is None else [F.col(rpkm) >= low]), *([] if high is None else [F.col(rpkm) <= high]), *([] if chrom is None else [F.col("chrom") == chrom])]
    for one in wanted:
        regions = regions.where(one)
    return regions


#: What a user's filter may hold: numbers, quoted text, names, comparisons, arithmetic, brackets; these words, and columns.
FILTER_TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)|(?P<text>'[^'\\]*')|(?P<name>[A-Za-z_]\w*)|(?P<sign><=|>=|<>|!=|==|[<>=+\-*/%(),]))")
FILTER_WORDS = {"and", "or", "not", "is", "null", "in", "between", "like", "true", "false"}


def allowed_filter(text: str, columns: list[str]) -> bool:
    """Whether the text is made of what a filter may hold alone: no function, no other name, no comment."""
    at = 0
    text = text.strip()
    known = {c.lower() for c in columns}
    while at < len(text):
        token = FILTER_TOKEN.match(text, at)
        if not token:
            return False
        at = token.end()
        if name := token["name"]:
            called = text[at:].lstrip().startswith("(") and name.lower() not in FILTER_WORDS
            if called or name.lower() not in known | FILTER_WORDS:
                return False
        elif token["sign"] == "-" and text[at : at + 1] == "-":
            return False
    return bool(text)


def user_filter(df: DataFrame, text: str, stages: tuple) -> DataFrame:
    """P25: the rows for which an expression over the columns holds; a stage's bare name stands for its rpkm, and a faulty text gives no rows."""
    names = "|".join(map(re.escape, stages))
    named = re.sub(rf"\b({names})\b(?!_)", r"\1_rpkm", text) if stages else text
    if not allowed_filter(named, df.columns):
        return df.where(F.lit(False))
    try:
        return df.where(F.expr(named))
    except (AnalysisException, ParseException):
        return df.where(F.lit(False))


def erfc_sql(x: str) -> str:
    """The complementary error function of x >= 0 as SQL: a Chebyshev fit with a relative error below 1.2e-7 everywhere."""
    # The fit's coefficients, from the constant term on.
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    t = f"(1 / (1 + ({x}) / 2))"
    power = " + ".join(f"({c}) * POWER({t}, {k})" for k, c in enumerate(terms))
    return f"({t} * EXP(-({x}) * ({x}) + {power}))"


def two_sided_p_sql(z: str) -> str:
    """The two-sided normal p-value of z as SQL, 1e-300 at least."""
    return f"GREATEST({erfc_sql(f'ABS({z}) / SQRT(2)')}, 1e-300)"
