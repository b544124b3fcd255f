"""Secret scan: patterns, and a battery of randomness tests over token-like strings. DataFrame functions only.

Patterns (kinds assign, access, hex) are matched leftmost and without overlap, each kind on its own; spans are whole
matches in code points, end exclusive. The battery looks at tokens of 16 or more characters (kind random). Of each it infers
the encoding: hex, base32, base36, base62 or base64, the smallest alphabet that holds the token; digits alone are none. Three tests follow:

1. Uniformity: chi-squared of the symbols over that alphabet.
2. Runs: changes between neighbours. Of halves of the alphabet for randomness; of classes (digit, upper, lower; marks are left out) for writing,
   where a capital letter belongs to the small ones after it.
3. Serial correlation of neighbours' places in the alphabet.

Each is asked two questions. Against randomness: Wilson-Hilferty for 1, normal tails for 2 and 3; a token whose smallest p-value, times three,
is below `alpha` is no random string. Against ordinary writing: its letters coincide with the frequency COINCIDE (1: fewer coincidences speak
for chance), it changes class at the rate ORDINARY (2: more), and its neighbours correlate by NEAR (3: less). The three upper-tail z-values are added
and divided by 2, which allows for a correlation of 1/6 among them (3 + 6 / 6 = 4); the normal tail of that is the token's evidence p. These rates are fixed, so a text
is judged alike in every corpus.

False-discovery control: longer tokens can say more, so p is divided by a weight that grows with length (length in steps of a quarter of an
octave, without end; weights have mean 1 over the corpus), and the Benjamini-Hochberg rule at level `fdr` runs over all candidates of
the corpus, with p-values in bins of a tenth of a decade (rounded up, so it errs to the safe side).

Candidates within a pattern's span are not reported again. Results: a null text is empty; a text without a find has empty
lists; an empty table gives no rows; repeated rows count one by one in the false-discovery rule. Ties of start are in the order of kinds. Nothing is cut
off in long texts. Other columns stay; one named like `into` is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The patterns. The upper bounds on length are none; lower bounds are tested after matching.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"  # maximal runs, so shorter ones cannot hide a longer one
RANDOM = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}"
KINDS = ("assign", "access", "hex", "random")
#: Ordinary writing: two letters of a text are the same, three are, neighbours in a token differ in class, correlation of neighbours' places.
COINCIDE, THRICE, ORDINARY, NEAR = 0.066, 0.0055, 0.15, 0.35
#: Matches that are placed in one go; a text with more is taken block by block.
BLOCK = 256
_SPAN = "struct<s: int, e: int, x: string>"
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def gathered(carry: Column, count: Column, step, kind: str) -> Column:
    """What step(carry, i) -> (carry, list of results) gives for i from 0 to count, as one list of `kind`. Blocks of BLOCK results have a list of their
    own, so that lists that grow stay short; carry holds all that a step reads, for a column would be made anew for each i."""
    none = F.array().cast(f"array<{kind}>")

    def add(acc: Column, i: Column) -> Column:
        now, got = step(acc.carry, i)
        return F.struct(now.alias("carry"), F.concat(acc.out, got).alias("out"))

    def block(acc: Column, k: Column) -> Column:
        done = F.aggregate(F.sequence(k * BLOCK, F.least((k + 1) * BLOCK, acc.n) - 1), F.struct(acc.carry.alias("carry"), none.alias("out")), add)
        return F.struct(done.carry.alias("carry"), acc.n.alias("n"), F.concat(acc.all, F.array(done.out)).alias("all"))

    start = F.struct(carry.alias("carry"), count.cast("int").alias("n"), F.array().cast(f"array<array<{kind}>>").alias("all"))
    return F.when(count == 0, none).otherwise(F.aggregate(F.sequence(F.lit(0), F.floor((count - 1) / BLOCK).cast("int")), start, block, lambda acc: F.flatten(acc.all)))


def located(text: Column, pattern: str, matches: Column) -> Column:
    """Spans (s, e, x) of the matches of a pattern in a text; the text between matches comes from split()."""

    def step(c: Column, i: Column):
        s = c.at + F.char_length(F.get(c.gaps, i))
        x = F.get(c.found, i)
        e = s + F.char_length(x)
        return F.struct(e.alias("at"), c.gaps.alias("gaps"), c.found.alias("found")), F.array(F.struct(s.alias("s"), e.alias("e"), x.alias("x")))

    return gathered(F.struct(F.lit(0).alias("at"), F.split(text, pattern, -1).alias("gaps"), matches.alias("found")), F.size(matches), step, _SPAN)


def outside(tokens: Column, base: Column) -> Column:
    """Tokens (s, e, x) that lie in no span of base: one pass over both in order, with the farthest end of a span so far."""
    kind = "struct<s: int, random: boolean, e: int, x: string>"
    both = F.array_sort(F.concat(F.transform(base, lambda b: F.struct(b.s.alias("s"), F.lit(False).alias("random"), b.e.alias("e"), F.lit("").alias("x"))), F.transform(tokens, lambda c: F.struct(c.s.alias("s"), F.lit(True).alias("random"), c.e.alias("e"), c.x.alias("x")))).cast(f"array<{kind}>"))

    def step(c: Column, i: Column):
        y = F.get(c.all, i)
        free = y.random & (y.e > c.far)
        return F.struct(F.when(y.random, c.far).otherwise(F.greatest(c.far, y.e)).alias("far"), c.all.alias("all")), F.when(free, F.array(F.struct(y.s.alias("s"), y.e.alias("e"), y.x.alias("x")))).otherwise(F.array().cast(f"array<{_SPAN}>"))

    return gathered(F.struct(F.lit(0).alias("far"), both.alias("all")), F.size(tokens) + F.size(base), step, _SPAN)


def tail(z: Column) -> Column:
    """Upper tail of the normal law, to within 1 % in its own size (bound of Boerjesson and Sundberg, mirrored below 0)."""
    a = F.abs(z)
    up = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) / (0.661 * a + 0.339 * F.sqrt(a * a + 5.51))
    return F.when(z >= 0, up).otherwise(1 - up)


def tested(tokens: Column, alpha: float) -> Column:
    """(s, e, n, p) of each token: its span, length, and evidence against ordinary writing; p is null if it is no random token."""

    def encoded(c: Column) -> Column:
        x = c.x
        size = F.when(x.rlike("^[0-9]+$"), 0).when(x.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(x.rlike("^[A-Z2-7]+$"), 32).when(x.rlike("^([A-Z0-9]+|[a-z0-9]+)$"), 36).when(x.rlike("^[A-Za-z0-9]+$"), 62).otherwise(64)
        shown = F.when(size.isin(16, 36), F.lower(x)).otherwise(F.translate(x, "-_", "+/"))
        return F.struct(c.s.alias("s"), c.e.alias("e"), size.alias("k"), F.filter(F.split(shown, ""), lambda y: y != "").alias("c"), F.filter(F.split(F.translate(x, "-_/+", ""), ""), lambda y: y != "").alias("raw"))

    def numbered(c: Column) -> Column:
        order = F.when(c.k == 16, _DIGITS + "abcdef").when(c.k == 32, _UPPER + "234567").when(c.k == 36, _DIGITS + _LOWER).otherwise(_UPPER + _LOWER + _DIGITS + "+/")
        kind = lambda y: F.when(y.between("0", "9"), 0).when(y.between("A", "Z"), 1).when(y.between("a", "z"), 2).otherwise(3)
        return F.struct(c.s.alias("s"), c.e.alias("e"), c.k.alias("k"), F.size(c.c).alias("n"), c.c.alias("c"), F.transform(c.c, lambda y: F.position(y, order)).alias("i"), F.transform(c.raw, kind).alias("kind"))

    def pairs(x: Column, n: Column) -> Column:
        return F.zip_with(F.slice(x, F.lit(1), n - 1), F.slice(x, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    add = lambda values: F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double"))

    def summed(c: Column) -> Column:
        n, half = c.n.cast("double"), c.k / 2
        mean = add(c.i) / n
        return F.struct(
            c.s.alias("s"), c.e.alias("e"), c.k.cast("double").alias("k"), n.alias("n"),
            add(F.transform(F.array_distinct(c.c), lambda y: F.pow(F.size(F.filter(c.c, lambda z: z == y)), F.lit(2)))).alias("squares"),
            add(F.transform(c.i, lambda v: (v > half).cast("int"))).alias("above"),
            add(F.transform(pairs(c.i, c.n), lambda p: ((p.a > half) != (p.b > half)).cast("int"))).alias("turns"),
            add(F.transform(pairs(c.i, c.n), lambda p: (p.a - mean) * (p.b - mean))).alias("near"),
            add(F.transform(c.i, lambda v: (v - mean) * (v - mean))).alias("spread"),
            add(F.transform(pairs(c.kind, F.greatest(F.size(c.kind), F.lit(1))), lambda p: ((p.a != p.b) & ~((p.a == 1) & (p.b == 2))).cast("int"))).alias("changes"),
        )

    def judged(c: Column) -> Column:
        n, free = c.n, c.k - 1
        chi = c.k / n * c.squares - n
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        expect = 2 * c.above * (n - c.above) / n
        spread = expect * (expect - 1) / (n - 1)
        z_runs = F.when(spread > 0, (c.turns - expect) / F.sqrt(spread)).otherwise(F.lit(9.0))
        z_near = F.when(c.spread > 0, (c.near / c.spread + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0))
        p = 3 * F.least(tail(z_chi), 2 * tail(F.abs(z_runs)), 2 * tail(F.abs(z_near)))
        m, pairs_ = n - 1, n * (n - 1)
        few = (pairs_ * COINCIDE - (c.squares - n)) / F.sqrt(2 * pairs_ * COINCIDE * (1 - COINCIDE) + 4 * pairs_ * (n - 2) * (THRICE - COINCIDE**2))
        changed = (c.changes - 0.5 - m * ORDINARY) / F.sqrt(m * ORDINARY * (1 - ORDINARY))
        apart = F.when(c.spread > 0, (NEAR - c.near / c.spread) * F.sqrt(n)).otherwise(F.lit(-9.0))
        return F.struct(c.s.alias("s"), c.e.alias("e"), n.alias("n"), F.when((c.k > 0) & (p >= alpha), tail((few + changed + apart) / 2)).otherwise(F.lit(1.0)).alias("p"))

    return F.transform(F.transform(F.transform(F.transform(tokens, encoded), numbered), summed), judged)


def scan(docs: DataFrame, *, text: str = "text", carry: list[str] | None = None, fdr: float = 0.01, alpha: float = 0.001, into: str = "secrets") -> DataFrame:
    """The columns `carry` of docs (all by default) and an array of spans: kind number (as in KINDS), start, end; in order.

    The rule over all candidates needs the corpus twice. Where the text is carried, it is scanned twice, so that no copy of the texts is
    written; else what the first scan found is a narrow table in shared storage.
    """
    kept = [c for c in (docs.columns if carry is None else carry) if c != into]
    given = F.struct(*kept).alias("given")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    once = docs.select(given, t.alias("t")).select("given", "t", *[F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(k) for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, RANDOM), strict=True)])
    spans = {k: located(F.col("t"), p, F.col(k)) for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, RANDOM), strict=True)}
    spans["assign"] = F.filter(spans["assign"], lambda c: F.char_length(F.regexp_extract(c.x, ASSIGN, 2)) >= 6)
    spans["access"] = F.filter(spans["access"], lambda c: c.e - c.s >= 20)
    placed = once.select("given", *[spans[k].alias(k) for k in KINDS])
    of_kind = lambda i: lambda c: F.struct(c.s.alias("s"), F.lit(i).alias("kind"), c.e.alias("e"))
    base = F.concat(*[F.transform(F.col(k), of_kind(i)) for i, k in enumerate(KINDS[:3])])
    held = placed.select("given", F.array_sort(base).alias("base"), "random")
    fresh = F.when(F.size("base") == 0, F.col("random")).when(F.size("random") == 0, F.col("random")).otherwise(outside(F.col("random"), F.col("base")))
    found = held.select("given", "base", tested(fresh, alpha).alias("random"))
    if text not in kept:
        found = cut(found, "secrets")
    limit = bound(found.select(F.explode("random").alias("c")).select("c.n", "c.p"), fdr)
    more = F.transform(F.filter("random", lambda c: rank(c.p, c.n, limit[1]) >= limit[0]), of_kind(3))
    spans_ = F.when(F.size("random") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", more)))
    return found.select("given.*", F.transform(spans_, lambda c: F.struct(c.kind.alias("kind"), c.s.alias("start"), c.e.alias("end"))).alias(into))


def step(n: Column) -> Column:
    """Length in quarters of an octave."""
    return F.floor(4 * F.log2(n)).cast("int")


def rank(p: Column, n: Column, mean: float) -> Column:
    """Bin of a weighted p-value: tenths of a decade, the higher the smaller p is."""
    weighted = F.least(F.lit(1.0), F.greatest(p, F.lit(1e-300)) / (F.pow(F.lit(2.0), step(n) / 4) / F.lit(mean)))
    return F.floor(-10 * F.log10(weighted)).cast("int")


def bound(candidates: DataFrame, fdr: float) -> tuple[int, float]:
    """The lowest bin that the Benjamini-Hochberg rule admits (beyond all bins if none) and the mean weight."""
    rows = candidates.groupBy(step(F.col("n")).alias("n"), F.floor(-100 * F.log10(F.greatest("p", F.lit(1e-300)))).cast("int").alias("at")).count().collect()  # by steps of length and hundredths of a decade: bounded, and one pass
    total = sum(r["count"] for r in rows)
    if not total:
        return 1 << 30, 1.0
    mean = sum(2 ** (r.n / 4) * r["count"] for r in rows) / total
    bins: dict[int, int] = {}
    for r in rows:
        k = math.floor(max(0.0, r.at / 10 + 10 * math.log10(2 ** (r.n / 4) / mean)))
        bins[k] = bins.get(k, 0) + r["count"]
    so_far, lowest = 0, 1 << 30
    for k in sorted(bins, reverse=True):
        so_far += bins[k]
        if 10 ** (-k / 10) <= fdr * so_far / total:
            lowest = k
    return lowest, mean


def masked(docs: DataFrame, *, text: str = "text", mask: str = "<SECRET>", **how) -> DataFrame:
    """docs with every span of their text replaced by mask (overlapping spans by one)."""
    found = scan(docs, text=text, into="__secrets__", **how)

    def step(c: Column, i: Column):
        x = F.get(c.spans, i)
        piece = F.when(x.start >= c.at, F.array(F.substr(c.text, c.at + 1, x.start - c.at), F.lit(mask))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(c.at, x.end).alias("at"), c.text.alias("text"), c.spans.alias("spans")), piece

    shown = F.col(text).cast("string")
    pieces = gathered(F.struct(F.lit(0).alias("at"), shown.alias("text"), F.col("__secrets__").alias("spans")), F.size("__secrets__"), step, "string")
    done = F.concat(F.array_join(pieces, ""), F.substr(shown, F.array_max(F.transform("__secrets__", lambda x: x.end)) + 1))
    return found.withColumn(text, F.when(F.size("__secrets__") > 0, done).otherwise(F.col(text))).drop("__secrets__")


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat(F.get(names, c.kind), F.lit(":"), c.start.cast("string"), F.lit(":"), c.end.cast("string"))), ",")


def op6_randomness_battery(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, carry=["doc_id"])
    number = lambda i: F.size(F.filter("secrets", lambda c: c.kind == i)).cast("long")
    base = F.filter("secrets", lambda c: c.kind < 3)
    return found.select("doc_id", *[number(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
