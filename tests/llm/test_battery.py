"""The randomness battery and its false-discovery rule against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import secret_scan as s

UPPER, LOWER, DIGITS = s._UPPER, s._LOWER, s._DIGITS
ALPHABETS = {"hex": DIGITS + "abcdef", "base32": UPPER + "234567", "base36": DIGITS + LOWER, "base62": UPPER + LOWER + DIGITS, "base64": UPPER + LOWER + DIGITS + "+/"}


def upper_tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def slow(token, alpha=0.001):
    """Evidence p of a token, from the definitions."""
    if token.isdigit():
        return 1.0
    sets = ((set(ALPHABETS["hex"]), "hex"), (set(DIGITS + "ABCDEF"), "hex"), (set(ALPHABETS["base32"]), "base32"), (set(DIGITS + UPPER), "base36"), (set(DIGITS + LOWER), "base36"), (set(ALPHABETS["base62"]), "base62"))
    name = next((n for c, n in sets if set(token) <= c), "base64")
    shown = token.lower() if name in ("hex", "base36") else token.replace("-", "+").replace("_", "/")
    order = ALPHABETS[name]
    x = np.array([order.index(c) + 1 for c in shown], dtype=float)
    n, k = len(x), len(order)
    counts = np.bincount(x.astype(int), minlength=k + 1)[1:]
    chi = ((counts - n / k) ** 2 / (n / k)).sum()
    z1 = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    above = x > k / 2
    expect = 2 * above.sum() * (~above).sum() / n
    spread = expect * (expect - 1) / (n - 1)
    z2 = ((above[1:] != above[:-1]).sum() - expect) / math.sqrt(spread) if spread > 0 else 9.0
    d = x - x.mean()
    r = (d[1:] * d[:-1]).sum() / (d * d).sum() if (d * d).sum() else None
    z3 = (r + 1 / n) * math.sqrt(n) if r is not None else 9.0
    if 3 * min(upper_tail(z1), 2 * upper_tail(abs(z2)), 2 * upper_tail(abs(z3))) < alpha:
        return 1.0
    kind = ["d" if c in DIGITS else "u" if c in UPPER else "l" for c in token if c not in "-_+/"]
    changes = sum(a != b and a + b != "ul" for a, b in zip(kind, kind[1:]))
    pairs, m = n * (n - 1), n - 1
    few = (pairs * s.COINCIDE - (counts * (counts - 1)).sum()) / math.sqrt(2 * pairs * s.COINCIDE * (1 - s.COINCIDE) + 4 * pairs * (n - 2) * (s.THRICE - s.COINCIDE**2))
    changed = (changes - 0.5 - m * s.ORDINARY) / math.sqrt(m * s.ORDINARY * (1 - s.ORDINARY))
    apart = (s.NEAR - r) * math.sqrt(n) if r is not None else -9.0
    return upper_tail((few + changed + apart) / 2)


def tokens(rnd, times=40):
    out = ["".join(rnd.choice(a) for _ in range(n)) for a in ALPHABETS.values() for n in (16, 24, 40, 64, 200) for _ in range(times // 8)]
    words = "meeting report final Version draft North under valley summary table".split()
    return out + [rnd.choice("-_/").join(rnd.choice(words) for _ in range(rnd.randint(3, 8))) + rnd.choice(["", "2024", "-01"]) for _ in range(times)] + ["1" * 30, "a" * 20, "ab" * 20, "A" * 17 + "-"]


def test_evidence(spark):
    some = [t for t in tokens(random.Random(1)) if len(t) >= 16]
    df = spark.createDataFrame([(t,) for t in some], "x string").select(F.array(F.struct(F.lit(0).alias("s"), F.char_length("x").alias("e"), F.col("x"))).alias("a"), "x")
    got = {r.x: r.p for r in df.select("x", F.element_at(s.tested(F.col("a"), 0.001), 1).p.alias("p")).collect()}
    for t in some:
        want = slow(t)
        assert got[t] == pytest.approx(want, rel=0.05) or abs(got[t] - want) < 0.01, t


def test_false_discovery_rule(spark):
    rnd = random.Random(2)
    rows = [(float(rnd.choice([16, 20, 33, 64, 300, 5000])), 10 ** rnd.uniform(-12, 0) if rnd.random() < 0.3 else rnd.random()) for _ in range(3000)]
    lowest, mean = s.bound(spark.createDataFrame(rows, "n double, p double"), 0.01)
    weight = [2 ** (math.floor(4 * math.log2(n)) / 4) for n, _ in rows]
    assert mean == pytest.approx(sum(weight) / len(rows))
    weighted = sorted(min(1.0, p / (w / mean)) for (_, p), w in zip(rows, weight, strict=True))
    exact = max((x for i, x in enumerate(weighted, 1) if x <= 0.01 * i / len(rows)), default=0.0)
    assert 10 ** (-(lowest + 1.2) / 10) <= exact <= 10 ** (-(lowest - 2) / 10)  # to a bin of a tenth of a decade
    picked = spark.createDataFrame(rows, "n double, p double").where(s.rank(F.col("p"), F.col("n"), mean) >= lowest).count()
    assert 0 < picked <= sum(x <= exact for x in weighted) * 1.02 + 1
    assert s.bound(spark.createDataFrame([], "n double, p double"), 0.01)[0] == 1 << 30


def test_power_by_encoding(spark):
    """Random strings among ordinary tokens: found by encoding and length; ordinary tokens are left alone."""
    rnd = random.Random(3)
    words = "meeting report final version draft north under valley summary table Release Windows index.html user account".split()
    plain = [rnd.choice("-_/").join(rnd.choice(words) for _ in range(rnd.randint(3, 7))) + rnd.choice(["", "-2024", "_v2", "/01"]) for _ in range(600)]
    rows, kinds = [(i, f"see {t} there") for i, t in enumerate(plain)], {}
    for name in ("base32", "base36", "base62", "base64"):
        for n in (20, 32, 64):
            for _ in range(30):
                kinds[len(rows)] = (name, n)
                rows.append((len(rows), f"see {''.join(rnd.choice(ALPHABETS[name]) for _ in range(n))} there"))
    got = {r.doc_id: len(r.secrets) for r in s.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] for i in range(600)) <= 3
    found = {k: sum(got[i] for i in kinds if kinds[i] == k) / 30 for k in set(kinds.values())}
    print(sorted(found.items()))
    assert all(found[name, n] >= 0.85 for name in ("base62", "base64") for n in (32, 64)) and found["base36", 64] >= 0.85 and found["base32", 64] >= 0.7


def test_many_matches(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK", 7)
    text = " ".join("f" * 24 + "é" * (i % 3) for i in range(60))
    got = s.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().secrets
    assert [text[x.start : x.end] for x in got] == ["f" * 24] * 60
    monkeypatch.undo()
    hidden = "token=" + "x" * 20 + " " + "aB3dE5gH7jK9mN1pQ3" + " "
    tokens = s.scan(spark.createDataFrame([(1, hidden * 40)], "doc_id long, text string")).first().secrets
    assert sum(x.kind == 0 for x in tokens) == 40 and not any(x.kind == 3 and x.start % len(hidden) < 26 for x in tokens)
    long = "password=abcdef12 " * 20_000
    assert len(s.scan(spark.createDataFrame([(1, long)], "doc_id long, text string")).first().secrets) == 20_000
