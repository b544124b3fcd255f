"""Near-duplicate texts against brute-force Jaccard."""

import random

import pytest

from quern.llm import near_text, simhash


def groups(sets):
    up = list(range(len(sets)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    pairs = 0
    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                pairs += a != b
                lo, hi = sorted((find(i), find(j)))
                up[hi] = lo
    return [find(i) for i in range(len(sets))], pairs


@pytest.mark.parametrize("sample", [16384, 8])
def test_all_pairs_of_the_similarity(spark, monkeypatch, sample):
    monkeypatch.setattr(near_text, "SAMPLE", sample)
    rnd = random.Random(4)
    word = lambda: "w" + str(rnd.randrange(4000))
    texts = [" ".join(word() for _ in range(rnd.choice([1, 3, 5, 40]))) for _ in range(60)] + ["", None, " \n"]
    line = [word() for _ in range(60)]
    for _ in range(8):  # near copies about the bound, chains, and a common line with other words
        w = [word() for _ in range(rnd.randint(20, 200))]
        for _ in range(14):
            if rnd.random() < 0.3:
                w = list(w)
                w[rnd.randrange(len(w))] = word()
            v = [word() if rnd.random() < rnd.choice([0.002, 0.01, 0.02]) else x for x in w]
            texts.append(" ".join(v))
        texts.append(" ".join(line + [word() for _ in range(rnd.choice([5, 12, 20, 60]))]))
    rnd.shuffle(texts)
    words = [(t or "").lower().split() for t in texts]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in words]
    want, pairs = groups(sets)
    assert pairs > 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_text.classes(df).collect()}
    assert got == dict(enumerate(want))


def test_a_group_of_near_copies_makes_no_square_of_pairs(spark, monkeypatch):
    rnd = random.Random(6)
    base = [f"w{rnd.randrange(4000)}" for _ in range(150)]

    def copy(changes):
        w = list(base)
        for i in rnd.sample(range(5, 145, 5), changes):
            w[i] = f"x{rnd.randrange(10**6)}"
        return " ".join(w)

    texts = [copy(4) for _ in range(300)] + [copy(1) for _ in range(60)] + [copy(3) for _ in range(40)]
    rnd.shuffle(texts)
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in map(str.split, texts)]
    want, _ = groups(sets)
    pairs, compared = [], near_text.compared
    monkeypatch.setattr(near_text, "compared", lambda found, *more: pairs.append(found.count()) or compared(found, *more))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_text.classes(df).collect()}
    assert got == dict(enumerate(want))
    assert sum(pairs) < 10 * len(texts)


def test_outlines_bound_the_difference():
    import numpy as np

    rnd = np.random.default_rng(7)
    for size in (0, 1, 30, 700):
        a = rnd.integers(0, 1 << 63, size, dtype=np.uint64)
        b = np.concatenate([a[size // 3 :], rnd.integers(0, 1 << 63, size // 4, dtype=np.uint64)])
        bits = int(np.bitwise_count((near_text.outline(a) ^ near_text.outline(b)).view(np.uint64)).sum())
        assert bits <= size // 3 + size // 4 and (bits - size // 3 - size // 4) % 2 == 0


def test_stage_removes_near_copies(spark):
    import corpus_pipeline as c

    rnd = random.Random(5)
    a = [f"w{rnd.randrange(4000)}" for _ in range(100)]
    far, b = list(a), list(a)
    b[50] = "other"  # 91 of 101 runs shared, more than 3 bits apart
    for i in (20, 40, 60):
        far[i] = "other"  # 81 of 111
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(far)), (None, "x y"), (None, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert bin(simhash.fingerprint(rows[0][1].encode()) ^ simhash.fingerprint(rows[1][1].encode())).count("1") > 3
    kept = c.simhash_near_dedup(spark, df, "")
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, None]
    assert c.simhash_near_dedup(spark, df.limit(0), "").count() == 0
