"""Near-duplicate removal by row, and the search when shards are split."""

import random

import numpy as np
import pytest

from quern.llm import near_text, simhash


class Union:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, a):
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def prose(seed, n=60):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))


@pytest.mark.parametrize("by", [simhash.classes, near_text.classes])
@pytest.mark.parametrize("few", [1 << 20, 0])
def test_repeated_keys_lose_no_other_text(spark, monkeypatch, by, few):
    monkeypatch.setattr(simhash, "FEW", few)
    a, b, c = (prose(i) for i in range(3))
    rows = [(1, a, "m1"), (5, a, "m2"), (5, b, "m3"), (7, c, "m4"), (7, b, "m5"), (9, None, "m6"), (9, " ", "m7"), (None, a, "m8"), (None, prose(9), "m9"), (3, c, "m10"), (3, c, "m11")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(3)
    out = simhash.keep_one(df, by=by)
    assert out.columns == df.columns
    got = sorted((r.doc_id, r.text, r.component_id) for r in out.collect() if r.doc_id is not None)
    assert [(i, t) for i, t, _ in got if t and t.strip()] == [(1, a), (3, c), (5, b)]
    assert [i for i, t, _ in got if not (t and t.strip())] == [9]
    assert [r.component_id for r in out.collect() if r.doc_id is None] == ["m9"]
    assert by(df.select("doc_id", "text")).count() == len(rows)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, prose(1), 5, "r"), (2, prose(1), 6, "r")], "doc_id long, text string, __row0__ int, k string")
    out = simhash.keep_one(df, by=near_text.classes)
    assert out.columns == df.columns and [tuple(r)[2:] for r in out.collect()] == [(5, "r")]


@pytest.mark.parametrize("seed", [1, 2])
def test_split_shards_find_the_same(spark, monkeypatch, seed):
    monkeypatch.setattr(simhash, "SPLIT", 60)
    monkeypatch.setattr(simhash, "LOCAL", 20)
    rng = np.random.default_rng(seed)
    prints = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    low = rng.integers(0, 1 << 32, dtype=np.uint64)
    prints = np.concatenate([prints, (rng.integers(0, 1 << 31, 400, dtype=np.uint64) << np.uint64(32)) | low])  # one half that many share
    for _ in range(4):
        middle = rng.integers(0, 1 << 63, dtype=np.uint64)
        near = [middle ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for _ in range(200)]
        prints = np.concatenate([prints, np.array(near, dtype=np.uint64)])
    prints = np.unique(prints)
    u = Union(len(prints))
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3):
            u.join(i, int(j))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "f long")
    at = {int(x): i for i, x in enumerate(prints.view(np.int64))}
    got = Union(len(prints))
    for r in simhash.links(df, "f").collect():
        assert ((r.a ^ r.b) % (1 << 64)).bit_count() <= 3
        got.join(at[r.a], at[r.b])
    assert [got.find(i) for i in range(len(prints))] == [u.find(i) for i in range(len(prints))]


def test_long_texts():
    words = [f"w{i % 7}" for i in range(400_000)]
    raw = " ".join(words).encode()
    import xxhash

    h = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), seed=42) for i in range(7)], dtype=np.uint64)
    times = np.bincount(np.arange(len(words) - 2) % 7, minlength=7)
    want = sum(1 << b for b in range(64) if 2 * sum(int(n) for x, n in zip(h.tolist(), times, strict=True) if x >> b & 1) > len(words) - 2)
    assert simhash.fingerprint(raw) == want
    assert simhash.fingerprint(b" " * 5_000_000) == 0 and simhash.fingerprint(b"x" * 5_000_000) == xxhash.xxh64_intdigest(b"x" * 5_000_000, seed=42)
