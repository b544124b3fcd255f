"""Recall of the Hamming tables at the threshold, by number of vectors, and the exact way."""

from math import comb

import numpy as np
import pytest

from quern.llm import itq


def vectors(rng, n, dims=64):
    x = rng.normal(size=(n, dims)) * np.linspace(1, 0.3, dims)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def apart(rng, a, cosine):
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return cosine * a + np.sqrt(1 - cosine**2) * side


@pytest.mark.parametrize("rows", [2_000, 50_000, 1_000_000, 10_000_000, 1_000_000_000])
@pytest.mark.parametrize("cosine", [0.95, 0.96])
def test_recall_at_the_threshold_does_not_fall(rows, cosine):
    rng = np.random.default_rng(1)
    unit = vectors(rng, 3000)
    q = itq.Quantiser(unit[:2000])
    masks = itq.tables(q, unit[2000:], rows, 0.95)
    a = vectors(rng, 4000)
    differ = q.codes(a) ^ q.codes(apart(rng, a, cosine))
    recall = ((differ[:, None] & masks) == 0).any(axis=1).mean()
    print(rows, cosine, len(masks), int(masks[0]).bit_count(), recall)
    assert recall > 0.93 and len(masks) <= itq.MOST


@pytest.mark.parametrize("bits, parts, radius", [(64, 4, 1), (64, 3, 2), (20, 4, 0), (12, 5, 1)])
def test_tables_are_the_search_within_a_radius_of_a_substring(bits, parts, radius):
    rng = np.random.default_rng(2)
    masks, length = itq.masks_of(bits, parts, radius), bits // parts
    assert len(masks) == parts * comb(length, radius)
    for _ in range(500):
        differ = int(sum(1 << int(b) for b in rng.choice(bits, rng.integers(0, min(bits, 14)), replace=False)))
        near = any((differ >> (k * length) & ((1 << length) - 1)).bit_count() <= radius for k in range(parts))
        assert near == bool(((np.uint64(differ) & masks) == 0).any())
        assert near or differ.bit_count() >= parts * (radius + 1)


def test_few_bits():
    rng = np.random.default_rng(2)
    unit = rng.normal(size=(500, 4))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert len(itq.tables(itq.Quantiser(unit), unit, 10**6, 0.95)) >= 1


def test_pairs_at_the_threshold_in_a_table(spark):
    rng = np.random.default_rng(3)
    a = vectors(rng, 1500, 32)
    x = np.concatenate([a, apart(rng, a[:700], 0.952), vectors(rng, 300, 32)]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, n_links int")
    found = {r.vec_id: r.n_links for r in itq.neighbours(df).collect()}
    assert all(found[i] <= near[i].sum() for i in found) and sum(found.values()) >= 0.9 * near.sum() > 1000
    whole = {r.vec_id: r.n_links for r in itq.neighbours(df, exact=True).collect()}
    assert whole == {i: int(n) for i, n in enumerate(near.sum(axis=1))}
