"""Token counts by section against brute force, and texts that are hard on the encoder."""

import random

import pytest

from quern.llm import token_counts


@pytest.fixture(scope="module")
def encoder():
    with open(token_counts.RANKS, "rb") as f:
        return token_counts.Encoder(f.read())


def slow_counts(encoder, text):
    """Tokens of each line, by walking over the bytes of every token."""
    data, owner, line = text.encode(), [], 0
    for i, b in enumerate(data):
        owner.append(line)
        if b == 10 and data[i + 1 : i + 2] != b"\n":
            line += 1
    counts, at = [0] * (owner[-1] + 1 if owner else 0), 0
    for token in encoder.encoding.encode_ordinary(text):
        n = int(encoder.lengths[token])
        inside = owner[at : at + n]
        counts[max(sorted(set(inside)), key=inside.count)] += 1
        at += n
    return counts


def test_each_section_against_brute_force(spark, encoder):
    rnd = random.Random(1)
    parts = ["word", "Zwei", " ", "  ", "\n", "\n\n", "\t", "é", "日本", "😀", "1234", "...", "'s", "\u3000", "\x85", "\x1c"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 80)))) for i in range(150)] + [(500, None), (501, ""), (502, "\n"), (None, "a\nb")]
    rows += rows[:3]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, section string, n_tokens int")
    found = sorted(map(tuple, token_counts.attribute(df).collect()), key=str)
    want = []
    for key, text in rows:
        for j, n in enumerate(slow_counts(encoder, text) if text else ()):
            a, b = token_counts.lines_of(text)[j][1:]
            want.append((key, j, None, a, b, n))
    assert found == sorted(want, key=str)


def test_long_blanks_are_cut_without_change(encoder, monkeypatch):
    import re

    monkeypatch.setattr(token_counts, "_BLANKS", re.compile(token_counts._BLANKS.pattern.replace("1024", "2")))
    rnd = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\u2003", "\xa0", "\x1c", "\x1f", "a", "Wort", "'s", "7", "!", "é"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert encoder.pieces(text) == encoder.encoding.encode_ordinary(text)


def test_very_long_runs(spark):
    n = 1_000_000
    rows = [(i, "a" + c * n + "b") for i, c in enumerate(" \n\tx1-\u0301\u3000")] + [(50, " " * n), (51, "x" + "\n" * n)]
    got = token_counts.attribute(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    by = {r.doc_id: (r.n, r.e) for r in got.groupBy("doc_id").agg({"n_tokens": "sum", "end": "max"}).toDF("doc_id", "n", "e").collect()}
    assert by.keys() == {r[0] for r in rows} and all(by[i][0] > 1000 and by[i][1] == len(t) for i, t in rows)
