"""Operators on texts against brute force, and their rules for odd input."""

import collections
import hashlib
import math
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import decontaminate, language, lattice, secret_scan, sentence_spans, token_counts, warc

WORDS = [a + b for a in ("an", "re", "ti", "on", "the", "in", "er", "ou") for b in ("st", "nd", "ea", "ly", "ed", "s", "")]


def prose(rnd, n, end="."):
    return " ".join(rnd.choice(WORDS) + (end if rnd.random() < 0.15 else "") for _ in range(n))


ODD = [(900, None, None, None, "x"), (901, "", "en", "s", "x"), (None, "a null id", "en", None, "x"), (902, " \t\n ", None, "s", "x"), (903, "42 !!", "en", "s", "x")]
SCHEMA = "doc_id long, text string, lang string, source string, score string"


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


# --- lattice


def toy():
    pieces = [f"<{b}>" for b in range(256)] + [" ", "a", "b", " a", "ab", " ab", "ba", "é"]
    p = [1e-4] * 256 + [0.1, 0.2, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05]
    import numpy as np

    return pieces, np.log(np.array(p))


def every_path(word, pieces, logs):
    s, known = " " + word, {p: i for i, p in enumerate(pieces[256:], 256)}

    def go(i):
        if i == len(s):
            return 1.0
        total = 0.0 if s[i] in known else math.exp(sum(logs[b] for b in s[i].encode())) * go(i + 1)
        return total + sum(math.exp(logs[known[s[i:j]]]) * go(j) for j in range(i + 1, len(s) + 1) if s[i:j] in known)

    return math.log(go(0))


def test_lattice_sums_all_paths(monkeypatch):
    pieces, logs = toy()
    words = ["ab", "aba", "bababab", "é", "xaß", "日b", "a" * 30]
    told, _ = lattice.Lattice(pieces, logs).run(words)
    assert told == pytest.approx([every_path(w, pieces, logs) for w in words])
    import numpy as np

    weights = np.arange(1.0, 8.0)
    _, counts = lattice.Lattice(pieces, logs).run(words, weights)
    monkeypatch.setattr(lattice, "LONG", 1)
    alone, counts2 = lattice.Lattice(pieces, logs).run(words, weights)
    assert alone == pytest.approx(told) and counts2 == pytest.approx(counts)
    # expected counts are the gradient of the weighted log likelihood
    i = pieces.index("ab")
    up, down = logs.copy(), logs.copy()
    up[i] += 1e-5
    down[i] -= 1e-5
    slope = (weights @ lattice.Lattice(pieces, up).run(words)[0] - weights @ lattice.Lattice(pieces, down).run(words)[0]) / 2e-5
    assert counts[i] == pytest.approx(slope, rel=1e-5)


def test_lattice_scores(spark):
    rnd = random.Random(1)
    rows = [(i, prose(rnd, rnd.randint(1, 60)) + (" " + "".join(rnd.choice("xyz") for _ in range(400)) if i == 3 else ""), "en", "s", "clash") for i in range(60)] + ODD
    rows += rows[:2]  # repeated rows
    df = docs(spark, rows)
    train = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))
    vocabulary = toy()
    got = lattice.score(df, train, vocabulary=vocabulary, rounds=1, head=5).collect()
    assert len(got) == len(rows)
    is_train = lambda i: i is None or i % 3 != 0
    tokens = lambda t: (t or "").encode().lower().split()
    c = collections.Counter(w for i, t, *_ in rows if is_train(i) for w in tokens(t))
    texts = sum(is_train(r[0]) for r in rows)
    n, v = sum(c.values()) + texts, len(c) + 1
    model = lattice.Lattice(*vocabulary)
    import numpy as np

    plain = model
    _, e = model.run([w.decode() for w in c], np.array(list(c.values()), dtype=float))
    e = e + 0.1
    model = lattice.Lattice(vocabulary[0], np.log(e / (e.sum() + texts)), math.log(texts / (e.sum() + texts)))
    base = lambda x: math.log10((x + 1) / (n + v + 1))
    expected = []
    for i, t, *_ in rows:
        w = tokens(t)
        logs = model.run([x.decode() for x in w])[0].sum() if w else 0.0
        expected.append((i, len(w) + 1, sum(x in c for x in w) + 1, n, sum(base(c[x]) for x in w) + base(texts), (logs + model.end) / math.log(10), ((plain.run([x.decode() for x in w])[0].sum() if w else 0.0) - math.log(256)) / math.log(10)))
    same = lattice.score(df, train, vocabulary=vocabulary, head=5)
    assert same.where("score != vocabulary_score").count() == 0 and sorted(r.score for r in same.collect()) == pytest.approx(sorted(r[6] for r in expected))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:])


def test_lattice_empty(spark):
    df = docs(spark, [])
    assert lattice.score(df, F.lit(True), vocabulary=toy()).count() == 0
    one = lattice.score(docs(spark, [(1, "ab", None, None, "")]), F.lit(False), vocabulary=toy()).first()
    assert (one.n_tokens, one.n_known, one.train_tokens, one.base_score) == (2, 0, 0, 0.0)


# --- decontamination


def brute_hits(text, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        q = words(t)
        n = min(len(q), window)
        for k in range(max(0, len(q) - n + 1)) if q else ():
            for at in range(len(w) - n + 1):
                if w[at : at + n] == q[k : k + n]:
                    hit |= set(range(at, at + n))
                    ids.add(i)
    return len(w), len(hit), sorted(i for i in ids if i is not None)


@pytest.mark.parametrize("part_bytes, piece", [(10**9, 2000), (120, 2000), (250, 3), (40, 1)])
def test_decontamination(spark, monkeypatch, part_bytes, piece):
    monkeypatch.setattr(decontaminate, "PART_BYTES", part_bytes)
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    rnd = random.Random(2)
    items = [(i, prose(rnd, n)) for i, n in enumerate((20, 3, 1, 13, 40, 0))] + [(7, None), (None, "lone words here"), (1, "More Ünder (one) id")]
    rows = [(i, prose(rnd, 30) + " " + rnd.choice(items[:5])[1].upper() + "—" + prose(rnd, 30), "en", "s", "clash") for i in range(40)] + ODD + [(950, "lone words here, more ünder ONE id", None, None, "x")]
    found = decontaminate.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), window=5)
    assert found.columns == ["doc_id", "text", "lang", "source", "score", "contamination"]
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, ids = brute_hits(r.text, [(None if i is None else str(i), t) for i, t in items], 5)
        c = r.contamination
        assert (c.n_words, c.n_hit, sorted(c["items"]), c.contaminated) == (n, hit, ids, hit > 0 and 20 * hit >= n)
        assert sum(brute_hits(r.text[a:b], [], 5)[0] for a, b in zip(c.span_starts, c.span_ends, strict=True)) == hit
        assert all(b < a for b, a in zip(c.span_ends, c.span_starts[1:], strict=False))


def test_decontamination_of_long_texts(spark):
    rnd = random.Random(22)
    item = prose(rnd, 40)
    rows = [(1, "x" * 2_000_000 + " " + item, None, None, ""), (2, "é " * 500_000 + item, None, None, ""), (3, " " * 2_000_000, None, None, ""), (4, "w " * 700 + item, None, None, "")]
    got = {r.doc_id: r.contamination for r in decontaminate.contamination(docs(spark, rows), spark.createDataFrame([(1, item), (2, "one two " * 30_000)], "item_id long, text string")).collect()}
    n = len(brute_hits(item, [], 13)[1:]) and brute_hits(item, [], 13)[0]
    assert [(got[i].n_words, got[i].n_hit, got[i].contaminated) for i in (1, 2, 3, 4)] == [(n + 1, n, True), (500_000 + n, n, False), (0, 0, False), (700 + n, n, 20 * n >= 700 + n)]
    assert got[2].span_starts == [1_000_000]


def test_merged_keeps_each_run_once():
    one = {"starts": [2, 9], "ends": [5, 12], "span_starts": [20, 90], "span_ends": [50, 120], "items": ["b"]}
    two = {"starts": [5, 30], "ends": [9, 31], "span_starts": [50, 300], "span_ends": [88, 310], "items": ["a", "b"]}
    assert decontaminate.merged([one, two]) == {"starts": [2, 30], "ends": [12, 31], "span_starts": [20, 300], "span_ends": [120, 310], "items": ["a", "b"]}


def test_states_of_the_automaton_are_bounded():
    rnd = random.Random(23)
    raw = " ".join(rnd.choice(WORDS) + str(i) for i in range(5000)).encode()
    machine = decontaminate.Windows([("1", raw)], 13)
    assert machine.machine.get_stats()["nodes_count"] <= 2 * 13 * 5000 + 1


def test_decontamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs(spark, []), none).count() == 0
    assert decontaminate.contamination(docs(spark, ODD), none).where("contamination.contaminated").count() == 0


# --- secrets


def test_secret_patterns(spark):
    rnd = random.Random(3)
    bits = ["password=abc", 'Token: "0123456789abcdef0123456789abcdef"', "secret=token:abcdefg", "api_key='zz-9_x/=+'", "AKIA" + "A1" * 8, "AKIAAKIA" + "B" * 12, "f" * 24, "e" * 23, "é😀", "API-KEY = x", "apikey:aaaaaa", "passwd  =  'qqqqqqq"]
    rows = [(i, " ".join(rnd.choice(bits + WORDS) for _ in range(rnd.randint(0, 60))), "en", "s", "clash") for i in range(80)] + ODD + [(951, "f" * 24 + " " + "ab " * 20000 + "password=" + "z" * 5000, None, None, "x")]
    got = {(r.doc_id, r.text): r.secrets for r in secret_scan.scan(docs(spark, rows)).collect()}
    assign = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
    for i, t, *_ in rows:
        s = t or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(s) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", s) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", s) if len(m[0]) >= 24]
        assert [(x.start, x.kind, x.end) for x in got[i, t] if x.kind < 3] == sorted(want)


def test_randomness_battery(spark):
    rnd = random.Random(4)
    full = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    secret = [(i, f"see {''.join(rnd.choice(full) for _ in range(40))} here", "en", "s", "x") for i in range(60)]
    plain = [(100 + i, f"final_report_version{i}_of_the_meeting zzzzzzzzzzzzzzzzzzz{i}zzz 2024-01-0{i % 9}T00-00-00-000000 1234567890123456789012", "en", "s", "x") for i in range(60)]
    got = {r.doc_id: len(r.secrets) for r in secret_scan.scan(docs(spark, secret + plain)).collect()}
    assert sum(got[i] for i in range(60)) >= 54 and sum(got[100 + i] for i in range(60)) == 0
    clear = secret_scan.masked(docs(spark, secret[:1] + plain + ODD + [(7, "é password=abcdefg token=abcdefgh x", "en", "s", "x")]))
    texts = {r.doc_id: r.text for r in clear.collect()}
    assert texts[7] == "é <SECRET> <SECRET> x" and texts[900] is None and texts[100] == plain[0][1] and clear.columns == ["doc_id", "text", "lang", "source", "score"]
    assert secret_scan.scan(docs(spark, [])).count() == 0


# --- sentence spans


def test_sentences_cover_texts():
    rnd = random.Random(5)
    for t in (prose(rnd, 400), prose(rnd, 300, ""), "a. b! c?\n\nd", "", "  x. "):
        parts = sentence_spans.sentences_of(t)
        assert "".join(t[a:b] for a, b in parts).strip() == t.strip() and all(a < b for a, b in parts)


def test_repeated_passages_go(spark):
    rnd = random.Random(6)
    passage, line = prose(rnd, 70), prose(rnd, 200, "")
    rows = [(i, prose(rnd, 120) + ". \n" + (passage + "\n" if i % 2 else "") + (line + "\n" if i % 5 == 0 else "") + prose(rnd, 80), "en", "s", "clash") for i in range(40)] + ODD
    got = {r.doc_id: r for r in sentence_spans.remove_repeats(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    words = passage.split()
    kept = [i for i in range(40) if " ".join(words[20:40]) in " ".join(got[i].text.split())]
    assert kept == [1]
    words = line.split()
    assert [i for i in range(40) if " ".join(words[80:110]) in got[i].text] == [0]
    for i in range(40):
        if i % 2 == 0 and i % 5:
            assert got[i].text == rows[i][1] and not got[i].removed
        left, lost = got[i].text, sum(s.end - s.start for s in got[i].removed)
        assert len(left) + lost == len(rows[i][1])
    assert got[900].text is None and got[901].text == ""
    again = sentence_spans.remove_repeats(docs(spark, [(1, passage, None, None, "")] * 3)).collect()
    assert [r.text for r in again] == [passage] * 3
    assert sentence_spans.remove_repeats(docs(spark, [])).count() == 0


def test_brute_force_spans(spark):
    rnd = random.Random(7)
    rows = [(i, ". ".join(rnd.choice("abc") for _ in range(12)), None, None, "") for i in range(30)]
    got = {r.doc_id: r.text for r in sentence_spans.remove_repeats(docs(spark, rows), sentences=3, words=3).collect()}
    first, lost = {}, collections.defaultdict(set)
    for i, t, *_ in sorted(rows):
        parts = sentence_spans.sentences_of(t)
        for j in range(len(parts) - 2):
            h = " ".join(t[a:b].strip() for a, b in parts[j : j + 3])
            if first.setdefault(h, (i, j)) != (i, j):
                lost[i] |= {j, j + 1, j + 2}
    for i, t, *_ in rows:
        parts = sentence_spans.sentences_of(t)
        assert got[i] == "".join(t[a:b] for j, (a, b) in enumerate(parts) if j not in lost[i])


# --- language


def test_language(spark):
    rnd = random.Random(8)
    letters = {"en": "theandofing", "fr": "éèçàuxleoi", "de": "üßscheinund"}
    make = lambda c, n: " ".join("".join(rnd.choice(letters[c]) for _ in range(rnd.randint(2, 7))) for _ in range(n))
    rows = [(i, make(c, rnd.randint(4, 60)), c, "s", "clash") for i, c in enumerate(rnd.choices(list(letters), k=400))] + ODD
    df = docs(spark, rows)
    model = language.train(df.where(~language.held_out()), per_language=80)
    got = language.identify(df, model).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "lang", "source", "lang_pred", "score"}
    judged = [(r.lang, r.lang_pred) for r in got if r.doc_id is not None and r.doc_id < 400]
    assert sum(a == b for a, b in judged) / len(judged) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (900, 901, 902, 903)} == dict.fromkeys((900, 901, 902, 903), "und")
    assert language.train(docs(spark, ODD[:1])) is None
    assert [r.lang_pred for r in language.identify(docs(spark, ODD), None).collect()] == ["und"] * 5
    assert language.identify(docs(spark, []), model).count() == 0


def test_collapsed_product_is_the_kernel_regression():
    import numpy as np

    rnd = random.Random(9)
    texts = [prose(rnd, 20) for _ in range(30)]
    seen = [language.present(language.pieces(t)[0]) for t in texts]
    marks = language.Landmarks(np.array([np.packbits(s) for s in seen[:10]]))
    sums, label = language.Sums(marks.white.shape[1], 2), np.arange(30) % 2
    for at in (0, 7, 22):  # in parts, as tasks do
        part = language.Sums(marks.white.shape[1], 2)
        rows = list(range(at, {0: 7, 7: 22, 22: 30}[at]))
        part.add(marks.phi([seen[i] for i in rows]), label[rows], np.ones(len(rows)))
        sums.merge(part.all)
    beta, bias = sums.solve(1e-3)
    m = language.Model(["a", "b"], marks.weights(beta), bias)
    sets = [set(np.flatnonzero(s).tolist()) for s in seen]
    k = lambda x, y: len(x & y) / math.sqrt(len(x) * len(y))
    kmm = np.array([[k(x, y) for y in sets[:10]] for x in sets[:10]])
    values, vectors = np.linalg.eigh(kmm)
    phi = np.array([[k(x, y) for y in sets[:10]] for x in sets]) @ (vectors / np.sqrt(values))
    y = np.where(label[:, None] == np.arange(2), 1.0, -1.0)
    z = phi - phi.mean(0)
    beta = np.linalg.solve(z.T @ z + 1e-3 * 30 * np.eye(10), z.T @ (y - y.mean(0)))
    v = language.SHARPNESS * (z @ beta + y.mean(0))
    assert m.scores(texts) == pytest.approx(np.exp(v) / np.exp(v).sum(1, keepdims=True), abs=1e-3)


def test_long_texts_keep_their_language(spark):
    rnd = random.Random(12)
    words = {c: ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 8))) for _ in range(20_000)] for c, letters in {"x": "theandofing bcmprsuvwxyz", "y": "theandofing jklqrsuéèà"}.items()}
    make = lambda c, n: " ".join(rnd.choice(words[c]) for _ in range(n))
    rows = [(i, make(c, 30), c, None, "") for i, c in enumerate(["x", "y"] * 60)] + [(500, make("x", 400_000), None, None, ""), (501, make("y", 400_000), None, None, ""), (502, " " * 1_000_000 + "!", None, None, "")]
    df = docs(spark, rows)
    got = {r.doc_id: r for r in language.identify(df, language.train(df)).where("doc_id >= 500").collect()}
    assert (got[500].lang_pred, got[501].lang_pred, got[502].lang_pred) == ("x", "y", "und") and min(got[500].score, got[501].score) > 0.8


# --- WARC


def test_warc(spark):
    page = b"<html><head><title>T &amp; u</title><style>p{}</style></head><body><p>One<b>two</b></p><script>x<y</script><br>three &lt; 4 <a href='/z'>l</a><!-- c --></body>"
    rows = [("<urn:uuid:1>", "http://x/", "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nServer: s\r\nContent-Type: text/html\r\n", page), ("<urn:uuid:2>", None, None, None, None), ("<urn:uuid:3>", "u", None, "", b"\xff<p"), ("<urn:uuid:3>", "u", None, "", b"\xff<p")]
    df = spark.createDataFrame(rows, "record_id string, target_uri string, date string, http_headers string, payload binary")
    got = warc.derive(df).collect()
    assert len(got) == 8
    conv = next(r for r in got if r.refers_to == "<urn:uuid:1>" and r.warc_type == "conversion")
    assert bytes(conv.block).decode() == "Onetwo\nthree < 4 l"
    meta = next(r for r in got if r.refers_to == "<urn:uuid:1>" and r.warc_type == "metadata")
    told = dict(x.split(": ", 1) for x in bytes(meta.block).decode().split("\r\n") if x)
    assert told["source-header-server"] == "s" and told["title"] == "T & u" and told["outlinks"] == "1" and told["source-payload-digest"] == warc.digest(page) and told["conversion-digest"] == conv.block_digest
    assert "WARC-Refers-To: <urn:uuid:1>\r\n" in conv.headers and "WARC-Target-URI" not in next(r for r in got if r.refers_to == "<urn:uuid:2>").headers
    again = list(warc.parse(b"".join(map(warc.serialise, got))))
    assert [(h["warc-record-id"], b) for h, b in again] == [(r.record_id, bytes(r.block)) for r in got]
    assert all(warc.digest(b) == h["warc-block-digest"] for h, b in again)
    assert warc.derive(df.limit(0)).count() == 0


def test_read_responses(spark, tmp_path):
    import gzip

    body = b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\n<p>hi"
    one = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:9>\r\nWARC-Target-URI: http://y\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one.replace(b"response", b"warcinfo")) + gzip.compress(one))
    got = warc.read_responses(spark, str(tmp_path)).collect()
    assert [(r.record_id, r.target_uri, bytes(r.payload)) for r in got] == [("<urn:uuid:9>", "http://y", b"<p>hi")]


# --- token counts


def test_token_counts(spark):
    rnd = random.Random(10)
    rows = [(i, "\n".join(prose(rnd, rnd.randint(0, 30)) + rnd.choice(["", "é日本", "  "]) for _ in range(6)), None, None, "") for i in range(30)] + ODD + [(952, "x" * 50_000, None, None, "")]
    got = token_counts.attribute(docs(spark, rows)).collect()
    with open(token_counts.RANKS, "rb") as f:
        e = token_counts.Encoder(f.read())
    for i, t, *_ in rows:
        mine = sorted((r.section, r.start, r.end, r.n_tokens) for r in got if r.doc_id == i)
        assert sum(m[3] for m in mine) == len(e.encoding.encode_ordinary(t or ""))
        assert "".join((t or "")[a:b] for _, a, b, _ in mine) == (t or "")
    assert token_counts.attribute(docs(spark, [])).count() == 0


def test_boundary_rule(spark):
    import numpy as np

    ends, borders = np.array([4, 6, 10]), np.array([1, 5, 10])  # tokens 0-4, 4-6, 6-10; sections 0-1, 1-5, 5-10
    assert token_counts.allot(ends, borders).tolist() == [0, 2, 1]
    df = spark.createDataFrame([(1, "hello world, hello", [("a", 0, 5), ("b", 13, 18)])], "doc_id long, text string, parts array<struct<name:string,start:long,end:long>>")
    assert [(r.name, r.start, r.end) for r in token_counts.attribute(df, sections="parts").collect()] == [("a", 0, 5), (None, 5, 13), ("b", 13, 18)]


def test_digest_and_fingerprint_base():
    assert hashlib.sha256(b"1,2").hexdigest() == decontaminate.digest(["1", "2"])
    assert xxhash.xxh64_intdigest(b"a", seed=42) != xxhash.xxh64_intdigest(b"a")
