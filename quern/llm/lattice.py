"""Subword lattice likelihood: a unigram model over an existing piece vocabulary, summed over all segmentations.

A text is a sequence of words (runs of anything but ASCII white space, A-Z lowered), each led by the word-start symbol,
and one end symbol. A segmentation is a path through the lattice of pieces that spell the text; its probability is the
product of its pieces' probabilities; the text's is the sum over all paths, by forward recursion in log space. A piece
holds the word-start symbol at its front only, so the lattice of a text is that of its words in a row, and the recursion
is run once for each distinct word. A character that no piece spells alone is spelled by the vocabulary's byte pieces.

Vocabulary: pieces and scores as they exist. Scores of a unigram model are log probabilities; those of a merge list are
ranks, read as a Zipf law. These weight all segmentations: `vocabulary_score` is a text's probability under the unchanged scores. `score` is the same
unless `rounds` is given: then so many steps of expectation maximisation start from the existing scores, over the word counts of all
training texts (forward-backward, every distinct word, nothing sampled), and the probabilities that result weight the segmentations; the vocabulary stays. The
end symbol, of which the vocabulary has no score, weighs 1/256, or what is learnt.

Scale: word counts are combined in the tasks, then shuffled by word. The HEAD most frequent words (a fixed number) are
broadcast; every other word of a text is joined by shuffle, so nothing that is broadcast grows with the corpus.

Results: a null text is empty (the end symbol alone). Without training texts every c, N and V is 0 and the vocabulary's own
scores are used. A null doc_id is not held out. Ties do not arise. Repeated rows count and score one by one. Very long words take the same recursion, one
at a time; long texts are counted whole. An empty table gives no rows. Columns of docs other than key and text play no part.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_bytes, cut, map_batches

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
HEAD = 1 << 16
#: Symbols of a word from which on it is taken alone.
LONG = 128
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_START = " "  # no word holds it, so it stands for the start of a word


def load_vocabulary(path: str = PIECES) -> tuple[list[str], np.ndarray]:
    """Pieces (the first 256 are the bytes' own) and log probabilities, of a sentencepiece model file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    mark = "▁"
    kept = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)) and mark not in m.id_to_piece(i)[1:]]
    scores = np.array([m.get_score(i) for i in kept])
    kept = [(_START + p[1:] if p[0] == mark else p, s) for p, s in ((m.id_to_piece(i), s) for i, s in zip(kept, scores, strict=True)) if s > -1e8]
    pieces, scores = [p for p, _ in kept], np.array([s for _, s in kept])
    if len(scores) and scores.min() < -200:  # ranks of merges
        scores = -np.log(2 + scores.max() - scores)
    scores = np.concatenate([np.full(256, scores.min() if len(scores) else 0.0), scores])
    return [f"<{b}>" for b in range(256)] + pieces, scores - np.logaddexp.reduce(scores)


class Lattice:
    """Pieces with log probabilities (the first 256 are bytes) and that of the end symbol."""

    def __init__(self, pieces: list[str], logs: np.ndarray, end: float = 0.0):
        self.logs, self.end = logs, end
        tables: dict[int, dict[int, int]] = {}
        for i, piece in enumerate(pieces[256:], 256):
            h = 0
            for n, c in enumerate(piece, 1):
                h = (h * int(_PRIME) + ord(c) + 1) % (1 << 64)
                tables.setdefault(n, {}).setdefault(h, -1)
            tables[len(piece)][h] = i
        self.tables = []
        for n in range(1, len(tables) + 1):
            keys = np.array(sorted(tables[n]), dtype=np.uint64)
            self.tables.append((keys, np.array([tables[n][int(k)] for k in keys], dtype=np.int64)))

    def edges(self, words: list[str]):
        """Symbols, the word and the place in it of each, and edges (start symbol, length, piece; -1: by bytes)."""
        codes = np.frombuffer((_START + _START.join(words)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        first = np.flatnonzero(codes == 32)
        word = np.cumsum(codes == 32) - 1
        place = np.arange(len(codes)) - first[word]
        left = np.append(first[1:], len(codes))[word] - np.arange(len(codes))
        at, h, found = np.arange(len(codes)), np.zeros(len(codes), dtype=np.uint64), []
        for n, (keys, ids) in enumerate(self.tables, 1):
            more = left[at] >= n
            at = at[more]
            h = h[more] * _PRIME + (codes[at + n - 1] + np.uint32(1)).astype(np.uint64)
            spot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            known = keys[spot] == h
            whole = known & (ids[spot] >= 0)
            if n == 1:
                spelled = np.zeros(len(codes), dtype=bool)
                spelled[at[whole]] = True
            found.append((at[whole], np.full(whole.sum(), n), ids[spot[whole]]))
            at, h = at[known], h[known]
        rest = np.flatnonzero(~spelled) if self.tables else np.arange(len(codes))
        found.append((rest, np.full(len(rest), 1), np.full(len(rest), -1)))
        start, length, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        return codes, first, word, place, start, length, piece

    def _bytes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        kinds, which = np.unique(codes, return_inverse=True)
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in kinds]
        return np.array([sum(self.logs[b] for b in s) for s in spelled]), which, spelled

    def run(self, words: list[str], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability (natural, without the end symbol) of each word; with weights also the expected number of each piece."""
        total = np.zeros(len(words))
        expected = None if weights is None else np.zeros(len(self.logs))
        long = [i for i, w in enumerate(words) if len(w) >= LONG]
        short = [i for i, w in enumerate(words) if len(w) < LONG]
        for part in [short] * bool(short) + [[i] for i in long]:
            self._run([words[i] for i in part], part, weights, total, expected, len(words[part[0]]) >= LONG)
        return total, expected

    def _run(self, words, part, weights, total, expected, alone: bool) -> None:
        codes, first, word, place, start, length, piece = self.edges(words)
        value = self.logs[np.maximum(piece, 0)]
        odd = np.flatnonzero(piece < 0)
        if len(odd):
            sums, which, spelled = self._bytes(codes[start[odd]])
            value[odd] = sums[which]
        source = start + word[start]  # every word has one node more than symbols
        key = place[start] * 64 + length
        order = np.argsort(key, kind="stable")
        source, length, piece, value, key = source[order], length[order], piece[order], value[order], key[order]
        target = source + length
        begin, end = first + np.arange(len(first)), np.append(first[1:], len(codes)) + np.arange(len(first))
        a = np.full(len(codes) + len(words), -np.inf)
        a[begin] = 0.0
        bounds = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)] if not alone else []
        groups = [slice(x, y) for x, y in zip(bounds, bounds[1:], strict=False)]
        for g in groups:
            t = target[g]
            a[t] = np.logaddexp(a[t], a[source[g]] + value[g])
        if alone:
            a = np.array(_sums(a.tolist(), source.tolist(), target.tolist(), value.tolist()))
        total[part] = a[end]
        if expected is None:
            return
        b = np.full(len(a), -np.inf)
        b[end] = 0.0
        for g in reversed(groups):
            s = source[g]
            b[s] = np.logaddexp(b[s], value[g] + b[target[g]])
        if alone:
            b = np.array(_sums(b.tolist(), target[::-1].tolist(), source[::-1].tolist(), value[::-1].tolist()))
        owner = np.repeat(np.arange(len(words)), end - begin + 1)[source]
        mass = np.exp(a[source] + value + b[target] - a[end][owner]) * weights[part][owner]
        expected += np.bincount(np.maximum(piece, 0), weights=np.where(piece >= 0, mass, 0.0), minlength=len(expected))
        if len(odd):
            back = np.empty(len(order), dtype=np.int64)
            back[order] = np.arange(len(order))
            for s, m in zip(spelled, np.bincount(which, weights=mass[back[odd]]), strict=True):
                for x in s:
                    expected[x] += m


def _sums(a: list[float], source: list[int], target: list[int], value: list[float]) -> list[float]:
    for s, t, v in zip(source, target, value, strict=True):
        x, y = a[t], a[s] + v
        if y > x:
            x, y = y, x
        a[t] = x + math.log1p(math.exp(y - x)) if y > -math.inf else x
    return a


def word_counts(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """docs: (training boolean, text binary). Rows (word binary, c): how often a word occurs in training; 0 for words of other texts."""

    def run(batches):
        schema, seen = arrow_schema("word binary, c long"), Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], schema=schema)
        for batch in batches:
            for training, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.lower().split()
                if training:
                    seen.update(words)
                else:
                    for w in words:
                        seen.setdefault(w, 0)
                if len(seen) >= most:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return docs.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def learn(words: DataFrame, pieces: list[str], logs: np.ndarray, texts: int, rounds: int = 4, prior: float = 0.1) -> Lattice:
    """Expectation maximisation of the pieces' probabilities over word counts (rows word, c > 0)."""
    end = 0.0
    for _ in range(rounds if texts else 0):
        sent = words.sparkSession.sparkContext.broadcast((pieces, logs))

        def run(batches, sent=sent):
            lattice, total = Lattice(*sent.value), None
            for batch in batches:
                _, got = lattice.run([w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()], np.array(batch.column(1).to_pylist(), dtype=float))
                total = got if total is None else total + got
            if total is not None:
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], schema=arrow_schema("piece long, n double"))

        got = np.full(len(logs), prior)
        for r in words.select("word", "c").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():  # one row a piece of the vocabulary
            got[r.piece] += r.n
        all_ = got.sum() + texts
        logs, end = np.log(got / all_), math.log(texts / all_)
    return Lattice(pieces, logs, end if texts and rounds else math.log(1 / 256))


def score(docs: DataFrame, training, *, text: str = "text", key: str = "doc_id", vocabulary: tuple[list[str], np.ndarray] | None = None, rounds: int = 0, prior: float = 0.1, head: int = HEAD) -> DataFrame:
    """A row for each row of docs: key, n_tokens, n_known, train_tokens, base_score, score, vocabulary_score. training: a boolean column over docs."""
    pieces, logs = vocabulary or load_vocabulary()
    ten = math.log(10)
    narrow = docs.select(training.alias("training"), as_bytes(F.col(text)).alias("t"), F.col(key).alias("k"))
    counts = cut(word_counts(narrow.select("training", "t")), "words")
    texts = docs.where(training).count()
    n, v = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    n, v = (n or 0) + texts, (v or 0) + (texts > 0)
    lattice = learn(counts.where("c > 0"), pieces, logs, texts, rounds, prior)
    plain, learnt = Lattice([], logs, math.log(1 / 256)), lattice.logs is not logs
    sent = docs.sparkSession.sparkContext.broadcast((pieces, logs, lattice.logs if learnt else None))

    def make():
        pieces, logs, other = sent.value
        models = [Lattice(pieces, logs)] + ([Lattice(pieces, other)] if learnt else [])

        def step(batch):
            words = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            q, *p = [pa.array(m.run(words)[0] / ten) for m in models]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(p or [q]), q], schema=arrow_schema("word binary, c long, p double, q double"))

        return step

    known = cut(map_batches(counts.select("word", "c"), "word binary, c long, p double, q double", make), "scored")
    base = lambda c: math.log10((c + 1) / (n + v + 1))
    common = docs.sparkSession.sparkContext.broadcast({bytes(r.word): (r.c > 0, base(r.c), r.p, r.q) for r in known.orderBy(F.desc("c"), "word").limit(head).collect()})
    last = (texts > 0, base(texts), lattice.end / ten, plain.end / ten)

    def heads():
        top = common.value

        def step(batch):
            rows: dict[str, list] = {k: [] for k in ("n", "known", "base", "p", "q", "words", "times")}
            for raw in batch.column(1).to_pylist():
                words = Counter(raw.lower().split())
                seen, b, p, q, rare, times = int(last[0]), *last[1:], [], []
                for w, m in words.items():
                    got = top.get(w)
                    if got is None:
                        rare.append(w)
                        times.append(m)
                    else:
                        seen, b, p, q = seen + m * got[0], b + m * got[1], p + m * got[2], q + m * got[3]
                for k, x in zip(rows, (sum(words.values()) + 1, seen, b, p, q, rare, times), strict=True):
                    rows[k].append(x)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(rows.values(), kinds, strict=True))], names=["k", *rows])

        return step

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), *T._parse_datatype_string("n bigint, known bigint, base double, p double, q double, words array<binary>, times array<bigint>").fields])
    rows = cut(map_batches(narrow.select("k", "t"), schema, heads).withColumn("row", F.monotonically_increasing_id()), "texts")
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    per_word = F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))
    sums = rare.join(known, "word").groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known2"), F.sum(per_word * F.col("times")).alias("base2"), F.sum(F.col("p") * F.col("times")).alias("p2"), F.sum(F.col("q") * F.col("times")).alias("q2"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.drop("words", "times").join(sums, "row", "left").select(F.col("k").alias(key), F.col("n").alias("n_tokens"), (F.col("known") + zero("known2")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + zero("base2")).alias("base_score"), (F.col("p") + zero("p2")).alias("score"), (F.col("q") + zero("q2")).alias("vocabulary_score"))


def held_out(key: str = "doc_id", parts: int = 7, part: int = 2):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def op1_subword_lattice(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, ~held_out(), rounds=4).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "vocabulary_score")
