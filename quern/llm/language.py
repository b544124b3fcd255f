"""Language identification: a blended-spectrum string kernel, Nystroem landmarks, one-versus-rest kernel ridge regression.

Feature of a piece of text: which n-grams of n = 1..4 bytes of its lowered UTF-8 occur in it (presence, not counts), n-grams
hashed to BUCKETS places. Kernel: common n-grams over the root of the product of their numbers (1 for a piece with itself). A text is cut into
pieces of at most PIECE bytes, since a long text holds nearly every n-gram; its values are the mean of its pieces' values.

Fitting: `landmarks` pieces span the Nystroem map phi(x) = K(x, L) (K(L, L) + eps)^(-1/2); one ridge regression per
language on phi. Both come from a bounded labelled sample (at most `per_language` rows expected a language, chosen by a
hash of doc_id; the pieces of a row share its weight); all rows are scored. Only the landmarks come to the driver: tasks compute phi and add up the normal equations
(phi' phi, phi' y), of which each of PARTS tasks returns one. Scoring a batch is presence (pieces x BUCKETS) times one matrix (BUCKETS x languages):
the landmark, whitening and ridge matrices are constant, so their product is taken once.

Results: a text that is null or has no letter is `und` with score 0. score: softmax of the scaled one-versus-rest values.
Ties go to the language that sorts first. Training rows need text, language and at least one letter. If no row can be
learned from, every text is `und`; so an empty table gives no model and no rows. Repeated rows are learned from and scored like any other; no row
is dropped. Columns of docs stay; those named like the label and the score are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, map_batches

BUCKETS = 1 << 16
#: Bytes of a piece of text.
PIECE = 1 << 15
#: Tasks that add up the normal equations of the sample, and so the number of results that the driver adds.
PARTS = 8
#: Scale of the one-versus-rest values (targets are -1 and 1) in the softmax.
SHARPNESS = 4.0
_MIX = (np.uint32(0), np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def present(piece: bytes) -> np.ndarray:
    """Which places the n-grams of a piece (lowered) take."""
    b = np.frombuffer(piece, dtype=np.uint8).astype(np.uint32)
    seen = np.zeros(BUCKETS, dtype=bool)
    code = np.zeros(0, dtype=np.uint32)
    for n in range(1, 5):
        if len(b) < n:
            break
        code = b if n == 1 else (code[:-1] << np.uint32(8)) | b[n - 1 :]
        seen[((code ^ np.uint32(n)) * (_MIX[n - 1] | np.uint32(1)) + _MIX[n - 1] >> np.uint32(16 if n > 1 else 0)) & np.uint32(BUCKETS - 1)] = True
    return seen


def pieces(text: str) -> list[bytes]:
    raw = text.lower().encode("utf-8", "ignore")
    return [raw[at : at + PIECE] for at in range(0, max(1, len(raw)), PIECE)]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Model:
    """weights: BUCKETS x languages; value of language c for a piece with places P: bias[c] + sum(weights[P, c]) / sqrt(len(P))."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray):
        self.languages, self.weights, self.bias = languages, weights, bias

    def values(self, seen: list[np.ndarray]) -> np.ndarray:
        x = np.array(seen, dtype=np.float32)
        x /= np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))
        return (x @ self.weights).astype(np.float64) + self.bias

    def scores(self, texts: list[str], at_once: int = 64) -> np.ndarray:
        parts = [pieces(t) for t in texts]
        flat, values = [p for x in parts for p in x], []
        for at in range(0, len(flat), at_once):
            values.append(self.values([present(p) for p in flat[at : at + at_once]]))
        sums = np.add.reduceat(np.concatenate(values), np.cumsum([0] + [len(x) for x in parts[:-1]]), axis=0)
        v = SHARPNESS * sums / np.array([len(x) for x in parts])[:, None]
        e = np.exp(v - v.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


class Landmarks:
    """bits: landmarks x BUCKETS / 8, packed presence. phi(): the Nystroem map."""

    def __init__(self, bits: np.ndarray):
        self.bits = np.ascontiguousarray(bits)
        self.words = self.bits.view(np.uint64)
        self.many = np.maximum(1, np.bitwise_count(self.words).sum(axis=1, dtype=np.int64))
        values, vectors = np.linalg.eigh(np.array([self.kernel(w) for w in self.words]))
        keep = values > 1e-6 * values.max()
        self.white = vectors[:, keep] / np.sqrt(values[keep])

    def kernel(self, word: np.ndarray) -> np.ndarray:
        """Kernel of a piece (packed presence as 64-bit words) with every landmark."""
        return np.bitwise_count(self.words & word).sum(axis=1, dtype=np.int64) / np.sqrt(self.many * max(1, int(np.bitwise_count(word).sum(dtype=np.int64))))

    def phi(self, seen: list[np.ndarray]) -> np.ndarray:
        return np.array([self.kernel(np.packbits(s).view(np.uint64)) for s in seen]) @ self.white

    def weights(self, beta: np.ndarray, at_once: int = 16) -> np.ndarray:
        """BUCKETS x languages: what beta over phi is over presence."""
        by = (self.white @ beta / np.sqrt(self.many)[:, None]).astype(np.float32)
        out = np.zeros((BUCKETS, beta.shape[1]), dtype=np.float32)
        for at in range(0, len(by), at_once):
            out += np.unpackbits(self.bits[at : at + at_once], axis=1).astype(np.float32).T @ by[at : at + at_once]
        return out


class Sums:
    """Weighted normal equations of phi and the -1 and 1 targets of the languages."""

    def __init__(self, dims: int, languages: int):
        self.all = [0.0, np.zeros(dims), np.zeros(languages), np.zeros((dims, dims)), np.zeros((dims, languages))]

    def add(self, phi: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        y = np.where(label[:, None] == np.arange(self.all[2].shape[0]), 1.0, -1.0)
        z = weight[:, None] * phi
        self.merge([weight.sum(), z.sum(axis=0), weight @ y, z.T @ phi, z.T @ y])

    def merge(self, other: list) -> None:
        self.all = [a + np.asarray(b).reshape(np.shape(a)) for a, b in zip(self.all, other, strict=True)]

    def solve(self, ridge: float) -> tuple[np.ndarray, np.ndarray]:
        """(beta, bias) of the ridge regression with an intercept."""
        n, phi, y, square, cross = self.all
        beta = np.linalg.solve(square - np.outer(phi, phi) / n + ridge * n * np.eye(len(phi)), cross - np.outer(phi, y) / n)
        return beta, (y - phi @ beta) / n


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 1500, landmarks: int = 384, ridge: float = 1e-3) -> Model | None:
    """Fit on a bounded sample of docs: rows whose key hashes below per_language / (rows of their language)."""
    rows = docs.select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l"), F.col(key).cast("string").alias("k")).where("t IS NOT NULL AND l IS NOT NULL")
    counts = {r.l: r["count"] for r in rows.groupBy("l").count().collect()}
    if not counts:
        return None
    u = F.pmod(F.xxhash64(F.coalesce("k", F.lit("")), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = lambda most: F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, most / n))])
    below = lambda most: rows.withColumn("u", u).where(F.col("u") < F.element_at(share(most), F.col("l"))).select("t", "l", "u")

    def packed():
        def step(batch):
            got = [(np.packbits(present((p := pieces(t))[int(u * 1e9) % len(p)])).tobytes(), lang, u) for t, lang, u in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) if has_letter(t)]
            yield {"bits": [g[0] for g in got], "l": [g[1] for g in got], "u": [g[2] for g in got]}

        return step

    each = -(-landmarks // len(counts))
    found = sorted((r.u, r.l, bytes(r.bits)) for r in map_batches(below(2 * each + 16), "bits binary, l string, u double", packed).collect())  # some landmarks a language
    if not found:
        found = sorted((r.u, r.l, bytes(r.bits)) for r in map_batches(below(per_language), "bits binary, l string, u double", packed).collect())
    if not found:
        return None
    turn: dict[str, int] = {}
    ranked = sorted((turn.__setitem__(name, turn.get(name, -1) + 1) or turn[name], i) for i, (_, name, _) in enumerate(found))
    marks = Landmarks(np.frombuffer(b"".join(found[i][2] for _, i in ranked[:landmarks]), dtype=np.uint8).reshape(-1, BUCKETS // 8))
    languages = sorted(counts)
    weight = {c: 1.0 / min(per_language, n) for c, n in counts.items()}
    sent = docs.sparkSession.sparkContext.broadcast((marks, languages, weight))
    kinds = "n double, phi array<double>, y array<double>, square array<double>, cross array<double>"

    def added(batches):
        marks, languages, weight = sent.value
        sums = Sums(marks.white.shape[1], len(languages))
        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if has_letter(t):
                    parts = pieces(t)
                    for at in range(0, len(parts), 64):
                        some = [present(p) for p in parts[at : at + 64]]
                        sums.add(marks.phi(some), np.full(len(some), languages.index(name)), np.full(len(some), weight[name] / len(parts)))
        yield pa.RecordBatch.from_arrays([pa.array([x]) if np.ndim(x) == 0 else pa.array([np.ravel(x).tolist()]) for x in sums.all], schema=arrow_schema(kinds))

    sums = Sums(marks.white.shape[1], len(languages))
    for r in below(per_language).select("t", "l").repartition(PARTS).mapInArrow(added, kinds).collect():
        sums.merge([r.n, r.phi, r.y, r.square, r.cross])
    if not sums.all[0]:
        return None
    beta, bias = sums.solve(ridge)
    return Model(languages, marks.weights(beta), bias)


def identify(docs: DataFrame, model: Model | None, *, text: str = "text", carry: list[str] | None = None, label: str = "lang_pred", score: str = "score", rows_at_once: int = 64) -> DataFrame:
    """docs (or its columns `carry`) with the predicted language and its score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in (docs.columns if carry is None else carry) if c not in (label, score)]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())])

    def make():
        m = sent.value

        def step(batch):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            names, values = ["und"] * len(texts), [0.0] * len(texts)
            rows = [i for i, t in enumerate(texts) if m is not None and has_letter(t)]
            for at in range(0, len(rows), rows_at_once):
                some = rows[at : at + rows_at_once]
                p = m.scores([texts[i] for i in some])
                for i, c, v in zip(some, p.argmax(axis=1), p.max(axis=1), strict=True):
                    names[i], values[i] = m.languages[c], float(v)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(names, pa.string()), pa.array(values, pa.float64())], names=[*kept, label, score])

        return step

    return map_batches(docs.select(*dict.fromkeys([*kept, text])), schema, make)


def held_out(key: str = "doc_id", parts: int = 5, part: int = 0):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def op8_string_kernel(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    return identify(docs, model, carry=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
