"""Substring dedup by sliding sentence spans.

A text is cut into sentences (after . ! ? and closing marks before white space, and at line ends); a sentence over LONG words is
cut further after words that a hash picks (and after PIECE words without one), so that long lines share cuts wherever a
passage lies in them. From every
sentence starts a span: at least `sentences` sentences and at least `words` words (a text without so many words left is
its last span). Spans are hashed over their words, A-Z lowered and white space made even. Hashes are joined over the whole
corpus; the first occurrence, by doc_id and place, stays; sentences covered by any other occurrence of a repeated span go.

Results: null and blank texts have no sentences and stay as they are. Rows with the same doc_id and text are one document, so
they are treated alike; a null doc_id sorts first. Tables may be empty. Long texts are read whole; hashes have 128 bits. Columns of docs stay; removed text takes the white space after it along.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_batches

_END = re.compile(r"[.!?]+[\"')\]]*\s+|\s*\n\s*")
_WORD = re.compile(r"\S+")
LONG, PIECE = 24, 16


def sentences_of(text: str) -> list[tuple[int, int]]:
    """Spans of sentences; together with the white space after them they are the whole text (but for white space at its front)."""
    import xxhash

    out, at = [], 0
    for end in [m.end() for m in _END.finditer(text)] + [len(text)]:
        if text[at:end].strip():
            words = list(_WORD.finditer(text, at, end))
            start = at
            if len(words) > LONG:
                since = 0
                for w, following in zip(words, words[1:], strict=False):
                    since += 1
                    if since == PIECE or xxhash.xxh32_intdigest(w[0].encode()) % 8 == 0:
                        out.append((start, following.start()))
                        start, since = following.start(), 0
            out.append((start, end))
            at = end
    return out


def spans_of(text: str, sentences: int, words: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, bytes]]]:
    """Sentences, and spans as (first sentence, number of sentences, hash of 16 bytes)."""
    import xxhash

    parts = sentences_of(text)
    tokens = [text[a:b].encode().lower().split() for a, b in parts]
    out = []
    for i in range(len(parts)):
        n, total = 0, 0
        while i + n < len(parts) and (n < sentences or total < words):
            total += len(tokens[i + n])
            n += 1
        if total < words and i:  # what is left is part of the span before
            break
        out.append((i, n, xxhash.xxh3_128_digest(b" ".join(w for t in tokens[i : i + n] for w in t))))
    return parts, out


def remove_repeats(docs: DataFrame, *, text: str = "text", key: str = "doc_id", sentences: int = 3, words: int = 15) -> DataFrame:
    """docs with repeated sentences removed from the text, n_sentences and removed (spans of characters in the old text)."""
    print_ = F.xxhash64(F.coalesce(F.col(text), F.lit("")))  # beside a key, half of it will do
    print_ = F.when(F.col(key).isNull(), print_).otherwise(print_.bitwiseAND(F.lit(0xFFFFFFFF)))
    kind = docs.schema[key].dataType

    def make():
        def step(batch):
            at, hashes, first, length = [], [], [], []
            for row, t in enumerate(batch.column(2).to_pylist()):
                for i, n, h in spans_of(t or "", sentences, words)[1]:
                    at.append(row)
                    hashes.append(h)
                    first.append(i)
                    length.append(n)
            rows, h = pa.array(at, pa.int32()), np.frombuffer(b"".join(hashes), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(first, pa.int32()), pa.array(length, pa.int32())], names=["k", "p", "h", "h2", "i", "n"])

        return step

    schema = T.StructType([T.StructField("k", kind), T.StructField("p", T.LongType()), T.StructField("h", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("i", T.IntegerType()), T.StructField("n", T.IntegerType())])
    runs = cut(map_batches(docs.select(F.col(key).alias("k"), print_.alias("p"), F.col(text).cast("string").alias("t")), schema, make), "spans")
    # counts by half a hash are small to shuffle and leave few rows; those are then told apart by the whole hash
    often = cut(runs.groupBy("h").count().where("count > 1").select("h"), "often")
    rest = cut(runs.join(often, "h", "left_semi"), "repeats")
    place = F.struct("k", "p", "i")
    least = cut(rest.groupBy("h", "h2").agg(F.min(place).alias("least"), F.count("*").alias("c")).where("c > 1").drop("c"), "first")
    covered = rest.join(least, ["h", "h2"]).where(~place.eqNullSafe(F.col("least"))).groupBy(F.col("k").alias("__k__"), F.col("p").alias("__p__")).agg(F.collect_set(F.struct("i", "n")).alias("__gone__"))
    joined = docs.join(covered, F.col(key).eqNullSafe(F.col("__k__")) & (print_ == F.col("__p__")), "left").select(*docs.columns, "__gone__")
    kept = [c for c in docs.columns if c not in ("n_sentences", "removed")]
    out = T.StructType([*(docs.schema[c] for c in kept), T.StructField("n_sentences", T.LongType()), *T._parse_datatype_string("removed array<struct<start: bigint, end: bigint>>").fields])

    def finish():
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def step(batch):
            names = batch.schema.names
            texts, n, removed = [], [], []
            for t, gone in zip(batch.column(names.index(text)).to_pylist(), batch.column(names.index("__gone__")).to_pylist(), strict=True):
                parts = sentences_of(t or "")
                lost = {j for g in gone or () for j in range(g["i"], g["i"] + g["n"])}
                spans: list[dict] = []
                for j in sorted(lost):
                    a, b = parts[j]
                    if spans and spans[-1]["end"] == a:
                        spans[-1]["end"] = b
                    else:
                        spans.append({"start": a, "end": b})
                if lost:
                    edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(t)]
                    t = "".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                texts.append(t)
                n.append(len(parts))
                removed.append(spans)
            cols = [pa.array(texts, pa.string()) if c == text else batch.column(names.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(removed, span)], names=[*kept, "n_sentences", "removed"])

        return step

    return map_batches(joined, out, finish)


def op7_sentence_spans(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_sentences", F.size("removed").cast("long").alias("n_removed"), "removed", "text")
