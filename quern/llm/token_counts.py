"""Token counts by section: whole documents are encoded once and each token is given to one section by its characters.

Offsets: token byte lengths are added up, so a token's span is exact in the document's UTF-8 bytes. Tokens are joined to
sections as intervals (both are in order, so by binary search). A token that lies in several sections goes to the
one that holds most of its bytes, and to the first of those if equal; this rule is the only one.

Sections are given as an array column of (name, start, end) in characters, in order and without overlap, or are the text's
lines by default (a line end belongs to the line before it, so that lines cover the text). Tokens outside all given
sections are counted in a section with null name, one for each gap.

Results: a null or empty text has no sections and gives no rows. Repeated rows are counted each. The sum over a text's sections is its
number of tokens. Texts are encoded whole, whatever their length; a long run of white space goes to the merges by itself, which is what the
splitting pattern does with it (Encoder.pieces). Ties: a token that lies in two sections by equal shares goes to the first. Columns of docs other
than key, text and sections play no part, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before merges, for the rank files above.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LINE = re.compile(r"[^\n]*\n+|[^\n]+")
#: Runs of what the pattern above takes for white space (Unicode's White_Space), too long for its look-ahead to step back through.
_BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1024,}")


class Encoder:
    def __init__(self, ranks: bytes):
        import tiktoken

        pieces = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=pieces, special_tokens={})
        self.lengths = np.zeros(max(pieces.values()) + 1, dtype=np.int64)
        for p, i in pieces.items():
            self.lengths[i] = len(p)

    def pieces(self, text: str) -> list[int]:
        """Token ids. Of a run of white space the pattern takes all but its last character as one piece (all of it at the end of the
        text) and goes on at that character, so cutting the text there changes nothing; the piece goes straight to the merges."""
        out, at = [], 0
        for run in _BLANKS.finditer(text):
            last = run.end() if run.end() == len(text) else run.end() - 1
            out += self.encoding.encode_ordinary(text[at : run.start()])
            out += self.encoding._encode_single_piece(text[run.start() : last].encode())
            at = last
        return out + self.encoding.encode_ordinary(text[at:])

    def ends(self, text: str) -> np.ndarray:
        """Where each token ends, in bytes."""
        return np.cumsum(self.lengths[np.array(self.pieces(text), dtype=np.int64)])


def lines_of(text: str) -> list[tuple[str | None, int, int]]:
    return [(None, m.start(), m.end()) for m in _LINE.finditer(text)]


def filled(sections: list[tuple[str | None, int, int]], length: int) -> list[tuple[str | None, int, int, bool]]:
    """Sections and the gaps between them; the last field is true for given sections."""
    out, at = [], 0
    for name, a, b in sections:
        a, b = max(at, min(a, length)), max(at, min(b, length))
        if a > at:
            out.append((None, at, a, False))
        if b > a:
            out.append((name, a, b, True))
            at = b
    return out + [(None, at, length, False)] * (at < length)


def allot(ends: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Tokens of each section; borders: section ends in bytes, ascending, the last being the text's."""
    starts = np.concatenate([[0], ends[:-1]])
    first, last = np.searchsorted(borders, starts, side="right"), np.searchsorted(borders, ends - 1, side="right")
    counts = np.bincount(first[first == last], minlength=len(borders))
    for k in np.flatnonzero(first != last):
        inside = np.arange(first[k], last[k] + 1)
        low = np.maximum(starts[k], np.concatenate([[0], borders])[inside])
        counts[inside[np.argmax(np.minimum(ends[k], borders[inside]) - low)]] += 1
    return counts


def attribute(docs: DataFrame, *, text: str = "text", key: str = "doc_id", sections: str | None = None, ranks: str = RANKS) -> DataFrame:
    """A row for each section of each text: key, section (from 0), name, start, end (characters), n_tokens."""
    with open(ranks, "rb") as f:  # the driver's copy of the vocabulary is sent to the workers
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), *T._parse_datatype_string("section bigint, name string, start bigint, end bigint, n_tokens bigint").fields])

    def make():
        encoder = Encoder(sent.value)

        def step(batch):
            given = batch.column(2).to_pylist() if sections else None
            at, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if not t:
                    continue
                parts = filled([(s["name"], s["start"], s["end"]) for s in given[i] or ()] if given else lines_of(t), len(t))
                ascii_ = t.isascii()
                borders = np.array([b for _, _, b, _ in parts]) if ascii_ else np.cumsum([len(t[a:b].encode()) for _, a, b, _ in parts])
                for j, ((name, a, b, _), n) in enumerate(zip(parts, allot(encoder.ends(t), borders).tolist(), strict=True)):
                    at.append(i)
                    rows.append((j, name, a, b, n))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=["k", "section", "name", "start", "end", "n_tokens"])

        return step

    chosen = [F.col(key).alias("k"), F.col(text).cast("string").alias("t")] + ([F.col(sections).cast("array<struct<name: string, start: bigint, end: bigint>>").alias("s")] if sections else [])
    return map_batches(docs.select(*chosen), schema, make).withColumnRenamed("k", key)


def op10_offset_attribution(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return attribute(docs).select("doc_id", "section", "start", "end", "n_tokens")
