"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Words are maximal runs of ASCII letters, digits and non-ASCII characters after A-Z is lowered. Every item gives
its windows of `window` consecutive words (an item of fewer words is one window); all windows are the patterns of
one automaton. Its letters stand for words: a word of the benchmark has a number, written in two letters, and every other
word is one and the same, so an automaton has at most 2 * window states a benchmark word. A text is normalised once, scanned
once, and each occurrence is mapped back to its words and to character offsets in the original text.

Size: the benchmark is dealt into pieces of at most PIECE windows, so a long item is no unit, and their bytes are measured. Up to PART_BYTES
they are one automaton (about 0.2 GB in a worker, 0.6 at the worst, for words of one letter). A larger benchmark has an automaton a part,
built and scanned one after another, so no task, broadcast or collect holds more than one part; what the parts find is merged document by
document by the rule that joins runs within one part, so spans, items and counts are the same for any number of parts.

Nulls: a null text, of either side, has no words. An item with a null item_id marks the words it hits but is not listed.
Empty tables: no items means no hits; no documents means no rows. Repeated rows are judged each on their own; so are repeated items.
Ties: none. Other columns of the documents are kept; a column named like `into` is replaced by the result.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, cut, map_batches

#: Lowers A-Z and turns every other ASCII character that is no letter or digit into a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
#: Bytes of benchmark text in one automaton, and windows in a piece of an item.
PART_BYTES, PIECE = 1_000_000, 2_000
#: The two letters of all words that are not the benchmark's, and where the first and the second letters of its own words start.
_OTHER, _FIRST, _SECOND = "\x01\x01", 0x400, 0xE000
_ROW = "__row__"
_HIT = T.StructType([*(T.StructField(x, T.ArrayType(T.LongType())) for x in ("starts", "ends", "span_starts", "span_ends")), T.StructField("items", T.ArrayType(T.StringType()))])
_HIT_ARROW = [*((x, pa.list_(pa.int64())) for x in ("starts", "ends", "span_starts", "span_ends")), ("items", pa.list_(pa.string()))]


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


def windows_of(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


class Windows:
    """The automaton of all windows of (item_id, text); None in place of it if there is no window."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        import ahocorasick

        found: dict[tuple[bytes, ...], set] = {}
        for item, raw in items:
            for w in windows_of(words_of(raw), window):
                found.setdefault(w, set()).add(item)
        known = sorted({w for ws in found for w in ws})
        letters = math.isqrt(len(known)) + 1  # edges are searched one by one, so as few letters as will do
        self.codes = {w: chr(_FIRST + n // letters) + chr(_SECOND + n % letters) for n, w in enumerate(known)}
        self.machine = ahocorasick.Automaton() if found else None
        for w, ids in found.items():
            self.machine.add_word("".join(map(self.codes.get, w)), (len(w), tuple(i for i in ids if i is not None)))
        if found:
            self.machine.make_automaton()

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit runs of words as (first, end exclusive), items with occurring windows."""
        words = words_of(raw)
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        if self.machine is None or not words:
            return len(words), runs, items
        code = self.codes.get
        for at, (n, ids) in self.machine.iter("".join([code(w, _OTHER) for w in words])):
            last = at // 2 + 1
            items.update(ids)
            first = last - n
            while runs and runs[-1][1] >= first:  # ends do not decrease, so overlaps are at the end
                first = min(first, runs.pop()[0])
            runs.append((first, last))
        return len(words), runs, items

    def hits(self, raw: bytes) -> tuple[int, dict]:
        """Number of words, and what _HIT holds."""
        n, runs, items = self.scan(raw)
        at = offsets(raw, runs) if runs else []
        return n, {"starts": [a for a, _ in runs], "ends": [b for _, b in runs], "span_starts": [a for a, _ in at], "span_ends": [b for _, b in at], "items": sorted(items)}


def offsets(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words (ascending) as character offsets (end exclusive) into the original text."""
    spans = [m.span() for m in _WORD.finditer(raw.translate(_TABLE))]
    out, chars, at = [], 0, 0
    for a, b in runs:
        first = chars + len(raw[at : spans[a][0]].decode("utf-8", "ignore"))
        chars = first + len(raw[spans[a][0] : spans[b - 1][1]].decode("utf-8", "ignore"))
        at = spans[b - 1][1]
        out.append((first, chars))
    return out


def merged(hits: list[dict]) -> dict:
    """What the parts found in one text as one: runs that overlap or touch are joined, as within a part."""
    if len(hits) < 2:
        return hits[0] if hits else {k: [] for k in _HIT.names}
    out: list[list[int]] = []
    for run in sorted(r for h in hits for r in zip(h["starts"], h["ends"], h["span_starts"], h["span_ends"], strict=True)):
        if out and out[-1][1] >= run[0]:
            out[-1][1], out[-1][3] = max(out[-1][1], run[1]), max(out[-1][3], run[3])
        else:
            out.append(list(run))
    return {k: [r[i] for r in out] for i, k in enumerate(_HIT.names[:4])} | {"items": sorted({i for h in hits for i in h["items"]})}


def pieces(benchmark: DataFrame, item_id: str, item_text: str, window: int) -> DataFrame:
    """Rows (i, k, t): the items cut after every PIECE windows, each piece with the words of all its windows."""

    def make():
        def step(batch):
            rows = [(i, k, b" ".join(words[at : at + PIECE + window - 1])) for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for words in (words_of(raw),) for k, at in enumerate(range(0, max(1, len(words) - window + 1) if words else 0, PIECE))]
            yield {"i": [r[0] for r in rows], "k": [r[1] for r in rows], "t": [r[2] for r in rows]}

        return step

    return map_batches(benchmark.select(F.col(item_id).cast("string").alias("i"), as_bytes(F.col(item_text)).alias("t")), "i string, k long, t binary", make)


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, part: int = 20, into: str = "contamination", carry: list[str] | None = None) -> DataFrame:
    """docs with a struct column: n_words, n_hit, items (sorted), span_starts, span_ends (characters), contaminated.

    contaminated: at least one word is hit and part * n_hit >= n_words.
    carry: the columns of docs to return (all by default); texts that are not carried need not come back from Python.
    """
    kept = [c for c in (docs.columns if carry is None else carry) if c != into]
    items = pieces(benchmark, item_id, item_text, window)
    parts = -(-(items.agg(F.sum(F.length("t"))).first()[0] or 0) // PART_BYTES) or 1
    if parts == 1:
        found = _scanned(docs.select(*dict.fromkeys([*kept, text])), text, items, window, kept)
    else:
        items = cut(items, "pieces")
        rows = cut(docs.select(*dict.fromkeys([*kept, text])).withColumn(_ROW, F.monotonically_increasing_id()), "texts")
        hits = None
        for k in range(parts):  # one automaton at a time
            mine = items.where(F.pmod(F.xxhash64("i", "k"), F.lit(parts)) == k)
            got = cut(_scanned(rows.select(_ROW, text), text, mine, window, [_ROW]).where("size(__hit__.starts) > 0").select(F.col(_ROW).alias("__of__"), "__hit__"), "hits")
            hits = got if hits is None else hits.union(got)
        hits = hits.groupBy("__of__").agg(F.collect_list("__hit__").alias("__hits__"))  # at most one a part
        found = _joined(rows.join(hits, F.col(_ROW) == F.col("__of__"), "left"), text, kept)
    hit = F.col("__hit__")
    n_hit = F.aggregate(F.zip_with(hit.ends, hit.starts, lambda a, b: a - b), F.lit(0).cast("long"), lambda a, x: a + x)
    told = F.struct(F.col("__n__").alias("n_words"), n_hit.alias("n_hit"), hit["items"].alias("items"), hit.span_starts.alias("span_starts"), hit.span_ends.alias("span_ends"))
    found = found.select(*kept, told.alias(into))
    return found.withColumn(into, F.col(into).withField("contaminated", (F.col(into).n_hit > 0) & (F.col(into).n_hit * part >= F.col(into).n_words)))


def _out(docs: DataFrame, kept: list[str]) -> T.StructType:
    return T.StructType([*(docs.schema[c] for c in kept), T.StructField("__n__", T.LongType()), T.StructField("__hit__", _HIT)])


def _batch(batch: pa.RecordBatch, kept: list[str], rows: list[tuple[int, dict]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array([n for n, _ in rows], pa.int64()), pa.array([h for _, h in rows], pa.struct(_HIT_ARROW))], names=[*kept, "__n__", "__hit__"])


def _scanned(docs: DataFrame, text: str, items: DataFrame, window: int, kept: list[str]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast([(r.i, bytes(r.t)) for r in items.select("i", "t").collect()])  # PART_BYTES, about

    def make():
        machine = Windows(sent.value, window)
        return lambda batch: iter([_batch(batch, kept, [machine.hits(raw or b"") for raw in batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()])])

    return map_batches(docs, _out(docs, kept), make)


def _joined(rows: DataFrame, text: str, kept: list[str]) -> DataFrame:
    def make():
        def step(batch):
            texts, hits = (batch.column(batch.schema.get_field_index(c)) for c in (text, "__hits__"))
            yield _batch(batch, kept, [(len(words_of(raw or b"")), merged(h or [])) for raw, h in zip(texts.cast(pa.binary()).to_pylist(), hits.to_pylist(), strict=True)])

        return step

    return map_batches(rows, _out(rows, kept), make)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def op5_aho_corasick(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["doc_id"])
    c = F.col("contamination")
    return found.select("doc_id", c.n_words.alias("n_words"), c.n_hit.alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), c.contaminated.alias("contaminated"))


#: Windows are compared as strings of words; hit words are those whose position lies in an occurrence.
SQL_5 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS i, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT i, least(len(w), 13) AS n, array_to_string(w[k : k + least(len(w), 13) - 1], ' ') AS s FROM (SELECT i, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lens WHERE len(w) >= n)),
occ AS (SELECT dw.r, dw.k, dw.n, win.i FROM dw JOIN win ON dw.s = win.s AND dw.n = win.n),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, k, n FROM occ)) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT r, i FROM occ) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hits ON hits.r = d.r LEFT JOIN ids ON ids.r = d.r
"""
