"""Exact and fuzzy deduplication, keeping the first (or last) row in a given order."""

from __future__ import annotations

import math
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import cut


def _order(order_by: str | Column | None) -> Column:
    return F.col(order_by) if isinstance(order_by, str) else F.monotonically_increasing_id() if order_by is None else order_by


def exact(df: DataFrame, field: str, order_by: str | Column | None = None, keep: str = "first") -> DataFrame:
    """One row for each text of a field; rows whose field is null or '' all stay.

    The row to keep is an aggregate that holds the whole row and combines before the shuffle, so a text that holds a third of the rows
    is no hot spot, rows are shuffled once, and no row is looked up again by a number that another run might give differently. Ties of the
    order are broken by a hash of the row's plain columns.
    """
    text = F.col(f"`{field}`").cast("string")
    free = F.coalesce(text, F.lit("")) == ""
    rows = df.where(~free).withColumn("__o__", F.struct(_order(order_by).alias("a"), F.xxhash64(*_plain(df)).alias("b")))
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = rows.groupBy(F.sha2(text, 256).alias("__k__")).agg((F.min_by if keep == "first" else F.max_by)(whole, F.col("__o__")).alias("__row__"))
    return best.select("__row__.*").union(df.where(free))


def _plain(df: DataFrame) -> list[Column]:
    """Columns that can be hashed."""
    return [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]


@F.pandas_udf(T.DoubleType())
def similarity(new: pd.Series, kept: pd.Series) -> pd.Series:
    """1 for equal texts, else the matching-blocks ratio of the newer text against the kept one."""
    return pd.Series([1.0 if a == b else SequenceMatcher(None, a, b).ratio() for a, b in zip(new, kept, strict=True)], dtype="float64")


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def _prefix(text: str, threshold: float):
    """The rarest characters of a text (counted: e#3 is its third e), as many as any text similar enough must share one of.

    A ratio of t needs t / 2 of the two lengths in common characters. The shortest partner of a text of length n has
    t n / (2 - t) characters, so at least that many are common, and n less that many plus one hold one of them.
    """
    n = len(text)
    seen: Counter = Counter()
    tokens = []
    for c in text:
        tokens.append((-seen[c], c))
        seen[c] += 1
    need = max(1, math.ceil(threshold * n / (2 - threshold) - 1e-9))
    return [f"{c}#{-k}" for k, c in sorted(tokens)[: n - need + 1]]


def pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """Edges (old, new) between rows (ord, t) of distinct texts, where the newer row is near enough to the older.

    Candidates share a character of their prefixes (an exact filter for the ratio); bounds on lengths and on the Jaccard index
    of the character sets follow, then the ratio itself.
    """
    keyed = texts.select("ord", F.char_length("t").alias("n"), F.explode(_prefix("t", F.lit(float(threshold)))).alias("token"))
    a, b = keyed.alias("a"), keyed.alias("b")
    gap = F.abs(F.col("a.n") - F.col("b.n"))
    near = (gap / F.greatest("a.n", "b.n") <= 1 - threshold) & (gap / F.col("b.n") <= 1 - threshold)
    found = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.ord") < F.col("b.ord")) & near).select(F.col("a.ord").alias("old"), F.col("b.ord").alias("new")).distinct()
    both = found.join(texts.select(F.col("ord").alias("old"), F.col("t").alias("told")), "old").join(texts.select(F.col("ord").alias("new"), F.col("t").alias("tnew")), "new")
    chars = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    both = both.withColumn("x", chars("told")).withColumn("y", chars("tnew"))
    alike = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")) >= threshold * 0.8
    return both.where(alike).where(similarity("tnew", "told") >= threshold).select("old", "new")


def survivors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Greedy choice in order, in parallel rounds: a row stays once no earlier neighbour is open or kept, and goes once one is kept.

    Every round decides at least the first open row, so the rounds end; a chain of near texts takes one for every second of its texts.
    """
    open_, kept = cut(nodes.select("ord"), "open"), None
    edges = cut(edges, "near")
    if not edges.limit(1).count():
        return open_
    while True:
        free = cut(open_.join(edges.select(F.col("new").alias("ord")).distinct(), "ord", "left_anti"), "free")
        kept = free if kept is None else kept.union(free)
        lost = edges.join(free.select(F.col("ord").alias("old")), "old", "left_semi").select(F.col("new").alias("ord")).distinct()
        lost = cut(lost, "lost")
        open_ = cut(open_.join(free, "ord", "left_anti").join(lost, "ord", "left_anti"), "open")
        gone = lost.select(F.col("ord").alias("x"))
        edges = cut(edges.join(gone, F.col("old") == F.col("x"), "left_anti").join(gone, F.col("new") == F.col("x"), "left_anti").join(free.select(F.col("ord").alias("x")), F.col("old") == F.col("x"), "left_anti"), "near")
        if not open_.limit(1).count():
            return kept


def fuzzy(df: DataFrame, field: str, order_by: str | Column | None = None, threshold: float = 0.95) -> DataFrame:
    """Without rows that equal or come near an earlier kept row; rows with a null or empty field stay. Exact only from 0.99 on."""
    first = exact(df, field, order_by)
    if threshold >= 0.99:
        return first
    rows = cut(first.withColumn("__o__", F.struct(_order(order_by).alias("a"), F.monotonically_increasing_id().alias("b"))), "texts")
    text = F.col(f"`{field}`").cast("string")
    texts = rows.where(F.coalesce(text, F.lit("")) != "").select(F.col("__o__").alias("ord"), text.alias("t"))
    kept = survivors(texts, pairs(texts, threshold)).select(F.col("ord").alias("__kept__"))
    whole = rows.join(kept, F.col("__o__") == F.col("__kept__"), "left_semi").select(*df.columns)
    return whole.union(rows.where(F.coalesce(text, F.lit("")) == "").select(*df.columns))


def split_fuzzy(df: DataFrame, field: str, order_by: str, threshold: float = 0.95, keep: str = "first") -> DataFrame:
    """df with is_duplicate. keep='last' runs the same choice from the other end."""
    order = F.col(order_by) if keep == "first" else -F.col(order_by)
    kept = fuzzy(df, field, order, threshold).select(F.col(order_by).alias("__id__"))
    return df.join(kept, F.col(order_by) == F.col("__id__"), "left").withColumn("is_duplicate", F.col("__id__").isNull()).drop("__id__")
