"""Mixing sources to target weights by entropy balancing.

Rates: among all document rates w that meet the token target of every source (sum of w * size = target), and come near the
corpus' own profile of document sizes (tokens by class of size, a class for each power of two), those nearest to
1 in relative entropy, counted per token. The convex dual has one multiplier a source and one a class of size, with a ridge penalty on the
latter, so that it has a solution whatever the targets; the optimum is the exponential tilt w = exp(source's + class's multiplier).

Newton: the sources' multipliers follow from the classes' (their part of the Hessian is diagonal, and eliminated), so what is left is a dual
of CLASSES variables, however many sources there are. A step is one pass over a table with a row a source that adds up value, gradient
and Hessian in the tasks; the driver solves a system of CLASSES unknowns and halves the step while the dual's value does not fall enough.
Sources whose target is their cap have the rate `most` throughout and take no part; no rate exceeds `most`.

Copies: floor(w) for all, and one more for the documents of a source whose key u / (w - floor(w)) is lowest, u being a
hash of the key, the size and all columns. How far to go is found by a search over digits of that key: one histogram (4096 bins a source)
a level, refined in the bin where the remainder runs out; so no source is sorted or gathered in one task. Where a large
document did not fit, the search runs again over those that do; at last one document a source changes by a copy, if that
mends what is left.

Results: a null text has size 0; a null source is a source of its own, last in order. Targets: weights repeat over sources in
code point order; a target stops at `most` times its source's size, the excess is shared anew by weight. With no words at
all every target is 0. Ties of the key are broken by row; they concern rows that are alike in all columns only. Repeated rows are
documents of their own. No document is taken more than `most` times. An empty table gives no rows. Targets are found by windows over one row a
source, in one task; millions of sources are well within it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, as_bytes, cut, map_batches

WEIGHTS = (5.0, 2.0, 1.0)
#: Classes of size: the last holds all sizes of 2 ** (CLASSES - 1) - 1 words or more. Ridge penalty on their multipliers, a share of all tokens.
CLASSES, RIDGE = 24, 0.02
_DIGIT, _LEVELS, _FEW = 12, 5, 200


def sizes(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The columns of docs and size, the number of words (runs of anything but ASCII white space)."""
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField("size", T.LongType())])

    def make():
        def step(batch):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([len(t.split()) for t in batch.column(len(columns)).to_pylist()], pa.int64())], names=[*columns, "size"])

        return step

    return map_batches(docs.select(*columns, as_bytes(F.col(text)).alias("__text__")), schema, make)


def targets(tokens: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """tokens: (source, source_size), a row a source. Adds target: shares of all tokens by weight, filled up to the caps."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    at = tokens.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    before = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    left = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    open_ = F.when(F.col("cap") / F.col("weight") >= F.col("left"), F.col("left"))
    level = F.min_by(open_, F.when(open_.isNotNull(), F.col("cap") / F.col("weight"))).over(everything)
    return at.withColumn("left", left).withColumn("level", level).select("source", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def size_class(size: str):
    return F.least(F.floor(F.log2(F.col(size) + 1)), F.lit(CLASSES - 1)).cast("int")


def rates(groups: DataFrame, wanted: np.ndarray, ridge: float = RIDGE, rounds: int = 60, near: float = 1e-10) -> tuple[DataFrame, np.ndarray]:
    """groups: (source, target, ks, ns), a row a source: its classes (array<int>) and their tokens (array<double>), both sums above 0. wanted: tokens by class.

    Returns groups with `rates`, a rate for each class, and the classes' multipliers mu, which minimise
    sum of target * log(sum of ns * exp(mu)) - wanted . mu + penalty * |mu|^2 / 2, the penalty being ridge * all targets.
    """
    k, groups = len(wanted), cut(groups, "groups")

    def passed(mu: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(batches):
            value, first, second = 0.0, np.zeros(k), np.zeros((k, k))
            for batch in batches:
                target, ks, ns = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
                of = np.repeat(np.arange(len(target)), np.asarray(ks.value_lengths()))
                w = np.zeros((len(target), k))
                np.add.at(w, (of, np.asarray(ks.flatten())), np.asarray(ns.flatten()) * np.exp(mu[np.asarray(ks.flatten())]))
                all_ = w.sum(axis=1)
                value += float(target @ np.log(all_))
                p = w / all_[:, None]
                first += target @ p
                second -= p.T @ (target[:, None] * p)
            yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([first.tolist()]), pa.array([second.ravel().tolist()])], schema=arrow_schema("value double, first array<double>, second array<double>"))

        got = groups.select("target", "ks", "ns").mapInArrow(run, "value double, first array<double>, second array<double>").collect()  # one row a task
        first = np.sum([r.first for r in got], axis=0) if got else np.zeros(k)
        second = np.sum([r.second for r in got], axis=0).reshape(k, k) if got else np.zeros((k, k))
        return sum(r.value for r in got), first, second + np.diag(first)

    mu, all_ = np.zeros(k), float(groups.agg(F.sum("target")).first()[0] or 0.0)
    penalty = ridge * all_
    whole = lambda value, mu: value - wanted @ mu + penalty * mu @ mu / 2
    value, first, second = passed(mu)
    for _ in range(rounds):
        slope = first - wanted + penalty * mu
        if not all_ or np.abs(slope).max() <= near * all_:
            break
        step = -np.linalg.lstsq(second + penalty * np.eye(k), slope, rcond=1e-12)[0]
        size = 1.0
        while True:
            then = passed(mu + size * step)
            if whole(then[0], mu + size * step) <= whole(value, mu) + 1e-4 * size * slope @ step + 1e-13 * all_ or size < 1e-6:
                break
            size /= 2
        mu, (value, first, second) = mu + size * step, then
    tilt = F.array(*[F.lit(float(x)) for x in np.exp(mu)])
    whole_ = F.aggregate(F.zip_with("ks", "ns", lambda c, n: n * F.get(tilt, c)), F.lit(0.0), lambda acc, x: acc + x)
    return groups.withColumn("rates", F.transform(tilt, lambda e: F.col("target") * e / whole_)), mu


def copies(rows: DataFrame, most: int = 3, near: float = 0.002) -> DataFrame:
    """rows: (source, size, rate, target, u, row) and more; u in (0, 1). Adds copies; per source, copies * size comes near target."""
    base = F.floor("rate")
    part = F.col("rate") - base
    r = F.when(part > 0, F.col("u") / part)
    low, high = F.pmod(F.xxhash64("row"), F.lit(1 << 24)), F.floor(r / (1 + r) * F.lit(float((1 << 36) - 1)))
    now = cut(rows.withColumn("copies", base.cast("long")).withColumn("key", (high * (1 << 24) + low).cast("long")), "keyed")
    lack = lambda df: df.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("rest"), F.first("target").alias("goal"))
    of = lambda table, s: table.join(s.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    for turn in range(4):
        rest = cut(lack(now), "rest")
        if turn and (rest.agg(F.max(F.when(F.col("goal") > 0, F.col("rest") / F.col("goal")))).first()[0] or 0.0) <= near:
            break
        # at first the documents with a part of a copy left; then any that still fit, where a large one was passed over
        some = now.where(F.col("key").isNotNull()) if not turn else of(now, rest.select("source", "rest")).where((F.col("copies") < most) & (F.col("size") > 0) & (F.col("size") <= F.col("rest"))).withColumn("key", (F.floor(F.col("u") * F.lit(float((1 << 36) - 1))) * (1 << 24) + low).cast("long"))
        more = _filling(some.select("source", "size", "key", "row"), rest.select("source", "rest"), of)
        now = cut(now.join(more.select(F.col("row").alias("also")), F.col("row") == F.col("also"), "left").withColumn("copies", F.col("copies") + F.col("also").isNotNull().cast("long")).drop("also"), "rounded")
    rest = lack(now).select("source", "rest")
    can = F.when(F.col("rest") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0) & (F.abs(F.abs("rest") - F.col("size")) < F.abs("rest"))
    best = of(now, rest).where(can).groupBy("source").agg(F.min(F.struct(F.abs(F.abs("rest") - F.col("size")).alias("left"), "u", "row", F.signum("rest").alias("change"))).alias("b"))
    mended = now.join(best.select(F.col("b.row").alias("fix"), F.col("b.change").alias("change")), F.col("row") == F.col("fix"), "left")
    return mended.withColumn("copies", (F.col("copies") + F.coalesce("change", F.lit(0))).cast("long")).drop("fix", "change", "key")


def _filling(rows: DataFrame, rest: DataFrame, of) -> DataFrame:
    """Of rows (source, size, key, row), those of each source in order of key whose sizes add up to no more than its rest."""
    state, shift = rest.withColumn("prefix", F.lit(0).cast("long")), _DIGIT * _LEVELS
    for _ in range(_LEVELS):
        here = of(rows, state).where(F.shiftright("key", shift) == F.col("prefix"))
        shift -= _DIGIT
        bins = here.groupBy("source", "prefix", "rest", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("s"), F.count("*").alias("n"))
        upto = F.sum("s").over(Window.partitionBy("source").orderBy("bin"))
        ended = bins.withColumn("upto", upto).withColumn("ended", F.when(F.col("upto") > F.col("rest"), F.col("bin")))
        found = ended.groupBy("source").agg(F.min("ended").alias("bin"), F.max("bin").alias("top"), F.first("rest").alias("rest"), F.min_by(F.struct("upto", "s", "n"), "ended").alias("cross"))
        # where nothing runs out, all are taken: the prefix moves past the last bin and nothing is open below it
        told = found.select(F.col("source").alias("of"), F.when(F.col("bin").isNotNull(), F.col("rest") - (F.col("cross.upto") - F.col("cross.s"))).otherwise(0.0).alias("left"), F.coalesce("bin", F.col("top") + 1).alias("to"), F.coalesce("cross.n", F.lit(0)).alias("n"))
        # a source that is finished has no row at its prefix and is not among them; its prefix gets one more digit, so all below stay taken
        kept = state.join(told, F.col("source").eqNullSafe(F.col("of")) & F.col("to").isNotNull(), "left")
        state = cut(kept.select("source", F.coalesce("left", "rest").alias("rest"), F.coalesce("to", F.shiftleft("prefix", _DIGIT)).alias("prefix"), F.coalesce("n", F.lit(0)).alias("n")), "search")
        most = state.agg(F.max("n")).first()[0] or 0
        state = state.drop("n")
        if most <= _FEW:
            break
    at = of(rows, state).withColumn("place", F.shiftright("key", shift))
    order = Window.partitionBy("source").orderBy("key", "row")
    last = at.where(F.col("place") == F.col("prefix")).withColumn("upto", F.sum("size").over(order)).where(F.col("upto") <= F.col("rest"))
    return at.where(F.col("place") < F.col("prefix")).select("row").union(last.select("row"))


def decide(docs: DataFrame, columns: list[str], *, text: str = "text", key: str = "doc_id", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = 3, ridge: float = RIDGE, tie: str | None = None) -> DataFrame:
    """A row for each row of docs: columns (key and source among them), size, source_size, target, copies. tie: a column that tells rows of equal
    key and size apart, by default a hash of all columns."""
    given = docs.withColumn("__tie__", print_of(docs) if tie is None else F.col(tie))
    kept = list(dict.fromkeys([*columns, key, source]))
    rows = cut(sizes(given, [*kept, "__tie__"], text).withColumn("row", F.monotonically_increasing_id()), "sizes")
    u = (F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), "size", "__tie__"), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    cells = cut(rows.groupBy(F.col(source).alias("source"), size_class("size").alias("k")).agg(F.sum("size").alias("tokens")), "cells")
    tokens = cells.groupBy("source").agg(F.sum("tokens").alias("source_size"))
    wanted = cut(targets(tokens, weights, most), "targets")
    # the corpus' profile of sizes, of which capped sources take their part as it is
    held = (F.col("target") >= F.col("source_size") * (most * (1 - 1e-12))) | (F.col("target") <= 0)
    parts = cells.join(wanted.withColumn("held", held).withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    profile, fixed, all_ = np.zeros(CLASSES), np.zeros(CLASSES), 0.0
    for r in parts.groupBy("k").agg(F.sum("tokens").alias("n"), F.sum(F.when(F.col("held") & (F.col("target") > 0), F.col("tokens") * float(most)).otherwise(0.0)).alias("fixed")).collect():  # a row a class
        profile[r.k], fixed[r.k], all_ = r.n, r.fixed, all_ + r.n
    open_ = parts.where("NOT held AND tokens > 0").groupBy("source", "target").agg(F.sort_array(F.collect_list(F.struct("k", F.col("tokens").cast("double").alias("n")))).alias("x")).select("source", "target", F.col("x.k").alias("ks"), F.col("x.n").alias("ns"))  # CLASSES at most
    tilted, _ = rates(open_, np.maximum(profile - fixed, 0.0), ridge)
    each = wanted.join(tilted.select(F.col("source").alias("of"), "rates"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of").withColumnRenamed("source", "__of__")
    joined = rows.join(each, F.col(source).eqNullSafe(F.col("__of__"))).drop("__of__")
    rate = F.least(F.when(F.col("rates").isNotNull(), F.get("rates", size_class("size"))).when(F.col("target") > 0, F.lit(float(most))).otherwise(0.0), F.lit(float(most)))
    found = copies(joined.select(F.struct(*columns).alias("given"), F.col(source).alias("source"), "size", rate.alias("rate"), "source_size", "target", u.alias("u"), "row"), most)
    return found.select("given.*", "size", "source_size", "target", "copies")


def print_of(docs: DataFrame):
    """A hash of a row's columns, but for maps and variants, which have none."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])


def mixed(docs: DataFrame, *, text: str = "text", key: str = "doc_id", source: str = "source", into: str = "copy", **how) -> DataFrame:
    """docs, each row as often as the mix takes it, with the number of the copy in `into` (from 1; where docs has that name, in the first of
    into_2, into_3 and so on that it has not). Rows are told apart by numbers of their own, so rows that share key and text are taken each on its own."""
    free = lambda name: name if name not in docs.columns else next(x for i in range(2, len(docs.columns) + 3) if (x := f"{name}_{i}") not in docs.columns)
    row, into = free("__row__"), free(into)
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    narrow = rows.select(F.col(row).alias("r"), F.col(key).alias("k"), F.col(source).alias("s"), F.col(text).alias("t"), print_of(docs).alias("print"))
    plan = decide(narrow, ["r"], text="t", key="k", source="s", tie="print", **how).where("copies > 0").select(F.col("r").alias("__r__"), F.col("copies").alias("__copies__"))
    return rows.join(plan, F.col(row) == F.col("__r__")).withColumn(into, F.explode(F.sequence(F.lit(1).cast("long"), "__copies__"))).select(*docs.columns, into)


def op9_entropy_balancing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return decide(docs, ["doc_id", "source"]).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
