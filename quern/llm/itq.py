"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Equal vectors fall together first. A bounded sample of the distinct ones (SAMPLE rows, chosen by hash) fits a principal
component projection and the rotation that brings it nearest to the corners of the cube (iterative quantisation), giving
up to 64 balanced bits; every vector is coded.

Tables: the code is cut into disjoint substrings of equal length, and vectors meet whose codes differ in at most `radius` bits of some substring.
Within a radius of 1 or 2 that is one table for each choice of bits of a substring that are left out of the key, so
both sides are looked up once a table and no key is probed. With m substrings all pairs within a Hamming distance of m * (radius + 1) - 1 meet
for certain. The number of substrings and the radius are those of least cost (entries moved and pairs compared, for the number
of vectors) among all whose recall at the threshold, predicted by a simulation of pairs at just that cosine, is RECALL or more; so recall does not depend on the
number of vectors. If no choice reaches it, and with exact=True, all vectors meet in one table, which is exact and takes all pairs.

Vectors that meet are compared by their original vectors in double precision. A pair counts in the first table that brings it
together, so no list of pairs is made: a bucket yields, for each vector, how many vectors it links with and one tree over its links. A
bucket over CHUNK vectors is dealt into chunks, and pairs of chunks are compared in different tasks.

Vectors link only within one number of components. Vectors that are null, zero or hold a null or non-finite component link
with nothing (n_links 0, a component of their own). Ties: none, a cosine equal to the threshold links. Repeated rows are
copies; repeated vec_ids keep a row each. A null vec_id takes part but never names a component. An empty table gives no rows. Other columns
play no part, whatever their names.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut, map_batches

SAMPLE = 8192
#: Tables at most, and pairs compared in the time that it takes to move an entry of a table.
MOST, MOVED = 512, 500
#: Predicted recall of pairs at the threshold, and the pairs it is predicted from.
RECALL, PAIRS = 0.95, 8192
CHUNK = 256
GROUP = 1024


class Quantiser:
    """mean and a projection that holds principal components and rotation; bit j of a code is the sign of column j."""

    def __init__(self, unit: np.ndarray, rounds: int = 50, seed: int = 11):
        self.mean = unit.mean(axis=0)
        centred = unit - self.mean
        values, vectors = np.linalg.eigh(centred.T @ centred / max(1, len(unit)))
        basis = vectors[:, ::-1][:, :64]
        v = centred @ basis
        rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(basis.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ rotation > 0, 1.0, -1.0).T @ v)
            rotation = (u @ w).T
        self.projection = basis @ rotation
        self.bits = basis.shape[1]

    def codes(self, unit: np.ndarray) -> np.ndarray:
        bits = np.zeros((len(unit), 64), dtype=np.uint8)
        bits[:, : self.bits] = (unit - self.mean) @ self.projection > 0
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]


def masks_of(bits: int, parts: int, radius: int) -> np.ndarray:
    """Masks of the bits that are each table's key: of every substring, all but `radius` bits, for every choice of these."""
    length, out = bits // parts, []
    for k in range(parts):
        whole = ((1 << length) - 1) << (k * length)
        out += [whole & ~sum(1 << (k * length + b) for b in left) for left in combinations(range(length), radius)]
    return np.array(out, dtype=np.uint64)


def tables(quantiser: Quantiser, unit: np.ndarray, rows: int, threshold: float, seed: int = 13) -> np.ndarray:
    """The tables' masks. unit: vectors that the quantiser was not fitted on, where there are enough."""
    rng = np.random.default_rng(seed)
    a = unit[rng.integers(0, len(unit), PAIRS)]
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    size = np.linalg.norm(side, axis=1, keepdims=True)
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold * threshold)) * side / np.where(size > 0, size, 1)
    differ = quantiser.codes(a) ^ quantiser.codes(b)
    best = (MOVED * rows + rows * rows / 2, None)
    for parts in range(1, quantiser.bits + 1):
        length = quantiser.bits // parts
        least = np.min([np.bitwise_count(differ >> np.uint64(k * length) & np.uint64((1 << length) - 1)) for k in range(parts)], axis=0)
        for radius in range(min(3, length)):
            many = parts * math.comb(length, radius)
            cost = many * rows * (MOVED + rows / 2 ** (length - radius) / 2)
            if many <= MOST and cost < best[0] and (least <= radius).mean() >= RECALL:
                best = (cost, (parts, radius))
    return np.zeros(1, dtype=np.uint64) if best[1] is None else masks_of(quantiser.bits, *best[1])


def unit_rows(column) -> np.ndarray:
    """Vectors of one length, from an Arrow list column, scaled to length 1."""
    x = np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked(table: int, unit: np.ndarray, codes: np.ndarray, copies: np.ndarray, side: np.ndarray, masks: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of a bucket (or two of its chunks: side 0 and 1): places with links, number of vectors linked, place of their tree's root."""
    two = side.any() and not side.all()
    a = np.flatnonzero(side == 0) if two else np.arange(len(unit))
    b = np.flatnonzero(side == 1) if two else a
    near = unit[a] @ unit[b].T >= threshold
    if not two:
        np.fill_diagonal(near, False)
    if not near.any():
        return []
    i, j = np.nonzero(near)
    for m in masks[:table]:
        fresh = ((codes[a[i]] ^ codes[b[j]]) & m) != 0
        near[i[~fresh], j[~fresh]] = False
        i, j = i[fresh], j[fresh]
    add = np.zeros(len(unit), dtype=np.int64)
    add[a] += near @ copies[b]
    if two:
        add[b] += near.T @ copies[a]
    root, at_a, at_b = np.full(len(unit), -1), {int(x): k for k, x in enumerate(a)}, {int(x): k for k, x in enumerate(b)} if two else {}
    for start in np.flatnonzero(add).tolist():
        wave = [start] if root[start] < 0 else []
        root[start] = start if wave else root[start]
        while wave:
            x = wave.pop()
            near_x = b[near[at_a[x]]] if x in at_a else a[near[:, at_b[x]]]
            new = near_x[root[near_x] < 0]
            root[new] = start
            wave += new.tolist()
    some = np.flatnonzero(add)
    return [(some, add[some], root[some])]


def neighbours(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, exact: bool = False) -> DataFrame:
    """Rows (key, n_links, component_id, kept) for every row of vectors. exact: compare all pairs, whatever the codes."""
    v = F.col("v")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"  # floats are moved as floats
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast(kind).alias("v")).withColumn("sound", F.coalesce(sound, F.lit(False)))
    classes = cut(rows.where("sound").groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()).withColumn("d", F.size("v")), "vectors")
    found = None
    for r in classes.groupBy("d").count().collect():  # a row for each number of components
        part = _links(classes.where(F.col("d") == r.d), r["count"], threshold, exact)
        found = part if found is None else found.union(part)
    if found is None:
        named = classes.select("node", "v", "copies", F.col("least").alias("component"), F.lit(0).cast("long").alias("links"))
    else:
        found = cut(found, "links")
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        tree = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).join(classes.select(F.col("node").alias("n"), "least"), F.col("node") == F.col("n")).select("node", F.col("component").alias("root"), "least")
        least = tree.groupBy("root").agg(F.min("least").alias("smallest"))
        tree = tree.join(least, "root").select("node", "smallest", F.lit(True).alias("joined"))
        named = classes.join(links, "node", "left").join(tree, "node", "left").select("v", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.when(F.col("joined"), F.col("smallest")).otherwise(F.col("least")).alias("component"))
    whole = rows.where("sound").join(named.select(F.col("v").alias("w"), "links", "copies", "component"), F.col("v") == F.col("w")).select("id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where(~F.col("sound")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return whole.union(alone).select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _links(classes: DataFrame, n: int, threshold: float, exact: bool) -> DataFrame:
    """Rows (node, links, root) of every bucket."""
    spark = classes.sparkSession
    sample = np.array([np.asarray(r.v, dtype=float) for r in classes.orderBy(F.xxhash64("v")).limit(SAMPLE).select("v").collect()])
    sample = sample / np.abs(sample).max(axis=1, keepdims=True)
    sample = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    held = np.arange(len(sample)) % 4 == 3 if len(sample) >= 64 else np.ones(len(sample), dtype=bool)
    quantiser = Quantiser(sample[~held] if not held.all() else sample)
    masks = np.zeros(1, dtype=np.uint64) if exact else tables(quantiser, sample[held], n, threshold)  # the codes fit rows better that they were fitted on
    sent = spark.sparkContext.broadcast((quantiser, masks))
    coded_type = T.StructType([classes.schema[c] for c in ("node", "copies", "v")] + [T.StructField("code", T.LongType())])

    def make():
        q, _ = sent.value

        def step(batch):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(q.codes(unit_rows(batch.column(2))).view(np.int64))], names=["node", "copies", "v", "code"])

        return step

    coded = cut(map_batches(classes.select("node", "copies", "v"), coded_type, make), "codes")
    keyed = coded.select("*", F.posexplode(F.array(*[F.col("code").bitwiseAND(F.lit(int(m)).cast("long")) for m in masks.view(np.int64)])).alias("t", "key"))
    large = keyed.groupBy("t", "key").count().where(F.col("count") > CHUNK).select("t", "key", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    dealt = keyed.join(large, ["t", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    dealt = dealt.withColumn("side", F.when(F.col("i") == F.col("j"), 0).otherwise((F.col("own") == F.col("j")).cast("int")))
    groups = max(64, n * len(masks) // GROUP)
    dealt = dealt.withColumn("g", F.pmod(F.xxhash64("t", "key", "i", "j"), F.lit(groups)))

    def compare(table: pa.Table) -> pa.Table:
        masks = sent.value[1]
        t, k, i, j, side, node, code, copies = (table.column(c).to_numpy() for c in ("t", "key", "i", "j", "side", "node", "code", "copies"))
        order = np.lexsort((j, i, k, t))
        same = np.flatnonzero((np.diff(t[order]) != 0) | (np.diff(k[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
        unit = unit_rows(table.column("v").combine_chunks())
        out = []
        for part in np.split(order, same):
            if len(part) > 1:
                p = part[np.argsort(node[part])]
                out += [(node[p[x]], add, node[p[r]]) for x, add, r in linked(int(t[p[0]]), unit[p], code[p].view(np.uint64), copies[p], side[p], masks, threshold)]
        return pa.table({"node": np.concatenate([o[0] for o in out]), "links": np.concatenate([o[1] for o in out]), "root": np.concatenate([o[2] for o in out])} if out else {c: np.zeros(0, dtype=np.int64) for c in ("node", "links", "root")})

    return dealt.select("g", "t", "key", "i", "j", "side", "node", "code", "copies", "v").groupBy("g").applyInArrow(compare, "node long, links long, root long")


def op3_iterative_quantisation(spark, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL_3 = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
