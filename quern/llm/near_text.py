"""Near-duplicate texts: all pairs whose sets of word shingles have a Jaccard similarity of `least` or more.

A text's set holds the XXH64 hashes (seed 42) of its runs of `shingle` words (lower case, ASCII white space); a text of
fewer words has one run of them all, a text without words the empty set. Equal sets fall together first, as one node.

Search is exact (prefix filter): in any one order of all shingles, two sets of similarity t or more share LEVEL shingles among the first
n - ceil(t * n) + LEVEL of each (LEVEL is lowered where different sets of that similarity may share fewer). The order puts shingles that a
bounded sample of texts shows more than once last, so that common lines are in few prefixes; the sample decides the cost only. Sets that share
LEVEL shingles of their prefixes are candidates if their sizes and the places of these allow the similarity: two sets of n and m share o = t / (1 + t) * (n + m)
or more, so LEVEL lie among the first n - o + LEVEL of the one and m - o + LEVEL of the other. A set's outline is a row of OUTLINE bits, one flipped for each shingle; two
outlines differ in no more bits than the sets in shingles, so pairs whose outlines differ in more than n + m - 2 * o bits go as they meet. Candidates are
compared by their whole sets, computed from the texts, and once.

Large groups are joined before that: first by SimHash (simhash.links: fingerprints of the same shingles, all that differ in at most `distance` bits, by
vantage-point trees; their pairs count if the sets are similar), then by ROUNDS passes in which each shingle's sets are compared with two of
them: that with the fewest rarer shingles for its size, to which most of a group of near copies are similar, and any one. Then all candidates that are not yet in one
component are compared, so no list of all pairs of a group is made, and pairs that differ in more bits are found as well.

Results: component_id is the smallest non-null doc_id reachable (null if there is none). Ties: none, a similarity equal to
`least` links. An empty table gives no rows. Repeated rows are returned as often as they come. Hashes have 64 bits and stand for
their shingles and sets. Long texts are taken whole. Columns of docs other than key and text play no part.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import as_bytes, components, cut, ddl, map_batches

ROUNDS = 1
#: Shingles that similar sets share at the front.
LEVEL = 3
#: Bits of an outline, in longs.
OUTLINE = 512
#: Texts whose shingles a task keeps while it compares pairs.
HELD = 256
#: Nodes that a task remembers, so as to give the prefix of a set once.
SEEN = 1 << 18
#: Texts in the sample that finds common shingles, about, and how many of these are kept.
SAMPLE, COMMON = 16384, 1 << 17


def shingles(raw: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes."""
    return np.unique(simhash.hashes(raw, size))


def node_of(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), seed=42) - (1 << 63)


def level_of(least: Fraction) -> int:
    """LEVEL, or what different sets of this similarity share at the least."""
    return min(LEVEL, math.ceil(least / (1 - least))) if least < 1 else LEVEL


def prefix(hashes: np.ndarray, common: np.ndarray, times: np.ndarray, least: Fraction) -> np.ndarray:
    """The first shingles in the order (times seen in the sample, hash); common is sorted, times is aligned with it."""
    n = len(hashes)
    size = min(n, n - math.ceil(least * n) + level_of(least))
    seen = np.zeros(n, dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        seen = np.where(common[at] == hashes, times[at], 0)
    return hashes[np.lexsort((hashes, seen))[:size]]


_BITS = [f"o{i}" for i in range(OUTLINE // 64)]


def outline(hashes: np.ndarray) -> np.ndarray:
    """Longs whose bits tell which of OUTLINE classes of hashes hold an odd number of the given ones."""
    odd = np.bincount((hashes & np.uint64(OUTLINE - 1)).astype(np.int64), minlength=OUTLINE) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def classes(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 5, least: Fraction = Fraction(4, 5), distance: int = 3, row: str | None = None) -> DataFrame:
    """Rows (key, component_id) for every row of docs. row: a column that numbers the rows of a stored docs; without it docs are stored and numbered."""
    chosen = [F.col(key).alias("k"), as_bytes(F.col(text)).alias("t"), (F.monotonically_increasing_id() if row is None else F.col(row)).alias("row")]
    texts = docs.select(*chosen) if row else cut(docs.select(*chosen), "texts")
    sent = order_of(texts, shingle)
    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), *ddl("row long, node long, f long, n long, first array<long>, " + ", ".join(f"{x} long" for x in _BITS))])

    def make():
        (common, times), seen = sent.value, set()

        def step(batch):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                nodes, prints, sizes, firsts, outlines = [], [], [], [], []
                for t in part.column(1).to_pylist():
                    all_ = simhash.hashes(t, shingle)
                    own = np.unique(all_)
                    nodes.append(node_of(own))
                    prints.append(simhash.bits_of(all_))
                    sizes.append(len(own))
                    outlines.append(outline(own))
                    fresh = nodes[-1] not in seen
                    firsts.append(prefix(own, common, times, least).view(np.int64) if fresh else None)
                    if fresh and len(seen) < SEEN:
                        seen.add(nodes[-1])
                prints = np.array(prints, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(nodes, pa.int64()), pa.array(prints), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), *map(pa.array, np.array(outlines).T)], names=schema.names)

        return step

    sets = cut(map_batches(texts, schema, make), "sets")
    one = cut(sets.groupBy("node").agg(F.min("k").alias("least"), F.min("row").alias("first"), F.min("f").alias("f"), *[F.min(x).alias(x) for x in _BITS]), "distinct")
    entries = sets.where("first IS NOT NULL").select("node", "n", F.posexplode("first").alias("place", "h"))
    edges = pairs_of(one, entries, lambda pairs: compared(pairs, one, texts, shingle, least), least, distance)
    linked = components(edges).withColumnRenamed("node", "m").join(one, F.col("m") == F.col("node")).select("node", "component", "least")
    smallest = linked.groupBy("component").agg(F.min("least").alias("id"))
    named = one.select("node", "least").join(linked.join(smallest, "component").select("node", "id", F.lit(True).alias("found")), "node", "left").select("node", F.when(F.col("found"), F.col("id")).otherwise(F.col("least")).alias("component_id"))
    return sets.select("k", "node").join(cut(named, "named"), "node").select(F.col("k").alias(key), "component_id")


def order_of(texts: DataFrame, size: int):
    """Broadcast: shingles that occur more than once in the sample, sorted, and how often."""

    def every():
        seen = set()

        def step(batch):
            for t in batch.column(0).to_pylist():
                own = shingles(t, size)
                if (node := node_of(own)) not in seen:  # copies say nothing about how common a shingle is
                    if len(seen) < SEEN:
                        seen.add(node)
                    yield {"h": own.view(np.int64)}

        return step

    part = min(1.0, SAMPLE / max(1, texts.count()))
    some = texts.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < int(part * (1 << 20))).select("t")
    often = map_batches(some, "h long", every).groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(COMMON).collect()
    common, times = np.array([r.h for r in often], dtype=np.int64).view(np.uint64), np.array([r["count"] for r in often], dtype=np.int64)
    order = np.argsort(common)
    return texts.sparkSession.sparkContext.broadcast((common[order], times[order]))


def pairs_of(one: DataFrame, entries: DataFrame, near_ones, least: Fraction, distance: int) -> DataFrame:
    """Edges (a, b) between nodes that have the components of all pairs of similarity `least` or more. one: (node, f), outlines and more, a row a
    node; entries: (node, n, place, h), the prefixes; near_ones: of pairs those that are similar."""
    lead = cut(one.groupBy("f").agg(F.min("node").alias("node")), "prints")  # fingerprints are longs, as nodes are
    alike = one.join(lead.select(F.col("f").alias("g"), F.col("node").alias("b")), (F.col("f") == F.col("g")) & (F.col("node") != F.col("b"))).select(F.col("node").alias("a"), "b")
    trees = simhash.links(lead.select("f"), "f", distance)
    close = trees.join(lead.select(F.col("f").alias("a"), F.col("node").alias("x")), "a").join(lead.select(F.col("f").alias("b"), F.col("node").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    edges = cut(near_ones(cut(alike.union(close), "pairs")), "near")
    named = cut(components(edges).select(F.col("node").alias("of"), F.col("component").alias("c")), "joined")

    shared = entries.groupBy("h").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select(F.col("h").alias("s"))
    entries = cut(entries.join(shared, F.col("h") == F.col("s")).select("h", "node", "n", "place"), "shared")
    seen = edges.limit(0)
    fits = lambda n, m: (F.lit(least.denominator) * F.least(n, m) >= F.lit(least.numerator) * F.greatest(n, m))
    most = lambda n, m, left: F.lit(least.numerator) * (n + m) <= F.lit(least.numerator + least.denominator) * left  # may they share as many as `left`?
    n, m, level = F.col("n"), F.col("m"), level_of(least)
    for k in range(ROUNDS + 1):
        now = entries.join(named, F.col("node") == F.col("of"), "left").select("h", "node", "n", "place", F.coalesce("c", "node").alias("c"))
        one_of = F.struct("node", "n", "c")
        leads = F.array(F.min_by(one_of, F.struct(F.col("place") / n, F.xxhash64("node", F.lit(k)))), F.min_by(one_of, F.xxhash64("node", F.lit(k))))
        mixed = now.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high"), leads.alias("leads")).where("low < high").select(F.col("h").alias("s"), F.array_distinct("leads").alias("leads"))
        if k < ROUNDS:
            led = now.join(mixed, F.col("h") == F.col("s")).select("node", "n", "c", F.explode("leads").alias("lead")).where((F.col("c") != F.col("lead.c")) & fits(n, F.col("lead.n")))
            pairs = led.groupBy(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).count().where(F.col("count") >= level).select("a", "b")
        else:
            now = now.join(mixed.select("s"), F.col("h") == F.col("s")).drop("s")
            now = cut(now.join(one.select(F.col("node").alias("of"), *_BITS), F.col("node") == F.col("of")).drop("of"), "open")
            other = now.select(F.col("h").alias("g"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("place").alias("spot"), F.col("c").alias("d"), *[F.col(x).alias(f"{x}_") for x in _BITS])
            early = most(n, m, n - F.col("place") + (level - 1)) & most(n, m, m - F.col("spot") + (level - 1))
            apart = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"{x}_"))) for x in _BITS), F.lit(0))
            met = now.join(other, (F.col("h") == F.col("g")) & (F.col("node") < F.col("b")) & (F.col("c") != F.col("d")) & fits(n, m) & early & most(n, m, (n + m - apart) / 2))
            met = met.groupBy(F.col("node").alias("a"), "b", "n", "m").agg(F.count("*").alias("shared"), F.min("place").alias("place"), F.min("spot").alias("spot"))
            # the first shingle that two sets share in the order leaves at most what follows it in both
            enough = most(n, m, F.least(n - F.col("place"), m - F.col("spot")))
            pairs = met.where((F.col("shared") >= level) & enough).select("a", "b").join(seen, ["a", "b"], "left_anti")
        pairs = cut(pairs, "pairs")
        near = near_ones(pairs)
        seen = seen.union(pairs)
        edges = cut(edges.union(near), "near")
        if k < ROUNDS:
            named = cut(components(edges).select(F.col("node").alias("of"), F.col("component").alias("c")), "joined")
    return edges


def compared(pairs: DataFrame, one: DataFrame, texts: DataFrame, size: int, least: Fraction) -> DataFrame:
    """Of stored pairs (a, b) of nodes those of similarity `least` or more."""
    members = cut(one.join(pairs.select(F.explode(F.array("a", "b")).alias("x")).distinct(), F.col("node") == F.col("x")).select("node", F.col("first").alias("r")), "members")
    few = members.count() <= simhash.FEW
    mine = cut(texts.select("row", "t").join(F.broadcast(members) if few else members, F.col("row") == F.col("r")).select("node", "t"), "compared")
    both = pairs.join(mine.select(F.col("node").alias("i"), F.col("t").alias("ta")), F.col("a") == F.col("i")).join(mine.select(F.col("node").alias("j"), F.col("t").alias("tb")), F.col("b") == F.col("j"))

    def make():
        held: dict[int, np.ndarray] = {}

        def shown(node: int, text) -> np.ndarray:
            if node not in held:
                if len(held) >= HELD:
                    held.clear()
                held[node] = shingles(text.as_py(), size)
            return held[node]

        def step(batch):
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep = np.zeros(len(a), dtype=bool)
            for i in range(len(a)):
                x, y = shown(a[i], batch.column(2)[i]), shown(b[i], batch.column(3)[i])
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = least.denominator * same >= least.numerator * (len(x) + len(y) - same)
            yield {"a": a[keep], "b": b[keep]}

        return step

    return map_batches(both.select("a", "b", "ta", "tb"), "a long, b long", make)
