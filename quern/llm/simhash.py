"""SimHash near-duplicates over vantage-point trees.

A text's fingerprint has 64 bits: bit b is set if it is set in over half of the XXH64 hashes (seed 42) of its word
shingles, repeats included. Texts link if their fingerprints differ in at most `distance` bits.

Search: two fingerprints within distance d agree within d // 2 on one of their 32-bit halves, so there is one
vantage-point tree for each half, with radius d // 2. Its top is built on the driver from a bounded sample of distinct
fingerprints (only its shape depends on the sample; every fingerprint is placed). Each fingerprint has one home leaf and
also visits every leaf that the triangle bound cannot exclude (distance to the vantage point within the radius of the
border). A leaf is one shard. While a shard is home to more than SPLIT fingerprints, it is split by a vantage point of its own, chosen and
placed by aggregates over the shard (split()), so trees grow as deep as the corpus asks. A shard splits further in memory by
the same rule, then compares its homes with all that came; one that many fingerprints share, being alike in this half, splits by whole
fingerprints. A shard returns a forest of its links (each point once, to the point that reached it first), never
all pairs of a group. Copies fall together before the search, as one fingerprint. Components come from the forests.

Results: nulls and blank texts have no words; their fingerprint is zero and links like any other. component_id is the
smallest non-null doc_id reachable (null if there is none). Ties: none, equal fingerprints are one node. An empty table
gives no rows. Repeated rows are returned as often as they come. Long texts are hashed whole, in blocks. Columns of docs other than key and text
play no part in classes() and stay in keep_one(), whatever their names.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut, map_batches

SAMPLE = 1 << 15
#: Distinct fingerprints at home in a shard, about; the sample bounds the number of shards that the driver makes.
SHARD = 2048
#: A shard with more homes than this is split again by a pass over the routed fingerprints.
SPLIT = 1 << 15
#: A shard with more homes than this splits again in memory.
LOCAL = 1024
#: Rows to drop that are sent to every task at most; beyond that they are joined by shuffle.
FEW = 1 << 20


def hashes(raw: bytes, shingle: int = 3) -> np.ndarray:
    """XXH64 of all shingles in their order, repeats included; of the whole sequence of words if there are fewer."""
    import xxhash

    w = raw.lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    pieces = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) >= shingle else iter([b" ".join(w)])
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), pieces), dtype=np.uint64, count=max(1, len(w) - shingle + 1))


def bits_of(found: np.ndarray) -> int:
    """The fingerprint: bits that are set in over half of the hashes."""
    if not len(found):
        return 0
    ones = sum(np.unpackbits(found[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for at in range(0, len(found), 65536))
    return int(np.packbits(2 * ones > len(found), bitorder="little").view(np.uint64)[0])


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    return bits_of(hashes(raw, shingle))


class Tree:
    """Inner nodes: vantage point, border, inside child, outside child; children below zero are leaves -1 - leaf."""

    def __init__(self, values: np.ndarray, radius: int, leaves: int, seed: int = 7):
        self.radius, self.nodes, self.leaves = radius, [], 0
        self.root = self._grow(np.unique(values), leaves, np.random.default_rng(seed))

    def _grow(self, values: np.ndarray, leaves: int, rng) -> int:
        best = None
        if leaves > 1 and len(values) > 1:
            for v in values[rng.integers(0, len(values), 12)]:
                count = np.bincount(np.bitwise_count(values ^ v), minlength=66)
                inside = np.cumsum(count) / len(values)
                for mu in np.flatnonzero((inside >= 0.3) & (inside <= 0.7)):
                    border = count[max(0, mu - self.radius + 1) : mu + self.radius + 1].sum() / len(values)
                    cost = border + abs(inside[mu] - 0.5)
                    if best is None or cost < best[0]:
                        best = (cost, v, int(mu))
        if best is None:
            self.leaves += 1
            return -self.leaves
        _, v, mu = best
        inside = np.bitwise_count(values ^ v) <= mu
        at = len(self.nodes)
        self.nodes.append(None)
        self.nodes[at] = (v, mu, self._grow(values[inside], leaves // 2, rng), self._grow(values[~inside], leaves - leaves // 2, rng))
        return at

    def route(self, values: np.ndarray, home: np.ndarray):
        """For each leaf that some value reaches: (leaf, places in values, which of them are at home there)."""
        stack = [(self.root, np.arange(len(values)), home)]
        while stack:
            node, at, own = stack.pop()
            if node < 0:
                if len(at):
                    yield -1 - node, at, own
                continue
            v, mu, inner, outer = self.nodes[node]
            d = np.bitwise_count(values[at] ^ v).astype(np.int64)
            for child, there, mine in ((inner, d - self.radius <= mu, d <= mu), (outer, d + self.radius > mu, d > mu)):
                stack.append((child, at[there], (own & mine)[there]))


def half(full: np.ndarray, k: int) -> np.ndarray:
    return (full >> np.uint64(32 * k)) & np.uint64(0xFFFFFFFF)


def forest(full: np.ndarray, home: np.ndarray, distance: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span what the links of homes with all points connect: pairs of arrays of places."""
    for own, radius in ((half(full, k), distance // 2), (full, distance)) if home.sum() > LOCAL else ():
        tree = Tree(own[home], radius, max(2, int(home.sum()) // (LOCAL // 4)))
        if tree.leaves > 1:
            out = []
            for _, at, mine in tree.route(own, home):
                if mine.any():
                    out += [(at[a], at[b]) for a, b in flat(full[at], mine, distance)]
            return out
    return flat(full, home, distance)


def flat(full: np.ndarray, home: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """As forest(), by search from each home that nothing has reached yet; a point that is reached leaves the search."""
    homes, guests = np.flatnonzero(home), np.flatnonzero(~home)
    out = []
    while len(homes):
        wave, homes = homes[:1], homes[1:]
        while len(wave):
            p, wave = wave[0], wave[1:]
            near = np.bitwise_count(full[homes] ^ full[p]) <= distance
            found, homes = homes[near], homes[~near]
            if home[p]:
                near = np.bitwise_count(full[guests] ^ full[p]) <= distance
                found, guests = np.concatenate([found, guests[near]]), guests[~near]
            if len(found):
                out.append((np.full(len(found), p), found))
                wave = np.concatenate([wave, found])
    return out


def links(prints: DataFrame, column: str, distance: int = 3) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (longs) that have the components of all pairs within `distance`."""
    spark = prints.sparkSession
    sample = np.array([r[0] for r in prints.orderBy(F.xxhash64(column)).limit(SAMPLE).select(column).collect()], dtype=np.int64).view(np.uint64)
    n = prints.count()
    leaves = 1 << max(6, min(13, (max(1, n // SHARD) - 1).bit_length()))
    sent = spark.sparkContext.broadcast([Tree(half(sample, k), distance // 2, leaves) for k in (0, 1)])

    def make():
        trees = sent.value

        def step(batch):
            full = np.asarray(batch.column(0)).view(np.uint64)
            for k, tree in enumerate(trees):
                got = list(tree.route(half(full, k), np.ones(len(full), dtype=bool)))
                if got:
                    yield {"shard": np.concatenate([np.full(len(at), 2 * leaf + k) for leaf, at, _ in got]), "f": np.concatenate([full[at] for _, at, _ in got]).view(np.int64), "home": np.concatenate([own for _, _, own in got])}

        return step

    def search(table: pa.Table) -> pa.Table:
        full, home = table.column("f").to_numpy().view(np.uint64), table.column("home").to_numpy()
        order = np.argsort(full, kind="stable")
        full, home = full[order], home[order]
        got = forest(full, home, distance, int(table.column("shard")[0].as_py()) & 1)
        a, b = (np.concatenate([x[i] for x in got]) if got else np.zeros(0, dtype=np.int64) for i in (0, 1))
        return pa.table({"a": full[a].view(np.int64), "b": full[b].view(np.int64)})

    routed = map_batches(prints.select(column), "shard long, f long, home boolean", make)
    if n > SPLIT:  # else no shard can be too large
        routed = split(cut(routed, "routed"), distance // 2)
    return routed.groupBy("shard").applyInArrow(search, "a long, b long")


def split(routed: DataFrame, radius: int, most: int = 40) -> DataFrame:
    """routed (shard, f, home) with every shard over SPLIT homes split in two, again and again: by the distance to one of its own homes, at
    the border that few visit from both sides. A shard whose halves are all alike stays, and splits in memory. New shards are
    named by a hash; should two names be equal, their fingerprints are searched together, which finds the same links."""
    own = F.when(F.col("shard") % 2 == 0, F.col("f").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("f", 32))
    far = F.bit_count(own.bitwiseXOR(F.col("v"))).alias("d")
    for turn in range(most):
        homes = routed.where("home").groupBy("shard").agg(F.count("*").alias("n"), F.min_by(own, F.xxhash64("f", F.lit(turn))).alias("v"))
        large = cut(homes.where(F.col("n") > SPLIT).withColumnRenamed("shard", "s"), "large")
        if not large.limit(1).count():
            break
        counts = routed.where("home").join(large, F.col("shard") == F.col("s")).select("s", "v", "n", far).groupBy("s", "v", "n", "d").count()
        border = counts.groupBy("s", "v", "n").agg(F.collect_list(F.struct("d", "count")).alias("h"))  # 33 distances at most
        sums = lambda low, high: F.aggregate(F.filter("h", lambda x: (x.d > low) & (x.d <= high)), F.lit(0).cast("long"), lambda acc, x: acc + x["count"])
        cost = lambda mu: F.struct((sums(mu - radius, mu + radius) / F.col("n") + F.abs(sums(F.lit(-1), mu) / F.col("n") - 0.5)).alias("cost"), mu.alias("mu"), sums(F.lit(-1), mu).alias("inside"))
        costs = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), cost), lambda x: (x.inside > 0) & (x.inside < F.col("n")))
        border = cut(border.select("s", "v", F.array_min(costs).alias("best")).where("best IS NOT NULL").select("s", "v", F.col("best.mu").alias("mu")), "borders")
        if not border.limit(1).count():
            break
        placed = routed.join(border, F.col("shard") == F.col("s"), "left").select("shard", "f", "home", "v", "mu", far)
        name = lambda side: F.shiftleft(F.xxhash64("shard", F.lit(turn), F.lit(side)).bitwiseAND(F.lit((1 << 60) - 1)), 1) + F.col("shard") % 2
        side = lambda k, near, mine: F.when(near, F.array(F.struct(name(k).alias("shard"), F.col("f"), (F.col("home") & mine).alias("home")))).otherwise(F.array())
        d, mu = F.col("d"), F.col("mu")
        both = F.concat(side(0, d - radius <= mu, d <= mu), side(1, d + radius > mu, d > mu))
        routed = cut(placed.select(F.explode(F.when(F.col("v").isNull(), F.array(F.struct("shard", "f", "home"))).otherwise(both)).alias("x")).select("x.*"), "routed")
    return routed


def classes(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 3, distance: int = 3, row: str | None = None) -> DataFrame:
    """Rows (key, fingerprint as 16 hex digits, component_id) for every row of docs. row: as near_text.classes() takes it; not needed here."""
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("k", kind), T.StructField("f", T.LongType())])

    def make():
        def step(batch):
            prints = np.array([fingerprint(t or b"", shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["k", "f"])

        return step

    rows = cut(map_batches(docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")), schema, make), "prints")
    one = cut(rows.groupBy("f").agg(F.min("k").alias("least")), "distinct")
    linked = components(links(one, "f", distance)).join(one, F.col("node") == F.col("f")).select("f", "component", "least")
    least = linked.groupBy("component").agg(F.min("least").alias("id"))
    named = one.join(linked.join(least, "component").select("f", "id", F.lit(True).alias("found")), "f", "left").select("f", F.when(F.col("found"), F.col("id")).otherwise(F.col("least")).alias("component_id"))
    named = cut(named, "named")  # then both sides of the join below are plain shuffles, and rows of a hot fingerprint may be split
    return rows.join(named, "f").select(F.col("k").alias(key), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, text: str = "text", key: str = "doc_id", by=classes, **how) -> DataFrame:
    """docs without near-duplicates: of each class (as told by `by`) one row stays, that with the smallest key; a row without a key comes after
    all others. Rows are told apart by numbers of their own, so rows that share a key but not a class are judged each on its own, and of rows
    that are alike in key and class one stays. Columns and their names do not matter; the columns of docs return as they are."""
    row = next(f"__row{k}__" for k in range(len(docs.columns) + 1) if f"__row{k}__" not in docs.columns)
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "rows")  # numbered once, so the numbers hold
    told = F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), F.col(row).alias("row"))
    found = by(rows.select(told.alias("k"), F.col(text).alias("t"), F.col(row).alias("r")), text="t", key="k", row="r", **how)
    gone = cut(found.where(F.col("k.row") != F.col("component_id.row")).select(F.col("k.row").alias("__gone__")), "gone")
    few = gone.count() <= FEW
    return rows.join(F.broadcast(gone) if few else gone, F.col(row) == F.col("__gone__"), "left_anti").select(*docs.columns)


def op4_vantage_point(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
