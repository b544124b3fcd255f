"""Shared parts of the corpus operators: tables cut in shared storage, Arrow batches, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import cut


#: Nodes that a task holds while it contracts edges.
NODES = 1 << 20


def as_bytes(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit("")).cast("binary")


def map_batches(df: DataFrame, schema: str | T.StructType, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch | dict]]]) -> DataFrame:
    """mapInArrow where make() runs once a task and its result turns a batch into batches (or dicts of columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, to = make(), None
        for batch in batches:
            for out in step(batch):
                if isinstance(out, dict):
                    if to is None:
                        to = arrow_schema(schema)
                    out = pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in to], schema=to)
                yield out

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema if isinstance(schema, T.StructType) else ddl(schema))


def ddl(schema: str) -> T.StructType:
    """A small reader of "name type, ..." that needs no JVM, for use on executors."""
    kinds = {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "int": T.IntegerType(), "boolean": T.BooleanType()}
    kinds |= {f"array<{k}>": T.ArrayType(v) for k, v in kinds.items()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(","))])


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b), b < a, with the components of the given ones: in every task the edges it has become stars on their least node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, up = arrow_schema("a long, b long"), {}

        def root(x: int) -> int:
            top = x
            while (y := up.get(top, top)) != top:
                top = y
            while x != top:
                up[x], x = top, up.get(x, x)
            return top

        def stars() -> pa.RecordBatch:
            nodes = np.fromiter(up, dtype=np.int64, count=len(up))
            roots = np.array([root(x) for x in nodes.tolist()], dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], schema=schema)

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) > NODES:  # what is known so far goes out, so that a task's memory is bounded
                yield stars()
                up.clear()
        if up:
            yield stars()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component), component being the smallest node reachable.

    Tasks first contract the edges that they hold. Then large-star and small-star rounds alternate: each is a minimum per node (combined on
    the map side) and a join back; edges of a hub lie in a sort-merge join that AQE may split. Every round is a table in shared
    storage; it ends when a round leaves the set of edges as it was. Nodes without an edge to another are not returned.
    """

    def star(pairs: DataFrame, small: bool) -> DataFrame:
        both = pairs if small else pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("n", "m").alias("m")) if not small else both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        joined = both.join(least, F.col("a") == F.col("n"))
        if small:  # neighbours below the node, and the node itself, point to the least of them
            linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
        else:  # neighbours above the node point to the least of all
            linked = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return linked.where(F.col("a") != F.col("b")).distinct()

    now = cut(contracted(contracted(edges.where(F.col("a") != F.col("b"))).distinct()), "edges")
    sign = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = sign(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        now = cut(star(star(now, False), True), "edges")
        after = sign(now)
        if tuple(after) == tuple(before):
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
