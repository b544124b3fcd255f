"""Keyword search over datasets, limits and quotas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .predicates import matches

PER_FILE, STOP = 50, 1000


def search(datasets: dict[str, DataFrame], keyword: str, fields: list[str] | None = None, order_by: dict[str, str] | None = None, per_file: int = PER_FILE, stop: int = STOP) -> DataFrame:
    """Rows (dataset, line_number, record as JSON): the first `per_file` matches of each dataset, datasets in order until `stop` rows are reached.

    line_number is the row's place in the dataset by its order column (or as read). A dataset's matches are cut by a sorted limit, which keeps
    `per_file` rows a task; no dataset is sorted as a whole.
    """
    parts = []
    for i, (name, df) in enumerate(datasets.items()):
        order = F.col((order_by or {})[name]) if name in (order_by or {}) else F.monotonically_increasing_id()
        hit = df.where(matches(df, keyword, fields)).select(F.lit(i).alias("d"), F.lit(name).alias("dataset"), order.cast("long").alias("line_number"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("record"))
        parts.append(hit.orderBy("line_number").limit(per_file))
    found = reduce(DataFrame.union, parts)
    before = found.groupBy("d").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)))
    return found.join(before.where(F.coalesce("before", F.lit(0)) < stop).select("d"), "d").drop("d")


def head(df: DataFrame, n: int, order_by: str) -> DataFrame:
    return df.orderBy(order_by).limit(n)


def top(df: DataFrame, by: str, n: int = 10, tie: str | None = None) -> DataFrame:
    return df.orderBy(F.desc(by), *([tie] if tie else [])).limit(n)


def quota(files: int, max_rows: int) -> int:
    """Rows that a directory preview reads of each file."""
    return max(10, int(1.2 * max(1, max_rows // max(1, files))))


def preview_files(df: DataFrame, file: str, order_by: str, max_rows: int = 100, max_files: int = 10) -> DataFrame:
    """The first rows of each of the first files, by quota, cut to max_rows in order of file and row."""
    files = [r[0] for r in df.select(file).distinct().orderBy(file).limit(max_files).collect()]
    each = quota(len(files), max_rows)
    parts = [df.where(F.col(file).eqNullSafe(f)).orderBy(order_by).limit(each) for f in files]
    return reduce(DataFrame.union, parts).orderBy(file, order_by).limit(max_rows) if parts else df.limit(0)
