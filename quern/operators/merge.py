"""Merging datasets: union by name, append, and dedup by key or by whole row across inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ParameterError, SchemaMismatch


def compare(base: DataFrame, *others: DataFrame, ordered: bool = False) -> list[dict]:
    """For each other input: only_in_base, only_in_current, and whether it fits (as a set of names, or as a list if ordered)."""
    out = []
    for df in others:
        fits = df.columns == base.columns if ordered else set(df.columns) == set(base.columns)
        out.append({"fits": fits, "only_in_base": sorted(set(base.columns) - set(df.columns)), "only_in_current": sorted(set(df.columns) - set(base.columns))})
    return out


def _checked(dfs: list[DataFrame], ordered: bool) -> None:
    if not dfs:
        raise ParameterError("nothing to merge")
    for i, told in enumerate(compare(dfs[0], *dfs[1:], ordered=ordered), 1):
        if not told["fits"]:
            raise SchemaMismatch(f"input {i}: {told}")


def merge(dfs: list[DataFrame], shuffle_seed: int | None = None) -> DataFrame:
    """All rows of inputs with equal sets of names; in a random order of the given seed if one is given."""
    _checked(dfs, False)
    out = reduce(lambda a, b: a.unionByName(b), dfs)
    return out if shuffle_seed is None else out.orderBy(F.rand(shuffle_seed))


def append(base: DataFrame, *more: DataFrame) -> DataFrame:
    """Rows of `more` after those of base; names must be the same list."""
    _checked([base, *more], True)
    return reduce(DataFrame.unionByName, more, base)


def numbered(dfs: list[DataFrame], order_by: str | None = None) -> DataFrame:
    """The union with __place__: number of the input, then order within it. Read it once: rows without an order column are numbered as they come."""
    _checked(dfs, False)
    order = F.col(order_by) if order_by else F.monotonically_increasing_id()
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn("__place__", F.struct(F.lit(i).alias("input"), order.alias("at"), F.monotonically_increasing_id().alias("row"))) for i, df in enumerate(dfs)])


def dedup_key(dfs: list[DataFrame], field: str, keep: str = "first", order_by: str | None = None) -> DataFrame:
    """The first (or last) row of each key over all inputs; null keys are one key.

    An aggregate holds the whole row and its place, and combines before the shuffle; no row is looked up again by its number.
    """
    if keep not in ("first", "last"):
        raise ParameterError(f"keep: {keep}")
    rows = numbered(dfs, order_by)
    if field not in rows.columns:
        raise ParameterError(f"no field {field}")
    whole = F.struct(*[F.col(f"`{c}`") for c in dfs[0].columns])
    best = rows.groupBy(F.col(f"`{field}`").alias("__key__")).agg((F.min_by if keep == "first" else F.max_by)(whole, F.col("__place__")).alias("__row__"))
    return best.select("__row__.*")


def dedup_rows(dfs: list[DataFrame]) -> DataFrame:
    """Distinct whole rows, nested values included; names in any order."""
    return merge(dfs).distinct()


def counters(inputs: list[DataFrame], output: DataFrame) -> DataFrame:
    """One row: input_rows, output_rows, duplicate_rows, retention in per cent."""
    given = reduce(lambda a, b: a.union(b), [df.select(F.lit(1).alias("side")) for df in inputs])
    both = given.union(output.select(F.lit(0)))
    n_in, n_out = F.sum("side"), F.count_if(F.col("side") == 0)
    return both.agg(F.coalesce(n_in, F.lit(0)).alias("input_rows"), n_out.alias("output_rows"), (F.coalesce(n_in, F.lit(0)) - n_out).alias("duplicate_rows"), F.when(n_in > 0, F.round(100.0 * n_out / n_in, 2)).otherwise(0.0).alias("retention"))


def info_text(names: list[str], input_rows: int, output_rows: int, fields: list[str], dedup: str = "none") -> str:
    """What a merge did, for people."""
    kept = round(100.0 * output_rows / input_rows, 2) if input_rows else 0.0
    lines = [f"inputs: {len(names)} ({', '.join(names)})", f"dedup: {dedup}", f"rows read: {input_rows}", f"rows written: {output_rows}", f"duplicates removed: {input_rows - output_rows}", f"kept: {kept} %", f"fields: {', '.join(fields)}"]
    return "\n".join(lines) + "\n"


def target_name(names: list[str]) -> str:
    return "merged_" + "_".join(names) if len(names) <= 3 else f"{names[0]}_and_{len(names) - 1}_others"


def unprocessed(items: DataFrame, done: DataFrame, *, id_field: str = "id", question: Column | None = None) -> DataFrame:
    """Items whose signature is not among those of done (a column `signature`)."""
    return items.withColumn("signature", signature(items, id_field, question)).join(done.select("signature").distinct(), "signature", "left_anti").drop("signature")


def signature(items: DataFrame, id_field: str = "id", question: Column | None = None) -> Column:
    """The id, else the md5 of the question, else the md5 of the row as JSON."""
    options = [F.col(f"`{id_field}`").cast("string")] if id_field in items.columns else []
    if question is not None:
        options.append(F.md5(question))
    return F.coalesce(*options, F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in items.columns]), {"ignoreNullFields": "false"})))
