"""Writers by format. All write folders of part files; single=True asks for one part, for small results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SourceError
from .tables import register


def _one(df: DataFrame, single: bool) -> DataFrame:
    return df.coalesce(1) if single else df


def _cell(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def _framed(lines: DataFrame, first: list[str], rest: str, last: list[str]) -> DataFrame:
    """Text lines (value) of every part: the lines `first`, then its own, each but the first with `rest` in front, then `last`. A part is streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda values: pa.RecordBatch.from_arrays([pa.array(values, pa.string())], names=["value"])
        begun = False
        if first:
            yield made(first)
        for batch in batches:
            values = batch.column(0).to_pylist()
            yield made([rest * (begun or i > 0) + v for i, v in enumerate(values)])
            begun = begun or bool(values)
        if last:
            yield made(last)

    return lines.mapInArrow(run, "value string")


def markdown_lines(df: DataFrame, header: bool = True) -> DataFrame:
    """Table lines (value); the header comes first in every part, so that each part is a table."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[_cell(c) for c in df.columns]), F.lit(" |"))
    body = df.select(row.alias("value"))
    return _framed(body, ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"], "", []) if header else body


def json_array(df: DataFrame) -> DataFrame:
    """Lines of a JSON array a part; a part is streamed and never held."""
    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))
    return _framed(rows, ["["], ",", ["]"])


def write(df: DataFrame, path: str, format: str, mode: str = "errorifexists", single: bool = False, **options) -> None:
    if format in ("csv", "tsv"):
        flat = df.select(*[F.col(f"`{c}`") if not k.startswith(("struct", "array", "map", "variant")) else F.to_json(F.col(f"`{c}`")).alias(c) for c, k in df.dtypes])
        _one(flat, single).write.mode(mode).options(header="true", sep="\t" if format == "tsv" else ",", escape='"', **options).csv(path)
    elif format == "jsonl":
        _one(df, single).write.mode(mode).options(ignoreNullFields="false", **options).json(path)
    elif format == "json":
        json_array(_one(df, single)).write.mode(mode).text(path)
    elif format == "markdown":
        markdown_lines(_one(df, single)).write.mode(mode).text(path)
    elif format == "parquet":
        _one(df, single).write.mode(mode).options(**options).parquet(path)
    elif format in ("excel", "arrow"):
        register(df.sparkSession)
        _one(df, single).write.format({"excel": "xlsx", "arrow": "arrow_ipc"}[format]).mode("append").options(**options).save(path)
    else:
        raise SourceError(f"no writer for {format}")


def info(df: DataFrame) -> DataFrame:
    """One row for a sidecar: row_count and fields."""
    return df.agg(F.count("*").alias("row_count")).withColumn("fields", F.array(*map(F.lit, df.columns)))
