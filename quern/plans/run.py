"""Runs from path to path: convert, clean, extract, merge, preview; each returns its figures."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import merge as M
from ..operators import predicates as P
from ..operators import profile, project, search
from ..sources import read, write
from ..streaming import resume


@dataclass(frozen=True)
class Convert:
    source: str
    target: str
    target_format: str
    source_format: str | None = None
    text_fields: tuple[str, ...] = ()
    date_fields: tuple[str, ...] = ()
    skip_empty: bool = True
    clean_control: bool = True
    max_rows: int | None = None
    options: dict = field(default_factory=dict)


def convert(spark: SparkSession, spec: Convert) -> dict:
    df = read(spark, spec.source, spec.source_format, **spec.options)
    if spec.max_rows is not None:
        df = df.limit(spec.max_rows)
    if spec.skip_empty:
        df = P.skip_empty_rows(df)
    if spec.clean_control:
        df = project.clean_control(df)
    return _written(project.adapt_types(df, list(spec.text_fields), list(spec.date_fields)), spec.target, spec.target_format)


def _written(df: DataFrame, target: str, format_: str) -> dict:
    """Rows are counted as they are written, in the same pass."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")), target, format_)
    return {"rows": seen.get["rows"], "fields": df.columns, "target": target, "format": format_}


def sidecar(spark: SparkSession, target: str, told: dict) -> str:
    """Write the figures of a run beside its output, as <target>.meta.json, in whatever store that is; returns the path."""
    at = f"{target.rstrip('/')}.meta.json"
    text = json.dumps(told | {"created": time.strftime("%Y-%m-%dT%H:%M:%S")}, ensure_ascii=False, indent=2, default=str)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return at


def told(spark: SparkSession, target: str) -> dict:
    """What sidecar() wrote for a target."""
    return json.loads(spark.read.text(f"{target.rstrip('/')}.meta.json", wholetext=True).first()[0])


def row_count(df: DataFrame, limit: int | None = None) -> int:
    """Rows, or -1 where there are more than `limit`; no more than that are read."""
    if limit is None:
        return df.count()
    n = df.limit(limit + 1).count()
    return n if n <= limit else -1


def merge_named(spark: SparkSession, sources: list[str], folder: str, target_format: str, dedup_field: str | None = None) -> dict:
    """merge() into a folder named after its inputs, with a sidecar that holds figures and a text about them."""
    names = [s.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0] for s in sources]
    target = f"{folder.rstrip('/')}/{M.target_name(names)}"
    got = merge(spark, sources, target, target_format, dedup_field)
    got |= {"info": M.info_text(names, got["input_rows"], got["rows"], got["fields"], dedup_field or "none")}
    return got | {"meta": sidecar(spark, target, got)}


def extract_resumable(spark: SparkSession, spec: Extract, schema, checkpoint: str, files_per_batch: int = 1) -> DataFrame:
    """extract() over a folder of Parquet files in micro-batches; a run that was stopped goes on at the first batch that it has not committed."""
    stream = resume.files(spark, spec.source, schema, files_per_batch)
    step = lambda df: P.where(project.select_fields(df, list(spec.fields), spec.rename), spec.conditions, spec.logic)
    resume.once(stream, step, spec.target, checkpoint)
    return resume.result(spark, spec.target).drop("batch")


@dataclass(frozen=True)
class Extract:
    source: str
    target: str
    fields: tuple[str, ...]
    rename: dict[str, str] = field(default_factory=dict)
    conditions: tuple[P.Condition, ...] = ()
    logic: str = "and"
    source_format: str | None = None
    target_format: str = "jsonl"


def extract(spark: SparkSession, spec: Extract) -> dict:
    """Conditions see the chosen fields under their new names."""
    df = project.select_fields(read(spark, spec.source, spec.source_format), list(spec.fields), spec.rename)
    return _written(P.where(df, spec.conditions, spec.logic) if spec.conditions else df, spec.target, spec.target_format)


def clean(spark: SparkSession, source: str, target: str, spec: C.Clean, target_format: str = "jsonl", source_format: str | None = None) -> dict:
    df = read(spark, source, source_format)
    told = _written(C.clean(df, spec), target, target_format)
    n = df.count()
    return told | {"input_rows": n, "removed": n - told["rows"], "reduction_rate": round(100.0 * (n - told["rows"]) / n, 2) if n else 0.0}


def merge(spark: SparkSession, sources: list[str], target: str, target_format: str, dedup_field: str | None = None, dedup_all: bool = False, keep: str = "first", seed: int | None = None) -> dict:
    dfs = [read(spark, s) for s in sources]
    out = M.dedup_key(dfs, dedup_field, keep) if dedup_field else M.dedup_rows(dfs) if dedup_all else M.merge(dfs, seed)
    n = sum(df.count() for df in dfs)
    told = _written(out, target, target_format)
    return told | {"input_rows": n, "duplicate_rows": n - told["rows"], "retention": round(100.0 * told["rows"] / n, 2) if n else 0.0}


def preview(spark: SparkSession, path: str, max_rows: int = 100, max_text: int = 200, hide: bool = True, format: str | None = None) -> tuple[DataFrame, list[str]]:
    """The first rows with long texts cut, and the columns left out."""
    df = read(spark, path, format).limit(max_rows)
    hidden = profile.hidden_columns(df) if hide else []
    return project.truncated(df.drop(*hidden), max_text), hidden


def find(spark: SparkSession, paths: list[str], keyword: str, fields: list[str] | None = None) -> DataFrame:
    return search.search({p: read(spark, p) for p in paths}, keyword, fields)
