"""Dataset catalog: listing, storage statistics, rollups, backups."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SourceError
from ..functions.text import human_size

#: File names that are no data.
NOT_DATA = (
    "meta.json", "dataset_info.json", "dataset_infos.json",
    "state.json", "dataset_dict.json", "merge_meta.json",
    "extract_meta.json", "config.json", "tokenizer.json",
    "added_tokens.json", "special_tokens_map.json",
    "readme.md", "license", "license.txt", "checkpoint.json",
    "checkpoint.json.tmp",
)
FIRST = (".arrow", ".parquet")
OTHER = (".jsonl", ".json", ".csv", ".tsv", ".txt")
_ROWS = "path string, modified timestamp, size long"


def files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, modified, size) of all files below a path, from the listing alone."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def data_files(listing: DataFrame) -> DataFrame:
    """Data files in order of path: hidden files, logs and metadata are left out; if there are any Arrow or Parquet files, only those count."""
    name = F.lower(F.substring_index("path", "/", -1))
    kind = F.concat(F.lit("."), F.substring_index(name, ".", -1))
    kept = listing.where(~name.startswith(".") & ~name.isin(*NOT_DATA) & kind.isin(*FIRST, *OTHER)).withColumn("first", kind.isin(*FIRST))
    any_ = kept.agg(F.coalesce(F.max(F.col("first").cast("int")), F.lit(0)).alias("any"))
    return kept.withColumn("k", F.lit(1)).join(any_.withColumn("k", F.lit(1)), "k").where(F.col("first") | (F.col("any") == 0)).select(*listing.columns).orderBy("path")


def catalog(listing: DataFrame, root: str, data_type: str, most: int | None = None) -> DataFrame:
    """Rows (name, path, relative_path, type, format, size, size_mb, size_human, modified_time), newest first."""
    name = F.substring_index("path", "/", -1)
    out = listing.select(name.alias("name"), "path", F.substring_index("path", root.rstrip("/") + "/", -1).alias("relative_path"), F.lit(data_type).alias("type"), F.lower(F.substring_index(name, ".", -1)).alias("format"), "size", F.round(F.col("size") / 1048576, 2).alias("size_mb"), human_size(F.col("size").cast("double"), "0B").alias("size_human"), F.col("modified").alias("modified_time"))
    out = out.orderBy(F.desc("modified_time"), "path")
    return out if most is None else out.limit(most)


def named(listing: DataFrame, part: str) -> DataFrame:
    """Files whose name or path holds a text, in any case."""
    return listing.where(F.contains(F.lower("name"), F.lit(part.lower())) | F.contains(F.lower("path"), F.lit(part.lower())))


def reconciled(tasks: DataFrame, folders: DataFrame, key: str) -> DataFrame:
    """Folders that no task names (both have the column `key`), as completed tasks to be added to the log."""
    return folders.select(key).distinct().join(tasks.select(key), key, "left_anti").withColumn("status", F.lit("completed"))


def storage_stats(df: DataFrame, by: str, size: str) -> DataFrame:
    """Rows (group, size, count, percentage of all bytes); the total is a second aggregate of the groups."""
    groups = df.groupBy(F.col(by).alias("grp")).agg(F.sum(size).alias("size"), F.count("*").alias("count"))
    total = groups.agg(F.sum("size").alias("total")).withColumn("k", F.lit(1))
    return groups.withColumn("k", F.lit(1)).join(total, "k").select("grp", "size", "count", F.when(F.col("total") > 0, F.round(100.0 * F.col("size") / F.col("total"), 2)).otherwise(0.0).alias("percentage"))


def rollup(df: DataFrame, outer: str, inner: str, size: str, time_: str | None = None) -> DataFrame:
    """Files, bytes and latest time for each inner group, with a subtotal row (null inner) for each outer group."""
    aggs = [F.count("*").alias("file_count"), F.sum(size).alias("total_size")] + ([F.max(time_).alias("latest")] if time_ else [])
    return df.rollup(outer, inner).agg(F.grouping_id().alias("level"), *aggs).where("level < 3").drop("level")


def summary(df: DataFrame, file: str, format_: str, size: str) -> DataFrame:
    return df.agg(F.count_distinct(file).alias("file_count"), F.array_sort(F.collect_set(format_)).alias("formats"), F.coalesce(F.sum(size), F.lit(0)).alias("total_size"))


def hashes(spark: SparkSession, path: str, algorithm: str = "md5") -> DataFrame:
    """Rows (path, hash) of files, computed where the files are read."""
    make = {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256)}[algorithm]
    return spark.read.format("binaryFile").load(path).select("path", make("content").alias("hash"))


def _sha256(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def backup(paths: list[str], root: str, name: str | None = None) -> Path:
    """Copy local files below root/name with a manifest; returns the folder. Files keep their places below their common folder, so equal names do not meet."""
    to = Path(root) / (name or time.strftime("backup_%Y%m%d_%H%M%S"))
    given = [Path(p).absolute() for p in dict.fromkeys(map(str, paths))]
    for p in given:
        if not p.is_file():
            raise SourceError(f"no file {p}")
    common = Path(os.path.commonpath([p.parent for p in given])) if given else Path()
    to.mkdir(parents=True, exist_ok=False)
    rows = []
    for p in given:
        copy = to / "files" / p.relative_to(common)
        copy.parent.mkdir(parents=True, exist_ok=True)
        shutil.copy2(p, copy)
        rows.append({"source": str(p), "file": str(p.relative_to(common)), "size": p.stat().st_size, "sha256": _sha256(copy)})
    (to / "manifest.json").write_text(json.dumps({"backup_id": to.name, "created": time.strftime("%Y-%m-%dT%H:%M:%S"), "files": rows}, ensure_ascii=False, indent=2), encoding="utf-8")
    return to


def restore(folder: str, target: str | None = None) -> list[Path]:
    """Copy a backup's files back, to where they came from or below target, after all their hashes are checked."""
    rows = json.loads((Path(folder) / "manifest.json").read_text(encoding="utf-8"))["files"]
    for row in rows:
        if _sha256(Path(folder) / "files" / row["file"]) != row["sha256"]:
            raise SourceError(f"{row['file']} differs from its manifest")
    out = []
    for row in rows:
        to = Path(target) / row["file"] if target else Path(row["source"])
        to.parent.mkdir(parents=True, exist_ok=True)
        shutil.copy2(Path(folder) / "files" / row["file"], to)
        out.append(to)
    return out


def delete_backup(folder: str) -> None:
    """Delete a backup; a folder without a manifest is none."""
    if not (Path(folder) / "manifest.json").is_file():
        raise SourceError(f"no backup {folder}")
    shutil.rmtree(folder)


def backups(spark: SparkSession, root: str) -> DataFrame:
    """Rows (backup_id, created, files, size), newest first."""
    found = spark.read.option("multiLine", "true").schema("backup_id string, created string, files array<struct<source:string,file:string,size:long,sha256:string>>").json(f"{root}/*/manifest.json")
    return found.select("backup_id", "created", F.size("files").alias("files"), F.aggregate("files", F.lit(0).cast("long"), lambda a, x: a + x.size).alias("size")).orderBy(F.desc("created"))
