"""Format by name or by content, and text encoding, from the first bytes of a file that Spark reads."""

from __future__ import annotations

import codecs
import json

from pyspark.sql import SparkSession

#: Formats by suffix.
SUFFIXES = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".xlsx": "excel", ".xls": "excel", ".md": "markdown", ".markdown": "markdown", ".arrow": "arrow", ".feather": "arrow", ".parquet": "parquet", ".xml": "xml", ".txt": "text"}


def by_name(path: str) -> str | None:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    return next((f for s, f in SUFFIXES.items() if name.endswith(s)), None)


def by_content(first: bytes) -> str:
    """Format of a file of unknown name from its first bytes."""
    if b"\x00" in first:
        return "unknown"
    line = first.decode("utf-8", "replace").lstrip("﻿").strip().split("\n", 1)[0].strip()
    if line.startswith("{"):
        try:
            json.loads(line)
            return "jsonl"
        except ValueError:
            return "json"
    return "json" if line.startswith("[") else "csv" if "," in line else "tsv" if "\t" in line else "text"


def first_bytes(spark: SparkSession, path: str, n: int = 10_240) -> bytes:
    """Read by Hadoop's file system, so that any store Spark reads will do."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    size = min(n, fs.getFileStatus(at).getLen())
    stream = fs.open(at)
    try:
        return bytes(x & 0xFF for x in jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(size))) if size else b""
    finally:
        stream.close()


def detect(spark: SparkSession, path: str) -> str:
    named = by_name(path)
    if named in (None, "text"):
        try:
            told = by_content(first_bytes(spark, path))
        except Exception:  # a folder, or no such file: its reader will say so
            return named or "unknown"
        return told if named is None or told in ("jsonl", "csv") else named
    return named


def encoding(first: bytes) -> str:
    """By mark, else UTF-8 if the bytes are that, else the first of the usual ones that fits."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if first.startswith(mark):
            return name
    for name in ("utf-8", "gb18030", "windows-1252"):
        try:
            codecs.getincrementaldecoder(name)().decode(first)
            return name
        except UnicodeDecodeError:
            continue
    return "utf-8"
