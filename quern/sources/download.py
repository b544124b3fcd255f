"""Fetching files over HTTP with resume, and discovery of datasets that are already there."""

from __future__ import annotations

import shutil
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SourceError


def retry(f: Callable, attempts: int = 3, delay: float = 2.0, factor: float = 2.0, errors: tuple = (OSError,), sleep: Callable[[float], None] = time.sleep):
    """f() with pauses that grow between failures."""
    for k in range(attempts):
        try:
            return f()
        except errors:
            if k == attempts - 1:
                raise
            sleep(delay * factor**k)


def fetch(url: str, target: str, headers: dict[str, str] | None = None, attempts: int = 3, timeout: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Path:
    """Download to target by way of target.tmp; what is there of that file is kept and the rest asked for by range."""
    to = Path(target)
    part = to.with_name(to.name + ".tmp")
    to.parent.mkdir(parents=True, exist_ok=True)

    def once() -> None:
        have = part.stat().st_size if part.exists() else 0
        asked = urllib.request.Request(url, headers=(headers or {}) | ({"Range": f"bytes={have}-"} if have else {}))
        try:
            with urllib.request.urlopen(asked, timeout=timeout) as got, part.open("ab" if have and got.status == 206 else "wb") as f:
                shutil.copyfileobj(got, f, 1 << 20)
        except urllib.error.HTTPError as e:
            if e.code != 416:  # nothing is left to fetch
                raise SourceError(f"HTTP {e.code} for {url}") from e

    retry(once, attempts, sleep=sleep)
    part.replace(to)
    return to


def datasets(listing: DataFrame, root: str, splits: tuple[str, ...] = ("data", "dataset", "train", "test", "val")) -> DataFrame:
    """Rows (dataset, files, size) of the folders below root that hold data files, split folders counting as their parent's."""
    inner = F.split(F.substring_index("path", root.rstrip("/") + "/", -1), "/")
    folders = F.filter(F.slice(inner, F.lit(1), F.size(inner) - 1), lambda x: ~x.isin(*splits))
    named = listing.withColumn("dataset", F.array_join(folders, "/")).where(F.col("dataset") != "")
    return named.groupBy("dataset").agg(F.count("*").alias("files"), F.sum("size").alias("size")).orderBy("dataset")
