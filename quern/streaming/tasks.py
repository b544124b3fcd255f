"""Task log: states of runs in a JSON file on the driver, and statistics over them as DataFrames."""

from __future__ import annotations

import json
import threading
import uuid
from datetime import UTC, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ParameterError

STATUSES = ("pending", "running", "paused", "completed", "failed", "cancelled")
_SCHEMA = "task_id string, task_type string, task_subtype string, status string, progress double, created timestamp, started timestamp, ended timestamp, updated timestamp, error string"
#: Which states a task may be in before it is paused, resumed or cancelled.
_FROM = {"pause": ("running", "pending"), "resume": ("paused",), "cancel": ("pending", "running", "paused")}
_TO = {"pause": "paused", "resume": "running", "cancel": "cancelled"}


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds")


class TaskLog:
    """Every change is saved at once, to a new file that takes the old one's place."""

    def __init__(self, path: str):
        self.path, self.lock = Path(path), threading.Lock()
        self.tasks: dict[str, dict] = json.loads(self.path.read_text(encoding="utf-8")) if self.path.exists() else {}

    def _save(self) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        part = self.path.with_name(self.path.name + ".tmp")
        part.write_text(json.dumps(self.tasks, ensure_ascii=False, indent=2), encoding="utf-8")
        part.replace(self.path)

    def add(self, kind: str, subtype: str = "", params: dict | None = None, task_id: str | None = None) -> str:
        with self.lock:
            name = task_id or uuid.uuid4().hex
            if name in self.tasks:
                raise ParameterError(f"task {name} exists")
            at = _now()
            self.tasks[name] = {"task_id": name, "task_type": kind, "task_subtype": subtype, "status": "pending", "progress": 0.0, "params": json.loads(json.dumps(params or {})), "created": at, "started": None, "ended": None, "updated": at, "error": None, "result": None, "statistics": {}, "metadata": {}}
            self._save()
            return name

    def get(self, task_id: str) -> dict:
        if task_id not in self.tasks:
            raise ParameterError(f"no task {task_id}")
        return json.loads(json.dumps(self.tasks[task_id]))

    def update(self, task_id: str, **changes) -> None:
        with self.lock:
            task = self.tasks.get(task_id)
            if task is None:
                raise ParameterError(f"no task {task_id}")
            if changes.get("status", "pending") not in STATUSES:
                raise ParameterError(f"no status {changes['status']}")
            task |= changes | {"updated": _now()}
            if changes.get("status") == "running" and not task["started"]:
                task["started"] = task["updated"]
            if changes.get("status") in ("completed", "failed", "cancelled"):
                task["ended"] = task["updated"]
            self._save()

    def change(self, task_id: str, what: str) -> bool:
        """pause, resume or cancel; false if the task's state does not allow it."""
        if self.get(task_id)["status"] not in _FROM[what]:
            return False
        self.update(task_id, status=_TO[what])
        return True

    def delete(self, task_id: str) -> None:
        with self.lock:
            if self.tasks.pop(task_id, None) is None:
                raise ParameterError(f"no task {task_id}")
            self._save()

    def recover(self) -> int:
        """After a restart: tasks that were running are paused, to be resumed from their checkpoints."""
        found = [k for k, t in self.tasks.items() if t["status"] == "running"]
        for k in found:
            self.update(k, status="paused")
        return len(found)

    def cleanup(self, days: int = 30, keep_failed: bool = True) -> int:
        """Ended tasks older than some days go (failed ones on demand)."""
        since = (datetime.now(UTC) - timedelta(days=days)).isoformat()
        old = [k for k, t in self.tasks.items() if t["ended"] and t["ended"] < since and not (keep_failed and t["status"] == "failed")]
        for k in old:
            self.delete(k)
        return len(old)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [json.dumps({k: t[k] for k in ("task_id", "task_type", "task_subtype", "status", "progress", "created", "started", "ended", "updated", "error")}) for t in self.tasks.values()]
        return spark.createDataFrame([(r,) for r in rows], "value string").select(F.from_json("value", _SCHEMA).alias("r")).select("r.*")


def listing(tasks: DataFrame, status: str | None = None, kind: str | None = None, limit: int | None = None) -> DataFrame:
    out = tasks if status is None else tasks.where(F.col("status") == status)
    out = (out if kind is None else out.where(F.col("task_type") == kind)).orderBy(F.desc("created"), "task_id")
    return out if limit is None else out.limit(limit)


def stale(tasks: DataFrame, now=None, after: str = "1 hour") -> DataFrame:
    """Running tasks without news for longer than `after` count as failed."""
    idle = (F.col("status") == "running") & (F.col("updated") < (now if now is not None else F.current_timestamp()) - F.expr(f"INTERVAL {after}"))
    return tasks.withColumn("status", F.when(idle, "failed").otherwise(F.col("status")))


def statistics(tasks: DataFrame, today=None) -> DataFrame:
    """One row: total, active, completed_today, and counts by status and by type as maps."""
    counts = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "count"))))
    by = [tasks.groupBy(c).count().agg(counts(c).alias(f"by_{n}")).withColumn("k", F.lit(1)) for c, n in (("status", "status"), ("task_type", "type"))]
    day = today if today is not None else F.current_date()
    one = tasks.agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("running", "pending")).alias("active"), F.count_if((F.col("status") == "completed") & (F.to_date("ended") == day)).alias("completed_today")).withColumn("k", F.lit(1))
    return one.join(by[0], "k").join(by[1], "k").drop("k")


def retained(tasks: DataFrame, now, days: int, keep_failed: bool = True) -> DataFrame:
    old = F.col("ended").isNotNull() & (F.col("ended") < now - F.expr(f"INTERVAL {days} DAYS"))
    return tasks.where(~(old & (F.col("status") != "failed")) if keep_failed else ~old)


def log_stats(files: DataFrame) -> DataFrame:
    """One row over a listing (path, size) of log files: files, total_size."""
    return files.where(F.lower("path").endswith(".log")).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))


def search_logs(lines: DataFrame, keyword: str, date: str | None = None, limit: int = 100) -> DataFrame:
    """Log lines (value) that hold a keyword in any case and, if given, a date; the first in order of the lines themselves, which start with their time."""
    found = lines.where(F.contains(F.lower("value"), F.lit(keyword.lower())))
    return (found if date is None else found.where(F.contains("value", F.lit(date)))).orderBy("value").limit(limit)
