"""Structured Streaming runs: cleaning and generation that resume from their checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import ParameterError


def lines(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Lines (value) of text files as they appear."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def files(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Parquet files as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def once(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, order_by: str | None = None) -> StreamingQuery:
    """Run a step over all that is there and stop. A batch that is run again after a failure overwrites its own folder, so rows come once.

    order_by: rows of a batch are written in this order; batches are in order of their folders.
    """

    def commit(batch: DataFrame, number: int) -> None:
        made = step(batch)
        (made.orderBy(order_by) if order_by else made).write.mode("overwrite").parquet(f"{out}/batch={number:010d}")

    query = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def start(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, log=None, task_id: str | None = None) -> StreamingQuery:
    """As once(), but goes on until it is stopped; with a task log, it stops itself after the batch in which its task is paused or cancelled."""

    def commit(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number:010d}")
        if log is not None:
            log.update(task_id, progress=float(number + 1))

    query = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).start()
    if log is not None:
        log.update(task_id, status="running")
    return query


def paused(query: StreamingQuery, log, task_id: str, status: str = "paused") -> bool:
    """Stop a query after its current batch and note it; its checkpoint is where it goes on. False if its task is in no state to be paused."""
    if not log.change(task_id, {"paused": "pause", "cancelled": "cancel"}[status]):
        return False
    query.stop()
    return True


def resumed(log, task_id: str, overrides: dict | None = None, as_new: bool = False) -> tuple[str, dict]:
    """The task that goes on, and its parameters with the overrides: the paused task itself, or a new one that has its checkpoint and names it."""
    task = log.get(task_id)
    params = task["params"] | (overrides or {})
    if as_new:
        new = log.add(task["task_type"], task["task_subtype"], params | {"resumed_from": task_id})
        return new, log.get(new)["params"]
    if not log.change(task_id, "resume"):
        raise ParameterError(f"task {task_id} is {task['status']}")
    log.update(task_id, params=params)
    return task_id, params


def result(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out)


def distinct_by(stream: DataFrame, signature: str, event_time: str | None = None, late: str = "1 day") -> DataFrame:
    """Each signature once; with an event time, signatures are forgotten once the watermark has passed them, so state is bounded."""
    if event_time is None:
        return stream.dropDuplicates([signature])
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark([signature])


def undone(batch: DataFrame, sink: str, signature: str) -> DataFrame:
    """Rows of a batch whose signature the sink does not hold yet."""
    spark = batch.sparkSession
    try:
        done = spark.read.parquet(sink).select(signature).distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return batch
    return batch.join(done, signature, "left_anti")


def progress(query: StreamingQuery) -> list[dict]:
    """Rows and rates of each batch."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "rows_per_second": p.get("processedRowsPerSecond")} for p in query.recentProgress]


def eta(done: float, total: float, seconds: float) -> dict:
    """Speed and time left of a transfer or run."""
    speed = done / seconds if seconds > 0 else 0.0
    return {"percent": round(100.0 * done / total, 2) if total else 0.0, "speed": speed, "eta": (total - done) / speed if speed else None}


def windowed(stream: DataFrame, time: str, every: str, *by: str, late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window, rows later than `late` left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, every), *by).count()
