import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern.config import Config
from quern.errors import ParameterError
from quern.streaming import resume, tasks


def test_resume(spark, tmp_path):
    src, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    src.mkdir()
    step = lambda b: resume.undone(b.select(F.get_json_object("value", "$.id").alias("id")), out, "id")
    for n, ids in enumerate(([1, 2], [2, 3], [])):
        (src / f"{n}.jsonl").write_text("".join(json.dumps({"id": i}) + "\n" for i in ids))
        resume.once(resume.lines(spark, str(src)), step, out, check, "id")
    assert sorted(r.id for r in resume.result(spark, out).collect()) == ["1", "2", "3"]
    assert resume.eta(50, 200, 10) == {"percent": 25.0, "speed": 5.0, "eta": 30.0}


def test_task_log(spark, tmp_path):
    log = tasks.TaskLog(str(tmp_path / "s" / "tasks.json"))
    a, b = log.add("clean", params={"x": 1}), log.add("merge")
    log.update(a, status="running", progress=0.5)
    assert log.change(a, "pause") and not log.change(a, "pause") and log.change(a, "resume")
    again = tasks.TaskLog(str(tmp_path / "s" / "tasks.json"))
    assert again.recover() == 1 and again.get(a)["status"] == "paused"
    again.update(b, status="completed")
    got = tasks.statistics(again.frame(spark)).first()
    assert (got.total, got.active, got.completed_today, got.by_status) == (2, 0, 1, {"completed": 1, "paused": 1})
    assert tasks.listing(again.frame(spark), status="paused").first().task_id == a
    assert again.cleanup(0) in (0, 1)
    with pytest.raises(ParameterError):
        again.get("none")
    with pytest.raises(ParameterError):
        again.update(a, status="odd")


def test_task_rules(spark):
    at = datetime(2024, 1, 2, 12)
    rows = [("a", "running", datetime(2024, 1, 2, 10), None), ("b", "running", datetime(2024, 1, 2, 11, 30), None), ("c", "failed", at, datetime(2023, 1, 1)), ("d", "completed", at, datetime(2023, 1, 1))]
    df = spark.createDataFrame(rows, "task_id string, status string, updated timestamp, ended timestamp")
    assert {r.task_id: r.status for r in tasks.stale(df, F.lit(at)).collect()} == {"a": "failed", "b": "running", "c": "failed", "d": "completed"}
    assert sorted(r.task_id for r in tasks.retained(df, F.lit(at), 30).collect()) == ["a", "b", "c"]
    logs = spark.createDataFrame([("2024-01-02 Error x",), ("2024-01-03 error y",)], "value string")
    assert tasks.search_logs(logs, "ERROR", "2024-01-03").count() == 1


def test_config(tmp_path):
    c = Config(str(tmp_path / "c.json"))
    c.set("generation.quality_threshold", 0.5)
    assert Config(str(tmp_path / "c.json")).get("generation.quality_threshold") == 0.5
    with pytest.raises(ParameterError):
        c.set("generation.quality_threshold", 2)
    c.reset("generation")
    assert c.get("generation.quality_threshold") == 0.7 and c.get("a.b", 1) == 1 and not c.problems()
