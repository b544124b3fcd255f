"""Long blanks, rows that come in another order each time, files of one name, runs that go on, parts of files."""

import json

import pytest
from pyspark.sql import functions as F

from quern import errors, storage
from quern.functions import text as X
from quern.operators import catalog, clean, dedup, merge, predicates, project
from quern.plans import run as plans
from quern.sources import read, write
from quern.sources.readers import xml
from quern.streaming import resume, tasks


def test_long_blanks_cost_one_pass(spark):
    n = 1_000_000
    rows = [(1, " " * n), (2, "　\x1c" * (n // 2)), (3, " " * n + "x" + "\n" * n), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    assert [r.id for r in predicates.remove_empty(df, ["text"]).collect()] == [3]
    assert sorted(r.id for r in predicates.skip_empty_rows(df.select("text", F.when(F.col("id") == 3, "y").otherwise("").alias("id"))).collect()) == ["", "y"]  # a null is a value
    got = {r.id: r for r in df.select("id", X.strip(F.col("text")).alias("s"), X.is_blank(F.col("text")).alias("b"), X.normalize(F.col("text"), ["nfc"]).alias("n")).collect()}
    assert [got[i].b for i in range(1, 6)] == [True, True, False, True, True] and got[3].s == "x" == got[3].n and got[2].s == ""


def test_strip_is_pythons(spark):
    texts = [chr(c) + "a" + chr(c) for c in [*range(1, 0x100), 0x1680, *range(0x1FFF, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.strip(F.col("t")).alias("s")).collect()
    assert all(r.s == r.t.strip() for r in got)


def test_rows_that_move_are_not_lost(spark):
    df = spark.range(5000).select((F.col("id") % 700).cast("string").alias("text"), F.rand().alias("noise"), F.lit("x").alias("__o__x"))
    moving = df.repartition(7).orderBy(F.rand()).repartition(5)
    assert dedup.exact(moving, "text").count() == 700
    assert merge.dedup_key([moving, moving], "text", "last").count() == 700
    one = dedup.exact(spark.createDataFrame([(1, "a", "p"), (1, "a", "q"), (2, None, "r"), (3, "", "s"), (2, None, "r")], "id int, text string, more string"), "text", "id")
    assert one.count() == 4 and one.where("text = 'a'").count() == 1


def test_long_chains_settle(spark):
    nodes = spark.range(12).select(F.col("id").alias("ord"))
    edges = spark.range(11).select(F.col("id").alias("old"), (F.col("id") + 1).alias("new"))
    assert sorted(r.ord for r in dedup.survivors(nodes, edges).collect()) == [0, 2, 4, 6, 8, 10]


def test_backup_keeps_files_of_one_name(tmp_path):
    for d in ("a", "b/c"):
        (tmp_path / "in" / d).mkdir(parents=True)
        (tmp_path / "in" / d / "data.json").write_text(d)
    paths = [str(tmp_path / "in" / d / "data.json") for d in ("a", "b/c")]
    kept = catalog.backup(paths, str(tmp_path / "backups"), "one")
    for p in paths:
        open(p, "w").close()
    catalog.restore(str(kept))
    assert [open(p).read() for p in paths] == ["a", "b/c"]
    assert [p.read_text() for p in catalog.restore(str(kept), str(tmp_path / "out"))] == ["a", "b/c"]
    (kept / "files/a/data.json").write_text("changed")
    with pytest.raises(errors.SourceError):
        catalog.restore(str(kept))
    catalog.delete_backup(str(kept))
    assert not kept.exists()
    with pytest.raises(errors.SourceError):
        catalog.delete_backup(str(tmp_path))


def test_parts_of_json_and_markdown(spark, tmp_path):
    df = spark.range(100).select("id", F.concat(F.lit('a "b" '), "id").alias("name")).repartition(4)
    for kind in ("json", "markdown"):
        write(df, f"{tmp_path}/{kind}", kind)
        assert len(list((tmp_path / kind).glob("part-*"))) == 4
        got = read(spark, f"{tmp_path}/{kind}", kind)
        assert sorted((int(r.id), r.name) for r in got.collect()) == sorted(tuple(r) for r in df.collect())
    write(df, f"{tmp_path}/one", "json", single=True)
    (part,) = (tmp_path / "one").glob("part-*")
    assert len(json.loads(part.read_text())) == 100


def test_projection_and_xml(spark, tmp_path):
    df = spark.range(3)
    none = project.select_fields(df, ["a", "b"], {"a": "x"})
    assert none.columns == ["x", "b"] and none.count() == 0
    (tmp_path / "a.xml").write_text("<?xml version='1.0'?><!DOCTYPE t><t><item k='1'><v>a</v><v>b</v></item><item k='2'><v>c</v></item></t>")
    assert sorted((r.k, r.v) for r in xml(spark, str(tmp_path / "a.xml")).collect()) == [(1, ["a", "b"]), (2, ["c"])]
    assert clean.preview(spark, "my Password", clean.Sensitive(action="drop_record")) is None


def test_tasks_go_on(spark, tmp_path):
    log = tasks.TaskLog(str(tmp_path / "tasks.json"))
    task = log.add("clean", params={"a": 1, "b": 2})
    spark.range(10).repartition(2).write.parquet(f"{tmp_path}/in")
    stream = resume.files(spark, f"{tmp_path}/in", "id long")
    query = resume.start(stream, lambda b: b, f"{tmp_path}/out", f"{tmp_path}/c", log, task)
    query.processAllAvailable()
    assert resume.paused(query, log, task) and not query.isActive and log.get(task)["status"] == "paused"
    assert log.get(task)["progress"] == 2.0 and resume.result(spark, f"{tmp_path}/out").count() == 10
    assert not resume.paused(query, log, task)
    new, params = resume.resumed(log, task, {"b": 3}, as_new=True)
    assert new != task and params == {"a": 1, "b": 3, "resumed_from": task}
    assert resume.resumed(log, task, {"b": 4}) == (task, {"a": 1, "b": 4}) and log.get(task)["status"] == "running"
    with pytest.raises(errors.ParameterError):
        resume.resumed(log, task)


def test_sidecars_and_counts(spark, tmp_path):
    df = spark.range(20).toDF("k")
    write(df, f"{tmp_path}/a.parquet", "parquet")
    write(df.where("k < 5"), f"{tmp_path}/b.parquet", "parquet")
    told = plans.merge_named(spark, [f"{tmp_path}/a.parquet", f"{tmp_path}/b.parquet"], f"file://{tmp_path}/out", "parquet", "k")
    assert told["rows"] == 20 and told["duplicate_rows"] == 5 and plans.told(spark, told["target"])["info"] == told["info"]
    assert (plans.row_count(df), plans.row_count(df, 20), plans.row_count(df, 19)) == (20, 20, -1)


def test_tables_are_deleted_by_choice(spark):
    a, b = storage.cut(spark.range(3)), storage.cut(spark.range(4))
    made = storage.cuts(spark)[-2:]
    assert storage.release(spark, made, keep=b) == 1 and b.count() == 4
    with pytest.raises(Exception):
        a.count()
    assert storage.release(spark, made) == 1
