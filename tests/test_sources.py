import json

import pytest
from pyspark.sql import functions as F

from quern import plans
from quern.errors import SourceError
from quern.operators import catalog
from quern.operators.clean import Clean
from quern.operators.predicates import Condition
from quern.plans import run
from quern.sources import detect, read, readers, tables, write


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_detect(spark, tmp_path):
    assert detect.by_name("/x/a.TSV") == "tsv" and detect.by_name("/x/a") is None
    assert detect.by_content(b'{"a":1}\n') == "jsonl" and detect.by_content(b"a,b\n1,2") == "csv" and detect.by_content(b"\x00\x01") == "unknown"
    assert detect.encoding("é".encode()) == "utf-8" and detect.encoding("﻿a".encode("utf-16")) == "utf-16" and detect.encoding("中文".encode("gb18030")) == "gb18030"
    assert detect.detect(spark, put(tmp_path / "a.txt", '{"a":1}\n')) == "jsonl"
    assert detect.detect(spark, put(tmp_path / "b", "x\ty\n")) == "tsv"


def test_jsonl(spark, tmp_path):
    path = put(tmp_path / "a.jsonl", '{"a":1}\n\n# note\n// note\n{"a":2,"b":"x"}\n')
    assert sorted(r.a for r in readers.jsonl(spark, path).collect()) == [1, 2]
    assert readers.jsonl(spark, path, mode="strict").count() == 2
    bad = put(tmp_path / "b.jsonl", '{"a":1}\nnope\n')
    assert readers.jsonl(spark, bad).count() == 1
    with pytest.raises(Exception):
        readers.jsonl(spark, bad, mode="strict", schema="a long").collect()
    assert readers.variants(spark, bad).count() == 1


def test_json(spark, tmp_path):
    for text, n in (('[{"a":1},{"a":2}]', 2), ('{"a":1}', 1), ('{"n":[],"m":3,"rows":[{"a":1},{"a":2},{"a":3}],"more":[{"z":1}]}', 3)):
        assert readers.json(spark, put(tmp_path / "x.json", text)).count() == n


def test_csv(spark, tmp_path):
    path = put(tmp_path / "a.csv", 'a,b\n1,\n2,"x,\ny"\n')
    assert [tuple(r) for r in read(spark, path).collect()] == [(1, None), (2, "x,\ny")]
    assert [tuple(r) for r in read(spark, path, infer=False).collect()] == [("1", ""), ("2", "x,\ny")]


def test_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("a,b\n1,中文\n".encode("gb18030"))
    assert read(spark, str(tmp_path / "a.csv"), encoding="auto").first().b == "中文"


def test_text_xml(spark, tmp_path):
    path = put(tmp_path / "a.txt", "one\r\ntwo\n")
    assert [tuple(r) for r in readers.text_lines(spark, path).orderBy("line_number").collect()] == [(1, "one"), (2, "two")]
    path = put(tmp_path / "a.xml", '<r><row id="1"><n>a</n><n>b</n></row><row id="2"><n>c</n></row></r>')
    rows = {str(r.id): r.n for r in read(spark, path, row_tag="row").collect()}
    assert rows["1"] == ["a", "b"] and rows["2"] == ["c"]


def test_markdown(spark, tmp_path):
    path = put(tmp_path / "a.md", "# t\n\n| a | b |\n|---|---|\n| 1 | x |\n| 2 |\n| 3 |  |\n\n| c |\n|--|\n| 9 |\n")
    assert [tuple(r) for r in read(spark, path).collect()] == [("1", "x"), ("3", "")]
    with pytest.raises(SourceError):
        tables.markdown_table("no table")


def test_excel_and_arrow(spark, tmp_path):
    df = spark.createDataFrame([(i, f"<n&{i}>", None if i % 2 else 1.5) for i in range(7)], "a long, b string, c double")
    write(df.coalesce(1), f"file://{tmp_path}/x", "excel", max_rows=3)
    assert len(list((tmp_path / "x").glob("*.xlsx"))) == 3
    got = read(spark, f"file://{tmp_path}/x", "excel")
    assert sorted(tuple(r) for r in got.select(F.col("a").cast("long"), "b", F.col("c").cast("double")).collect()) == sorted(map(tuple, df.collect()))
    write(df, f"file://{tmp_path}/d/train", "arrow")
    put(tmp_path / "d" / "dataset_dict.json", json.dumps({"splits": ["train", "test"]}))
    assert sorted(map(tuple, read(spark, f"file://{tmp_path}/d", "arrow", split="none").collect())) == sorted(map(tuple, df.collect()))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    write(df, f"{tmp_path}/j", "json", single=True)
    assert json.loads(next((tmp_path / "j").glob("part*")).read_text()) == [{"i": 1, "s": "a"}, {"i": 2, "s": None}]
    write(df, f"{tmp_path}/m", "markdown", single=True)
    assert next((tmp_path / "m").glob("part*")).read_text() == "| i | s |\n| --- | --- |\n| 1 | a |\n| 2 |  |\n"
    write(df, f"{tmp_path}/l", "jsonl", single=True)
    assert '{"i":2,"s":null}' in next((tmp_path / "l").glob("part*")).read_text()
    with pytest.raises(SourceError):
        write(df, f"{tmp_path}/z", "zip")


def test_runs(spark, tmp_path):
    src = put(tmp_path / "a.jsonl", "".join(json.dumps({"id": i, "text": f" t{i % 3} ", "d": 45292}) + "\n" for i in range(6)))
    told = run.convert(spark, run.Convert(src, f"{tmp_path}/c", "csv", date_fields=("d",)))
    assert told["rows"] == 6 and read(spark, f"{tmp_path}/c", "csv", infer=False).first().d == "2024-01-01"
    told = run.clean(spark, src, f"{tmp_path}/k", Clean(("normalize_text", "dedup"), dedup_field="text", threshold=1, order_by="id"))
    assert (told["rows"], told["removed"], told["reduction_rate"]) == (3, 3, 50.0)
    told = run.extract(spark, run.Extract(src, f"{tmp_path}/e", ("id",), {"id": "n"}, (Condition("n", ">", 3),)))
    assert told["rows"] == 2 and told["fields"] == ["n"]
    told = run.merge(spark, [src, src], f"{tmp_path}/m", "parquet", dedup_field="id")
    assert told["duplicate_rows"] == 6 and told["retention"] == 50.0
    shown, hidden = run.preview(spark, src, max_text=2)
    assert shown.count() == 6 and "d" in hidden
    assert run.find(spark, [src], "T1").count() == 2
    assert plans.__doc__


def test_catalog(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    for n in ("a.jsonl", "meta.json", ".hidden.csv", "b.log"):
        put(tmp_path / "raw" / n, "{}\n")
    listing = catalog.files(spark, str(tmp_path / "raw"))
    assert [r.name for r in catalog.catalog(catalog.data_files(listing), str(tmp_path), "raw").collect()] == ["a.jsonl"]
    put(tmp_path / "raw" / "z.parquet", "x")
    assert [r.path.rsplit("/", 1)[-1] for r in catalog.data_files(catalog.files(spark, str(tmp_path / "raw"))).collect()] == ["z.parquet"]
    at = catalog.backup([str(tmp_path / "raw" / "a.jsonl")], str(tmp_path / "backups"), "one")
    assert catalog.backups(spark, str(tmp_path / "backups")).first().files == 1
    assert catalog.restore(str(at), str(tmp_path / "back"))[0].read_text() == "{}\n"
    put(at / "files" / "a.jsonl", "changed")
    with pytest.raises(SourceError):
        catalog.restore(str(at))
    import hashlib

    assert catalog.hashes(spark, str(tmp_path / "back" / "a.jsonl"), "sha256").first().hash == hashlib.sha256(b"{}\n").hexdigest()
