"""Queries of sources, sinks, tasks, generation and catalog: each makes its input (files, states, responses) from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import models
from .functions import text as X
from .operators import catalog, clean, generate, merge, predicates, profile, project
from .operators.predicates import Condition
from .plans import run as plans
from .queries import QUERIES, SQL, query
from .sources import detect, read, readers, sinks, write
from .storage import shared_dir
from .streaming import resume, tasks

_CUSTOMERS = "SELECT c_custkey, c_name, c_mktsegment FROM customer"


def on_files(name: str, *tables: str, sql: str):
    """Register a function of DataFrames of the named tables and a fresh folder in shared storage."""

    def register(f: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(f"{shared_dir(spark)}/{name}-{uuid4().hex}", *[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])

        QUERIES[name], SQL[name] = run, sql
        return f

    return register


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- sources ------------------------------------------------------------------------------------------------------


@on_files("scan_csv_text", "customer", sql="SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS c_name FROM customer")
def scan_csv_text(path, df):
    write(df.select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("c_name")), path, "csv")
    return read(df.sparkSession, path, "csv", infer=False)


@on_files("scan_csv_clean", "customer", sql="SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 <> 0")
def scan_csv_clean(path, df):
    write(df.select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("c_name")), path, "csv")
    return predicates.remove_empty(read(df.sparkSession, path, "csv"), ["c_name"]).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name")


@on_files("scan_tsv_lenient", "customer", sql="SELECT c_custkey, c_name FROM customer")
def scan_tsv_lenient(path, df):
    write(df.select("c_custkey", "c_name"), path, "tsv")
    return read(df.sparkSession, path, "tsv", lenient=True).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name")


def _lines(df: DataFrame, extra: list[str]) -> DataFrame:
    json = df.select(F.to_json(F.struct("c_custkey", "c_name", "c_mktsegment")).alias("value"))
    odd = df.where("c_custkey % 10 = 0").select(F.explode(F.array(*map(F.lit, extra))).alias("value"))
    return json.union(odd)


@on_files("scan_jsonl_lenient", "customer", sql=_CUSTOMERS)
def scan_jsonl_lenient(path, df):
    _lines(df, ["", "  ", "{broken", "[1, 2]", "plain words"]).write.text(path)
    return readers.jsonl(df.sparkSession, path)


@on_files("scan_jsonl_strict", "customer", sql=_CUSTOMERS)
def scan_jsonl_strict(path, df):
    _lines(df, ["", "# a comment", "// another"]).write.text(path)
    return readers.jsonl(df.sparkSession, path, mode="strict", schema="c_custkey long, c_name string, c_mktsegment string")


@on_files("scan_jsonl_preview", "customer", sql=_CUSTOMERS)
def scan_jsonl_preview(path, df):
    _lines(df, ['{"c_name": "a\x00b"}', "no record"]).write.text(path)
    return readers.jsonl_preview(df.sparkSession, path, 1_000_000)


def _wrapped(df: DataFrame, *front: str) -> DataFrame:
    """One JSON document that holds the nations in a list."""
    records = F.to_json(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))))
    return df.agg(F.concat(F.lit("".join(front)), records, F.lit("}" if front else "")).alias("value")).coalesce(1)


@on_files("scan_json_wrapped", "nation", sql="SELECT n_nationkey, n_name FROM nation")
def scan_json_wrapped(path, df):
    _wrapped(df, '{"about": {"n": 1}, "none": [], "numbers": [1, 2], "data": ').write.text(path)
    return readers.json(df.sparkSession, path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@on_files("json_array_to_lines", "nation", sql="SELECT n_nationkey, n_name FROM nation")
def json_array_to_lines(path, df):
    _wrapped(df).write.text(f"{path}/in")
    readers.json_to_lines(df.sparkSession, f"{path}/in", f"{path}/out")
    return readers.jsonl(df.sparkSession, f"{path}/out", schema="n_nationkey int, n_name string")


@query("rows_in_memory", "region", sql="SELECT CAST(r_regionkey AS BIGINT) AS key, r_name AS name FROM region")
def rows_in_memory(df):
    return readers.rows(df.sparkSession, [{"key": r.r_regionkey, "name": r.r_name} for r in df.collect()])  # five rows


@on_files("scan_text_lines", "part", sql="SELECT row_number() OVER (ORDER BY p_partkey) AS line_number, p_name AS content FROM part")
def scan_text_lines(path, df):
    df.select("p_partkey", "p_name").coalesce(1).sortWithinPartitions("p_partkey").select("p_name").write.text(path)
    return readers.text_lines(df.sparkSession, path).select(F.col("line_number").cast("long").alias("line_number"), "content")


@on_files("scan_xml", "nation", sql="SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name, n_regionkey % 2 = 0 AS even FROM nation")
def scan_xml(path, df):
    row = F.format_string('<nation key="%d"><name>%s</name><even>%s</even></nation>', "n_nationkey", "n_name", (F.col("n_regionkey") % 2 == 0).cast("string"))
    df.agg(F.concat(F.lit("<?xml version='1.0'?>\n<!-- all -->\n<nations>\n"), F.array_join(F.collect_list(row), "\n"), F.lit("\n</nations>")).alias("value")).coalesce(1).write.text(path)
    return readers.xml(df.sparkSession, path).select("key", "name", "even")


@on_files("scan_by_detection", "customer", sql=_CUSTOMERS)
def scan_by_detection(path, df):
    write(df.select("c_custkey", "c_name", "c_mktsegment"), f"{path}.jsonl", "jsonl")
    return read(df.sparkSession, f"{path}.jsonl")


_FORMATS = [("csv", "csv"), ("tsv", "tsv"), ("json", "json"), ("jsonl", "jsonl"), ("xlsx", "excel"), ("md", "markdown"), ("parquet", "parquet"), ("arrow", "arrow"), ("xml", "xml"), ("bin", "none")]
_VALUES = lambda pairs: ", ".join(f"('{a}', '{b}')" for a, b in pairs)


@query("format_by_suffix", "region", sql=f"SELECT r_name || '.' || suffix AS name, format FROM region, (VALUES {_VALUES(_FORMATS)}) AS t(suffix, format)")
def format_by_suffix(df):
    names = [f"{r.r_name}.{s}" for r in df.collect() for s, _ in _FORMATS]  # fifty names
    return _table(df.sparkSession, [(n, detect.by_name(f"/data/{n}") or "none") for n in names], "name string, format string")


@query("format_by_content", "region", sql="SELECT r_name AS name, CASE r_regionkey WHEN 0 THEN 'jsonl' WHEN 1 THEN 'json' WHEN 2 THEN 'csv' WHEN 3 THEN 'tsv' ELSE 'text' END AS format FROM region")
def format_by_content(df):
    shapes = ['{{"n": "{}"}}\n', '[{{"n": "{}"}}]', "n,{}\n1,2\n", "n\t{}\n1\t2\n", "{}\n"]
    return _table(df.sparkSession, [(r.r_name, detect.by_content(shapes[min(r.r_regionkey, 4)].format(r.r_name.replace(" ", "")).encode())) for r in df.collect()], "name string, format string")


@query("encoding_by_content", "nation", sql="SELECT n_name AS name, CASE n_nationkey % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16' ELSE 'gb18030' END AS encoding FROM nation")
def encoding_by_content(df):
    made = lambda r: f"{r.n_name} 中文".encode(("utf-8", "utf-16", "gb18030")[r.n_nationkey % 3])
    return _table(df.sparkSession, [(r.n_name, detect.encoding(made(r))) for r in df.collect()], "name string, encoding string")


# --- sinks and runs -----------------------------------------------------------------------------------------------


@on_files("sink_excel_split", "customer", sql=_CUSTOMERS)
def sink_excel_split(path, df):
    write(df.select("c_custkey", "c_name", "c_mktsegment"), path, "excel", max_rows="37")
    return read(df.sparkSession, path, "excel").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_mktsegment")


for _f in ("csv", "jsonl", "parquet"):

    @on_files(f"append_{_f}", "customer", sql=f"{_CUSTOMERS} UNION ALL {_CUSTOMERS} WHERE c_custkey % 2 = 0")
    def _(path, df, kind=_f):
        kept = df.select("c_custkey", "c_name", "c_mktsegment")
        write(kept, path, kind)
        write(kept.where("c_custkey % 2 = 0"), path, kind, mode="append")
        return read(df.sparkSession, path, kind).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_mktsegment")


@on_files("run_convert", "orders", sql="SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END, '') AS o_orderpriority FROM orders")
def run_convert(path, df):
    given = df.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    write(given, f"{path}/in", "parquet")
    plans.convert(df.sparkSession, plans.Convert(f"{path}/in", f"{path}/out", "jsonl", "parquet", ("o_orderpriority",), ("o_orderdate",)))
    return read(df.sparkSession, f"{path}/out", "jsonl")


@on_files("run_max_rows", "orders", sql="SELECT least(count(*), 50) AS n FROM orders")
def run_max_rows(path, df):
    write(df.select("o_orderkey"), f"{path}/in", "parquet")
    told = plans.convert(df.sparkSession, plans.Convert(f"{path}/in", f"{path}/out", "jsonl", "parquet", max_rows=50))
    return _table(df.sparkSession, [(told["rows"],)], "n long")


@on_files("run_sidecar", "orders", sql="SELECT count(*) FILTER (WHERE o_totalprice > 1000) AS rows, 'o_orderkey,price' AS fields FROM orders")
def run_sidecar(path, df):
    write(df.select("o_orderkey", "o_totalprice"), f"{path}/in", "parquet")
    spec = plans.Extract(f"{path}/in", f"{path}/out", ("o_orderkey", "o_totalprice"), {"o_totalprice": "price"}, (Condition("price", ">", 1000),), source_format="parquet")
    plans.sidecar(df.sparkSession, spec.target, plans.extract(df.sparkSession, spec))
    told = plans.told(df.sparkSession, spec.target)
    return _table(df.sparkSession, [(told["rows"], ",".join(told["fields"]))], "rows long, fields string")


@on_files("run_clean", "documents", sql="SELECT count(*) AS input_rows, count(DISTINCT text) AS rows, count(*) - count(DISTINCT text) AS removed FROM documents")
def run_clean(path, df):
    write(df.select("doc_id", "text"), f"{path}/in", "parquet")
    told = plans.clean(df.sparkSession, f"{path}/in", f"{path}/out", clean.Clean(("dedup",), dedup_field="text", threshold=1.0, order_by="doc_id"), source_format="parquet")
    return _table(df.sparkSession, [(told["input_rows"], told["rows"], told["removed"])], "input_rows long, rows long, removed long")


@on_files("run_merge_named", "orders", sql="SELECT count(*) AS input_rows, count(DISTINCT o_custkey) AS rows, 'merged_a_b' AS name, round(100.0 * count(DISTINCT o_custkey) / count(*), 2) AS retention FROM orders")
def run_merge_named(path, df):
    kept = df.select("o_orderkey", "o_custkey")
    write(kept.where("o_orderkey % 2 = 0"), f"{path}/a.parquet", "parquet")
    write(kept.where("o_orderkey % 2 <> 0"), f"{path}/b.parquet", "parquet")
    told = plans.merge_named(df.sparkSession, [f"{path}/a.parquet", f"{path}/b.parquet"], f"{path}/out", "parquet", "o_custkey")
    return _table(df.sparkSession, [(told["input_rows"], told["rows"], told["target"].rsplit("/", 1)[1], told["retention"])], "input_rows long, rows long, name string, retention double")


@on_files("run_find", "documents", sql="SELECT doc_id FROM (SELECT doc_id FROM documents WHERE contains(lower(text), 'password') ORDER BY doc_id LIMIT 50)")
def run_find(path, df):
    write(df.select("doc_id", "text").coalesce(1).sortWithinPartitions("doc_id"), f"{path}.parquet", "parquet")
    return plans.find(df.sparkSession, [f"{path}.parquet"], "PASSWORD", ["text"]).select(F.get_json_object("record", "$.doc_id").cast("long").alias("doc_id"))


@on_files("run_preview", "orders", sql="SELECT count(*) AS n FROM (SELECT 1 FROM orders LIMIT 100)")
def run_preview(path, df):
    write(df.select("o_orderkey", "o_orderstatus"), path, "parquet")
    return plans.preview(df.sparkSession, path, format="parquet")[0].agg(F.count("*").alias("n"))


@on_files("run_extract_resumed", "events", sql="SELECT event_id AS id, value FROM events WHERE value > 50")
def run_extract_resumed(path, df):
    df.select("event_id", "value").repartition(4).write.parquet(f"{path}/in")
    spec = plans.Extract(f"{path}/in", f"{path}/out", ("event_id", "value"), {"event_id": "id"}, (Condition("value", ">", 50),))
    return plans.extract_resumable(df.sparkSession, spec, "event_id long, value double", f"{path}/checkpoint")


@on_files("file_hash", "region", sql="SELECT md5(string_agg(r_name || chr(10), '' ORDER BY r_regionkey)) AS hash FROM region")
def file_hash(path, df):
    df.coalesce(1).sortWithinPartitions("r_regionkey").select("r_name").write.text(path)
    return catalog.hashes(df.sparkSession, f"{path}/part-*").select("hash")


@query("row_count_limits", "lineitem", sql="SELECT count(*) AS whole, -1 AS beyond FROM lineitem")
def row_count_limits(df):
    return _table(df.sparkSession, [(plans.row_count(df), plans.row_count(df, 100))], "whole long, beyond int")


# --- catalog ------------------------------------------------------------------------------------------------------

_LISTED = "SELECT '/data/' || source || '/' || CASE doc_id % 5 WHEN 0 THEN '.hidden.json' WHEN 1 THEN 'meta.json' WHEN 2 THEN 'Part-' || doc_id || '.jsonl' WHEN 3 THEN doc_id || '.csv' ELSE doc_id || '.log' END AS path, n_chars AS size, TIMESTAMP '2024-01-01' + to_seconds(doc_id * 60) AS modified FROM documents"


def _listed(docs: DataFrame) -> DataFrame:
    name = F.element_at(F.array(F.lit(".hidden.json"), F.lit("meta.json"), F.concat(F.lit("Part-"), "doc_id", F.lit(".jsonl")), F.concat("doc_id", F.lit(".csv")), F.concat("doc_id", F.lit(".log"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs.select(F.concat(F.lit("/data/"), "source", F.lit("/"), name).alias("path"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("doc_id") * 60)).alias("modified"), F.col("n_chars").alias("size"))


@query("shard_discovery", "documents", sql=f"SELECT path, size FROM ({_LISTED}) WHERE path LIKE '%.jsonl' OR path LIKE '%.csv'")
def shard_discovery(docs):
    return catalog.data_files(_listed(docs)).select("path", "size")


_NAME = "regexp_extract(path, '[^/]+$')"
_DATASETS = f"SELECT {_NAME} AS name, path, size, round(size / 1048576.0, 2) AS size_mb, modified AS modified_time FROM ({_LISTED})"


@query("list_datasets", "documents", sql=f"SELECT name, path, size, size_mb, modified_time FROM ({_DATASETS})")
def list_datasets(docs):
    return catalog.catalog(_listed(docs), "/data", "raw").select("name", "path", "size", "size_mb", "modified_time")


@query("list_datasets_cap", "documents", sql=f"SELECT name, path FROM ({_DATASETS}) ORDER BY modified_time DESC, path LIMIT 25")
def list_datasets_cap(docs):
    return catalog.catalog(_listed(docs), "/data", "raw", 25).select("name", "path")


@query("datasets_by_mtime", "documents", sql=f"SELECT name, row_number() OVER (ORDER BY modified_time DESC, path) AS place FROM ({_DATASETS}) ORDER BY 2 LIMIT 10")
def datasets_by_mtime(docs):
    first = catalog.catalog(_listed(docs), "/data", "raw", 10).collect()  # ten rows, in order
    return _table(docs.sparkSession, [(r["name"], i) for i, r in enumerate(first, 1)], "name string, place long")


@query("datasets_named", "documents", sql=f"SELECT path FROM ({_DATASETS}) WHERE contains(lower(name), 'part-1') OR contains(lower(path), 'part-1')")
def datasets_named(docs):
    return catalog.named(catalog.catalog(_listed(docs), "/data", "raw"), "PART-1").select("path")


@query("file_info", "documents", sql=f"SELECT path, regexp_extract(path, '[^/]+/[^/]+$') AS relative_path, lower(regexp_extract(path, '[^.]+$')) AS format FROM ({_LISTED})")
def file_info(docs):
    return catalog.catalog(_listed(docs), "/data", "raw").select("path", "relative_path", "format")


@query("log_files", "documents", sql=f"SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS total_size FROM ({_LISTED}) WHERE path LIKE '%.log'")
def log_files(docs):
    return tasks.log_stats(_listed(docs))


@query("unlogged_folders", "documents", "customer", sql="SELECT source, 'completed' AS status FROM (SELECT DISTINCT source FROM documents) WHERE source NOT IN (SELECT 'src' || c_custkey FROM customer WHERE c_custkey < 10)")
def unlogged_folders(docs, customers):
    known = customers.where("c_custkey < 10").select(F.concat(F.lit("src"), "c_custkey").alias("source"))
    return catalog.reconciled(known, docs.select("source"), "source")


@query("schema_info", "orders", sql="SELECT column_name AS \"column\", CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END AS type FROM (DESCRIBE SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders)")
def schema_info(df):
    told = profile.schema_info(df.select("o_orderkey", "o_totalprice", "o_orderstatus"))
    return _table(df.sparkSession, [(r["column"], r["type"]) for r in told], "column string, type string")


# --- tasks --------------------------------------------------------------------------------------------------------

_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END"
_ENDED = f"CASE WHEN {_STATUS} <> 'running' THEN o_orderdate + INTERVAL 2 HOUR END"
_TASKS = f"SELECT CAST(o_orderkey AS VARCHAR) AS task_id, o_orderpriority AS task_type, {_STATUS} AS status, o_orderdate AS created, {_ENDED} AS ended, o_orderdate + INTERVAL 1 HOUR AS updated FROM orders"


def _tasks(df: DataFrame) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    at = F.col("o_orderdate").cast("timestamp")
    return df.select(F.col("o_orderkey").cast("string").alias("task_id"), F.col("o_orderpriority").alias("task_type"), status.alias("status"), at.alias("created"), F.when(status != "running", at + F.expr("INTERVAL 2 HOURS")).alias("ended"), (at + F.expr("INTERVAL 1 HOUR")).alias("updated"))


@query("tasks_filtered", "orders", sql=f"SELECT task_id FROM ({_TASKS}) WHERE status = 'completed' AND task_type = '1-URGENT'")
def tasks_filtered(df):
    return tasks.listing(_tasks(df), "completed", "1-URGENT").select("task_id")


@query("tasks_newest", "orders", sql=f"SELECT task_id, created FROM ({_TASKS}) ORDER BY created DESC, task_id LIMIT 20")
def tasks_newest(df):
    return tasks.listing(_tasks(df), limit=20).select("task_id", "created")


@query("tasks_stale", "orders", sql=f"SELECT task_id, CASE WHEN status = 'running' AND updated < TIMESTAMP '1997-01-01' - INTERVAL 1 HOUR THEN 'failed' ELSE status END AS status FROM ({_TASKS})")
def tasks_stale(df):
    return tasks.stale(_tasks(df), F.lit("1997-01-01").cast("timestamp")).select("task_id", "status")


@query("tasks_retained", "orders", sql=f"SELECT task_id FROM ({_TASKS}) WHERE NOT (coalesce(ended < TIMESTAMP '1997-01-01' - INTERVAL 30 DAY, false) AND status <> 'failed')")
def tasks_retained(df):
    return tasks.retained(_tasks(df), F.lit("1997-01-01").cast("timestamp"), 30).select("task_id")


@query("task_statistics", "orders", sql=f"SELECT count(*) AS total, count(*) FILTER (WHERE status = 'running') AS active, count(*) FILTER (WHERE status = 'completed' AND CAST(ended AS DATE) = DATE '1996-03-15') AS completed_today, count(*) FILTER (WHERE status = 'failed') AS failed FROM ({_TASKS})")
def task_statistics(df):
    told = tasks.statistics(_tasks(df), F.lit("1996-03-15").cast("date"))
    return told.select("total", "active", "completed_today", F.coalesce(F.element_at("by_status", F.lit("failed")), F.lit(0)).alias("failed"))


@query("log_search", "events", sql="SELECT value FROM (SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') || ' INFO ' || event_type || ' ' || event_id AS value FROM events) WHERE contains(lower(value), 'click') ORDER BY value LIMIT 100")
def log_search(df):
    lines = df.select(F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.lit(" INFO "), "event_type", F.lit(" "), "event_id").alias("value"))
    return tasks.search_logs(lines, "CLICK")


def _task_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of the regions' tasks after additions, changes, a restart and a resumption as a new task."""
    import tempfile

    with tempfile.TemporaryDirectory() as folder:  # the log is the driver's own file
        log = tasks.TaskLog(f"{folder}/tasks.json")
        for r in spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").collect():  # five rows
            name = log.add("clean", params={"rows": 1}, task_id=r.r_name)
            if r.r_regionkey % 2 == 0:
                log.update(name, status="running")
            elif r.r_regionkey == 1:
                log.change(name, "cancel")
        log = tasks.TaskLog(f"{folder}/tasks.json")
        log.recover()
        first = next(k for k, t in log.tasks.items() if t["status"] == "paused")
        resume.resumed(log, first, {"rows": 2})
        return log.frame(spark).select("task_id", "status")


QUERIES["task_recovery"] = _task_log
SQL["task_recovery"] = "SELECT r_name AS task_id, CASE WHEN r_regionkey = 0 THEN 'running' WHEN r_regionkey % 2 = 0 THEN 'paused' WHEN r_regionkey = 1 THEN 'cancelled' ELSE 'pending' END AS status FROM region"


@query("model_statistics", "supplier", sql="SELECT kind, count(*) AS total, count(*) FILTER (WHERE status = 'online') AS online, round(avg(response_time) FILTER (WHERE status = 'online'), 2) AS mean_response_time FROM (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'vllm' WHEN 1 THEN 'ollama' ELSE 'openai' END AS kind, CASE WHEN s_suppkey % 4 = 0 THEN 'offline' ELSE 'online' END AS status, CAST(s_suppkey * 10 AS DOUBLE) AS response_time FROM supplier) GROUP BY kind")
def model_statistics(df):
    kind = F.when(F.col("s_suppkey") % 3 == 0, "vllm").when(F.col("s_suppkey") % 3 == 1, "ollama").otherwise("openai")
    return models.statistics(df.select(kind.alias("kind"), F.when(F.col("s_suppkey") % 4 == 0, "offline").otherwise("online").alias("status"), (F.col("s_suppkey") * 10).cast("double").alias("response_time")))


# --- cleaning, merging, profiles ----------------------------------------------------------------------------------


@query("sensitive_policies", "part", sql="SELECT p_partkey, regexp_replace(p_name, 'a', '', 'gi') AS p_name, regexp_replace(p_brand, 'a', '#', 'gi') AS p_brand, regexp_replace(p_type, 'a', '***', 'gi') AS p_type FROM part")
def sensitive_policies(df):
    rule = clean.Sensitive(("a",), policies=clean.Sensitive.policy_map("p_name:remove_word, p_brand:replace_word:#"))
    return clean.filter_sensitive(df.select("p_partkey", "p_name", "p_brand", "p_type"), rule)


@query("sensitive_default_words", "documents", sql="SELECT doc_id, regexp_replace(text, '密码|password|身份证|idcard|手机号|phone|邮箱|email|地址|address|银行卡|bankcard', '***', 'gi') AS text FROM documents")
def sensitive_default_words(df):
    return clean.filter_sensitive(df.select("doc_id", "text"), clean.Sensitive())


@query("sensitive_preview", "region", sql="SELECT r_name AS name, regexp_replace(r_name, 'a', '*', 'gi') AS shown FROM region")
def sensitive_preview(df):
    rule = clean.Sensitive(("a",), replacement="*")
    return _table(df.sparkSession, [(r.r_name, clean.preview(df.sparkSession, r.r_name, rule)) for r in df.collect()], "name string, shown string")  # five texts


@query("clean_deprecated", "documents", sql="SELECT doc_id, text FROM documents WHERE trim(text) <> ''")
def clean_deprecated(df):
    return clean.clean(df.select("doc_id", "text"), clean.Clean(("desensitize", "remove_empty"), empty_fields=("text",), threshold=7.0))


@query("merge_shuffled", "orders", sql="SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0")
def merge_shuffled(df):
    kept = df.select("o_orderkey", "o_custkey")
    return merge.merge([kept, kept.where("o_orderkey % 2 = 0")], 7)


@query("merge_schema_check", "orders", "customer", sql="SELECT * FROM (VALUES (1, true, '', ''), (2, false, 'o_custkey', 'c_name')) AS t(input, fits, only_in_base, only_in_current)")
def merge_schema_check(orders, customers):
    base = orders.select("o_orderkey", "o_custkey")
    found = merge.compare(base, base.select("o_custkey", "o_orderkey"), customers.select(F.col("c_custkey").alias("o_orderkey"), "c_name"))
    return _table(orders.sparkSession, [(i, r["fits"], ",".join(r["only_in_base"]), ",".join(r["only_in_current"])) for i, r in enumerate(found, 1)], "input int, fits boolean, only_in_base string, only_in_current string")


@query("merge_info", "orders", sql="SELECT 'inputs: 2 (a, b)' || chr(10) || 'dedup: o_custkey' || chr(10) || 'rows read: ' || count(*) || chr(10) || 'rows written: ' || count(DISTINCT o_custkey) || chr(10) || 'duplicates removed: ' || (count(*) - count(DISTINCT o_custkey)) AS info FROM orders")
def merge_info(df):
    text = merge.info_text(["a", "b"], df.count(), df.select("o_custkey").distinct().count(), df.columns, "o_custkey")
    return _table(df.sparkSession, [("\n".join(text.split("\n")[:5]),)], "info string")


@query("profile_samples", "events", sql="SELECT 'event_id' AS name, (SELECT list(CAST(event_id AS VARCHAR) ORDER BY event_id) FROM (SELECT event_id FROM events ORDER BY event_id LIMIT 5)) AS sample_values, (SELECT count(DISTINCT event_id) FROM events) AS unique_count UNION ALL SELECT 'event_type', (SELECT list(event_type ORDER BY event_id) FROM (SELECT * FROM events ORDER BY event_id LIMIT 5)), (SELECT count(DISTINCT event_type) FROM events)")
def profile_samples(df):
    return profile.profile_columns(df.select("event_id", "event_type"), order_by="event_id").select("name", "sample_values", "unique_count")


@query("preview_fields", "events", sql="SELECT coalesce(json_extract_string(doc, '$.who.id'), '') AS \"who.id\", CASE WHEN length(json_extract_string(doc, '$.what')) > 4 THEN substr(json_extract_string(doc, '$.what'), 1, 4) || '...' ELSE json_extract_string(doc, '$.what') END AS what, '' AS absent FROM (SELECT '{\"who\": {\"id\": ' || user_id || '}, \"what\": \"' || event_type || '\"}' AS doc FROM events)")
def preview_fields(df):
    doc = F.concat(F.lit('{"who": {"id": '), "user_id", F.lit('}, "what": "'), "event_type", F.lit('"}'))
    return project.field_preview(df.select(doc.alias("doc")), "doc", ["who.id", "what", "absent"], 4)


@query("common_fields", "documents", sql="SELECT 1 AS place, 'text' AS field UNION ALL SELECT 2, 'content_x'")
def common_fields(df):
    named = project.common_fields(["doc_id", "text", "content_x", "lang"])
    return _table(df.sparkSession, list(enumerate(named, 1)), "place int, field string")


@query("encrypt_round_trip", "customer", sql="SELECT c_custkey, c_name, true AS hidden FROM customer")
def encrypt_round_trip(df):
    key = "0123456789abcdef"
    made = df.select("c_custkey", F.col("c_name").alias("given"), X.encrypt(F.col("c_name"), key).alias("c"))
    return made.select("c_custkey", X.decrypt(F.col("c"), key).alias("c_name"), (~F.contains("c", "given") & X.decrypt(F.col("c"), key[::-1]).isNull()).alias("hidden"))


@query("predicate_validation", "region", sql="SELECT * FROM (VALUES ('> 1', 'taken'), ('near 1', 'refused'), ('contains', 'refused'), ('is_null', 'taken')) AS t(condition, told)")
def predicate_validation(df):
    rows = []
    for op, value in ((">", 1), ("near", 1), ("contains", None), ("is_null", None)):
        try:
            Condition("r_name", op, value)
            told = "taken"
        except ValueError:
            told = "refused"
        rows.append((f"{op} {value}" if value else op, told))
    return _table(df.sparkSession, rows, "condition string, told string")


# --- generation ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class _Script(models.Backend):
    """Answers by the length of the prompt, so a retried task gets the same ones: JSON lists, objects, JSON in prose, plain lines, nothing."""

    shape: str

    def generate(self, prompt: str) -> str:
        n = sum(map(ord, prompt)) % 1000
        return {"list": f'[{{"text": "a{n}"}}, {{"text": "b{n}"}}]', "prose": f'Sure: {{"text": "a{n}"}} as asked', "lines": f"one {n}\n\n two {n} ", "boxed": "so \\boxed{even}" if n % 2 == 0 else "hm \\boxed{other}"}[self.shape]


_ASKED = "SELECT n_nationkey, n_name, (list_sum(list_transform(string_split({p}, ''), lambda x: ord(x))) % 1000) AS n FROM nation"
_PARAPHRASE = generate.TEMPLATES["paraphrase"]


def _sql_prompt(template: str, **values: str) -> str:
    """A template as a SQL expression."""
    out = "'" + template.replace("'", "''").replace("\\", "\\") + "'"
    for k, v in values.items():
        out = out.replace("{" + k + "}", f"' || {v} || '")
    return f"({out})"


_PROMPT = _sql_prompt(_PARAPHRASE, sys_prefix="''", text="n_name", count="'5'")


def _made(df: DataFrame, shape: str, strategy: str, **more) -> DataFrame:
    spec = generate.Generate(strategy, selected_fields=("n_name",), target_field="out", **more)
    made = generate.generate(df.select("n_name"), spec, _Script(shape))
    return made.select("number", F.get_json_object("record", "$.n_name").alias("n_name"), F.get_json_object("record", "$.out").alias("out"))


@query("generate_many", "nation", sql=f"SELECT number, n_name, '{{\"text\": \"' || letter || n || '\"}}' AS out FROM ({_ASKED.format(p=_PROMPT)}), (VALUES (0, 'a'), (1, 'b')) AS t(number, letter)")
def generate_many(df):
    return _made(df, "list", "paraphrase")


@query("generate_prose", "nation", sql=f"SELECT 0 AS number, n_name, '{{\"text\": \"a' || n || '\"}}' AS out FROM ({_ASKED.format(p=_PROMPT)})")
def generate_prose(df):
    return _made(df, "prose", "paraphrase")


@query("generate_lines", "nation", sql=f"SELECT number, n_name, word || ' ' || n AS out FROM ({_ASKED.format(p=_PROMPT)}), (VALUES (0, 'one'), (1, 'two')) AS t(number, word)")
def generate_lines(df):
    return _made(df, "lines", "paraphrase")


_LABEL_PROMPT = _sql_prompt(generate.TEMPLATES["classify_label"], sys_prefix="''", data="'{' || chr(10) || '  \"n_name\" : \"' || n_name || '\"' || chr(10) || '}'", label_hint="'（可选标签集合：even, odd）'")


@query("generate_labels", "nation", sql=f"SELECT 0 AS number, n_name, CASE WHEN n % 2 = 0 THEN 'even' ELSE '{generate.FAILED_LABEL}' END AS out FROM ({_ASKED.format(p=_LABEL_PROMPT)})")
def generate_labels(df):
    return _made(df, "boxed", "classify_label", label_set=("even", "odd"))


@dataclass
class _Flaky(models.Backend):
    """Fails at the first call for every prompt in a process."""

    def __post_init__(self):
        self.seen = set()

    def generate(self, prompt: str) -> str:
        from .errors import ModelError

        if prompt not in self.seen:
            self.seen.add(prompt)
            raise ModelError("HTTP 500")
        return models.Fake().generate(prompt)


@query("generate_retried", "region", sql=f"SELECT r_name, 'answer ' || substr(md5({_sql_prompt(generate.TEMPLATES['q_to_a'], sys_prefix=chr(39) * 2, question='r_name')}), 1, 8) AS answer FROM region")
def generate_retried(df):
    made = generate.generate(df.select(F.col("r_name").alias("question")), generate.Generate("q_to_a", max_backoff=0.01, rps=200.0), _Flaky())
    return made.select(F.get_json_object("record", "$.instruction").alias("r_name"), F.get_json_object("record", "$.output").alias("answer"))


@query("strategy_defaults", "region", sql="SELECT * FROM (VALUES ('expand', 5), ('enhance', 1), ('paraphrase', 5), ('classify_label', 1), ('q_to_a', 5), ('custom', 1)) AS t(strategy, count)")
def strategy_defaults(df):
    return _table(df.sparkSession, [(r["strategy"], r["count"]) for r in generate.strategies()], "strategy string, count int")


@query("backend_requests", "region", sql="SELECT * FROM (VALUES ('openai', 'http://h/v1/chat/completions'), ('vllm', 'http://h/generate'), ('sglang', 'http://h/generate'), ('ollama', 'http://h/api/generate')) AS t(kind, url)")
def backend_requests(df):
    return _table(df.sparkSession, [(k, models.Http(k, "http://h/").request("p")[0]) for k in ("openai", "vllm", "sglang", "ollama")], "kind string, url string")


# --- streaming ----------------------------------------------------------------------------------------------------


@on_files("stream_windowed", "events", sql="SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windowed(path, df):
    spark = df.sparkSession
    given = df.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    given.coalesce(1).write.parquet(f"{path}/in")
    counts = resume.windowed(resume.files(spark, f"{path}/in", given.schema), "ts", "1 day", "event_type")
    name = f"w{uuid4().hex}"
    counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.col("window.start").alias("day"), "event_type", F.col("count").alias("n"))


@on_files("stream_unordered", "orders", sql="SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000")
def stream_unordered(path, df):
    spark, kept = df.sparkSession, df.select("o_orderkey", "o_totalprice")
    kept.repartition(3).write.parquet(f"{path}/in")
    for _ in range(2):  # the second run finds nothing left to do
        resume.once(resume.files(spark, f"{path}/in", kept.schema), lambda b: b.where("o_totalprice > 1000"), f"{path}/out", f"{path}/c")
    return resume.result(spark, f"{path}/out").drop("batch")


@on_files("stream_undone", "orders", sql="SELECT o_orderkey FROM orders")
def stream_undone(path, df):
    kept = df.select("o_orderkey")
    kept.where("o_orderkey % 3 = 0").write.parquet(path)
    resume.undone(kept, path, "o_orderkey").write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


@query("sink_info", "orders", sql="SELECT count(*) AS row_count, 2 AS fields FROM orders")
def sink_info(df):
    return sinks.info(df.select("o_orderkey", "o_custkey")).select("row_count", F.size("fields").alias("fields"))
