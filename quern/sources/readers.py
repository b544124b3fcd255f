"""Readers by format. Text formats that have a lenient and a strict form take mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import SourceError
from ..operators.project import json_schema
from . import detect, tables


def csv(spark: SparkSession, path: str, *, sep: str = ",", infer: bool = True, lenient: bool = False, encoding: str = "utf-8") -> DataFrame:
    """infer=False: every value is text, and an empty field is '' rather than null."""
    out = spark.read.option("header", "true").option("sep", sep).option("encoding", encoding).option("multiLine", "true").option("escape", '"')
    out = out.option("inferSchema", "true") if infer else out.option("nullValue", "\u0000").option("emptyValue", "")
    found = out.option("mode", "DROPMALFORMED" if lenient else "PERMISSIVE").csv(path)
    return found if infer else found.na.fill("")


def jsonl(spark: SparkSession, path: str, *, mode: str = "lenient", schema: str | None = None, encoding: str = "utf-8") -> DataFrame:
    """lenient: blank and malformed lines are passed over; strict: blank lines and comments (# or //) are, a bad line fails."""
    lines = spark.read.option("encoding", encoding).text(path).select(F.trim("value").alias("value"))
    lines = lines.where(F.col("value") != "")
    if mode == "strict":
        lines = lines.where(~F.col("value").startswith("#") & ~F.col("value").startswith("//"))
    else:
        lines = lines.where(F.try_parse_json("value").isNotNull() & F.col("value").startswith("{"))
    kind = schema if schema is not None else json_schema(lines)
    made = F.from_json("value", kind, {"mode": "FAILFAST" if mode == "strict" else "PERMISSIVE"})
    return lines.select(made.alias("r")).select("r.*")


def variants(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as VARIANT, so that each row keeps its own keys and types; malformed lines are passed over."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("v")).where("v IS NOT NULL")


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records, one record, or an object whose first non-empty list of records is meant; values as VARIANT column v.

    A JSON document cannot be split, so a file is one task's work; write large data as JSON lines.
    """
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("w"), "value")
    first = F.lower(F.schema_of_variant("w"))
    records = F.try_variant_get("w", "$", "array<variant>")
    keys = F.json_object_keys("value")
    top = whole.withColumn("array", records).withColumn("object", first.startswith("object"))
    direct = top.where(F.col("array").isNotNull()).select(F.explode("array").alias("v"))
    each = top.where("object").select("w", "value", F.posexplode(keys).alias("n", "k"))
    inner = each.withColumn("items", F.expr("try_variant_get(try_parse_json(get_json_object(value, concat(\"$['\", k, \"']\"))), '$', 'array<variant>')"))
    lists = inner.where((F.size("items") > 0) & F.lower(F.schema_of_variant(F.get("items", F.lit(0)))).startswith("object"))
    chosen = lists.groupBy("value").agg(F.min_by("items", "n").alias("items")).select(F.explode("items").alias("v"))
    single = top.where("object").join(lists.select("value").distinct(), "value", "left_anti").select(F.col("w").alias("v"))
    return direct.union(chosen).union(single)


def json(spark: SparkSession, path: str) -> DataFrame:
    """json_records() with columns."""
    texts = json_records(spark, path).select(F.to_json("v").alias("value"))
    return texts.select(F.from_json("value", json_schema(texts)).alias("r")).select("r.*")


def json_to_lines(spark: SparkSession, path: str, target: str) -> None:
    """The records of a JSON document as JSON lines."""
    json_records(spark, path).select(F.to_json("v").alias("value")).write.text(target)


def rows(spark: SparkSession, records: dict | list[dict]) -> DataFrame:
    """Records at hand as a DataFrame; keys that a record lacks are null."""
    import json as j

    texts = spark.createDataFrame([(j.dumps(r, ensure_ascii=False),) for r in ([records] if isinstance(records, dict) else records)], "value string")
    return texts.select(F.from_json("value", json_schema(texts)).alias("r")).select("r.*")


def jsonl_preview(spark: SparkSession, path: str, limit: int = 100, schema: str | None = None) -> DataFrame:
    """The first records in the order of the lines; lines that hold a NUL are passed over, bytes that are no UTF-8 replaced."""
    lines = spark.read.text(path).where(~F.contains("value", F.lit("\x00"))).select(F.trim("value").alias("value"))
    lines = lines.where(F.try_parse_json("value").isNotNull() & F.col("value").startswith("{")).limit(limit)
    return lines.select(F.from_json("value", schema if schema is not None else json_schema(lines)).alias("r")).select("r.*")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (line_number from 1, content) of a file."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", r"[\r\n]+$", "").alias("content"))
    return rows.withColumn("line_number", F.row_number().over(Window.partitionBy("file").orderBy("id"))).select("line_number", "content")


def xml(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """Children of the root with this tag (that of the first child by default) as rows; attributes and child elements are fields alike, repeated tags lists."""
    if row_tag is None:
        first = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.regexp_replace("value", r"(?s)<[?!].*?>", ""), r"^[^<]*<[^>]*>[^<]*<([\w:.-]+)", 1)).first()
        row_tag = first[0] if first and first[0] else "row"
    return spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "").option("valueTag", "text").load(path)


def whole_files(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """Spreadsheets, Markdown tables and Arrow shards: files are read by Spark, from any store, and parsed a file a task.

    The first file (by path) gives the columns; cells of a column that a file lacks are null.
    """
    pattern = {"excel": "*.xlsx", "markdown": "*.{md,markdown,txt}", "arrow": "*.arrow"}[kind]
    if kind == "arrow" and not path.endswith(".arrow"):
        path = _split_of(spark, path, options.pop("split", None) or "train")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
    columns = tables.columns_of(kind, options)
    first = files.orderBy("path").limit(1).select("content").mapInArrow(columns, "columns string").collect()
    if not first:
        raise SourceError(f"no {kind} file below {path}")
    schema = tables.schema_of(first[0][0])
    return files.select("content").mapInArrow(tables.rows_of(kind, schema, options), schema)


def _split_of(spark: SparkSession, path: str, split: str) -> str:
    """The folder of a split, where a dataset folder has splits; the first if it lacks the one asked for."""
    told = f"{path.rstrip('/')}/dataset_dict.json"
    at = spark._jvm.org.apache.hadoop.fs.Path(told)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return path
    import json as j

    splits = j.loads(spark.read.text(told, wholetext=True).first()[0])["splits"]
    return f"{path.rstrip('/')}/{split if split in splits else splits[0]}"


def read(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """A dataset by format, which is detected if none is given. encoding="auto" takes a file's encoding from its first bytes."""
    kind = format or detect.detect(spark, path)
    if options.get("encoding") == "auto":
        options["encoding"] = detect.encoding(detect.first_bytes(spark, path))
    if kind in ("csv", "tsv"):
        return csv(spark, path, **({"sep": "\t"} if kind == "tsv" else {}) | options)
    simple = {"jsonl": jsonl, "json": json, "text": text_lines, "xml": xml}
    if kind in simple:
        return simple[kind](spark, path, **options)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("excel", "markdown", "arrow"):
        return whole_files(spark, kind, path, **options)
    raise SourceError(f"no reader for {path} ({kind})")


def first_of(*attempts):
    """The result of the first source that can be read."""
    failed = []
    for attempt in attempts:
        try:
            return attempt()
        except Exception as e:  # the next source may do
            failed.append(f"{type(e).__name__}: {e}")
    raise SourceError("no source could be read: " + "; ".join(failed))
