"""Field and column profiles, type inference, columns that a preview hides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank

#: Words that read as booleans, and shapes of dates.
BOOLEANS = ("true", "false", "1", "0", "yes", "no", "y", "n")
DATES = (r"^\d{4}-\d{2}-\d{2}", r"^\d{2}/\d{2}/\d{4}", r"^\d{4}/\d{2}/\d{2}")
#: Parts of names of columns that matter, and of columns that do not.
IMPORTANT = (
    "instruction", "input", "output", "response", "answer", "question", "query", "prompt",
    "text", "content", "message", "conversation", "dialogue", "chat",
    "label", "target", "category", "class", "type", "tag", "classification",
    "id", "name", "title", "subject", "topic", "key",
    "指令", "输入", "输出", "回答", "问题", "内容", "文本", "标签", "类别", "名称", "标题",
    "问", "答", "对话", "聊天", "回复", "响应",
)
TRIVIAL = (
    "meta", "metadata", "version", "timestamp", "created", "updated", "modified",
    "uuid", "hash", "checksum", "index", "seq", "sequence", "order", "sort",
    "temp", "tmp", "debug", "test", "example", "sample", "dummy",
    "source", "origin", "raw", "original", "backup", "old", "prev", "previous",
)


def inferred(values: Column) -> Column:
    """Type of an array of text samples: number before boolean before date before string; no sample is a string."""
    shown = F.filter(values, lambda x: x.isNotNull())
    all_ = lambda test: F.forall(shown, test)
    date = lambda x: x.rlike("|".join(DATES))
    return F.when(F.size(shown) == 0, "string").when(all_(lambda x: x.try_cast("double").isNotNull()), "number").when(all_(lambda x: F.lower(x).isin(*BOOLEANS)), "boolean").when(all_(date), "date").otherwise("string")


def _long(df: DataFrame, order_by: str | None = None) -> DataFrame:
    fields = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(df.columns)])
    return df.select(*([F.col(order_by).alias("o")] if order_by else [F.monotonically_increasing_id().alias("o")]), F.explode(fields).alias("f")).select("o", "f.*")


def profile_fields(df: DataFrame, order_by: str | None = None, sample: int | None = 100, samples: int = 3) -> DataFrame:
    """Rows (name, type, sample_values, null_ratio) over the first `sample` rows (all rows for None)."""
    head = df if sample is None else (df.orderBy(order_by) if order_by else df).limit(sample)
    rows = _long(head, order_by)
    empty = F.col("v").isNull() | (F.col("v") == "")
    kept = F.array_compact(F.array(*[F.col(f"x{k}") for k in range(samples)]))
    stats = rows.groupBy("i", "name").agg((F.count_if(empty) / F.count("*")).alias("null_ratio"))
    for k in range(samples):  # the k-th place is the least beyond the place before: a combined minimum, never a list
        before = stats.select(F.col("i").alias("i2"), F.col(f"x{k - 1}.o").alias("past")) if k else None
        open_ = rows.where(~empty) if k == 0 else rows.where(~empty).join(before, F.col("i") == F.col("i2")).where(F.col("o") > F.col("past"))
        stats = stats.join(open_.groupBy("i").agg(F.min(F.struct("o", "v")).alias(f"x{k}")), "i", "left")
    values = F.transform(kept, lambda x: x.v)
    return stats.select("i", "name", inferred(values).alias("type"), values.alias("sample_values"), "null_ratio").orderBy("i").drop("i")


def profile_columns(df: DataFrame, exact: bool = True, order_by: str | None = None, samples: int = 5) -> DataFrame:
    """Rows (name, total_count, null_count, null_rate, unique_count, avg_length, max_length); one pass over df.

    Blank strings are nulls. Distinct values are counted by their hashes of 64 bits, so no long value is shuffled; exact=False counts them by a sketch,
    which shuffles none. order_by adds sample_values: those of the first rows in that order, `samples` at most.
    """
    parts = []
    for c in df.columns:
        v = F.col(f"`{c}`").cast("string")
        full = F.when(~is_blank(v), v)
        n = F.count(full)
        unique = F.count_distinct(F.when(full.isNotNull(), F.xxhash64(full))) if exact else F.approx_count_distinct(full)
        parts.append(F.struct(F.lit(c).alias("name"), F.count(F.lit(1)).alias("total_count"), (F.count(F.lit(1)) - n).alias("null_count"), F.when(F.count(F.lit(1)) > 0, 1 - n / F.count(F.lit(1))).otherwise(1.0).alias("null_rate"), unique.alias("unique_count"), F.coalesce(F.avg(F.char_length(full)), F.lit(0.0)).alias("avg_length"), F.coalesce(F.max(F.char_length(full)), F.lit(0)).alias("max_length")))
    out = df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    if order_by is None:
        return out
    first = profile_fields(df, order_by, None, samples).select("name", "sample_values")
    return out.join(first, "name")


def hidden_columns(df: DataFrame) -> list[str]:
    """Columns a preview leaves out: (nearly) empty, constant over more than five rows, or trivial; three stay in any case."""
    stats = [r.asDict() for r in profile_columns(df).collect()]  # a row a column
    important = lambda c: any(k in c.lower() for k in IMPORTANT)
    trivial = lambda s: any(k in s["name"].lower() for k in TRIVIAL) or (s["avg_length"] < 5 and s["unique_count"] < 3) or len(s["name"]) <= 2
    hidden = [s["name"] for s in stats if not important(s["name"]) and (s["null_rate"] >= 0.95 or (s["unique_count"] == 1 and s["total_count"] > 5 and s["name"].lower() != "id") or trivial(s))]
    if len(hidden) == len(stats):
        hidden = [s["name"] for s in sorted(stats, key=lambda s: s["null_rate"])[3:]]
    return hidden


def schema_info(df: DataFrame) -> list[dict]:
    return [{"column": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields]


def distinct_keys(c: Column, df: DataFrame) -> DataFrame:
    """The distinct top-level keys of a JSON text column."""
    return df.select(F.explode(F.json_object_keys(c)).alias("key")).distinct()
