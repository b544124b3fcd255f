"""Queries over the driver's tables, one or more for each operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import catalog, clean, dedup, generate, merge, predicates, profile, project, search
from .operators.predicates import Condition

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None):
    """Register a function of DataFrames of the named tables."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])
        if sql:
            SQL[name] = sql
        return f

    return register


#: Unicode word boundaries as groups, for an engine whose \b is ASCII; applied twice, as neighbours share a separator.
_L, _R = r"(^|[^\pL\pM\pN_])", r"($|[^\pL\pM\pN_])"


def _twice(text: str, body: str, new: str) -> str:
    one = lambda t: f"regexp_replace({t}, '{_L}{body}{_R}', '\\1{new}\\2', 'g')"
    return one(one(text))


_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d?\d)"
_IP = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_WS = r"[\t\n\v\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_EMAIL_SQL = r"regexp_replace(regexp_replace({t}, '(^|[^\pL\pM\pN_])[A-Za-z0-9_][A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{{2,}})', '\1<EMAIL>@\2', 'g'), '(^|[^\pL\pM\pN_<])[A-Za-z0-9_][A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{{2,}})', '\1<EMAIL>@\2', 'g')"


def _norm(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '{_WS}+', ' ', 'g'), '^ +| +$', '', 'g')"


# --- flagship -----------------------------------------------------------------------------------------------------


@query("clean_documents_summary", "documents", sql=f"""
WITH d AS (SELECT doc_id, lang, {_norm(_twice(_EMAIL_SQL.format(t='text'), _IP, '<ip>'))} AS t FROM documents WHERE {_norm('text')} <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS n FROM d)
SELECT lang, count(*) AS n_docs, CAST(sum(length(t)) AS BIGINT) AS n_chars, round(avg(length(t)), 6) AS avg_chars FROM k WHERE n = 1 GROUP BY lang""")
def clean_documents_summary(docs):
    spec = clean.Clean(("remove_empty", "pii_desensitize", "normalize_text", "dedup"), empty_fields=("text",), pii=("email", "ip"), text_fields=("text",), dedup_field="text", threshold=1.0, order_by="doc_id")
    out = clean.clean(docs.select("doc_id", "lang", "text"), spec)
    n = F.char_length("text")
    return out.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(n.cast("long")).alias("n_chars"), F.round(F.avg(n), 6).alias("avg_chars"))


# --- predicates ---------------------------------------------------------------------------------------------------

for _name, _op, _sql in (("gt", ">", ">"), ("lt", "<", "<"), ("ge", ">=", ">="), ("le", "<=", "<="), ("eq", "==", "="), ("ne", "!=", "<>")):

    @query(f"filter_num_{_name}", "lineitem", sql=f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_sql} 25")
    def _(df, op=_op):
        return predicates.where(project.select_fields(df, ["l_orderkey", "l_linenumber", "l_quantity"]), [Condition("l_quantity", op, "25")])


for _name, _op, _value, _sql in (("contains", "contains", "ring", "contains(p_name, 'ring')"), ("not_contains", "not_contains", "a", "p_name <> '' AND NOT contains(p_name, 'a')"), ("regex", "regex", "^[b-g].*e\\b", "regexp_matches(p_name, '^[b-g].*e\\b')")):

    @query(f"filter_{_name}", "part", sql=f"SELECT p_partkey, p_name FROM part WHERE {_sql}")
    def _(df, op=_op, value=_value):
        return predicates.where(project.select_fields(df, ["p_partkey", "p_name"]), [Condition("p_name", op, value)])


for _name, _op, _n, _sql in (("gt", "len_gt", 2000, "> 2000"), ("lt", "len_lt", 300, "< 300"), ("eq", "len_eq", 380, "= 380")):

    @query(f"filter_len_{_name}", "documents", sql=f"SELECT doc_id FROM documents WHERE length(text) {_sql} AND text <> ''")
    def _(df, op=_op, n=_n):
        return predicates.where(df, [Condition("text", op, n)]).select("doc_id")


_LABELLED = "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
for _name, _op, _sql in (("is_null", "is_null", "IS NULL"), ("not_null", "not_null", "IS NOT NULL")):

    @query(f"filter_{_name}", "documents", "labels", sql=f"SELECT * FROM ({_LABELLED}) WHERE quality {_sql}")
    def _(docs, labels, op=_op):
        return predicates.where(docs.select("doc_id").join(labels.select("doc_id", "quality"), "doc_id", "left"), [Condition("quality", op)])


for _name, _sql in (("and", "AND"), ("or", "OR")):

    @query(f"filter_{_name}", "events", sql=f"SELECT event_id, event_type, value FROM events WHERE event_type = 'click' {_sql} value > 50")
    def _(df, logic=_name):
        return predicates.where(df.select("event_id", "event_type", "value"), [Condition("event_type", "==", "click"), Condition("value", ">", 50)], logic)


@query("filter_after_rename", "events", sql="SELECT event_id AS id, value AS amount FROM events WHERE value <= 10")
def filter_after_rename(df):
    return predicates.where(project.select_fields(df, ["event_id", "value"], {"event_id": "id", "value": "amount"}), [Condition("amount", "<=", 10), Condition("value", "is_null")])


_BLANKED = "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '  ' ELSE role END AS role, CASE WHEN conv_id % 2 = 0 AND turn % 3 = 0 THEN NULL ELSE text END AS text FROM conversations"


def _blanked(df):
    return df.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.col("role")).alias("role"), F.when((F.col("conv_id") % 2 == 0) & (F.col("turn") % 3 == 0), None).otherwise(F.col("text")).alias("text"))


@query("remove_empty_any", "conversations", sql=f"SELECT * FROM ({_BLANKED}) WHERE trim(role) <> '' AND trim(coalesce(text, '')) <> ''")
def remove_empty_any(df):
    return predicates.remove_empty(_blanked(df), ["role", "text", "absent"], "any")


@query("remove_empty_all", "conversations", sql=f"SELECT * FROM ({_BLANKED}) WHERE NOT (trim(role) = '' AND trim(coalesce(text, '')) = '')")
def remove_empty_all(df):
    return predicates.remove_empty(_blanked(df), ["role", "text"], "all")


@query("skip_empty_rows", "conversations", sql=f"SELECT role, text FROM ({_BLANKED}) WHERE NOT (trim(role) = '' AND coalesce(trim(text) = '', false))")
def skip_empty_rows(df):
    return predicates.skip_empty_rows(_blanked(df).select("role", "text"))


@query("validate_format", "orders", sql="SELECT count(*) AS total_rows, count(*) FILTER (WHERE o_orderpriority <> '' AND o_orderkey % 10 <> 0) AS valid_rows, count(*) FILTER (WHERE NOT (o_orderpriority <> '' AND o_orderkey % 10 <> 0)) AS invalid_rows FROM orders")
def validate_format(df):
    odd = df.select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("cust"), "o_orderpriority")
    return predicates.validate(odd, ["o_orderkey", "o_orderpriority"], {"cust": "long"})


# --- projection ---------------------------------------------------------------------------------------------------


@query("project_rename", "customer", sql="SELECT c_custkey AS id, c_name AS name FROM customer")
def project_rename(df):
    return project.select_fields(df, ["c_custkey", "c_name", "absent"], {"c_custkey": "id", "c_name": "name"})


@query("nested_extract_props", "events", sql="SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def nested_extract_props(df):
    return project.extract_paths(df, "props", ["k"], keep=["event_id"])


@query("flatten_props", "events", sql="SELECT event_id, user_id AS \"who.id\", event_type AS \"who.did.what\", value AS \"who.did.much\" FROM events")
def flatten_props(df):
    deep = df.select("event_id", F.struct(F.col("user_id").alias("id"), F.struct(F.col("event_type").alias("what"), F.col("value").alias("much")).alias("did")).alias("who"))
    return project.flatten(deep)


@query("flatten_json_props", "events", sql="SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS leaf FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def flatten_json_props(df):
    return df.select("event_id", F.explode(project.flatten_json(F.col("props"))).alias("path", "leaf"))


@query("cast_text", "orders", sql="SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END, '') AS cust FROM orders")
def cast_text(df):
    return project.adapt_types(df.select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("cust")), ["cust"])


@query("cast_date", "orders", sql="SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '2024-01-01' WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'soon' END AS day FROM orders")
def cast_date(df):
    given = F.when(F.col("o_orderkey") % 3 == 0, "45292").when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    return project.adapt_types(df.select("o_orderkey", given.alias("day")), date_fields=["day"])


@query("clean_control_chars", "documents", sql=r"SELECT doc_id, regexp_replace(concat('a', chr(13), chr(7), text), '[\x00-\x08\x0B-\x1F\x{FEFF}]', '', 'g') AS text FROM documents")
def clean_control_chars(df):
    return project.clean_control(df.select("doc_id", F.concat(F.lit("a\r\x07"), "text").alias("text")))


@query("truncate_preview", "documents", sql="SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS text, CASE WHEN length(text) > 200 THEN true END AS text_truncated, CASE WHEN length(text) > 200 THEN CAST(length(text) AS INTEGER) END AS text_full_length FROM documents")
def truncate_preview(df):
    return project.truncated(df.select("doc_id", "text"), 200)


@query("null_normalise", "conversations", sql=f"SELECT conv_id, turn, CASE WHEN trim(role) <> '' THEN role END AS role, CASE WHEN trim(text) <> '' THEN text END AS text FROM ({_BLANKED})")
def null_normalise(df):
    return project.blank_to_null(_blanked(df))


@query("human_size", "documents", sql="SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%.1fB', CAST(n_chars AS DOUBLE)) WHEN n_chars / 1024.0 < 1024 THEN printf('%.1fKB', n_chars / 1024.0) ELSE printf('%.1fMB', n_chars / 1048576.0) END AS size FROM documents")
def human_size(df):
    return df.select("doc_id", X.human_size(F.col("n_chars").cast("double")).alias("size"))


@query("name_parts", "customer", sql="SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS provider, c_name AS dataset FROM customer")
def name_parts(df):
    full = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit("/"), "c_name")).otherwise(F.col("c_name"))
    provider, dataset = X.name_parts(full)
    return df.select("c_custkey", provider.alias("provider"), dataset.alias("dataset"))


# --- cleaning -----------------------------------------------------------------------------------------------------


@query("sensitive_drop", "documents", sql="SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(?i)password|token')")
def sensitive_drop(df):
    return clean.filter_sensitive(df.select("doc_id", "text"), clean.Sensitive(("password", "token"), "drop_record")).select("doc_id")


@query("sensitive_replace", "documents", sql="SELECT doc_id, regexp_replace(regexp_replace(text, 'password', '$1\\', 'gi'), 'the', '$1\\', 'gi') AS text FROM documents".replace("'$1\\'", "'$1\\\\'"))
def sensitive_replace(df):
    return clean.filter_sensitive(df.select("doc_id", "text"), clean.Sensitive(("password", "the"), "replace_word", "$1\\"))


@query("sensitive_remove", "documents", sql="SELECT doc_id, source, regexp_replace(text, 'a[nt]', '', 'g') AS text FROM documents")
def sensitive_remove(df):
    return clean.filter_sensitive(df.select("doc_id", "source", "text"), clean.Sensitive(("a[nt]",), "remove_word", regex=True, case_sensitive=True, exclude=("source",)))


@query("sensitive_hits", "documents", sql="SELECT 'text' AS field, w AS word, CAST(sum((length(t) - length(replace(t, w, ''))) / length(w)) AS BIGINT) AS hits FROM (SELECT lower(text) AS t, unnest(['password', 'token']) AS w FROM documents) GROUP BY w HAVING sum(length(t) - length(replace(t, w, ''))) > 0")
def sensitive_hits(df):
    return clean.sensitive_hits(df.select("text"), clean.Sensitive(("password", "token"), "replace_word", "#"))


@query("pii_email", "documents", sql=f"SELECT doc_id, {_EMAIL_SQL.format(t='text')} AS text FROM documents")
def pii_email(df):
    return clean.desensitize(df.select("doc_id", "text"), ["email"])


for _name, _body in (("ip", _IP), ("bank_card", r"\d{13,19}"), ("phone", r"1[3-9]\d{9}"), ("passport", r"[EePpKkSsGgDd]\d{8}")):

    @query(f"pii_{_name}", "documents", sql=f"SELECT doc_id, {_twice('text', _body, f'<{_name}>')} AS text FROM documents")
    def _(df, name=_name):
        return clean.desensitize(df.select("doc_id", "text"), [name])


_ID = r"\d{6}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[0-9Xx]"


def _ids(t: str) -> str:
    one = lambda x: f"regexp_replace({x}, '(^|[^0-9A-Za-z]){_ID}($|[^0-9A-Za-z])', '\\1<id_card>\\2', 'g')"
    return one(one(t))


@query("pii_id_card", "documents", sql=f"SELECT doc_id, {_twice(_ids('text'), r'\d{13,19}', '<bank_card>')} AS text FROM documents")
def pii_id_card(df):
    return clean.desensitize(df.select("doc_id", "text"), ["id_card", "bank_card"])


@query("normalize_basic", "documents", sql=f"SELECT doc_id, {_norm('text')} AS text FROM documents")
def normalize_basic(df):
    return clean.normalize(df.select("doc_id", "text"))


@query("normalize_lower", "documents", sql=f"SELECT doc_id, lower({_norm('text')}) AS text FROM documents")
def normalize_lower(df):
    return clean.normalize(df.select("doc_id", "text"), ["lowercase"])


_ASCII, _FULL = "".join(map(chr, range(0x21, 0x7F))), "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))


@query("normalize_fullwidth", "part", sql="SELECT p_partkey, '! ' || p_name AS name FROM part")
def normalize_fullwidth(df):
    return clean.normalize(df.select("p_partkey", F.concat(F.lit("！　"), F.translate("p_name", _ASCII, _FULL)).alias("name")), ["fullwidth"])


@query("normalize_nfc", "documents", sql=f"SELECT doc_id, nfc_normalize({_norm('text')}) AS text FROM documents")
def normalize_nfc(df):
    return clean.normalize(df.select("doc_id", "text"), ["nfc"])


_MASK = r"regexp_replace({t}, '({k}\s*[=:]\s*)([^\s]+)', '\1********', 'gi')"


@query("mask_secrets", "documents", sql=f"SELECT doc_id, regexp_replace(regexp_replace({_MASK.format(k='password', t=_MASK.format(k='token', t=_MASK.format(k='api[_-]?key', t='text')))}, 'hf_[a-zA-Z0-9]{{34}}', '************', 'gi'), 'sk-[a-zA-Z0-9]{{48}}', '************', 'gi') AS text FROM documents")
def mask_secrets(df):
    return df.select("doc_id", X.mask_secrets(F.col("text")).alias("text"))


@query("mask_log", "documents")
def mask_log(df):
    return df.select("doc_id", X.mask_log(F.col("text")).alias("text"))


@query("clean_report", "documents", sql="SELECT count(*) AS input_rows, count(DISTINCT text) AS output_rows, count(*) - count(DISTINCT text) AS removed_rows, round(100.0 * (count(*) - count(DISTINCT text)) / count(*), 2) AS reduction_rate FROM documents")
def clean_report(df):
    return clean.report(df, dedup.exact(df.select("doc_id", "text"), "text", "doc_id"))


# --- dedup and merge ----------------------------------------------------------------------------------------------


@query("dedup_exact_text", "documents", sql="SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_exact_text(df):
    return dedup.exact(df.select("doc_id", "text"), "text", "doc_id")


@query("dedup_fuzzy_short", "benchmark")
def dedup_fuzzy_short(df):
    return dedup.fuzzy(df.select("item_id", "text"), "text", "item_id", 0.9)


@query("dedup_exact_last", "documents", sql="SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS n FROM documents) WHERE n = 1")
def dedup_exact_last(df):
    return dedup.exact(df.select("doc_id", "text"), "text", "doc_id", "last")


@query("dedup_fuzzy_names", "part")
def dedup_fuzzy_names(df):
    return dedup.split_fuzzy(df.select("p_partkey", "p_name"), "p_name", "p_partkey", 0.95)


def _halves(df):
    kept = df.select("o_orderkey", "o_custkey", "o_orderstatus")
    return [kept.where("o_orderkey % 3 <> 0"), kept.where("o_orderkey % 2 = 0").select("o_orderstatus", "o_custkey", "o_orderkey")]


_HALVES = "SELECT 0 AS i, o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT 1, o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0"


@query("merge_union", "orders", sql=f"SELECT o_orderkey, o_custkey, o_orderstatus FROM ({_HALVES})")
def merge_union(df):
    return merge.merge(_halves(df))


@query("merge_append", "orders", sql=f"SELECT o_orderkey, o_custkey, o_orderstatus FROM ({_HALVES})")
def merge_append(df):
    a, b = _halves(df)
    return merge.append(a, b.select(a.columns))


@query("merge_dedup_key", "orders", sql=f"SELECT o_orderkey, o_custkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY i, o_orderkey) AS n FROM ({_HALVES})) WHERE n = 1")
def merge_dedup_key(df):
    return merge.dedup_key(_halves(df), "o_custkey", "first", "o_orderkey")


@query("merge_keep_last", "orders", sql=f"SELECT o_orderkey, o_custkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY i DESC, o_orderkey DESC) AS n FROM ({_HALVES})) WHERE n = 1")
def merge_keep_last(df):
    return merge.dedup_key(_halves(df), "o_custkey", "last", "o_orderkey")


@query("merge_dedup_row", "orders", sql=f"SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus FROM ({_HALVES})")
def merge_dedup_row(df):
    return merge.dedup_rows(_halves(df))


@query("merge_counters", "orders", sql=f"SELECT count(*) AS input_rows, count(DISTINCT o_orderkey) AS output_rows, count(*) - count(DISTINCT o_orderkey) AS duplicate_rows, round(100.0 * count(DISTINCT o_orderkey) / count(*), 2) AS retention FROM ({_HALVES})")
def merge_counters(df):
    halves = _halves(df)
    return merge.counters(halves, merge.dedup_rows(halves))


@query("signature_antijoin", "conversations", sql="SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND md5(text) NOT IN (SELECT md5(text) FROM conversations WHERE role = 'user' AND conv_id % 2 = 0)")
def signature_antijoin(df):
    asked = df.where("role = 'user'").select("conv_id", "turn", "text")
    done = asked.where("conv_id % 2 = 0").select(F.md5("text").alias("signature"))
    return merge.unprocessed(asked, done, question=F.col("text"))


# --- profiles, search, catalog ------------------------------------------------------------------------------------


@query("profile_columns", "events", sql=" UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS total_count, count(*) - count({v}) AS null_count, CASE WHEN count(*) > 0 THEN 1 - count({v}) / CAST(count(*) AS DOUBLE) ELSE 1.0 END AS null_rate, count(DISTINCT {v}) AS unique_count, coalesce(avg(length({v})), 0.0) AS avg_length, CAST(coalesce(max(length({v})), 0) AS INTEGER) AS max_length FROM events" for c, v in (("event_id", "CAST(event_id AS VARCHAR)"), ("event_type", "CASE WHEN trim(event_type) <> '' THEN event_type END"), ("props", "CASE WHEN trim(props) <> '' THEN props END"))))
def profile_columns(df):
    return profile.profile_columns(df.select("event_id", "event_type", "props"))


@query("profile_fields", "events", sql=" UNION ALL ".join(f"SELECT '{c}' AS name, '{t}' AS type, (SELECT list(v ORDER BY event_id) FROM (SELECT event_id, CAST({c} AS VARCHAR) AS v FROM events ORDER BY event_id LIMIT 3)) AS sample_values, CAST(0.0 AS DOUBLE) AS null_ratio" for c, t in (("event_id", "number"), ("event_type", "string"), ("props", "string"))))
def profile_fields(df):
    return profile.profile_fields(df.select("event_id", "event_type", "props"), "event_id")


@query("hidden_columns", "documents", sql="""
WITH s AS (SELECT 'doc_id' AS c, count(*) AS n, count(doc_id) AS f, count(DISTINCT doc_id) AS u, avg(length(CAST(doc_id AS VARCHAR))) AS l FROM documents
UNION ALL SELECT 'text', count(*), count(nullif(trim(text), '')), count(DISTINCT text), avg(length(text)) FROM documents
UNION ALL SELECT 'source', count(*), count(source), count(DISTINCT source), avg(length(source)) FROM documents
UNION ALL SELECT 'n_chars_order', count(*), count(n_chars), count(DISTINCT n_chars), avg(length(CAST(n_chars AS VARCHAR))) FROM documents)
SELECT c AS hidden FROM s WHERE NOT regexp_matches(c, 'id|text|name|type|content|key') AND (f <= 0.05 * n OR (u = 1 AND n > 5) OR regexp_matches(c, 'source|order|index|meta') OR (l < 5 AND u < 3) OR length(c) <= 2)""")
def hidden_columns(df):
    seen = df.withColumn("n_chars_order", F.col("n_chars"))
    return df.sparkSession.createDataFrame([(c,) for c in profile.hidden_columns(seen.select("doc_id", "text", "source", "n_chars_order"))], "hidden string")


@query("distinct_keys", "events", sql="SELECT DISTINCT unnest(json_keys(props)) AS key FROM events")
def distinct_keys(df):
    return profile.distinct_keys(F.col("props"), df)


_FOUND = "SELECT * FROM (SELECT '{0}' AS dataset, {1} AS line_number FROM {2} WHERE {3} ORDER BY 2 LIMIT 50)"


@query("search_keyword", "documents", "conversations", "part", sql=" UNION ALL ".join((
    _FOUND.format("documents", "doc_id", "documents", "contains(lower(text), 'ing') OR contains(lower(source), 'ing')"),
    _FOUND.format("conversations", "conv_id * 1000 + turn", "conversations", "contains(lower(text), 'ing')"),
    _FOUND.format("part", "p_partkey", "part", "contains(lower(p_name), 'ing') OR contains(lower(p_type), 'ing')"))))
def search_keyword(docs, convs, parts):
    turns = convs.select((F.col("conv_id") * 1000 + F.col("turn")).alias("place"), "text")
    found = search.search({"documents": docs.select("doc_id", "text", "source"), "conversations": turns, "part": parts.select("p_partkey", "p_name", "p_type")}, "ING", ["text", "source", "p_name", "p_type"], order_by={"documents": "doc_id", "conversations": "place", "part": "p_partkey"})
    return found.select("dataset", "line_number")


@query("search_stop", "documents", sql="""
WITH d AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM documents)), h AS (
SELECT d.i, d.source AS dataset, doc_id AS line_number, row_number() OVER (PARTITION BY d.source ORDER BY doc_id) AS n FROM documents JOIN d ON d.source = documents.source WHERE contains(lower(text), 'e')),
k AS (SELECT * FROM h WHERE n <= 50), c AS (SELECT i, count(*) AS n FROM k GROUP BY i), b AS (SELECT i, coalesce(sum(n) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT dataset, line_number FROM k JOIN b ON k.i = b.i WHERE before < 120""")
def search_stop(docs):
    names = [r[0] for r in docs.select("source").distinct().orderBy("source").collect()]  # the datasets' names
    return search.search({n: docs.where(F.col("source") == n).select("doc_id", "text") for n in names}, "e", ["text"], order_by=dict.fromkeys(names, "doc_id"), stop=120).select("dataset", "line_number")


@query("storage_stats", "documents", sql="SELECT lang AS grp, CAST(sum(n_chars) AS BIGINT) AS size, count(*) AS count, round(100.0 * sum(n_chars) / (SELECT sum(n_chars) FROM documents), 2) AS percentage FROM documents GROUP BY lang")
def storage_stats(df):
    return catalog.storage_stats(df, "lang", "n_chars")


@query("provider_rollup", "documents", sql="SELECT source, lang, count(*) AS file_count, CAST(sum(n_chars) AS BIGINT) AS total_size, max(doc_id) AS latest FROM documents GROUP BY source, lang UNION ALL SELECT source, NULL, count(*), CAST(sum(n_chars) AS BIGINT), max(doc_id) FROM documents GROUP BY source")
def provider_rollup(df):
    return catalog.rollup(df, "source", "lang", "n_chars", "doc_id")


@query("dataset_summary", "documents", sql="SELECT count(DISTINCT source) AS file_count, list_sort(list(DISTINCT lang)) AS formats, CAST(sum(n_chars) AS BIGINT) AS total_size FROM documents")
def dataset_summary(df):
    return catalog.summary(df, "source", "lang", "n_chars")


@query("topk_largest", "documents", sql="SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def topk_largest(df):
    return search.top(df.select("doc_id", "n_chars"), "n_chars", 10, "doc_id")


@query("topk_recent", "events", sql="SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 10")
def topk_recent(df):
    return search.top(df.select("event_id", "ts"), "ts", 10, "event_id")


@query("head_preview", "events", sql="SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 100")
def head_preview(df):
    return search.head(df.select("event_id", "event_type"), 100, "event_id")


@query("per_file_quota", "documents", sql="SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, dense_rank() OVER (ORDER BY source) AS f FROM documents) WHERE n <= 12 AND f <= 10 ORDER BY source, doc_id LIMIT 100")
def per_file_quota(df):
    return search.preview_files(df.select("source", "doc_id"), "source", "doc_id")


# --- generation ---------------------------------------------------------------------------------------------------


@query("prompt_build_qa", "conversations", sql="SELECT conv_id, turn, concat(chr(10), '核心指令：', chr(10), 'Be brief', chr(10), chr(10), chr(10), '问题：', chr(10), text, chr(10), chr(10), '任务：请回答上述问题。', chr(10)) AS prompt FROM conversations WHERE role = 'user'")
def prompt_build_qa(df):
    asked = df.where("role = 'user'")
    spec = generate.Generate("q_to_a", selected_fields=("text",), system_prompt="Be brief")
    return asked.select("conv_id", "turn", generate.prompt(asked, spec).alias("prompt"))


@query("prompt_build_paraphrase", "conversations", sql="SELECT conv_id, turn, concat(chr(10), chr(10), '原文：', chr(10), text, chr(10), chr(10), '任务：对上述文本进行改写，生成5个版本。', chr(10), chr(10), '格式要求：', chr(10), '1. 必须返回改写后的文本列表。', chr(10), '2. 仅返回文本内容，不要包含任何解释或序号。', chr(10), chr(10), '请严格遵循系统提示词中的风格和内容要求进行改写。', chr(10)) AS prompt FROM conversations WHERE text <> ''")
def prompt_build_paraphrase(df):
    some = df.where("text <> ''")
    return some.select("conv_id", "turn", generate.prompt(some, generate.Generate("paraphrase", selected_fields=("text",))).alias("prompt"))


_DATA = "'{' || chr(10) || '  \"role\" : ' || to_json(role) || ',' || chr(10) || '  \"text\" : ' || to_json(text) || chr(10) || '}'"


def _filled(template: str, **values: str) -> str:
    """A prompt template as a SQL expression."""
    out = "'" + template.replace("'", "''") + "'"
    for k, v in values.items():
        out = out.replace("{" + k + "}", f"' || {v} || '")
    return out


@query("prompt_build_classify", "conversations", sql=f"SELECT conv_id, turn, {_filled(generate.TEMPLATES['classify_label'], sys_prefix=chr(39) * 2, data=_DATA, label_hint=chr(39) + '（可选标签集合：ask, tell）' + chr(39))} AS prompt FROM conversations")
def prompt_build_classify(df):
    spec = generate.Generate("classify_label", selected_fields=("role", "text"), label_set=("ask", "tell"))
    return df.select("conv_id", "turn", generate.prompt(df, spec).alias("prompt"))


@query("label_extract", "labels", sql="SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN '##**分类失败**##' ELSE '##**分类失败**##' END AS label FROM labels")
def label_extract(df):
    told = F.when(F.col("toxic") == 1, "it is \\boxed{ toxic } or \\boxed{x}").when(F.col("quality") == 1, "\\boxed{good}").otherwise("none")
    return df.select("doc_id", generate.labelled(told, ["toxic", "clean"]).alias("label"))


_SCORE = "least(1.0, (CASE WHEN length(role) + length(text) < 50 THEN 0.7 WHEN length(role) + length(text) > 1000 THEN 1.1 ELSE 1.0 END) * (CASE WHEN lower(role) = lower(text) THEN 0.9 ELSE 1.0 END))"


@query("quality_score", "conversations", sql=f"SELECT conv_id, turn, CAST({_SCORE} AS DOUBLE) AS score FROM conversations")
def quality_score(df):
    return df.select("conv_id", "turn", generate.score([F.col("role"), F.col("text")]).alias("score"))


_PASS = f"(trim(role) <> '' OR trim(text) <> '') AND length(role) + length(text) BETWEEN 10 AND 200000 AND {_SCORE} >= 0.7"


@query("quality_gate", "conversations", sql=f"SELECT conv_id, turn FROM conversations WHERE {_PASS}")
def quality_gate(df):
    return df.where(generate.passes(df, ["role", "text"])).select("conv_id", "turn")


@query("quality_report", "conversations", sql=f"SELECT count(*) AS total_generated, count(*) FILTER (WHERE {_PASS}) AS quality_passed, count(*) - count(*) FILTER (WHERE {_PASS}) AS quality_failed, CAST(100.0 * count(*) FILTER (WHERE {_PASS}) / count(*) AS DOUBLE) AS quality_pass_rate, CAST(count(*) / CAST(count(DISTINCT conv_id) AS DOUBLE) AS DOUBLE) AS average_generations_per_input FROM conversations")
def quality_report(df):
    judged = df.withColumn("ok", generate.passes(df, ["role", "text"]))
    return generate.quality_report(judged, "ok", F.count_distinct("conv_id"))


@query("generate_answers", "conversations", sql="SELECT conv_id, turn, concat('answer ', substr(md5(concat(chr(10), chr(10), '问题：', chr(10), text, chr(10), chr(10), '任务：请回答上述问题。', chr(10))), 1, 8)) AS answer FROM conversations WHERE role = 'user'")
def generate_answers(df):
    asked = df.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    spec = generate.Generate("q_to_a")
    made = generate.generate(asked, spec, generate_backend()).select("prompt", F.get_json_object("record", "$.output").alias("answer")).distinct()
    return asked.select("conv_id", "turn", generate.prompt(asked, spec).alias("prompt")).join(made, "prompt").select("conv_id", "turn", "answer")


def generate_backend():
    from .models import Fake

    return Fake()


# --- streaming ----------------------------------------------------------------------------------------------------


def stream_clean_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a file stream, cleaned in micro-batches; repeated signatures are dropped by bounded state."""
    from uuid import uuid4

    from .storage import shared_dir
    from .streaming import resume

    root = f"{shared_dir(spark)}/stream-{uuid4().hex}"
    path = f"{sf_dir}/events.parquet"
    stream = resume.files(spark, f"{sf_dir}/event[s].parquet", spark.read.parquet(path).schema).withColumn("ts", F.col("ts").cast("timestamp"))
    once = resume.distinct_by(stream, "event_id", "ts")
    resume.once(once, lambda b: predicates.where(b, [Condition("value", ">", 20)]).select("event_id", F.upper("event_type").alias("event_type"), "value"), f"{root}/out", f"{root}/checkpoint", "event_id")
    return resume.result(spark, f"{root}/out").drop("batch")


QUERIES["stream_clean_events"] = stream_clean_events
SQL["stream_clean_events"] = "SELECT event_id, upper(event_type) AS event_type, value FROM events WHERE value > 20"


# --- formats ------------------------------------------------------------------------------------------------------


def _round_trip(format_: str, columns: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from uuid import uuid4

        from .sources import read, write
        from .storage import shared_dir

        path = f"{shared_dir(spark)}/formats-{uuid4().hex}"
        df = spark.read.parquet(f"{sf_dir}/customer.parquet").select(*columns)
        write(df, path, format_)
        return read(spark, path, format_).select(*[F.col(c).cast(df.schema[c].dataType) for c in columns])

    return run


for _f in ("csv", "jsonl", "json", "markdown", "excel", "arrow", "parquet"):
    QUERIES[f"format_{_f}"] = _round_trip(_f, ["c_custkey", "c_name", "c_mktsegment"])
    SQL[f"format_{_f}"] = "SELECT c_custkey, c_name, c_mktsegment FROM customer"
