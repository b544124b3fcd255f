"""Small literal cases of the operators' rules."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quern.errors import ParameterError, SchemaMismatch
from quern.functions import text as X
from quern.operators import clean, dedup, merge, profile, project
from quern.operators import predicates as P


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "value, op, against, expected",
    [("10", ">", "9", True), ("abc", ">", "abb", False), ("abc", "==", "abc", True), ("", "!=", "x", False), (None, "not_contains", "x", False), ("", "is_null", None, True), (" ", "is_null", None, False), ("1.0", "==", "1", True), ("x", "!=", "1", True), (" 10 ", ">=", "10", True), ("nan", "<", "5", False), ("Ab", "contains", "b", True), ("Ab", "contains", "B", False), ("été", "len_eq", 3, True), ("a1", "regex", r"\d$", True), (None, "not_null", None, False)],
)
def test_predicate(spark, value, op, against, expected):
    assert one(spark, value, lambda c: P.holds(c, op, against)) is expected


def test_conditions(spark):
    with pytest.raises(ParameterError):
        P.Condition("a", "like", "x")
    with pytest.raises(ParameterError):
        P.Condition("a", ">")
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    assert P.where(df, [P.Condition("a", ">", 1), P.Condition("c", "is_null")]).count() == 1
    assert P.where(df, [P.Condition("a", ">", 1), P.Condition("b", "==", "x")], "or").count() == 2


def test_remove_empty(spark):
    df = spark.createDataFrame([("x", " "), (None, ""), ("y", "z")], "a string, b string")
    assert [r.a for r in P.remove_empty(df).collect()] == ["y"]
    assert sorted(r.a for r in P.remove_empty(df, mode="all").collect()) == ["x", "y"]
    assert P.remove_empty(df, ["c"]).count() == 3
    assert P.skip_empty_rows(df.union(spark.createDataFrame([("", " ")], df.schema))).count() == 3


@pytest.mark.parametrize(
    "text, categories, expected",
    [
        ("call 13812345678 now", ["phone"], "call <phone> now"),
        ("手机13812345678", ["phone"], "手机13812345678"),
        ("手机 13812345678", ["phone"], "手机 <phone>"),
        ("id 110101199003078515 ok", ["id_card", "bank_card"], "id <id_card> ok"),
        ("id 110101199003078515 ok", ["bank_card", "id_card"], "id <bank_card> ok"),
        ("mail jo.e@x.org!", ["email"], "mail <EMAIL>@x.org!"),
        ("ip 10.0.0.256 and 10.0.0.25", ["ip"], "ip 10.0.0.256 and <ip>"),
        ("card 6222021234567890123", ["bank_card"], "card <bank_card>"),
        ("pass E12345678", ["passport"], "pass <passport>"),
        ("é4785380592391139", ["bank_card"], "é4785380592391139"),
    ],
)
def test_pii(spark, text, categories, expected):
    assert one(spark, text, lambda c: X.mask_pii(c, categories)) == expected


def test_pii_replacements(spark):
    assert one(spark, "a@b.co 13812345678", lambda c: X.mask_pii(c, ["email", "phone"], {"email": "$1\\", "default": "#"})) == "$1\\@b.co #"


@pytest.mark.parametrize("text, modes, expected", [("  A\t\n\n b  ", [], "A b"), ("ＡＢＣ！　x", ["fullwidth"], "ABC! x"), ("ＡＢＣ！　x", ["fullwidth", "lowercase"], "abc! x"), ("é", ["nfc"], "é"), ("a\x1cb", [], "a b")])
def test_normalize(spark, text, modes, expected):
    once = one(spark, text, lambda c: X.normalize(c, modes))
    assert once == expected == one(spark, once, lambda c: X.normalize(c, modes))


def test_scalars(spark):
    assert one(spark, "45292", X.to_day) == "2024-01-01"
    assert one(spark, None, X.to_day) == ""
    assert one(spark, "2024-05-06 07:08:09", X.to_day) == "2024-05-06"
    assert one(spark, "soon", X.to_day) == "soon"
    assert one(spark, "x \\boxed{ cat } y", X.boxed) == "cat"
    assert one(spark, "a\x00b\r\n\tc﻿", X.drop_control) == "ab\n\tc"
    assert one(spark, "1280", lambda c: X.human_size(c.cast("double"))) == "1.2KB"
    assert one(spark, "api_key = abc Token:xyz", X.mask_secrets) == "api_key = ******** Token:********"
    assert one(spark, "Bearer abc", X.mask_log) == "Bearer ****"


def test_sensitive(spark):
    df = spark.createDataFrame([("my Password (1)", "safe", 3), ("ok", None, 4)], "a string, b string, n int")
    assert clean.filter_sensitive(df, clean.Sensitive(("password",), "drop_record")).count() == 1
    rule = clean.Sensitive(("password", "(1)"), "replace_word", "$0", policies={"b": ("drop_record", None)})
    assert clean.filter_sensitive(df, rule).first().a == "my $0 $0"
    assert clean.Sensitive.policy_map("a:remove_word, b:replace_word:x") == {"a": ("remove_word", None), "b": ("replace_word", "x")}
    assert {(r.field, r.word): r.hits for r in clean.sensitive_hits(df, clean.Sensitive(("a", "s"), "remove_word")).collect()} == {("a", "a"): 1, ("a", "s"): 2, ("b", "a"): 1, ("b", "s"): 1}


def test_select_flatten_paths(spark):
    df = spark.createDataFrame([(1, "x", ("u", 3))], "a int, b string, s struct<p:string,q:int>")
    assert project.select_fields(df, ["b", "zz"], {"b": "c"}).columns == ["c"]
    none = project.select_fields(df, ["zz"])
    assert none.columns == ["zz"] and none.count() == 0
    assert project.flatten(df).columns == ["a", "b", "s.p", "s.q"]
    raw = spark.createDataFrame([('{"a":{"b":[{"c":5},{"c":null}]}}',), ('{"z":1}',), ("no",)], "v string")
    assert [r.asDict() for r in project.extract_paths(raw, "v", ["a.b[0].c", "a.b[1].c"], {"a.b[0].c": "x"}).collect()] == [{"x": "5", "a.b[1].c": None}]
    flat = lambda t: one(spark, t, project.flatten_json)
    assert flat('{"user":{"name":"Alice","age":30},"id":1}') == {"user.name": "Alice", "user.age": "30", "id": "1"}
    assert flat('{"a":[1,{"b":2}],"e":{}}') == {"a.0": "1", "a.1.b": "2"}


def test_nested_field_names(spark):
    rows = [('{"id":1,"name":"a","reasoning":{"teacher":"t","Cognitive_Difficulty":{"level":"x","score":0.5}}}',)]
    got = [tuple(r) for r in project.paths_of(spark.createDataFrame(rows, "value string")).collect()]
    assert got == [("id", "integer", False), ("name", "string", False), ("reasoning", "object", False), ("reasoning.Cognitive_Difficulty", "object", True), ("reasoning.Cognitive_Difficulty.level", "string", True), ("reasoning.Cognitive_Difficulty.score", "float", True), ("reasoning.teacher", "string", True)]


def test_truncated_and_common(spark):
    df = project.truncated(spark.createDataFrame([("abcdef",), ("ab",)], "t string"), 3)
    assert [tuple(r) for r in df.collect()] == [("abc...", True, 6), ("ab", None, None)]
    assert project.common_fields(["id", "Answer", "question_text"]) == ["Answer", "question_text"]
    assert project.common_fields(["a", "b", "c", "d"]) == ["a", "b", "c"]


@pytest.mark.parametrize("values, kind", [(["1", "2.5"], "number"), (["true", "No"], "boolean"), (["1", "0"], "number"), (["2024-01-02x", "01/02/2024"], "date"), (["a", "1"], "string"), ([], "string"), ([None], "string")])
def test_inferred(spark, values, kind):
    assert spark.createDataFrame([(values,)], "v array<string>").select(profile.inferred(F.col("v")).alias("r")).first().r == kind


def test_exact(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None), (6, ""), (7, "")], "i int, t string")
    assert sorted(r.i for r in dedup.exact(df, "t", "i").collect()) == [1, 2, 4, 5, 6, 7]
    assert sorted(r.i for r in dedup.exact(df, "t", "i", "last").collect()) == [2, 3, 4, 5, 6, 7]


def model_of_fuzzy(rows, t):
    kept = []
    for i, x in rows:
        def near(y):
            gap = abs(len(x) - len(y))
            if x == y:
                return True
            a, b = set(x), set(y)
            return gap / max(len(x), len(y)) <= 1 - t and gap / len(x) <= 1 - t and len(a & b) / len(a | b) >= 0.8 * t and SequenceMatcher(None, x, y).ratio() >= t

        if not x or not any(y and near(y) for _, y in kept):
            kept.append((i, x))
    return [i for i, _ in kept]


def test_fuzzy(spark):
    golden = [(1, "Hello world"), (2, "Hello world!"), (3, "Hello world."), (4, "Different text"), (5, "Another text")]
    df = spark.createDataFrame(golden, "i int, t string")
    assert sorted(r.i for r in dedup.fuzzy(df, "t", "i", 0.8).collect()) == [1, 4, 5]
    assert {r.i: r.is_duplicate for r in dedup.split_fuzzy(df, "t", "i", 0.8, "last").collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}
    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 14)))) for i in range(120)]
    for t in (0.7, 0.9):
        assert sorted(r.i for r in dedup.fuzzy(spark.createDataFrame(rows, "i int, t string"), "t", "i", t).collect()) == model_of_fuzzy(rows, t)


def test_merge(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([("c", 1), (None, None), ("d", None)], "v string, k int")
    assert merge.merge([a, b]).count() == 5
    pairs = lambda keep: sorted((r.v for r in merge.dedup_key([a, b], "k", keep).where("k IS NOT NULL").collect()))
    assert pairs("first") == ["a", "b"] and pairs("last") == ["b", "c"]
    assert merge.dedup_key([a, b], "k").where("k IS NULL").count() == 1
    with pytest.raises(SchemaMismatch):
        merge.append(a, b)
    with pytest.raises(SchemaMismatch):
        merge.merge([a, a.withColumnRenamed("v", "w")])
    assert merge.compare(a, a.withColumnRenamed("v", "w"))[0] == {"fits": False, "only_in_base": ["v"], "only_in_current": ["w"]}
    assert merge.target_name(["a", "b"]) == "merged_a_b" and merge.target_name(list("abcd")) == "a_and_3_others"
    deep = spark.createDataFrame([([1, 2],), ([1, 2],)], "x array<int>")
    assert merge.dedup_rows([deep]).count() == 1


def test_clean_order(spark):
    df = spark.createDataFrame([(1, " a@b.org "), (2, "a@b.org"), (3, " ")], "i int, t string")
    spec = clean.Clean(("dedup", "normalize_text", "remove_empty", "pii_desensitize", "desensitize"), pii=("email",), text_fields=("t",), dedup_field="t", threshold=1, order_by="i")
    assert [tuple(r) for r in clean.clean(df, spec).collect()] == [(1, "<EMAIL>@b.org")]
    assert clean.Clean((), threshold=7).valid_threshold == 0.95
    with pytest.raises(ParameterError):
        clean.Clean(("polish",))


def test_field_preview_cuts_strings_only(spark):
    doc = '{"a": {"n": 1234567, "f": 3.25125, "s": "12345", "t": true, "o": {"k": 123456}, "l": [1, 2, 3], "e": "", "z": null}}'
    df = spark.createDataFrame([(doc,), (None,), ("no JSON",)], "v string")
    paths = ["a.n", "a.f", "a.s", "a.t", "a.o", "a.l", "a.l[1]", "a.e", "a.z", "b"]
    want = [("1234567", "3.25125", "1234...", "true", '{"k":123456}', "[1,2,3]", "2", "", "", ""), ("",) * 10, ("",) * 10]
    for kind in (F.col("v"), F.try_parse_json("v")):
        assert [tuple(r) for r in project.field_preview(df.select(kind.alias("v")), "v", paths, 4).collect()] == want
