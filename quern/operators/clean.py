"""Cleaning in a fixed order: empty records, sensitive words, personal data, normalisation, duplicates."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ParameterError
from ..functions import text as X
from . import dedup
from .predicates import remove_empty

#: The words masked where none are given.
DEFAULT_WORDS = ("密码", "password", "身份证", "idcard", "手机号", "phone", "邮箱", "email", "地址", "address", "银行卡", "bankcard")
OPERATIONS = ("remove_empty", "filter_sensitive", "pii_desensitize", "normalize_text", "dedup")


@dataclass(frozen=True)
class Sensitive:
    """action: remove_word, replace_word, drop_record (anything else replaces). policies: field -> (action, replacement)."""

    words: tuple[str, ...] = DEFAULT_WORDS
    action: str = "replace_word"
    replacement: str = "***"
    fields: tuple[str, ...] | None = None
    exclude: tuple[str, ...] = ()
    policies: dict[str, tuple[str | None, str | None]] = field(default_factory=dict)
    regex: bool = False
    case_sensitive: bool = False

    @classmethod
    def policy_map(cls, text: str) -> dict[str, tuple[str | None, str | None]]:
        """`field:action[:replacement]`, a line or comma for each."""
        parts = [p.split(":", 2) for p in text.replace("\n", ",").split(",") if ":" in p]
        return {p[0].strip(): (p[1].strip(), p[2].strip() if len(p) > 2 else None) for p in parts}

    def pattern(self, word: str) -> str:
        return ("" if self.case_sensitive else "(?iu)") + (f"(?U){word}" if self.regex else X.escape(word))

    def plan(self, df: DataFrame) -> dict[str, tuple[str, str]]:
        """String fields to treat, with action and replacement."""
        out = {}
        for name, kind in df.dtypes:
            if kind == "string" and (self.fields is None or name in self.fields) and name not in self.exclude:
                action, new = self.policies.get(name, (None, None))
                out[name] = (action or self.action, self.replacement if new is None else new)
        return out


def filter_sensitive(df: DataFrame, rule: Sensitive) -> DataFrame:
    drop, new = [], {}
    for name, (action, replacement) in rule.plan(df).items():
        c = F.col(f"`{name}`")
        if action == "drop_record":
            drop += [c.rlike(rule.pattern(w)) for w in rule.words]
        else:
            new[name] = reduce(lambda x, w: F.regexp_replace(x, rule.pattern(w), "" if action == "remove_word" else X.quoted(replacement)), rule.words, c)
    kept = df.where(~F.coalesce(reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), drop, F.lit(False)), F.lit(False))) if drop else df
    return kept.withColumns(new) if new else kept


def sensitive_hits(df: DataFrame, rule: Sensitive) -> DataFrame:
    """Rows (field, word, hits): substitutions of each word, applied one after the other; for drop_record the first hit of a row."""
    counts = []
    for name, (action, replacement) in rule.plan(df).items():
        c, before = F.col(f"`{name}`"), F.lit(False)
        for w in rule.words:
            if action == "drop_record":
                hit = F.coalesce(c.rlike(rule.pattern(w)), F.lit(False))
                n, before = (hit & ~before).cast("long"), before | hit
            else:
                n = F.coalesce(F.regexp_count(c, F.lit(rule.pattern(w))), F.lit(0))
                c = F.regexp_replace(c, rule.pattern(w), "" if action == "remove_word" else X.quoted(replacement))
            counts.append(F.struct(F.lit(name).alias("field"), F.lit(w).alias("word"), F.sum(n).alias("hits")))
    return df.agg(F.array(*counts).alias("a")).select(F.explode("a").alias("x")).select("x.*").where("hits > 0") if counts else df.sparkSession.createDataFrame([], "field string, word string, hits long")


def desensitize(df: DataFrame, categories: list[str], replacements: dict[str, str] | None = None, fields: list[str] | None = None) -> DataFrame:
    return df.withColumns({n: X.mask_pii(F.col(f"`{n}`"), categories, replacements) for n, kind in df.dtypes if kind == "string" and (fields is None or n in fields)})


def normalize(df: DataFrame, modes: list[str] = (), fields: list[str] | None = None) -> DataFrame:
    return df.withColumns({n: X.normalize(F.col(f"`{n}`"), modes) for n, kind in df.dtypes if kind == "string" and (fields is None or n in fields)})


@dataclass(frozen=True)
class Clean:
    """What to do; the order of `operations` is of no account. order_by decides which duplicate is first."""

    operations: tuple[str, ...]
    empty_fields: tuple[str, ...] | None = None
    empty_mode: str = "any"
    sensitive: Sensitive = Sensitive()
    pii: tuple[str, ...] = ()
    pii_replacements: dict[str, str] = field(default_factory=dict)
    modes: tuple[str, ...] = ()
    text_fields: tuple[str, ...] | None = None
    dedup_field: str | None = None
    threshold: float = 0.95
    order_by: str | Column | None = None

    def __post_init__(self):
        if unknown := [o for o in self.operations if o not in (*OPERATIONS, "desensitize")]:  # desensitize is taken and does nothing
            raise ParameterError(f"unknown operations {unknown}")

    @property
    def valid_threshold(self) -> float:
        return self.threshold if 0 < self.threshold <= 1 else 0.95


def clean(df: DataFrame, spec: Clean) -> DataFrame:
    fields = list(spec.text_fields) if spec.text_fields else None
    if "remove_empty" in spec.operations:
        df = remove_empty(df, list(spec.empty_fields) if spec.empty_fields else None, spec.empty_mode)
    if "filter_sensitive" in spec.operations:
        df = filter_sensitive(df, spec.sensitive)
    if "pii_desensitize" in spec.operations:
        df = desensitize(df, list(spec.pii), spec.pii_replacements, fields)
    if "normalize_text" in spec.operations:
        df = normalize(df, list(spec.modes), fields)
    if "dedup" in spec.operations and spec.dedup_field in df.columns:
        df = dedup.exact(df, spec.dedup_field, spec.order_by) if spec.valid_threshold >= 0.99 else dedup.fuzzy(df, spec.dedup_field, spec.order_by, spec.valid_threshold)
    return df


def preview(spark, text: str, rule: Sensitive) -> str | None:
    """What a rule makes of one text; null where it drops the record."""
    got = filter_sensitive(spark.createDataFrame([(text,)], "preview string"), rule).first()
    return got[0] if got else None


def report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: input_rows, output_rows, removed_rows, reduction_rate in per cent."""
    a, b = before.agg(F.count("*").alias("input_rows")), after.agg(F.count("*").alias("output_rows"))
    both = a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").drop("k")
    return both.withColumn("removed_rows", F.col("input_rows") - F.col("output_rows")).withColumn("reduction_rate", F.when(F.col("input_rows") > 0, F.round(100.0 * F.col("removed_rows") / F.col("input_rows"), 2)).otherwise(0.0))
