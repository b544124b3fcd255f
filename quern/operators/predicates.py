"""Typed filter conditions on columns, and the filters built from them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ParameterError
from ..functions.text import is_blank, strip

_COMPARE = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}
_LENGTH = {"len_gt": lambda a, b: a > b, "len_lt": lambda a, b: a < b, "len_eq": lambda a, b: a == b}
OPERATORS = (*_COMPARE, "contains", "not_contains", "regex", *_LENGTH, "is_null", "not_null")


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: Any = None

    def __post_init__(self):
        if not self.field or self.op not in OPERATORS:
            raise ParameterError(f"unknown condition {self.field!r} {self.op!r}")
        if self.op not in ("is_null", "not_null") and self.value is None:
            raise ParameterError(f"{self.op} needs a value")


def number(c: Column) -> Column:
    return c.try_cast("double")


def holds(c: Column, op: str, value: Any = None) -> Column:
    """Never null. A null or empty field holds for is_null only; numbers compare as numbers where both sides are numbers."""
    text = c.cast("string")
    empty = text.isNull() | (text == "")
    if op == "is_null":
        return F.coalesce(empty, F.lit(True))
    if op == "not_null":
        return ~F.coalesce(empty, F.lit(True))
    if op in _COMPARE:
        left, right = number(strip(text)), _as_number(value)
        same = F.lit(False) if op in (">", "<", ">=", "<=") else _COMPARE[op](text, F.lit(str(value)))
        told = same if right is None else F.when(left.isNotNull(), _COMPARE[op](left, F.lit(right)) & ~F.isnan(left) if op != "!=" else _COMPARE[op](left, F.lit(right)) | F.isnan(left)).otherwise(same)
    elif op == "contains":
        told = F.contains(text, F.lit(str(value)))
    elif op == "not_contains":
        told = ~F.contains(text, F.lit(str(value)))
    elif op == "regex":
        told = text.rlike(f"(?U){value}")
    elif op in _LENGTH:
        told = _LENGTH[op](F.char_length(text), int(value))
    else:
        raise ParameterError(op)
    return F.coalesce(~empty & told, F.lit(False))


def _as_number(value: Any) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def condition(df: DataFrame, conditions: Iterable[Condition], logic: str = "and") -> Column:
    """All conditions joined by AND, or by OR for any other logic. A field that df lacks counts as null."""
    told = [holds(F.col(f"`{c.field}`") if c.field in df.columns else F.lit(None).cast("string"), c.op, c.value) for c in conditions]
    return reduce((lambda a, b: a & b) if logic.lower() == "and" else (lambda a, b: a | b), told, F.lit(True) if not told or logic.lower() == "and" else F.lit(False))


def where(df: DataFrame, conditions: Iterable[Condition], logic: str = "and") -> DataFrame:
    return df.where(condition(df, conditions, logic))


def blank(df: DataFrame, name: str) -> Column:
    """Null, NaN, or a string of white space; other types are blank when null only."""
    c, kind = F.col(f"`{name}`"), dict(df.dtypes)[name]
    if kind == "string":
        return is_blank(c)
    return c.isNull() | F.isnan(c) if kind in ("double", "float") else c.isNull()


def remove_empty(df: DataFrame, fields: list[str] | None = None, mode: str = "any") -> DataFrame:
    """any: a row with one blank field goes; all: a row with nothing but blank fields goes. Fields that df lacks are passed over."""
    told = [blank(df, f) for f in (fields or df.columns) if f in df.columns]
    if not told:
        return df
    return df.where(~reduce((lambda a, b: a | b) if mode != "all" else (lambda a, b: a & b), told))


def skip_empty_rows(df: DataFrame) -> DataFrame:
    """Without rows whose every value is a blank string; a null is a value here."""
    return df.where(~reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() & is_blank(F.col(f"`{c}`").cast("string")) for c in df.columns]))


def matches(df: DataFrame, keyword: str, fields: list[str] | None = None) -> Column:
    """Case-insensitive substring of any of the fields (all by default)."""
    cols = [F.lower(F.col(f"`{f}`").cast("string")) for f in (fields or df.columns) if f in df.columns]
    return F.coalesce(F.exists(F.array(*cols), lambda x: F.coalesce(F.contains(x, F.lit(keyword.lower())), F.lit(False))), F.lit(False)) if cols else F.lit(False)


def violations(df: DataFrame, required: list[str] = (), types: dict[str, str] | None = None) -> Column:
    """What is wrong with a row: missing fields, values that are not of their type. Empty for valid rows."""
    found = [F.when(F.col(f"`{f}`").isNull() | (F.col(f"`{f}`").cast("string") == "") if f in df.columns else F.lit(True), F.lit(f"missing {f}")) for f in required]
    for f, kind in (types or {}).items():
        if f in df.columns:
            found.append(F.when(F.col(f"`{f}`").isNotNull() & F.col(f"`{f}`").cast("string").try_cast(kind).isNull(), F.lit(f"{f} is no {kind}")))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def validate(df: DataFrame, required: list[str] = (), types: dict[str, str] | None = None) -> DataFrame:
    """One row: total_rows, valid_rows, invalid_rows."""
    bad = F.size(violations(df, required, types)) > 0
    return df.select(bad.alias("bad")).agg(F.count("*").alias("total_rows"), F.count_if(~F.col("bad")).alias("valid_rows"), F.count_if(F.col("bad")).alias("invalid_rows"))
