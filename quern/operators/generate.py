r"""Model-driven generation: prompts, calls, response parsing, quality gate, report.

Prompts, quality score and gate are column expressions. The model call and the mapping of its response run in
mapInPandas: a response gives any number of records, which come back as JSON texts beside the input's signature.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ModelError, ParameterError
from ..functions.text import boxed, is_blank
from ..models import Backend

STRATEGIES = ("expand", "enhance", "paraphrase", "classify_label", "q_to_a", "custom")
#: Where a question is looked for, the mark of a failed classification, the prompt templates.
QUESTION_FIELDS = ("question", "instruction", "input", "query", "prompt", "Question", "Instruction", "Input", "Query", "Prompt")
FAILED_LABEL = "##**分类失败**##"
TEMPLATES = {
    "expand": "\n{sys_prefix}\n原始样本：\n{sample}\n\n任务：参考上述样本，生成{count}个新的数据样本。\n{field_hint}\n\n格式要求：\n1. 必须返回标准的JSON格式数据列表。\n2. 保持数据结构与原始样本一致。\n\n请严格遵循系统提示词中的风格和内容要求进行生成。\n",
    "enhance": "\n{sys_prefix}\n原始数据：\n{data}\n\n任务：对上述数据进行增强。\n\n格式要求：\n1. 返回增强后的JSON格式数据。\n2. 保持原有信息的准确性。\n\n请严格遵循系统提示词中的风格和内容要求进行增强。\n",
    "paraphrase": "\n{sys_prefix}\n原文：\n{text}\n\n任务：对上述文本进行改写，生成{count}个版本。\n\n格式要求：\n1. 必须返回改写后的文本列表。\n2. 仅返回文本内容，不要包含任何解释或序号。\n\n请严格遵循系统提示词中的风格和内容要求进行改写。\n",
    "classify_label": "\n{sys_prefix}\n数据：\n{data}\n\n任务：为上述数据生成分类标签。{label_hint}\n\n格式要求：\n1. 请将最终的分类标签放在 \\boxed{} 中，例如 \\boxed{标签名}。\n2. 不要输出任何其他解释或JSON格式，仅输出包含在boxed中的标签。\n\n请严格遵循系统提示词中的要求。\n",
    "q_to_a": "\n{sys_prefix}\n问题：\n{question}\n\n任务：请回答上述问题。\n",
    "custom": "{sys_prefix}\n{custom_body}\n",
}


DESCRIPTIONS = {
    "expand": "new samples in the manner of a row", "enhance": "a row with more in it", "paraphrase": "the text of a row in other words",
    "classify_label": "a label for a row", "q_to_a": "an answer to a row's question", "custom": "what own prompts ask for",
}


def strategies() -> list[dict]:
    """Name, description and number of results of every strategy."""
    return [{"strategy": s, "description": DESCRIPTIONS[s], "count": Generate(s).count} for s in STRATEGIES]


@dataclass(frozen=True)
class Generate:
    strategy: str
    target_field: str = "output"
    count: int = 0
    selected_fields: tuple[str, ...] = ()
    source_field: str | None = None
    label_set: tuple[str, ...] = ()
    system_prompt: str = ""
    q_prompt: str = ""
    a_prompt: str = ""
    q_field_name: str = "instruction"
    min_length: int = 10
    max_length: int = 200_000
    threshold: float = 0.7
    attempts: int = 3
    max_backoff: float = 8.0
    rps: float | None = None

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ParameterError(f"unknown strategy {self.strategy}")
        if not self.count:
            object.__setattr__(self, "count", 5 if self.strategy in ("expand", "paraphrase", "q_to_a") else 1)

    @staticmethod
    def names(text: str) -> tuple[str, ...]:
        """A list given as text, cut at commas of either width."""
        return tuple(x.strip() for x in re.split("[,，]", text) if x.strip())


def _pieces(template: str, values: dict[str, Column | str]) -> Column:
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[(v if isinstance(v := values[x], Column) else F.lit(v)) if i % 2 and x in values else F.lit("{" + x + "}" if i % 2 else x) for i, x in enumerate(parts)])


def as_json(df: DataFrame, fields: list[str] | None = None) -> Column:
    """A row as JSON indented by two, nulls included."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in (fields or df.columns)]), {"pretty": "true", "ignoreNullFields": "false"})


def question(df: DataFrame, spec: Generate) -> Column:
    """The first non-null of the chosen fields, else of the usual ones, else the row as JSON."""
    found = [F.col(f"`{f}`").cast("string") for f in (*spec.selected_fields, *QUESTION_FIELDS) if f in df.columns]
    return F.coalesce(*found, F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))


def prompt(df: DataFrame, spec: Generate) -> Column:
    head = f"核心指令：\n{spec.system_prompt.strip()}\n\n" if spec.system_prompt.strip() else ""
    values: dict[str, Column | str] = {"sys_prefix": head, "count": str(spec.count)}
    if spec.strategy == "expand":
        hint = f"仅对以下字段进行生成/改写：{', '.join(spec.selected_fields)}。" if spec.selected_fields else "（未指定字段约束）"
        sample, told = as_json(df), F.lit(hint)
        if spec.source_field in df.columns:
            c = F.col(f"`{spec.source_field}`").cast("string")
            given = F.coalesce(c, F.lit("")) != ""
            sample = F.when(given, c).otherwise(sample)
            told = F.when(given, f"基于字段 '{spec.source_field}' 的内容进行扩写。请生成包含字段 '{spec.source_field}' 的JSON对象列表。").otherwise(told)
        values |= {"sample": sample, "field_hint": told}
    elif spec.strategy == "enhance":
        values["data"] = as_json(df)
    elif spec.strategy == "paraphrase":
        chosen = [F.col(f"`{f}`").cast("string") for f in spec.selected_fields if f in df.columns]
        if "text" in df.columns:
            chosen.append(F.when(F.col("text") != "", F.col("text")))
        values["text"] = F.coalesce(*chosen, F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    elif spec.strategy == "classify_label":
        values |= {"data": as_json(df, [c for c in df.columns if c in spec.selected_fields] or None), "label_hint": f"（可选标签集合：{', '.join(spec.label_set)}）" if spec.label_set else ""}
    elif spec.strategy == "q_to_a":
        body = _pieces(TEMPLATES["q_to_a"], values | {"question": question(df, spec)})
        before = f"{head}[Q提示]\n{spec.q_prompt.strip()}\n\n" if spec.q_prompt.strip() else ""
        after = f"\n\n[答案风格提示]\n{spec.a_prompt.strip()}" if spec.a_prompt.strip() else ""
        return F.concat(F.lit(before), body, F.lit(after))
    else:
        parts = [f"[Q]\n{spec.q_prompt}"] * bool(spec.q_prompt) + [f"[A]\n{spec.a_prompt}"] * bool(spec.a_prompt)
        values |= {"sys_prefix": "", "custom_body": "\n\n".join(parts) if parts else as_json(df)}
    return _pieces(TEMPLATES[spec.strategy], values)


def json_in(text: str) -> list | None:
    """JSON records in free text: the outermost list, else the outermost object."""
    for left, right, kind in (("[", "]", list), ("{", "}", dict)):
        a, b = text.find(left), text.rfind(right)
        if 0 <= a < b:
            try:
                found = json.loads(text[a : b + 1])
            except ValueError:
                continue
            if isinstance(found, kind) and found:
                return found if kind is list else [found]
    return None


def _question(row: dict, spec: Generate) -> str:
    return next((str(row[f]) for f in (*spec.selected_fields, *QUESTION_FIELDS) if row.get(f) is not None), json.dumps(row, ensure_ascii=False))


def _original(row: dict, spec: Generate):
    fields = ([spec.source_field] if spec.source_field else []) + list(spec.selected_fields[:1]) + list(QUESTION_FIELDS[:5])
    return next((row[f] for f in fields if row.get(f) is not None), row)


def _shown(value) -> str:
    return json.dumps(value, ensure_ascii=False) if isinstance(value, dict | list) else str(value)


def mapped(value, row: dict, spec: Generate) -> dict:
    """A generated JSON value as an output record."""
    to = spec.target_field or "output"
    if spec.strategy == "expand":
        if isinstance(value, dict):
            only = next(iter(value.values())) if len(value) == 1 else None
            named = next((value[k] for k in ("query", "question", "instruction", "text", "content") if k in value), None)
            value = only if isinstance(only, str) else named if named is not None else value
        return {"original": _original(row, spec), to: _shown(value)}
    if spec.strategy == "q_to_a":
        return {spec.q_field_name: _question(row, spec), to: _shown(value)}
    return row | {to: _shown(value)}


def from_text(text: str, row: dict, spec: Generate) -> list[dict]:
    """Output records of a response that is plain text."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    to = spec.target_field or "output"
    if not lines:
        return []
    if spec.strategy == "expand":
        return [{"original": _original(row, spec), to: "\n".join(lines)}]
    if spec.strategy == "paraphrase":
        return [row | {to: x} for x in lines]
    if spec.strategy == "classify_label":
        return [row | {to: lines[0]}]
    if spec.strategy == "q_to_a":
        return [{spec.q_field_name: _question(row, spec), to: text}]
    return [row | {to: "\n".join(lines)}]


def parse(text: str, row: dict, spec: Generate) -> list[dict]:
    """Output records of a response: JSON if it is or holds JSON, else text. Answers to questions stay as they are."""
    if spec.strategy == "q_to_a":
        return from_text(text, row, spec)
    whole = text.strip()
    if whole[:1] in ("[", "{"):
        try:
            found = json.loads(whole)
        except ValueError:
            return from_text(text, row, spec)
        found = found if isinstance(found, list) else [found]
    else:
        found = json_in(text)
    return [mapped(x, row, spec) for x in found] if found else from_text(text, row, spec)


def label_of(text: str, spec: Generate) -> str | None:
    """The boxed label if it is allowed, else null."""
    m = re.search(r"\\boxed\{(.*?)\}", text)
    label = m[1].strip() if m else None
    return label if label is not None and (not spec.label_set or label in spec.label_set) else None


def labelled(c: Column, labels: list[str]) -> Column:
    """label_of() as a column, with the failure mark where there is none."""
    found = boxed(c)
    return F.coalesce(F.when(found.isin(labels), found) if labels else found, F.lit(FAILED_LABEL))


def backoff(attempt: int, most: float, limited: bool = False) -> float:
    return min(5 * 2**attempt, 60) if limited else min(2**attempt, most)


def generate_row(row: dict, asked: str, spec: Generate, backend: Backend, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """Records for one row; a failed call is tried again after a pause, an unusable label too, up to spec.attempts times."""
    for attempt in range(spec.attempts):
        last = attempt == spec.attempts - 1
        try:
            text = backend.generate(asked)
        except ModelError as e:
            if last:
                return []
            sleep(backoff(attempt, spec.max_backoff, "429" in str(e)) + random.random() * 0.3)
            continue
        if spec.strategy == "classify_label":
            label = label_of(text, spec)
            if label is None and not last:
                continue
            return [row | {spec.target_field: FAILED_LABEL if label is None else label}]
        found = parse(text, row, spec)
        if found or last:
            return found
    return []


def generate(df: DataFrame, spec: Generate, backend: Backend) -> DataFrame:
    """Rows (prompt, record as JSON, number within the input): every record that the model's responses give.

    Calls run in the tasks, so their number at a time is that of the cores; spec.rps is the rate of the whole job and is shared out over the cores:
    a task starts a call when its turn has come, and time that calls take themselves counts.
    """
    pause = max(1, df.sparkSession.sparkContext.defaultParallelism) / spec.rps if spec.rps else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = time.monotonic()
        for batch in batches:
            out = []
            for asked, raw in zip(batch["prompt"], batch["row"], strict=True):
                if pause:
                    time.sleep(max(0.0, turn - time.monotonic()))
                    turn = max(turn, time.monotonic()) + pause
                out += [(asked, json.dumps(r, ensure_ascii=False), i) for i, r in enumerate(generate_row(json.loads(raw), asked, spec, backend))]
            yield pd.DataFrame(out, columns=["prompt", "record", "number"])

    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    return df.select(prompt(df, spec).alias("prompt"), whole.alias("row")).mapInPandas(run, "prompt string, record string, number int")


def score(columns: list[Column]) -> Column:
    """Quality of a record from its fields' texts: few fields, few characters and repeated values lower it, many characters raise it."""
    texts = [F.coalesce(c.cast("string"), F.lit("None")) for c in columns]
    chars = sum((F.char_length(t) for t in texts), F.lit(0))
    out = F.lit(0.8 if len(columns) < 2 else 1.0)
    out = F.when(chars < 50, out * 0.7).when(chars > 1000, out * 1.1).otherwise(out)
    repeated = F.size(F.array_distinct(F.array(*[F.lower(t) for t in texts]))) < len(columns)
    return F.least(F.when(repeated, out * 0.9).otherwise(out), F.lit(1.0))


def passes(df: DataFrame, fields: list[str] | None = None, spec: Generate | None = None) -> Column:
    """The quality gate over scalar fields: some content besides `original`, no NUL, length within bounds, score high enough."""
    spec = spec or Generate("custom")
    names = fields or df.columns
    cols = {n: F.col(f"`{n}`") for n in names}
    content = [n for n in names if n != "original"]
    nul = F.exists(F.array(*[cols[n].cast("string") for n in content]), lambda x: F.coalesce(F.contains(x, F.lit("\x00")), F.lit(False)))
    full = F.exists(F.array(*[F.when(cols[n].isNull() | ~is_blank(cols[n].cast("string")), F.lit(True)) for n in content]), lambda x: F.coalesce(x, F.lit(False)))
    total = sum((F.coalesce(F.char_length(c.cast("string")), F.lit(0)) for c in cols.values()), F.lit(0))
    return full & ~nul & total.between(spec.min_length, spec.max_length) & (score(list(cols.values())) >= spec.threshold)


def quality_report(df: DataFrame, passed: str, inputs: int | Column) -> DataFrame:
    """One row: total_generated, quality_passed, quality_failed, quality_pass_rate, average_generations_per_input."""
    n, ok = F.count("*"), F.count_if(F.col(passed))
    given = inputs if isinstance(inputs, Column) else F.lit(inputs)
    return df.agg(n.alias("total_generated"), ok.alias("quality_passed"), (n - ok).alias("quality_failed"), F.when(n > 0, 100.0 * ok / n).otherwise(0.0).alias("quality_pass_rate"), F.when(given > 0, n / given).otherwise(0.0).alias("average_generations_per_input"))
