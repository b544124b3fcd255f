import json
import time

import pytest
from pyspark.sql import functions as F

from quern.errors import ModelError, ParameterError
from quern.models import Backend, Fake, Http, Registry, statistics
from quern.operators import generate as G


def test_parse():
    row = {"question": "q", "n": 1}
    spec = G.Generate("enhance")
    assert G.parse('[{"a": 1}, "x"]', row, spec) == [row | {"output": '{"a": 1}'}, row | {"output": "x"}]
    assert G.parse('so: [1, 2] done', row, spec) == [row | {"output": "1"}, row | {"output": "2"}]
    assert G.parse("{broken", row, spec) == [row | {"output": "{broken"}]
    assert G.parse(" a \n\n b ", row, G.Generate("paraphrase")) == [row | {"output": "a"}, row | {"output": "b"}]
    assert G.parse('{"only": "t"}', row, G.Generate("expand")) == [{"original": "q", "output": "t"}]
    assert G.parse('{"a": 1, "text": "t"}', row, G.Generate("expand")) == [{"original": "q", "output": "t"}]
    assert G.parse(" [1] ", row, G.Generate("q_to_a")) == [{"instruction": "q", "output": " [1] "}]
    assert G.parse(" \n ", row, spec) == []


def test_label_and_retry():
    class Flaky(Backend):
        calls = 0

        def generate(self, prompt):
            self.calls += 1
            if self.calls == 1:
                raise ModelError("HTTP 429")
            return "\\boxed{ cat }" if self.calls == 3 else "none"

    waits = []
    spec = G.Generate("classify_label", label_set=("cat",))
    assert G.generate_row({"x": 1}, "p", spec, Flaky(), waits.append) == [{"x": 1, "output": "cat"}]
    assert 5 <= waits[0] < 5.31
    assert G.generate_row({"x": 1}, "p", spec, Fake("no"), waits.append) == [{"x": 1, "output": G.FAILED_LABEL}]
    assert [G.backoff(k, 8) for k in range(5)] == [1, 2, 4, 8, 8] and G.backoff(4, 8, True) == 60


@pytest.mark.parametrize("texts, score", [(["x" * 60], 0.8), (["x" * 20], 0.56), (["x" * 10, "y" * 10], 0.7), (["A" * 15, "a" * 15], 0.63), (["x" * 30, "x" * 30], 0.9), (["x" * 1200], 0.88)])
def test_quality(spark, texts, score):
    df = spark.createDataFrame([tuple(texts)], [f"f{i}" for i in range(len(texts))])
    got = df.select(G.score([F.col(c) for c in df.columns]).alias("s"), G.passes(df).alias("p")).first()
    assert got.s == pytest.approx(score) and got.p == (score >= 0.7)


def test_gate(spark):
    df = spark.createDataFrame([("o" * 60, " "), ("o", "a\x00b" + "c" * 60), ("o", "d" * 60)], "original string, output string")
    assert [r.p for r in df.select(G.passes(df).alias("p")).collect()] == [False, False, True]


def test_prompts(spark):
    df = spark.createDataFrame([("Why?", None)], "question string, Answer string")
    text = lambda **k: df.select(G.prompt(df, G.Generate(**k)).alias("p")).first().p
    assert text(strategy="q_to_a", system_prompt=" S ", q_prompt="Q", a_prompt="A") == "核心指令：\nS\n\n[Q提示]\nQ\n\n\n核心指令：\nS\n\n\n问题：\nWhy?\n\n任务：请回答上述问题。\n\n\n[答案风格提示]\nA"
    assert "\\boxed{标签名}" in text(strategy="classify_label", label_set=("a", "b")) and "（可选标签集合：a, b）" in text(strategy="classify_label", label_set=("a", "b"))
    assert "生成3个新的数据样本" in text(strategy="expand", count=3) and "Why?" in text(strategy="expand", source_field="question")
    assert text(strategy="custom", q_prompt="x") == "\n[Q]\nx\n".lstrip("\n").join(["\n", ""])
    assert G.Generate.names("a，b, c") == ("a", "b", "c")
    with pytest.raises(ParameterError):
        G.Generate("dream")


def test_generate(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    out = G.generate(df, G.Generate("paraphrase", selected_fields=("text",)), Fake("one\ntwo")).collect()
    assert sorted((json.loads(r.record)["id"], json.loads(r.record)["output"], r.number) for r in out) == [(1, "one", 0), (1, "two", 1), (2, "one", 0), (2, "two", 1)]


def test_backends(tmp_path, spark):
    assert Http("openai", "http://h/v1", "m").request("p")[0] == "http://h/v1/chat/completions"
    assert Http("ollama", "http://h", "m").request("p")[1]["options"]["num_predict"] == 2048
    assert Http("openai", "http://h").text_of({"choices": [{"message": {"content": "c", "reasoning_content": "r"}}]}) == "<think>\nr\n</think>\n\nc"
    with pytest.raises(ParameterError):
        Http("openai", "ftp://h")
    with pytest.raises(ModelError):
        Http("openai", "http://127.0.0.1:9", timeout=1).generate("p")
    reg = Registry(str(tmp_path / "m.json"))
    reg.add("a", Http("ollama", "http://h", api_key="k"))
    reg.update("a", status="online", response_time=10.0)
    assert Registry(str(tmp_path / "m.json")).active() == ["a"] and "k" not in json.loads((tmp_path / "m.json").read_text())["a"].values()
    assert tuple(statistics(reg.rows(spark)).first()) == ("ollama", 1, 1, 10.0)
    began = time.time()
    assert reg.get("a").kind == "ollama" and time.time() - began < 1
