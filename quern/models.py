"""Text-generation back-ends behind one interface, a deterministic one for tests, and the model registry."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from .errors import ModelError, ParameterError


class Backend:
    def generate(self, prompt: str) -> str:
        raise NotImplementedError


@dataclass(frozen=True)
class Fake(Backend):
    """A pure function of the prompt, so that retried tasks give the same records. {hash} and {prompt} are filled in."""

    template: str = "answer {hash}"

    def generate(self, prompt: str) -> str:
        return self.template.replace("{hash}", hashlib.md5(prompt.encode()).hexdigest()[:8]).replace("{prompt}", prompt)


@dataclass(frozen=True)
class Http(Backend):
    """kind: openai, vllm, sglang or ollama."""

    kind: str
    url: str
    model: str = ""
    api_key: str = ""
    system_prompt: str = ""
    max_tokens: int = 2048
    temperature: float = 0.7
    top_p: float = 0.9
    timeout: float = 120.0
    headers: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in ("openai", "vllm", "sglang", "ollama"):
            raise ParameterError(f"unknown back-end {self.kind}")
        if not self.url.startswith(("http://", "https://")):
            raise ParameterError("a model's URL begins with http:// or https://")

    def request(self, prompt: str) -> tuple[str, dict]:
        base, options = self.url.rstrip("/"), {"temperature": self.temperature, "top_p": self.top_p}
        if self.kind == "ollama":
            return base if base.endswith("/api/generate") else f"{base}/api/generate", {"model": self.model, "prompt": prompt, "stream": False, "options": options | {"num_predict": self.max_tokens}}
        if self.kind == "sglang":
            return base if base.endswith("/generate") else f"{base}/generate", {"text": prompt, "sampling_params": options | {"max_new_tokens": self.max_tokens}}
        if self.kind == "vllm":
            return base if base.endswith("/generate") else f"{base}/generate", {"prompt": prompt, "max_tokens": self.max_tokens} | options
        messages = ([{"role": "system", "content": self.system_prompt}] if self.system_prompt else []) + [{"role": "user", "content": prompt}]
        path = base if base.endswith("/chat/completions") else f"{base}/chat/completions" if base.endswith("/v1") else f"{base}/v1/chat/completions"
        return path, {"model": self.model, "messages": messages, "max_tokens": self.max_tokens} | options

    def text_of(self, answer: dict) -> str:
        if self.kind == "ollama":
            return answer.get("response") or answer.get("text") or json.dumps(answer, ensure_ascii=False)
        if self.kind == "sglang":
            return answer.get("text") or answer.get("output_text") or json.dumps(answer, ensure_ascii=False)
        if self.kind == "vllm":
            text = answer.get("text") or answer.get("output") or ((answer.get("outputs") or [{}])[0].get("text", ""))
            return text[0] if isinstance(text, list) else text
        message = answer["choices"][0].get("message") or {}
        thought, content = message.get("reasoning_content"), message.get("content") or ""
        return f"<think>\n{thought}\n</think>\n\n{content}" if thought else content

    def generate(self, prompt: str) -> str:
        url, body = self.request(prompt)
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {}) | self.headers
        try:
            with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=self.timeout) as got:
                return self.text_of(json.load(got))
        except urllib.error.HTTPError as e:
            raise ModelError(f"HTTP {e.code}") from e
        except (OSError, ValueError, LookupError) as e:
            raise ModelError(str(e)) from e

    def test(self) -> dict:
        """Whether a short call succeeds, and how long it took in ms."""
        began = time.time()
        try:
            text = replace(self, max_tokens=10, timeout=min(self.timeout, 30)).generate("Hello")
            return {"status": "online", "response_time": round((time.time() - began) * 1000, 2), "text": text}
        except ModelError as e:
            return {"status": "offline", "response_time": round((time.time() - began) * 1000, 2), "error": str(e)}


class Registry:
    """Models by name in a JSON file. Keys stay out of the file: a model names the environment variable that holds its key."""

    def __init__(self, path: str):
        self.path = Path(path)
        self.models: dict[str, dict] = json.loads(self.path.read_text(encoding="utf-8")) if self.path.exists() else {}

    def _save(self) -> None:
        part = self.path.with_suffix(".tmp")
        part.write_text(json.dumps(self.models, ensure_ascii=False, indent=2), encoding="utf-8")
        part.replace(self.path)

    def add(self, name: str, backend: Http, key_variable: str = "") -> None:
        if name in self.models:
            raise ParameterError(f"model {name} exists")
        self.models[name] = {k: v for k, v in asdict(backend).items() if k != "api_key"} | {"key_variable": key_variable, "status": "unknown", "response_time": None, "created": time.strftime("%Y-%m-%dT%H:%M:%S")}
        self._save()

    def update(self, name: str, **changes) -> None:
        if name not in self.models:
            raise ParameterError(f"no model {name}")
        self.models[name] |= changes
        self._save()

    def delete(self, name: str) -> None:
        if self.models.pop(name, None) is None:
            raise ParameterError(f"no model {name}")
        self._save()

    def get(self, name: str) -> Http:
        import os

        m = self.models[name]
        return Http(**{k: m[k] for k in Http.__dataclass_fields__ if k in m}, api_key=os.environ.get(m["key_variable"], "") if m["key_variable"] else "")

    def active(self) -> list[str]:
        return [n for n, m in self.models.items() if m["status"] == "online"]

    def rows(self, spark):
        """The registry as a DataFrame (name, kind, status, response_time), for statistics."""
        return spark.createDataFrame([(n, m["kind"], m["status"], m["response_time"]) for n, m in self.models.items()], "name string, kind string, status string, response_time double")


def statistics(models):
    """Rows (kind, total, online, mean_response_time of online models, two places)."""
    from pyspark.sql import functions as F

    online = F.col("status") == "online"
    return models.groupBy("kind").agg(F.count("*").alias("total"), F.count_if(online).alias("online"), F.round(F.avg(F.when(online, F.col("response_time"))), 2).alias("mean_response_time"))
