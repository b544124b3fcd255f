import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from quern.errors import SourceError
from quern.operators import catalog
from quern.sources import download
from quern.sources.readers import first_of

BODY = bytes(range(256)) * 40


class Handler(BaseHTTPRequestHandler):
    asked: list = []

    def do_GET(self):
        span = self.headers.get("Range")
        Handler.asked.append(span)
        if self.path == "/none":
            self.send_error(404)
            return
        at = int(span[6:-1]) if span else 0
        self.send_response(206 if span else 200)
        self.send_header("Content-Length", str(len(BODY) - at))
        self.end_headers()
        self.wfile.write(BODY[at:])

    def log_message(self, *a):
        pass


@pytest.fixture
def server():
    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_fetch(server, tmp_path):
    Handler.asked = []
    assert download.fetch(f"{server}/a", str(tmp_path / "x" / "a")).read_bytes() == BODY
    (tmp_path / "b.tmp").write_bytes(BODY[:1000])
    assert download.fetch(f"{server}/b", str(tmp_path / "b")).read_bytes() == BODY
    assert Handler.asked == [None, "bytes=1000-"]
    with pytest.raises(SourceError):
        download.fetch(f"{server}/none", str(tmp_path / "c"))


def test_retry_and_chain():
    calls, waits = [], []

    def fails():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("no")
        return "yes"

    assert download.retry(fails, sleep=waits.append) == "yes" and waits == [2.0, 4.0]
    assert first_of(lambda: 1 / 0, lambda: "second") == "second"
    with pytest.raises(SourceError):
        first_of(lambda: 1 / 0)


def test_datasets(spark, tmp_path):
    for p in ("p/one/train/a.parquet", "p/one/test/b.parquet", "two/c.jsonl"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    got = download.datasets(catalog.files(spark, str(tmp_path)), str(tmp_path)).collect()
    assert [(r.dataset, r.files) for r in got] == [("p/one", 2), ("two", 1)]
