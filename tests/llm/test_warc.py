"""WARC derivatives against a plain HTML reader of the standard library, broken pages and cut archives."""

import gzip
import html.parser
import random
import time

from quern.llm import warc


class Reader(html.parser.HTMLParser):
    """Visible text as (word or line break)s, title and links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.title, self.links, self.hidden, self.titled = [], "", 0, [], False

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.titled = True
        if tag.encode() in warc.HIDDEN:
            self.hidden.append(tag)
            self.out.append(" ")
        elif not self.hidden:
            self.links += tag == "a" and "href" in dict(attrs)
            self.out += ["\n"] * (tag.encode() in warc.BREAKS)

    def handle_endtag(self, tag):
        if tag == "title":
            self.titled = False
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()
        elif not self.hidden:
            self.out += ["\n"] * (tag.encode() in warc.BREAKS)

    def handle_comment(self, data):
        self.out += [" "] * (not self.hidden)

    def handle_data(self, data):
        if self.titled:
            self.title += data
        elif not self.hidden:
            self.out.append(data)


def lines(text):
    return [" ".join(x.split()) for x in text.split("\n") if x.strip()]


def test_sound_pages_against_the_standard_reader():
    rnd = random.Random(1)
    word = lambda: rnd.choice(["alpha", "Beta", "3 &lt; 4", "&amp;", "caf&eacute;", "日本", "x"])

    def body(depth):
        if depth == 0 or rnd.random() < 0.2:
            return " ".join(word() for _ in range(rnd.randint(0, 5)))
        inner = "".join(body(depth - 1) for _ in range(rnd.randint(1, 4)))
        tag = rnd.choice(["p", "div", "b", "I", "h2", "li", "span", "a"])
        return rnd.choice([f"<{tag}>{inner}</{tag}>", f'<{tag} class="u">{inner}</{tag}>', f"<a href='/q'>{inner}</a>", f"{inner}<br/>", f"<!-- c {word()} -->{inner}", f"<script>if (a {rnd.choice('<>')} b) x()</script>{inner}", f"<style>p {{}}</style>{inner}"])

    for _ in range(300):
        page = f"<!DOCTYPE html><html><head><title>T {word()}</title><style>q</style></head><body>{body(4)}</body></html>"
        r = Reader()
        r.feed(page)
        r.close()
        text, title, links = warc.scanned(page)
        assert lines(text) == lines("".join(r.out)) and title == " ".join(r.title.split()) and links == r.links


def test_broken_pages_cost_no_more():
    for piece in ("<a ", "<", "<script", "<!--", "</", "<p", "<title", "&", "<a href", "<head><title", "</script ", "<script>", "<a href=' "):
        page = piece * (2_000_000 // len(piece))
        began = time.time()
        warc.scanned(page)
        assert time.time() - began < 20, piece


def test_odd_pages():
    assert warc.scanned("a < b <p")[0] == "a < b <p"
    assert warc.scanned("x<script>y")[0] == "x" and warc.scanned("x<!-- y")[0] == "x"
    assert warc.scanned("")[0] == "" and warc.scanned("<title>only")[1] == "only"


def test_encodings(spark):
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n"
    packed = gzip.compress("<p>café".encode("latin-1"))
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in (packed[:10], packed[10:])) + b"0\r\n\r\n"
    rows = [("a", "u", "d", head, chunked), ("b", "u", "d", head, b"no chunks"), (None, "u1", None, "Content-Type: text/html; charset=hex", b"<p>one"), (None, "u2", None, None, b"<p>one")]
    got = [r for r in warc.derive(spark.createDataFrame(rows, "record_id string, target_uri string, date string, http_headers string, payload binary")).collect() if r.warc_type == "conversion"]
    assert [bytes(r.block).decode() for r in got] == ["café", "no chunks", "one", "one"]
    assert got[0].source_digest == warc.digest(chunked)
    assert got[2].refers_to is None and "WARC-Refers-To:" not in got[2].headers and got[2].record_id != got[3].record_id


def test_cut_archives():
    one = lambda i, body: b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(body), body)
    whole = one(1, b"x" * 50) + one(2, b"y" * 50)
    for n in range(len(whole)):
        got = [h["warc-record-id"] for h, _ in warc.parse(whole[:n])]
        assert got == ["<1>", "<2>"][: len(got)]
    packed = gzip.compress(one(1, b"x" * 50)) + gzip.compress(one(2, b"y" * 50))
    assert [h["warc-record-id"] for h, _ in warc.parse(packed)] == ["<1>", "<2>"]
    assert [h["warc-record-id"] for h, _ in warc.parse(packed[:-5])][:1] == ["<1>"]
    assert list(warc.parse(b"")) == [] and list(warc.parse(packed[:7])) == []
