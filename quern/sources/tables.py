"""Parsers of whole files (Markdown tables, workbooks, Arrow files), and data sources that write workbooks and Arrow files.

Reading goes through Spark's own file reader (readers.whole_files). Writers use pyarrow's file systems: a folder that all
tasks share, or a store that pyarrow knows.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

from ..errors import SourceError


def _fs(path: str):
    from pyarrow import fs

    found = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return found


def markdown_table(text: str) -> tuple[list[str], list[list[str]]]:
    """Header and rows of the first table; rows of another width are left out."""
    block = re.search(r"(?:^[^\S\n]*\|[^\n]*\|[^\S\n]*(?:\n|\Z))(?:[^\S\n]*\S[^\n]*(?:\n|\Z))*", text, re.M)
    if not block:
        raise SourceError("no Markdown table")
    lines = [x.strip() for x in block[0].strip().split("\n")]
    cells = [[c.strip() for c in x.split("|")[1:-1]] for x in lines if x.startswith("|") and x.endswith("|")]
    return cells[0], [r for r in cells[2:] if len(r) == len(cells[0])]


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(raw: bytes, sheet: str | None = None) -> list[list[str | None]]:
    """Rows of a sheet (the first by default) of an Office Open XML workbook, cells as text."""
    book = zipfile.ZipFile(io.BytesIO(raw))
    names = set(book.namelist())
    shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_NS}si")] if "xl/sharedStrings.xml" in names else []
    sheets = [(s.get("name"), s.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet")]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    chosen = next((i for n, i in sheets if n == sheet), None if sheet else sheets[0][1])
    if chosen is None:
        raise SourceError(f"no sheet {sheet}")
    target = targets[chosen].lstrip("/")
    out = []
    for row in ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_NS}row"):
        cells: list[str | None] = []
        for c in row.iter(f"{_NS}c"):
            at = _column(c.get("r", "")) if c.get("r") else len(cells)
            cells += [None] * (at + 1 - len(cells))
            value = c.find(f"{_NS}v")
            if c.get("t") == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
            elif value is not None:
                cells[at] = shared[int(value.text)] if c.get("t") == "s" else {"1": "true", "0": "false"}.get(value.text, value.text) if c.get("t") == "b" else value.text
        out.append(cells)
    return out


def workbook(header: list[str], rows: list[list[str | None]], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet; texts that read as plain numbers are numbers."""
    from xml.sax.saxutils import escape, quoteattr

    def letters(n: int) -> str:
        out = ""
        n += 1
        while n:
            n, r = divmod(n - 1, 26)
            out = chr(65 + r) + out
        return out

    def cell(i: int, j: int, v: str | None) -> str:
        if v is None:
            return ""
        ref = f"{letters(j)}{i}"
        if i > 1 and re.fullmatch(r"-?(0|[1-9]\d{0,14})(\.\d+)?", v):
            return f'<c r="{ref}"><v>{v}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", v))}</t></is></c>'

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    body = "".join(f'<row r="{i}">{"".join(cell(i, j, v) for j, v in enumerate(r))}</row>' for i, r in enumerate([header, *rows], 1))
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'{head}<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def table_of(kind: str, raw: bytes, options: dict) -> tuple[list[str], list[list[str | None]]]:
    """Header and rows, as text, of a Markdown table or a sheet."""
    if kind == "markdown":
        return markdown_table(raw.decode(options.get("encoding") or "utf-8", "replace"))
    rows = sheet_rows(raw, options.get("sheet"))
    return ([x or "" for x in rows[0]], [r for r in rows[1:] if any(x is not None for x in r)]) if rows else ([], [])


def columns_of(kind: str, options: dict):
    """For mapInArrow: the schema of each file, as JSON."""

    def run(batches):
        for batch in batches:
            out = []
            for raw in batch.column(0).to_pylist():
                if kind == "arrow":
                    from pyspark.sql.pandas.types import from_arrow_schema

                    out.append(from_arrow_schema(arrow_batches(raw)[0].schema).json())
                else:
                    out.append(StructType([StructField(h, StringType()) for h in table_of(kind, raw, options)[0]]).json())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["columns"])

    return run


def schema_of(text: str) -> StructType:
    return StructType.fromJson(json.loads(text))


def rows_of(kind: str, schema: StructType, options: dict):
    """For mapInArrow: the rows of each file."""
    names = [f.name for f in schema.fields]

    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                if kind == "arrow":
                    for b in arrow_batches(raw):
                        yield b.select(names)
                    continue
                header, rows = table_of(kind, raw, options)
                at = {h: i for i, h in enumerate(header)}
                cells = [[r[at[n]] if n in at and at[n] < len(r) else None for r in rows] for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cells], names=names)

    return run


class _Message(WriterCommitMessage):
    pass


class ExcelWriter(DataSourceWriter):
    """One workbook a task, split further after max_rows rows."""

    def __init__(self, options, schema, overwrite: bool):
        self.options, self.names, self.overwrite = dict(options), [f.name for f in schema.fields], overwrite

    def write(self, iterator):
        import uuid

        f, p = _fs(self.options["path"])
        f.create_dir(p, recursive=True)
        limit, part, rows = int(self.options.get("max_rows", 1_048_575)), 1, []
        if not 0 < limit <= 1_048_575:
            raise SourceError("a sheet holds 1048576 rows, its header included")
        job = uuid.uuid4().hex[:12]

        def flush():
            nonlocal part, rows
            with f.open_output_stream(f"{p}/{job}_part{part}.xlsx") as s:
                s.write(workbook(self.names, rows, self.options.get("sheet", "Sheet1")))
            part, rows = part + 1, []

        for row in iterator:
            rows.append([None if v is None else str(v) for v in row])
            if len(rows) >= limit:
                flush()
        if rows:
            flush()
        return _Message()


class ExcelSource(DataSource):
    @classmethod
    def name(cls):
        return "xlsx"

    def writer(self, schema, overwrite):
        return ExcelWriter(self.options, schema, overwrite)


def arrow_batches(raw: bytes):
    try:
        file = pa.ipc.open_file(pa.BufferReader(raw))
        return [file.get_batch(i) for i in range(file.num_record_batches)]
    except pa.ArrowInvalid:
        return list(pa.ipc.open_stream(pa.BufferReader(raw)))


class ArrowSource(DataSource):
    @classmethod
    def name(cls):
        return "arrow_ipc"

    def writer(self, schema, overwrite):
        return ArrowWriter(self.options, schema)


class ArrowWriter(DataSourceWriter):
    def __init__(self, options, schema):
        self.options, self.fields = dict(options), schema

    def write(self, iterator):
        import uuid

        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.fields)
        f, p = _fs(self.options["path"])
        f.create_dir(p, recursive=True)
        with f.open_output_stream(f"{p}/data-{uuid.uuid4().hex}.arrow") as s, pa.ipc.new_stream(s, schema) as w:
            rows: list = []
            for row in iterator:
                rows.append(row.asDict(recursive=True))
                if len(rows) >= 10_000:
                    w.write_batch(pa.RecordBatch.from_pylist(rows, schema=schema))
                    rows = []
            if rows:
                w.write_batch(pa.RecordBatch.from_pylist(rows, schema=schema))
        return _Message()


def register(spark) -> None:
    for source in (ExcelSource, ArrowSource):
        spark.dataSource.register(source)
