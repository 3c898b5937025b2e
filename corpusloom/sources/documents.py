"""Readers of DOCX and PDF files with the standard library, in Arrow batches.

A file is a row (id, content); a reader gives a row for each block or page, and for a file it
can't read one row with an error."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DC = "{http://purl.org/dc/elements/1.1/}"
#: Bytes that a part of a package may have when unpacked.
MOST_XML = 64 * 1024 * 1024


def _runs(paragraph) -> str:
    out = []
    for x in paragraph.iter():
        if x.tag == _W + "t":
            out.append(x.text or "")
        elif x.tag == _W + "tab":
            out.append("\t")
        elif x.tag in (_W + "br", _W + "cr"):
            out.append("\n")
    return "".join(out)


def docx_blocks(content: bytes) -> tuple[str | None, list[tuple[str, int | None, int | None]]]:
    """(title, blocks) in the order of the body; a block is (text, table, row), the last two for
    rows of tables. Cells are joined by tabs; blank blocks are left out, but rows are counted."""
    if content[:8] == bytes.fromhex("d0cf11e0a1b11ae1"):
        raise ValueError("encrypted")
    try:
        package = zipfile.ZipFile(io.BytesIO(content))
        names = set(package.namelist())
    except zipfile.BadZipFile:
        raise ValueError("not_a_package") from None
    if "word/document.xml" not in names:
        raise ValueError("not_a_document")

    def part(name: str):
        if package.getinfo(name).file_size > MOST_XML:
            raise ValueError("too_large")
        raw = package.read(name)
        if b"<!DOCTYPE" in raw[:4096]:
            raise ValueError("has_dtd")
        return ElementTree.fromstring(raw)

    try:
        body = part("word/document.xml").find(_W + "body")
        title = part("docProps/core.xml").findtext(_DC + "title") if "docProps/core.xml" in names else None
    except (ElementTree.ParseError, zipfile.BadZipFile, zlib.error, EOFError):
        raise ValueError("corrupt") from None
    blocks: list[tuple[str, int | None, int | None]] = []
    table = 0
    for child in body if body is not None else []:
        if child.tag == _W + "p":
            blocks.append((_runs(child), None, None))
        elif child.tag == _W + "tbl":
            for number, row in enumerate(child.findall(_W + "tr")):
                cells = ["\n".join(_runs(p) for p in cell.iter(_W + "p")).strip() for cell in row.findall(_W + "tc")]
                blocks.append(("\t".join(cells), table, number))
            table += 1
    return (title if title and title.strip() else None), [x for x in blocks if x[0].strip()]


_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\nendstream", re.S)
_SHOW = re.compile(rb"\((?:\\.|[^\\()])*\)\s*(?:Tj|'|\")|<[0-9A-Fa-f\s]*>\s*Tj|\[(?:\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|[^\]])*\]\s*TJ|T\*|ET\b|-?[\d.]+\s+-?[\d.]+\s+T[dD]\b", re.S)
_TEXT = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(raw: bytes, table: dict[int, str] | None) -> str:
    if raw[:1] == b"<":
        data = bytes.fromhex("".join(raw[1:-1].decode("ascii").split()).ljust(0) + ("0" if len(b"".join(raw[1:-1].split())) % 2 else ""))
    else:
        data = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1][-1:] == b"\n" and m[1] != b"n" else _ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.S)
    if table:
        width = 2 if max(table) > 255 or len(data) % 2 == 0 and all(int.from_bytes(data[i : i + 2], "big") in table for i in range(0, len(data), 2)) else 1
        return "".join(table.get(int.from_bytes(data[i : i + width], "big"), "") for i in range(0, len(data), width))
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("cp1252", "replace")


def _unicode_map(cmap: bytes) -> dict[int, str]:
    out: dict[int, str] = {}
    for section in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", section):
            out[int(a, 16)] = bytes.fromhex(b.decode()).decode("utf-16-be", "replace")
    for section in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, z, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", section):
            for i in range(int(a, 16), min(int(z, 16), int(a, 16) + 65535) + 1):
                out[i] = chr(int(b, 16) + i - int(a, 16))
    return out


def pdf_pages(content: bytes) -> tuple[str | None, list[str]]:
    """(title, text of each page, in page order) of simple files: objects in the open, streams
    as they are or deflated, texts in simple encodings or with a ToUnicode table."""
    if content[:5] != b"%PDF-":
        raise ValueError("not_a_pdf")
    if b"/Encrypt" in content:
        raise ValueError("encrypted")
    objects: dict[int, bytes] = {int(m[1]): m[3] for m in _OBJECT.finditer(content)}
    if not objects:
        raise ValueError("corrupt")

    def data(number: int) -> bytes:
        m = _STREAM.match(objects.get(number, b""))
        if not m:
            return b""
        if b"/FlateDecode" in m[1]:
            inflater = zlib.decompressobj()
            try:
                out = inflater.decompress(m[2], MOST_XML)
                more = inflater.unconsumed_tail and inflater.decompress(inflater.unconsumed_tail, 1)
            except zlib.error:
                raise ValueError("corrupt") from None
            if more:
                raise ValueError("too_large")
            return out
        return m[2]

    def ref(source: bytes, key: bytes) -> list[int]:
        m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", source)
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []

    root = next((x for x in objects.values() if re.search(rb"/Type\s*/Catalog", x)), None)
    if root is None:
        raise ValueError("corrupt")
    order: list[int] = []
    todo, seen = ref(root, b"Pages")[::-1], set()
    while todo:
        n = todo.pop()
        if n in seen:
            continue
        seen.add(n)
        kids = ref(objects.get(n, b""), b"Kids")
        if kids:
            todo += kids[::-1]
        elif re.search(rb"/Type\s*/Page\b", objects.get(n, b"")):
            order.append(n)
    pages = []
    for n in order:
        tables: dict[int, str] = {}
        reach, depth = [objects[n]], 0
        while reach and depth < 4:  # the page's fonts, through its resources
            reach = [objects.get(int(x), b"") for o in reach for x in re.findall(rb"(\d+)\s+\d+\s+R", re.sub(rb"/Parent\s+\d+\s+\d+\s+R|/Contents\s*(?:\[[^\]]*\]|\d+\s+\d+\s+R)", b"", _STREAM.sub(rb"\1", o)))]
            for o in reach:
                for t in ref(o, b"ToUnicode"):
                    tables |= _unicode_map(data(t))
            depth += 1
        out: list[str] = []
        for m in _SHOW.finditer(b"\n".join(data(x) for x in ref(objects[n], b"Contents"))):
            shown = m[0]
            if shown.endswith((b"T*", b"ET", b"Td", b"TD")):
                if out and not out[-1].endswith("\n") and not (shown.endswith((b"Td", b"TD")) and float(shown.split()[1]) == 0):
                    out.append("\n")
            else:
                out += [_literal(x, tables or None) for x in _TEXT.findall(shown)]
                if shown.rstrip().endswith((b"'", b'"')):
                    out.append("\n")
        pages.append("".join(out))
    info = re.search(rb"/Info\s+(\d+)\s+\d+\s+R", content)
    m = re.search(rb"/Title\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)", objects.get(int(info[1]), b"")) if info else None
    title = _literal(m[1], None) if m else None
    return (title if title and title.strip() else None), pages


def _read(files: DataFrame, id_col: str, reader, fields: str) -> DataFrame:
    names = [id_col, *[x.split()[0] for x in fields.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, x in enumerate(batch.column(1)):
                try:
                    rows += [(i, *row, None) for row in reader(x.as_py() or b"")]
                except ValueError as e:
                    rows.append((i, *[None] * (len(names) - 2), str(e)))
            columns = [list(x) for x in zip(*rows, strict=True)] or [[]] * len(names)
            kinds = [pa.string() if f.endswith("string") else pa.int32() for f in fields.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *[pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)]], names=names)

    given = files.select(id_col, "content")
    return given.mapInArrow(run, f"{id_col} {given.schema[id_col].dataType.simpleString()}, {fields}")


def read_docx(files: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, position, text, table_index, row_index, title, error)."""

    def rows(content: bytes):
        title, blocks = docx_blocks(content)
        if not blocks:
            raise ValueError("no_text")
        return [(i, text, table, row, title) for i, (text, table, row) in enumerate(blocks)]

    return _read(files, id_col, rows, "position int, text string, table_index int, row_index int, title string, error string")


def read_pdf(files: DataFrame, id_col: str = "id", reader=pdf_pages) -> DataFrame:
    """(id, position, page, text, title, error) of pages that aren't blank; pages count from 1.
    Another reader, content -> (title, pages), can take the place of this simple one."""

    def rows(content: bytes):
        title, pages = reader(content)
        kept = [(n, x) for n, x in enumerate(pages, 1) if x.strip()]
        if not kept:
            raise ValueError("no_text")
        return [(i, n, x, title) for i, (n, x) in enumerate(kept)]

    return _read(files, id_col, rows, "position int, page int, text string, title string, error string")
