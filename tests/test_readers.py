"""Readers and parsers against small made-up inputs."""

import io
import json
import struct
import zipfile
import zlib

import pytest

from corpusloom.functions import digests
from corpusloom.operators.word_errors import score, words
from corpusloom.sources import documents, media
from corpusloom.sources.visible_html import visible

NBSP = chr(0xA0)


@pytest.mark.parametrize(
    ("html", "text", "title"),
    [
        ("<div>Rain fell</div><div>all day</div>", "Rain fell\n\nall day", None),
        ("<li><b>red</b> <i>fox</i></li>", "red fox", None),
        ("lead<h3>head</h3>tail", "lead\n\nhead\n\ntail", None),
        ("<td>up<br/>down</td>", "up\ndown", None),
        ("<pre>up<br> <br>\n<br>down</pre>", "up\n\ndown", None),
        ("x &lt;&amp;lt; y", "x <&lt; y", None),
        ("<p>&nbsp;held\t\n tight&#160;</p>", f"{NBSP}held tight{NBSP}", None),
        ("seen<style>q > p { a: '</p>' }</style> too", "seen too", None),
        ("<template>no<svg>no</template>yes</svg>", "yes", None),
        ("<noscript>no<p>no", "", None),
        ("one<!-- <p> -->word", "oneword", None),
        ("<head>no<title>\n</title><title> Of  two </title></head>body<title>Third</title>", "body", "Of two"),
        ("", "", None),
    ],
)
def test_visible_html(html, text, title):
    assert visible(html) == (text, title)


def _docx(body: str, title: str | None = None) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
        if title is not None:
            z.writestr("docProps/core.xml", f'<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{title}</dc:title></c>')
    return out.getvalue()


def _p(text: str) -> str:
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_docx():
    table = f"<w:tbl><w:tr><w:tc>{_p('a')}</w:tc><w:tc>{_p('b')}</w:tc></w:tr><w:tr><w:tc>{_p(' ')}</w:tc></w:tr><w:tr><w:tc>{_p('c')}</w:tc></w:tr></w:tbl>"
    assert documents.docx_blocks(_docx(_p("one") + table + _p(" ") + _p("two"), "T")) == ("T", [("one", None, None), ("a\tb", 0, 0), ("c", 0, 2), ("two", None, None)])
    assert documents.docx_blocks(_docx(_p("x"), "  "))[0] is None
    for bad, code in ((b"", "not_a_package"), (bytes.fromhex("d0cf11e0a1b11ae1") + b"x", "encrypted")):
        with pytest.raises(ValueError, match=code):
            documents.docx_blocks(bad)


def _pdf(pages: list[str], title: str | None = None) -> bytes:
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{10 + 2 * i} 0 R' for i in range(len(pages)))}] /Count {len(pages)} >>"]
    out = b"%PDF-1.4\n" + b"".join(f"{i + 1} 0 obj {o} endobj\n".encode() for i, o in enumerate(objects))
    for i, text in enumerate(pages):
        stream = zlib.compress(f"BT /F1 12 Tf 72 720 Td ({text}) Tj ET".encode()) if text else b""
        filters = "/Filter /FlateDecode " if text else ""
        out += f"{10 + 2 * i} 0 obj << /Type /Page /Parent 2 0 R /Contents {11 + 2 * i} 0 R >> endobj\n{11 + 2 * i} 0 obj << {filters}/Length {len(stream)} >> stream\n".encode() + stream + b"\nendstream endobj\n"
    if title is not None:
        out += f"9 0 obj << /Title ({title}) >> endobj\n".encode()
    return out + b"trailer << /Root 1 0 R" + (b" /Info 9 0 R" if title is not None else b"") + b" >>\n%%EOF"


def test_pdf_too_large(monkeypatch):
    import zlib

    text = b"BT (" + b"a" * 500 + b") Tj ET"
    packed = zlib.compress(text)
    page = b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(packed) + packed + b"\nendstream"
    pdf = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 1 >>\nendobj\n3 0 obj\n<< /Type /Page /Contents 4 0 R >>\nendobj\n4 0 obj\n" + page + b"\nendobj\n"
    assert "a" * 500 in documents.pdf_pages(pdf)[1][0]
    monkeypatch.setattr(documents, "MOST_XML", len(text))
    assert "a" * 500 in documents.pdf_pages(pdf)[1][0]
    monkeypatch.setattr(documents, "MOST_XML", 100)
    with pytest.raises(ValueError, match="too_large"):
        documents.pdf_pages(pdf)


def test_pdf(spark):
    assert documents.pdf_pages(_pdf(["first", "", r"th\(i\)rd"], "Doc")) == ("Doc", ["first\n", "", "th(i)rd\n"])
    files = spark.createDataFrame([(1, _pdf(["a", "", "b"])), (2, b"no"), (3, _pdf([""])), (4, None)], "id long, content binary")
    rows = {(r.id, r.page, r.error) for r in documents.read_pdf(files).collect()}
    assert rows == {(1, 1, None), (1, 3, None), (2, None, "not_a_pdf"), (3, None, "no_text"), (4, None, "not_a_pdf")}


def _png(width: int, height: int, depth: int = 8, colour: int = 6) -> bytes:
    head = b"IHDR" + struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)
    return bytes.fromhex("89504E470D0A1A0A") + struct.pack(">I", 13) + head + struct.pack(">I", zlib.crc32(head))


def test_image_headers(spark):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x05\x00\x09\x01\x11\x00\x00"
    bad = bytearray(_png(7, 3))
    bad[-1] ^= 1
    files = spark.createDataFrame(
        [(1, _png(7, 3), "image/png"), (2, bytes(bad), "image/png"), (3, _png(7, 3, 3), "image/png"), (4, jpeg, "image/jpeg"), (5, b"\xff\xd8\xff\xd9", "image/jpeg"), (6, b"", "image/gif"), (7, _png(0, 3), "image/png")],
        "id long, content binary, mime_type string",
    )
    got = {r.id: (r.width, r.height, r.error) for r in media.image_headers(files).collect()}
    assert got == {1: (7, 3, None), 2: (None, None, "crc"), 3: (None, None, "bit_depth"), 4: (9, 5, None), 5: (None, None, "no_frame"), 6: (None, None, "mime_unsupported"), 7: (None, None, "zero_dimension")}


def test_sniffing(spark):
    from pyspark.sql import functions as F

    ftyp = struct.pack(">I", 24) + b"ftypisom\0\0\0\x01mp42avc1"
    rows = spark.createDataFrame([(b"RIFF\0\0\0\0WAVEfmt ",), (b"OggS\0",), (b"ID3\x03",), (b"\xff\xfb\x90",), (b"nothing",), (ftyp,)], "c binary")
    got = rows.select(digests.audio_kind(F.col("c")), digests.mp4_brands(F.col("c"))).collect()
    assert [r[0] for r in got] == ["audio/wav", "audio/ogg", "audio/mpeg", "audio/mpeg", None, None]
    assert got[5][1] == ["isom", "mp42", "avc1"]


def test_probe():
    told = {"format": {"format_name": "MP4,mov, n/a", "duration": "1.5"}, "streams": [{"index": 1, "codec_type": "audio", "codec_name": "AAC", "sample_rate": "44100", "channels": 1}, {"index": 0, "codec_type": "video", "codec_name": "h264", "width": 64, "height": 48, "avg_frame_rate": "50/2"}]}
    facts = media.probe_facts(json.dumps(told))
    assert facts["container_names"] == ["mov", "mp4"] and facts["duration"] == 1.5
    assert facts["audio"][0]["sample_rate"] == 44100 and facts["video"][0]["frame_rate"] == "25/1"
    for bad in ("{", "[]", '{"format": {"duration": "-1"}}'):
        with pytest.raises(ValueError):
            media.probe_facts(bad)


def test_captions(spark):
    xml = '<transcript><text start="0" dur="1.5">a &amp; b</text><text start="2">c</text><text start="3" dur="0"> </text></transcript>'
    rows = media.captions(spark.createDataFrame([(1, xml), (2, "<x/>"), (3, "<!DOCTYPE x><transcript/>")], "id long, captions_xml string")).orderBy("id", "position").collect()
    assert [(r.id, r.type, r.text, r.start, r.end, r.error) for r in rows] == [(1, "transcript", "a & b", 0.0, 1.5, None), (1, "transcript", "c", 2.0, None, None), (1, "section", None, 3.0, 3.0, None), (2, None, None, None, None, "root"), (3, None, None, None, None, "has_dtd")]


def test_engine_failures_are_data(spark):
    files = spark.createDataFrame([(1, b"abc"), (2, b"")], "id long, content binary")
    rows = media.recognised(files, lambda c: c.decode() if c else 1 / 0).orderBy("id").collect()
    assert rows[0].text == "abc" and rows[1].error.startswith("ZeroDivisionError")


def test_word_errors():
    assert score(words("A b c"), words("a x c d")) == (3, 1, 0, 1)
    assert score(words("a b"), words("")) == (2, 0, 2, 0)
    assert score([], []) == (0, 0, 0, 0)
    assert words("Ёлка—x_y") == ["елка", "x", "y"]
