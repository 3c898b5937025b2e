"""Headers of images, printed media probes and caption tracks."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: markers of JPEG frames, and limits
FRAMES = frozenset((0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF))
MOST_MARKERS, MOST_SCANNED, MOST_CUES = 256, 1024 * 1024, 20_000


def jpeg_size(content: bytes) -> tuple[int, int]:
    """(width, height) from the first frame header."""
    if content[:2] != b"\xff\xd8":
        raise ValueError("signature")
    at = 2
    for _ in range(MOST_MARKERS):
        if at >= len(content):
            raise ValueError("truncated")
        if content[at] != 0xFF:
            raise ValueError("malformed")
        while at < len(content) and content[at] == 0xFF:
            at += 1
        if at >= len(content):
            raise ValueError("truncated")
        marker = content[at]
        at += 1
        if at > MOST_SCANNED:
            raise ValueError("too_far")
        if marker == 0:
            raise ValueError("malformed")
        if marker == 1 or 0xD0 <= marker <= 0xD7:
            continue
        if marker in (0xDA, 0xD9):
            raise ValueError("no_frame")
        size = int.from_bytes(content[at : at + 2], "big")
        if at + 2 > len(content):
            raise ValueError("truncated")
        if size < 2:
            raise ValueError("malformed")
        if marker in FRAMES:
            if at + size > len(content):
                raise ValueError("truncated")
            if size < 8 or size < 8 + 3 * content[at + 7]:
                raise ValueError("malformed")
            height, width = int.from_bytes(content[at + 3 : at + 5], "big"), int.from_bytes(content[at + 5 : at + 7], "big")
            if not width or not height:
                raise ValueError("zero_dimension")
            return width, height
        at += size
    raise ValueError("too_many_markers")


def image_headers(files: DataFrame, id_col: str = "id", mime_col: str = "mime_type") -> DataFrame:
    """(id, width, height, error) by the declared type; PNG is read by expressions alone."""
    from corpusloom.functions.digests import png_header

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                try:
                    out.append((*jpeg_size(x.as_py() or b""), None))
                except ValueError as e:
                    out.append((None, None, str(e)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]], names=[id_col, "width", "height", "error"])

    kind = files.schema[id_col].dataType.simpleString()
    png = files.where(F.col(mime_col) == "image/png").select(id_col, png_header(F.col("content")).alias("_h")).select(id_col, "_h.width", "_h.height", "_h.error")
    jpeg = files.where(F.col(mime_col) == "image/jpeg").select(id_col, "content").mapInArrow(run, f"{id_col} {kind}, width long, height long, error string")
    other = files.where(~F.coalesce(F.col(mime_col), F.lit("")).isin("image/png", "image/jpeg")).select(id_col, F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height"), F.lit("mime_unsupported").alias("error"))
    return png.union(jpeg).union(other)


PLACEHOLDERS = ("", "n/a", "na", "unknown", "none", "null")


def _word(x) -> str | None:
    x = x.strip().lower() if isinstance(x, str) else ""
    return None if x in PLACEHOLDERS else x


def _count(x) -> int | None:
    x = str(x) if x is not None and not isinstance(x, bool) else ""
    return int(x) if x.isascii() and x.isdigit() and int(x) > 0 else None


def _rate(x) -> str | None:
    try:
        n, d = map(int, str(x).split("/"))
    except ValueError:
        return None
    if d == 0 and n:
        raise ValueError("frame_rate")
    return str(Fraction(n, d).numerator) + "/" + str(Fraction(n, d).denominator) if n > 0 and d > 0 else None


def probe_facts(printed: str) -> dict:
    """Facts of a container from what a probe printed; streams by their index, names sorted."""
    try:
        told = json.loads(printed)
    except ValueError:
        raise ValueError("not_json") from None
    if not isinstance(told, dict) or not isinstance(told.get("format"), dict):
        raise ValueError("no_format")
    names = sorted({y for x in str(told["format"].get("format_name") or "").split(",") if (y := _word(x))})
    length = told["format"].get("duration")
    try:
        seconds = None if _word(str(length)) is None or length is None else float(length)
    except ValueError:
        raise ValueError("duration") from None
    if seconds is not None and not (math.isfinite(seconds) and seconds >= 0):
        raise ValueError("duration")
    streams = sorted((x for x in told.get("streams") or [] if isinstance(x, dict)), key=lambda x: x.get("index", 0))
    if len({x.get("index") for x in streams}) != len(streams):
        raise ValueError("stream_index")
    audio = [{"index": x["index"], "codec": _word(x.get("codec_name")), "sample_rate": _count(x.get("sample_rate")), "channels": _count(x.get("channels"))} for x in streams if x.get("codec_type") == "audio"]
    video = [
        {"index": x["index"], "codec": _word(x.get("codec_name")), "width": _count(x.get("width")), "height": _count(x.get("height")), "frame_rate": _rate(x.get("avg_frame_rate"))}
        for x in streams
        if x.get("codec_type") == "video" and not (x.get("disposition") or {}).get("attached_pic")
    ]
    return {"container_names": names, "duration": seconds, "audio": audio, "video": video}


PROBE = "container_names array<string>, duration double, audio array<struct<index:int,codec:string,sample_rate:int,channels:int>>, video array<struct<index:int,codec:string,width:int,height:int,frame_rate:string>>, error string"


def probes(printed: DataFrame, id_col: str = "id", text_col: str = "printed") -> DataFrame:
    """(id, container_names, duration, audio, video, error)."""
    given = printed.select(id_col, text_col)
    out_type = pa.struct(
        [
            ("container_names", pa.list_(pa.string())),
            ("duration", pa.float64()),
            ("audio", pa.list_(pa.struct([("index", pa.int32()), ("codec", pa.string()), ("sample_rate", pa.int32()), ("channels", pa.int32())]))),
            ("video", pa.list_(pa.struct([("index", pa.int32()), ("codec", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("frame_rate", pa.string())]))),
            ("error", pa.string()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                try:
                    out.append(probe_facts(x.as_py() or "") | {"error": None})
                except (ValueError, KeyError, TypeError) as e:
                    out.append({"error": str(e).strip("'")})
            told = pa.array(out, out_type)
            yield pa.RecordBatch.from_arrays([batch.column(0), *told.flatten()], names=[id_col, *[f.name for f in out_type]])

    return given.mapInArrow(run, f"{id_col} {given.schema[id_col].dataType.simpleString()}, {PROBE}")


def caption_cues(xml: str) -> list[tuple[str, float, float | None]]:
    """(text, start, end) of a caption track; strict about its form."""
    if "<!DOCTYPE" in xml or "<!ENTITY" in xml:
        raise ValueError("has_dtd")
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        raise ValueError("not_xml") from None
    if root.tag != "transcript":
        raise ValueError("root")
    if len(root) > MOST_CUES:
        raise ValueError("too_many_cues")
    cues = []
    for x in root:
        if x.tag != "text" or len(x) or set(x.attrib) - {"start", "dur"} or "start" not in x.attrib:
            raise ValueError("cue")
        try:
            start, length = float(x.attrib["start"]), float(x.attrib["dur"]) if "dur" in x.attrib else None
        except ValueError:
            raise ValueError("time") from None
        if not math.isfinite(start) or start < 0 or length is not None and (not math.isfinite(length) or length < 0):
            raise ValueError("time")
        cues.append((x.text or "", start, None if length is None else start + length))
    if not any(c[0].strip() for c in cues):
        raise ValueError("no_text")
    return cues


def captions(tracks: DataFrame, id_col: str = "id", xml_col: str = "captions_xml") -> DataFrame:
    """(id, position, type, text, caption_text, start, end, error): a cue with text is a
    transcript, a blank one a section that keeps what it had."""
    from corpusloom.sources.documents import _read

    def rows(content: bytes):
        return [
            (i, "transcript" if text.strip() else "section", text if text.strip() else None, None if text.strip() else text, repr(start), None if end is None else repr(end))
            for i, (text, start, end) in enumerate(caption_cues(content.decode("utf-8")))
        ]

    given = tracks.select(id_col, F.encode(xml_col, "UTF-8").alias("content"))
    out = _read(given, id_col, rows, "position int, type string, text string, caption_text string, start string, end string, error string")
    return out.withColumns({c: F.col(c).cast("double") for c in ("start", "end")})


def recognised(files: DataFrame, engine: Callable[[bytes], str], id_col: str = "id") -> DataFrame:
    """(id, text, error) by an engine that is given: recognition of print, speech or pictures is
    a function from bytes to text, and where none is installed, a stand-in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                try:
                    out.append((engine(x.as_py() or b""), None))
                except Exception as e:  # noqa: BLE001  an engine's failure is data
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in out], pa.string()) for i in (0, 1)]], names=[id_col, "text", "error"])

    return files.select(id_col, "content").mapInArrow(run, f"{id_col} {files.schema[id_col].dataType.simpleString()}, text string, error string")
