"""Capture services: from stored or recognised material to contents, through ingest."""

import hashlib
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom import schema
from corpusloom.operators import route, validate
from corpusloom.plans import lifecycle, services
from corpusloom.sources import raw_objects, store


def _sha(data):
    return hashlib.sha256(data).hexdigest()


def _capture(i, kind, content, mime, url=None, at="2026-01-02T03:04:05Z", ref=None):
    ref = ref or f"sha256:{_sha(content)}"
    return ("0.3", i, ("api", None, url), (kind, mime, None, None, ref, f"title {i}"), (at, None, None), ("save", None, []))


def _ingest(spark, folder, captures, contents, readers, *others):
    store.put(spark.createDataFrame([(c,) for c in contents], "content binary"), f"{folder}/raw")
    lifecycle.ingest(spark.createDataFrame(captures, schema.ENVELOPE), folder, readers=readers, processors=route.deployment(*others))
    ended = {r.id: (r.status, r.error) for r in lifecycle.table(spark, folder, "states").where("step = 3").collect()}
    refused = {r.id: r.route_error for r in lifecycle.table(spark, folder, "refusals").collect()}
    return ended, refused, {r.capture_id: r for r in lifecycle.table(spark, folder, "contents").collect()}


def test_audio(spark, tmp_path):
    sounds = [b"one", b"two", b"three", b"four"]
    cues = "array<struct<text:string,start:double,end:double>>"
    told = [(_sha(b"one"), "speech", 2.0, [("hi", 0.0, 1.0), ("you", 1.0, 2.0)]), (_sha(b"two"), "silence", 2.0, []), (_sha(b"three"), "speech", 2.0, [("late", 1.0, 9.0)])]
    transcripts = spark.createDataFrame(told, f"digest string, outcome string, duration double, cues {cues}")
    captures = [_capture(str(i), "audio", c, "audio/wav") for i, c in enumerate(sounds)] + [_capture("gone", "audio", b"gone", "audio/wav"), _capture("t", "image", b"one", "image/png")]
    ended, refused, contents = _ingest(spark, f"file://{tmp_path}/a", captures, sounds, {"transcription@0.1": services.transcribed(transcripts)}, "transcription@0.1")
    assert ended == {"0": ("complete", None), "1": ("complete", None), "2": ("failed", "duration"), "3": ("failed", "asr_unavailable")}
    assert refused == {"gone": "capture_material_unavailable"}
    assert [(s.position, s.text, s.start, s.end, s.provenance) for s in contents["0"].segments] == [(0, "hi", 0.0, 1.0, "transcript"), (1, "you", 1.0, 2.0, "transcript")]
    assert contents["1"].segments == [] and contents["0"].title == "title 0" and set(contents) == {"0", "1"}


def _png(width, height):
    head = b"IHDR" + struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + head + struct.pack(">I", zlib.crc32(head))


def test_images_and_probes(spark, tmp_path):
    good, bad = _png(7, 3), b"\x89PNG nothing"
    files = [good, bad, b"film", b"song"]
    captures = [_capture("p", "image", good, "image/png"), _capture("b", "image", bad, "image/png"), _capture("v", "video", b"film", "video/mp4"), _capture("w", "video", b"song", "video/webm"), _capture("a", "audio", b"song", "audio/mpeg"), _capture("n", "audio", good, "audio/ogg")]
    kind = "digest string, container_names array<string>, audio array<struct<index:int>>, video array<struct<index:int>>"
    probes = spark.createDataFrame([(_sha(b"film"), ["mov", "mp4"], [], [(0,)]), (_sha(b"song"), ["mp3"], [(0,)], [])], kind)
    folder = f"file://{tmp_path}/i"
    readers = {"image@0.1": services.images(f"{folder}/raw"), "audio@0.1": services.probed("audio", probes), "video@0.1": services.probed("video", probes)}
    ended, refused, contents = _ingest(spark, folder, captures, files, readers)
    assert ended == {"p": ("complete", None), "b": ("failed", "invalid_image"), "v": ("complete", None), "w": ("failed", "container_mismatch"), "a": ("complete", None), "n": ("failed", "media_probe_unavailable")}
    assert not refused and {c.type for c in contents.values()} == {"image", "video", "audio"}
    read = spark.createDataFrame([(_sha(good), "recognised", "words")], "digest string, status string, text string")
    other = f"file://{tmp_path}/o"
    ended, _, contents = _ingest(spark, other, captures[:2], files, {"image-ocr@0.1": services.images(f"{other}/raw", read)}, "image-ocr@0.1")
    assert ended["p"] == ("complete", None) and [s.text for s in contents["p"].segments] == ["words"] and ended["b"][0] == "failed"


def test_captions(spark, tmp_path):
    url = "https://www.youtube.com/watch?v=abcdefghijk"
    artifact = {"video_id": "abcdefghijk", "source_url": url, "captured_at": "2026-01-02T03:04:05Z", "track": {"language_code": "en", "is_generated": False}, "captions_xml": '<transcript><text start="1" dur="2">x &amp; y</text><text start="3"> </text></transcript>'}
    files = [json.dumps(artifact).encode(), json.dumps(artifact | {"captions_xml": "<x/>"}).encode(), b"no json"]
    captures = [_capture(str(i), "file", c, route.CAPTION_MIME, url) for i, c in enumerate(files)] + [_capture("u", "file", files[0], route.CAPTION_MIME, url + "x")]
    folder = f"file://{tmp_path}/c"
    ended, refused, contents = _ingest(spark, folder, captures, files, {"captions@0.1": services.captioned(f"{folder}/raw")}, "captions@0.1")
    assert ended == {"0": ("complete", None), "1": ("failed", "root"), "2": ("failed", "invalid_artifact"), "u": ("failed", "receipt_mismatch")} and not refused
    assert [(s.type, s.text, s.start, s.end) for s in contents["0"].segments] == [("transcript", "x & y", 1.0, 3.0), ("section", None, 3.0, None)]


def test_papers_and_verified_bytes(spark, tmp_path):
    folder = f"file://{tmp_path}/d"

    def rows(files):
        return files.select("id", F.lit(0).alias("position"), F.lit(1).alias("page"), F.decode("content", "UTF-8").alias("text"), F.lit("T").alias("title"), F.when(F.col("content") == b"bad", "not_pdf").alias("error"))

    captures = [_capture("g", "document", b"good", schema.DOCUMENT_MIMES[0]), _capture("b", "document", b"bad", schema.DOCUMENT_MIMES[0])]
    ended, _, contents = _ingest(spark, folder, captures, [b"good", b"bad"], {"pdf@0.1": services.papers(f"{folder}/raw", rows)})
    assert ended == {"g": ("complete", None), "b": ("failed", "not_pdf")} and [(s.text, s.page) for s in contents["g"].segments] == [("good", 1)]
    refs = spark.createDataFrame([(_sha(b"good"),), (_sha(b"none"),), (None,)], "digest string")
    assert [(r.digest, bytes(r.content)) for r in raw_objects.contents_of(refs, f"{folder}/raw").collect()] == [(_sha(b"good"), b"good")]


def test_router_deployments(spark):
    def names(processors, kind, mime):
        return spark.range(1).select(route.routed(route.matches(F.lit(kind), F.lit(mime), processors)).alias("r")).first().r

    assert len(route.PROCESSORS) + len(route.OTHERS) == 12
    both = route.PROCESSORS | {"pdf-ocr@0.1": route.OTHERS["pdf-ocr@0.1"]}
    assert names(both, "document", "application/pdf").error == "ambiguous: pdf@0.1, pdf-ocr@0.1"
    assert names(route.deployment("pdf-ocr@0.1"), "document", "application/pdf").processor == "pdf-ocr@0.1"
    every = route.deployment(*route.OTHERS)
    assert names(every, "audio", "audio/flac").processor == "transcription@0.1" and names(route.PROCESSORS, "audio", "audio/flac").error == "no_processor"
    assert names(every, "file", route.CAPTION_MIME).processor == "captions@0.1" and len(every) == 8


@pytest.mark.parametrize(
    ("row", "told"),
    [(("image", "x", "r", "audio/wav"), "payload_type"), (("audio", None, None, None), "no_raw_object"), (("audio", "x", None, None), "no_reference"), (("audio", "x", "r", None), "no_mime_type"), (("audio", "x", "r", "audio/flac"), "mime_type_not_read"), (("audio", "x", "r", "audio/wav"), None), ((None, "x", "r", "audio/wav"), "payload_type")],
)
def test_media_preconditions_in_order(spark, row, told):
    df = spark.createDataFrame([row], "kind string, raw string, ref string, mime string")
    assert df.select(validate.media_precondition(F.col("kind"), "audio", F.col("raw"), F.col("ref"), F.col("mime"), ("audio/wav",))).first()[0] == told
