"""Validation as expressions: each rule gives a code where it fails, and a row's errors are
an array, so that nothing is dropped on the way."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import schema
from corpusloom.functions.text import is_blank


def errors(*rules: tuple[str, Column]) -> Column:
    """The codes of the rules (code, holds) that don't hold; a null doesn't hold."""
    return F.filter(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(code)) for code, holds in rules]), lambda x: x.isNotNull())


def usable_payload(kind: Column, text: Column, html: Column, file_ref: Column) -> Column:
    """The material that a payload of its kind needs is there."""
    has = lambda x: ~is_blank(x)
    return (
        F.when(kind == "text", has(text))
        .when(kind == "webpage", has(html) | has(text))
        .when(kind == "document", has(file_ref) | has(text))
        .when(kind.isin("image", "audio", "video", "file"), has(file_ref))
        .otherwise(kind == "url")
    )


def envelope_errors() -> Column:
    """Of a row of schema.ENVELOPE."""
    version, kind = F.col("schema_version"), F.col("payload.type")
    return errors(
        ("version", version.isin(*schema.VERSIONS)),
        ("id", ~is_blank(F.col("id"))),
        ("source_type", F.col("source.type").isin(*schema.SOURCES)),
        ("payload_type", kind.isin(*schema.PAYLOADS)),
        ("payload", usable_payload(kind, F.col("payload.text"), F.col("payload.html"), F.col("payload.file_ref"))),
        ("url", (kind != "url") | ~is_blank(F.col("source.url"))),
        ("audio_version", (kind != "audio") | (version == "0.3")),
        ("captured_at", F.col("context.captured_at").isNull() | F.col("context.captured_at").rlike(r"(?:[zZ]|[+-][0-9]{2}:?[0-9]{2})\z")),
        ("intent", F.col("intent.action").isNull() | F.col("intent.action").isin(*schema.INTENTS)),
    )


def record_errors() -> Column:
    """Of a row of schema.RECORD."""
    version = F.col("schema_version")
    return errors(
        ("version", version.isin(*schema.VERSIONS)),
        ("status", F.col("status").isin(*schema.STATUSES)),
        ("payload_type", F.col("payload_type").isin(*schema.PAYLOADS)),
        ("audio_version", (F.col("payload_type") != "audio") | (version == "0.3")),
        ("early_metadata", (version != "0.1") | (F.col("context").isNull() & F.col("intent").isNull() & F.col("title").isNull())),
        ("context", (version == "0.1") | F.col("context").isNotNull()),
        ("updated_at", F.col("updated_at") >= F.col("received_at")),
    )


def temporal_ok(start: Column, end: Column) -> Column:
    return (start.isNotNull() | end.isNotNull()) & F.coalesce(start >= 0, F.lit(True)) & F.coalesce(end >= 0, F.lit(True)) & F.coalesce(end >= start, F.lit(True))


def spatial_ok(page: Column, box: list[Column]) -> Column:
    """All of a box or none of it, and something is located."""
    n = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in box), F.lit(0))
    return n.isin(0, 4) & ((n == 4) | page.isNotNull()) & F.coalesce(page > 0, F.lit(True))


def content_errors() -> Column:
    """Of a row of schema.CONTENT."""
    segments, assets = F.col("segments"), F.col("assets")
    known = F.array_append(F.transform(assets, lambda a: a["id"]), F.col("original.asset_id"))
    ids = lambda xs: F.transform(xs, lambda x: x["id"])
    return errors(
        ("type", F.col("type").isin(*schema.CONTENTS)),
        ("segment_ids", F.size(segments) == F.size(F.array_distinct(ids(segments)))),
        ("asset_ids", F.size(assets) == F.size(F.array_distinct(ids(assets)))),
        ("capture_id", F.forall(segments, lambda s: s["provenance"]["capture_id"] == F.col("source.capture_id"))),
        ("asset_refs", F.forall(segments, lambda s: s["provenance"]["asset_id"].isNull() | F.array_contains(known, s["provenance"]["asset_id"]))),
        ("segment_text", F.forall(segments, lambda s: ~s["type"].isin("text", "transcript", "ocr") | ~is_blank(s["text"]))),
        ("temporal", F.forall(segments, lambda s: s["temporal"].isNull() | temporal_ok(s["temporal"]["start"], s["temporal"]["end"]))),
        ("spatial", F.forall(segments, lambda s: s["spatial"].isNull() | spatial_ok(s["spatial"]["page"], [s["spatial"][c] for c in ("x", "y", "width", "height")]))),
    )


def unknown_fields(text: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that aren't allowed; from_json would drop them unseen."""
    return F.array_except(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")), F.array(*map(F.lit, allowed)))


def staged_error(kind: Column, file_ref: Column, others: Column, mime: Column, exists: Column, mimes: tuple[str, ...], media_enabled: bool = True) -> Column:
    """The first test that staged material fails, in the order in which they are told."""
    tests = [
        ("media_disabled", F.lit(not media_enabled)),
        ("file_ref_missing", is_blank(file_ref)),
        ("other_material", others),
        ("mime_missing", is_blank(mime)),
        ("mime_unsupported", ~mime.isin(*mimes)),
        ("ref_malformed", ~file_ref.rlike(r"\Asha256:[0-9a-f]{64}\z")),
        ("not_stored", ~exists),
    ]
    out = F.lit(None).cast("string")
    for code, failed in reversed(tests):
        out = F.when(F.coalesce(failed, F.lit(True)), code).otherwise(out)
    return out


def video_request_ok(describe: Column, frames: Column, speech: Column, profiles: Column) -> Column:
    """Descriptions need frames; each stage that is asked for has its profile and no other has."""
    asked = F.filter(F.array(F.when(speech, F.lit("speech")), F.when(frames, F.lit("frames")), F.when(describe, F.lit("describe"))), lambda x: x.isNotNull())
    return (~describe | frames) & (F.array_sort(profiles) == F.array_sort(asked))


def container_ok(mime: Column, names: Column) -> Column:
    """The declared type's container is among those that a probe found."""
    table = F.create_map(*[F.lit(x) for pair in schema.CONTAINERS.items() for x in pair])
    return F.coalesce(F.array_contains(names, F.try_element_at(table, mime)), F.lit(False))


def pages_error(pages: Column, recognised: Column, excluded: Column) -> Column:
    """What is wrong with the pages that a recogniser tells of: range, excluded, duplicate or missing."""
    every = F.sequence(F.lit(1), pages)
    return (
        F.when(F.exists(recognised, lambda p: (p < 1) | (p > pages)), "range")
        .when(F.arrays_overlap(recognised, excluded), "excluded")
        .when(F.size(recognised) != F.size(F.array_distinct(recognised)), "duplicate")
        .when(F.size(F.array_except(F.array_except(every, excluded), recognised)) > 0, "missing")
    )


def manifest_error(attachments: Column, total: int = 6 * 1024 * 1024) -> Column:
    """Of attachments array<struct<id,name,size>>: ids and names are unique, and sizes fit."""
    ids, names = F.transform(attachments, lambda a: a["id"]), F.transform(attachments, lambda a: a["name"])
    size = F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["size"])
    return F.when(F.size(ids) != F.size(F.array_distinct(ids)), "duplicate_id").when(F.size(names) != F.size(F.array_distinct(names)), "duplicate_name").when(size > total, "too_large")


def media_precondition(kind: Column, wanted: str, raw_id: Column, ref: Column, mime: Column, mimes: tuple[str, ...]) -> Column:
    """null, or what is known to be wrong with a media record before any byte is read, in the order
    in which it is told."""
    return (
        F.when(~F.coalesce(kind == wanted, F.lit(False)), "payload_type")
        .when(raw_id.isNull(), "no_raw_object")
        .when(ref.isNull(), "no_reference")
        .when(mime.isNull(), "no_mime_type")
        .when(~mime.isin(*mimes), "mime_type_not_read")
    )


def material(kind: Column, text: Column, html: Column, file_ref: Column, captions: bool = False) -> Column:
    """struct(material, error): which field is a capture's one original, or why none is. Texts and
    pages are inline, the others staged; a page's HTML stands alone, as one record keeps one
    original, and a page of text isn't taken."""
    staged = ("document", "image", "audio", "video", *(("file",) if captions else ()))
    more = text.isNotNull() | file_ref.isNotNull()
    error = (
        F.when((kind == "text") & text.isNull(), "invalid_capture_envelope")
        .when((kind == "webpage") & html.isNull() & text.isNull(), "invalid_capture_envelope")
        .when((kind == "webpage") & (html.isNull() | more), "unsupported_payload")
        .when(~F.coalesce(kind.isin("text", "webpage", *staged), F.lit(False)), "unsupported_payload")
        .when(kind.isin(*staged) & (file_ref.isNull() | text.isNotNull() | html.isNotNull()), "unsupported_payload")
    )
    told = F.when(kind == "text", "text").when(kind == "webpage", "html").otherwise("file_ref")
    return F.struct(F.when(error.isNull(), told).alias("material"), error.alias("error"))


def ran_in_order(started_at: Column, completed_at: Column) -> Column:
    """A run that ended didn't end before it began; one that has no end is in order."""
    return F.coalesce(completed_at >= started_at, F.lit(True))
