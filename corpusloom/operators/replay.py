"""Replays: an envelope that comes again is equal to what is stored, or in conflict with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_equal(envelope: str = "e", record: str = "r") -> Column:
    """An envelope of text tells the same as a record: null-safe in every field."""
    e, r = (lambda c, a=a: F.col(f"{a}.{c}") for a in (envelope, record))
    same = [("id", "id"), ("schema_version", "schema_version"), ("payload.type", "payload_type"), ("source", "source"), ("context", "context"), ("intent", "intent"), ("payload.title", "title"), ("payload.mime_type", "raw_object.mime_type")]
    out = F.sha2(e("payload.text"), 256).eqNullSafe(r("raw_object.sha256")) & e("payload.html").isNull() & e("payload.file_ref").isNull()
    for a, b in same:
        out = out & e(a).eqNullSafe(r(b))
    return out


def media_equal(envelope: str = "e", record: str = "r") -> Column:
    """The same for staged media, of version 0.3 only: the three digests agree."""
    e, r = (lambda c, a=a: F.col(f"{a}.{c}") for a in (envelope, record))
    out = (e("schema_version") == "0.3") & (e("payload.file_ref") == r("raw_object.ref")) & (r("raw_object.ref") == F.concat(F.lit("sha256:"), r("raw_object.sha256")))
    for a, b in [("id", "id"), ("schema_version", "schema_version"), ("payload.type", "payload_type"), ("source", "source"), ("context", "context"), ("intent", "intent"), ("payload.title", "title"), ("payload.mime_type", "raw_object.mime_type")]:
        out = out & e(a).eqNullSafe(r(b))
    return out & e("payload.text").isNull() & e("payload.html").isNull()


def resolve(envelopes: DataFrame, records: DataFrame, contents: DataFrame) -> DataFrame:
    """(id, outcome): new (201), replay (200), conflict or incomplete (409), or integrity (500:
    a complete record without its content). Text and media can be replayed, others conflict."""
    known = contents.select(F.col("source.capture_id").alias("_has")).distinct()
    joined = envelopes.alias("e").join(records.alias("r"), F.col("e.id") == F.col("r.id"), "left").join(known, F.col("r.id") == F.col("_has"), "left")
    equal = F.when(F.col("e.payload.type") == "text", text_equal()).when(F.col("e.payload.type").isin("audio", "image", "video"), media_equal()).otherwise(F.lit(False))
    outcome = (
        F.when(F.col("r.id").isNull(), "new")
        .when(~F.coalesce(equal, F.lit(False)), "conflict")
        .when(F.col("r.status") != "complete", "incomplete")
        .when(F.col("_has").isNull(), "integrity")
        .otherwise("replay")
    )
    return joined.select(F.col("e.id").alias("id"), outcome.alias("outcome"))
