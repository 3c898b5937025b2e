"""Results of recognition: limits, consistency, states and strict answers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import is_blank

# fixed values: pixels and bytes of an image, bytes of a caption artifact
MOST_PIXELS, MOST_BYTES, MOST_CAPTIONS = 20_000_000, 64 * 1024 * 1024, 16 * 1024 * 1024


def ocr_limit(pixels: Column, size: Column) -> Column:
    """null, or the limit that an image is beyond: such an image is skipped, which is no failure."""
    return F.when(pixels > MOST_PIXELS, "pixels").when(size > MOST_BYTES, "bytes")


def ocr_result_error(skipped: Column, text: Column, engine: Column) -> Column:
    """A skipped image has no text; a recognised one names its engine."""
    return F.when(skipped & text.isNotNull(), "skipped_with_text").when(~skipped & text.isNull(), "no_text").when(~skipped & is_blank(engine), "no_engine")


def ocr_status(requested: Column, skipped: Column, text: Column) -> Column:
    return F.when(~requested, "not_requested").when(skipped, "skipped").when(~is_blank(text), "text").otherwise("empty")


def caption_artifact_ok(video_id: Column, url: Column, xml: Column) -> Column:
    """The artifact's address is that of its video, and its size within the limit."""
    from corpusloom.functions.urls import watch_url

    return F.coalesce((url == watch_url(video_id)) & (F.octet_length(xml) <= MOST_CAPTIONS), F.lit(False))


def json_compatible(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def record_json(version: Column, fields: dict[str, Column], later: dict[str, Column]) -> Column:
    """A record as JSON; the first version doesn't have the later fields at all."""
    struct = lambda cols: F.to_json(F.struct(*[v.alias(k) for k, v in sorted(cols.items())]), {"ignoreNullFields": "false"})
    return F.when(version == "0.1", struct(fields)).otherwise(struct(fields | later))


def strict_object(text: str) -> dict:
    """A JSON object without repeated keys, numbers that JSON doesn't have, or control characters in strings."""

    def pairs(found):
        if len({k for k, _ in found}) != len(found):
            raise ValueError("repeated_key")
        return dict(found)

    def constant(_):
        raise ValueError("not_a_number")

    try:
        out = json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
    except json.JSONDecodeError:
        raise ValueError("not_json") from None
    if not isinstance(out, dict):
        raise ValueError("not_an_object")
    if any(isinstance(v, str) and any(ord(c) < 32 and c not in "\n\t" for c in v) for v in out.values()):
        raise ValueError("control_character")
    return out


def answers(texts: DataFrame, id_col: str = "id", text_col: str = "answer") -> DataFrame:
    """(id, status, description, error) of a picture model's answers: described, unclear or
    refused; all else is an error."""

    def one(text: str | None):
        try:
            told = strict_object(text or "")
        except ValueError as e:
            return None, None, str(e)
        status, description = told.get("status"), told.get("description")
        if status not in ("described", "unclear", "refused"):
            return None, None, "status"
        if status == "described" and not (isinstance(description, str) and description.strip()):
            return None, None, "description"
        return status, description if status == "described" else None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [one(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in out], pa.string()) for i in range(3)]], names=[id_col, "status", "description", "error"])

    given = texts.select(id_col, text_col)
    return given.mapInArrow(run, f"{id_col} {given.schema[id_col].dataType.simpleString()}, status string, description string, error string")


def job_invariants(state: Column, started: Column, finished: Column, error: Column) -> Column:
    """What a receipt's state says agrees with its times and its error."""
    return (
        F.when(state == "queued", started.isNull() & finished.isNull())
        .when(state == "running", started.isNotNull() & finished.isNull())
        .when(state == "complete", finished.isNotNull() & error.isNull())
        .when(state.isin("failed", "interrupted"), finished.isNotNull() & error.isNotNull())
        .otherwise(F.lit(False))
    )
