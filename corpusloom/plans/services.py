"""Capture services: what a processor makes of captures whose material is stored or recognised
elsewhere, as readers for lifecycle.ingest. A reader takes the captures of its processor and
gives contents; what it can't read is a content that failed, with the code of the first test."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import schema
from corpusloom.functions.digests import ref_error
from corpusloom.functions.text import is_blank
from corpusloom.operators.deliveries import transcript_error
from corpusloom.operators.validate import container_ok, media_precondition
from corpusloom.sources import documents, media, raw_objects

Reader = Callable[[DataFrame], DataFrame]


def _content(df: DataFrame, kind: str, title: Column, segments: Column, error: Column) -> DataFrame:
    return df.select(
        F.col("id").alias("capture_id"),
        F.lit(kind).alias("type"),
        title.alias("title"),
        F.col("digest").alias("sha256"),
        segments.alias("segments"),
        F.when(error.isNull(), "complete").otherwise("failed").alias("status"),
        error.alias("error"),
    )


def _precondition(kind: str, mimes: tuple[str, ...]) -> Column:
    ref = F.col("payload.file_ref")
    return media_precondition(F.col("payload.type"), kind, F.col("digest"), F.when(ref_error(ref).isNull(), ref), F.col("payload.mime_type"), mimes)


def _no_segments() -> Column:
    return F.array().cast("array<struct<position:int,type:string,text:string,provenance:string>>")


def images(raw: str, recognised: DataFrame | None = None) -> Reader:
    """Images whose header can be read; recognised (digest, status, text) adds a segment where
    print was found."""

    def read(captures: DataFrame) -> DataFrame:
        files = captures.select("id", "digest", F.col("payload.mime_type").alias("mime_type")).join(raw_objects.contents_of(captures, raw), "digest")
        header = media.image_headers(files).select("id", F.coalesce("error", F.lit("")).alias("_header"))
        df = captures.join(header, "id", "left")
        error = F.coalesce(_precondition("image", schema.IMAGE_MIMES), F.when(F.coalesce("_header", F.lit("missing")) != "", F.lit("invalid_image")))
        if recognised is None:
            return _content(df, "image", F.col("payload.title"), _no_segments(), error)
        told = recognised.groupBy("digest").agg(F.max_by(F.struct(F.col("status").alias("status"), F.col("text").alias("text")), "status").alias("_r"))
        df = df.join(told, "digest", "left")
        error = F.coalesce(error, F.when(F.col("_r").isNull(), "image_ocr_unavailable").when(F.col("_r.status") == "failed", "processing_failed"))
        one = F.array(F.struct(F.lit(0).alias("position"), F.lit("ocr").alias("type"), F.col("_r.text").alias("text"), F.lit("ocr").alias("provenance")))
        return _content(df, "image", F.col("payload.title"), F.when(is_blank(F.col("_r.text")), _no_segments()).otherwise(one), error)

    return read


def probed(kind: str, probes: DataFrame) -> Reader:
    """Audio or video by what a probe told of the stored file: probes (digest, container_names,
    audio, video). Audio needs a sound stream, video one of pictures."""
    mimes = tuple(m for m in schema.CONTAINERS if m.startswith(f"{kind}/"))

    def read(captures: DataFrame) -> DataFrame:
        df = captures.join(probes.select("digest", "container_names", F.size(kind).alias("_streams")).dropDuplicates(["digest"]), "digest", "left")
        error = F.coalesce(
            _precondition(kind, mimes),
            F.when(F.col("container_names").isNull(), "media_probe_unavailable")
            .when(~container_ok(F.col("payload.mime_type"), F.col("container_names")), "container_mismatch")
            .when(F.col("_streams") < 1, f"no_{kind}_stream"),
        )
        return _content(df, kind, F.col("payload.title"), _no_segments(), error)

    return read


def transcribed(transcripts: DataFrame) -> Reader:
    """Audio by its transcript: (digest, outcome, duration, cues array<struct<text,start,end>>). A
    transcript that doesn't hold together is an error; silence is a content without segments."""

    def read(captures: DataFrame) -> DataFrame:
        df = captures.join(transcripts.select("digest", "outcome", "duration", "cues").dropDuplicates(["digest"]), "digest", "left")
        error = F.coalesce(
            F.when(F.col("digest").isNull(), "audio_required"),
            F.when(F.col("outcome").isNull(), "asr_unavailable"),
            transcript_error(F.col("outcome"), F.col("cues"), F.col("duration")),
        )
        rows = F.transform(
            F.coalesce("cues", F.array().cast("array<struct<text:string,start:double,end:double>>")),
            lambda c, i: F.struct(i.alias("position"), F.lit("transcript").alias("type"), c["text"].alias("text"), F.lit("transcript").alias("provenance"), c["start"].alias("start"), c["end"].alias("end")),
        )
        return _content(df, "audio", F.col("payload.title"), rows, error)

    return read


ARTIFACT = "video_id string, source_url string, captured_at string, track struct<language_code:string,is_generated:boolean>, captions_xml string"


def captioned(raw: str) -> Reader:
    """Stored caption artifacts (JSON): the capture has to tell the same video and time, and cues
    become segments with their times, blank ones too."""

    def read(captures: DataFrame) -> DataFrame:
        stored = raw_objects.contents_of(captures, raw).select("digest", F.from_json(F.decode("content", "UTF-8"), ARTIFACT).alias("_a"))
        df = captures.join(stored, "digest", "left")
        cues = media.captions(df.where("_a.captions_xml is not null").select("id", F.col("_a.captions_xml").alias("captions_xml")))
        one = F.struct("position", "type", "text", F.lit("transcript").alias("provenance"), "start", "end")
        cues = cues.groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("error").isNull(), one))).alias("_cues"), F.max("error").alias("_cue_error"))
        df = df.join(cues, "id", "left")
        agrees = (F.col("source.url") == F.col("_a.source_url")) & (F.col("context.captured_at") == F.col("_a.captured_at"))
        error = (
            F.when(F.col("digest").isNull() | F.col("_a.captions_xml").isNull(), "invalid_artifact")
            .when(~F.coalesce(agrees, F.lit(False)), "receipt_mismatch")
            .when(F.col("_cue_error").isNotNull(), F.col("_cue_error"))
        )
        return _content(df, "video", F.lit(None).cast("string"), F.coalesce("_cues", F.array().cast("array<struct<position:int,type:string,text:string,provenance:string,start:double,end:double>>")), error)

    return read


def papers(raw: str, read_rows: Callable = documents.read_pdf) -> Reader:
    """Documents by a reader of their stored bytes: (id, position, text, title, error, and page for
    those that have pages)."""

    def read(captures: DataFrame) -> DataFrame:
        rows = read_rows(raw_objects.contents_of(captures, raw).select(F.col("digest").alias("id"), "content"))
        page = F.col("page") if "page" in rows.columns else F.lit(None).cast("int")
        one = F.struct("position", F.lit("section").alias("type"), "text", F.lit("original").alias("provenance"), page.alias("page"))
        parts = rows.groupBy(F.col("id").alias("digest")).agg(F.sort_array(F.collect_list(F.when(F.col("error").isNull(), one))).alias("_parts"), F.max("error").alias("_error"), F.max("title").alias("_title"))
        df = captures.join(parts, "digest", "left")
        error = F.coalesce(_precondition("document", schema.DOCUMENT_MIMES), F.when(F.col("_parts").isNull(), "capture_material_unavailable"), F.col("_error"))
        return _content(df, "document", F.coalesce("payload.title", "_title"), F.coalesce("_parts", F.array().cast("array<struct<position:int,type:string,text:string,provenance:string,page:int>>")), error)

    return read
