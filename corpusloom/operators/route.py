"""Routing: each record goes to exactly one processor, whatever their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import schema

#: name@version of the processors, in the order of their registration, and what each supports.
PROCESSORS = {
    "text@0.2": lambda kind, mime: kind == "text",
    "webpage@0.1": lambda kind, mime: kind == "webpage",
    "pdf@0.1": lambda kind, mime: (kind == "document") & (mime == schema.DOCUMENT_MIMES[0]),
    "docx@0.1": lambda kind, mime: (kind == "document") & (mime == schema.DOCUMENT_MIMES[1]),
    "image@0.1": lambda kind, mime: (kind == "image") & mime.isin(*schema.IMAGE_MIMES),
    "audio@0.1": lambda kind, mime: (kind == "audio") & mime.startswith("audio/") & mime.isin(*schema.CONTAINERS),
    "video@0.1": lambda kind, mime: (kind == "video") & mime.startswith("video/") & mime.isin(*schema.CONTAINERS),
}

# fixed values: the mime type of a stored caption artifact
CAPTION_MIME = "application/vnd.corpusloom.captions+json"
#: Other processors that a deployment may take: the first two in place of the plain readers (with
#: both, each such record is ambiguous), the next two in place of the probes.
OTHERS = {
    "pdf-ocr@0.1": PROCESSORS["pdf@0.1"],
    "image-ocr@0.1": PROCESSORS["image@0.1"],
    "transcription@0.1": lambda kind, mime: kind == "audio",
    "video-notes@0.1": lambda kind, mime: kind == "video",
    "captions@0.1": lambda kind, mime: (kind == "file") & (mime == CAPTION_MIME),
}
_INSTEAD = {"pdf-ocr@0.1": "pdf@0.1", "image-ocr@0.1": "image@0.1", "transcription@0.1": "audio@0.1", "video-notes@0.1": "video@0.1"}


def deployment(*others: str) -> dict:
    """The processors with others, each in the place of the one whose records it takes."""
    left = {_INSTEAD.get(name) for name in others}
    return {k: v for k, v in PROCESSORS.items() if k not in left} | {name: OTHERS[name] for name in others}


def matches(kind: Column, mime: Column, processors: dict | None = None) -> Column:
    """The names of all processors that support a record."""
    found = [F.when(F.coalesce(supports(kind, mime), F.lit(False)), F.lit(name)) for name, supports in (processors or PROCESSORS).items()]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def routed(names: Column) -> Column:
    """struct(processor, error): no_processor for none, ambiguous for several."""
    return F.struct(
        F.when(F.size(names) == 1, F.get(names, F.lit(0))).alias("processor"),
        F.when(F.size(names) == 0, "no_processor").when(F.size(names) > 1, F.concat(F.lit("ambiguous: "), F.concat_ws(", ", names))).alias("error"),
    )
