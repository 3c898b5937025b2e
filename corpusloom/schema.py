"""Schemas, closed vocabularies and versions of the canonical documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the versions that are known, as a set, and the closed vocabularies
VERSIONS = ("0.1", "0.2", "0.3")
SOURCES = ("browser", "filesystem", "upload", "api")
PAYLOADS = ("text", "webpage", "image", "document", "video", "file", "url", "audio")
STATUSES = ("received", "stored", "queued", "processing", "complete", "partial", "failed")
CONTENTS = ("text", "web", "image", "document", "video", "audio")
SEGMENTS = ("text", "section", "transcript", "ocr", "visual")
PROVENANCES = ("original", "html", "ocr", "transcript", "vision", "processor")
ROLES = ("original", "image", "keyframe", "thumbnail", "audio", "attachment")
INTENTS = ("save", "analyze")

# fixed values: the mime types that may be staged, and the container of each media type
DOCUMENT_MIMES = ("application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document")
IMAGE_MIMES = ("image/png", "image/jpeg")
CONTAINERS = {"audio/mpeg": "mp3", "audio/wav": "wav", "audio/ogg": "ogg", "video/mp4": "mp4", "video/webm": "webm"}

ENVELOPE = (
    "schema_version string, id string, source struct<type:string,provider:string,url:string>, "
    "payload struct<type:string,mime_type:string,text:string,html:string,file_ref:string,title:string>, "
    "context struct<captured_at:string,device:string,application:string>, intent struct<action:string,collection:string,tags:array<string>>"
)
RECORD = (
    "id string, status string, received_at timestamp, updated_at timestamp, source struct<type:string,provider:string,url:string>, payload_type string, "
    "raw_object struct<id:string,mime_type:string,sha256:string,ref:string>, error string, context struct<captured_at:string,device:string,application:string>, "
    "intent struct<action:string,collection:string,tags:array<string>>, title string, schema_version string"
)
SEGMENT = (
    "struct<id:string,type:string,text:string,temporal:struct<start:double,end:double>,spatial:struct<page:int,x:double,y:double,width:double,height:double>,"
    "provenance:struct<kind:string,capture_id:string,asset_id:string,processor:string,version:string>,metadata:string,position:int>"
)
ASSET = "struct<id:string,role:string,mime_type:string,ref:string,sha256:string,metadata:string>"
CONTENT = (
    "id string, type string, source struct<capture_id:string,provider:string,url:string>, original struct<asset_id:string,mime_type:string,sha256:string>, "
    f"title string, metadata string, segments array<{SEGMENT}>, assets array<{ASSET}>, processing array<struct<processor:string,version:string,status:string>>"
)

#: Every failure that has a code, with the status that tells it to a client (fixed values).
ERRORS = {
    "capture_already_exists": 409,
    "content_conflict": 409,
    "invalid_capture_state": 409,
    "not_found": 404,
    "unsupported_payload": 422,
    "invalid_capture_envelope": 422,
    "processing_failed": 422,
    "capture_material_unavailable": 422,
    "processing_configuration_error": 500,
    "data_integrity_error": 500,
    "storage_unavailable": 503,
    "ocr_unavailable": 503,
    "image_ocr_unavailable": 503,
    "media_probe_unavailable": 503,
    "invalid_request": 422,
    "queue_full": 429,
    "operation_not_found": 404,
    "operation_conflict": 409,
    "operation_history_full": 507,
    "result_not_ready": 409,
    "destination_not_found": 404,
    "delivery_not_found": 404,
    "asset_not_found": 404,
    "markdown_too_large": 413,
    "package_too_large": 413,
    "delivery_history_full": 507,
}
#: The status of a code that isn't listed.
OTHER_STATUS = 503


def status_of(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ERRORS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.lit(OTHER_STATUS))
