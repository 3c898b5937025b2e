"""What is told of media, recognitions, operations and destinations: metadata in which an absent
value is absent (never null), views of operations, and the rules of where a receiver may write."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.digests import NAME_PREFIX
from corpusloom.schema import VERSIONS
from corpusloom.sources import store

# fixed values: the versions that carry capture metadata and audio, the states of an operation
# with a result, the limits of a receiver's folders, and its times between polls in milliseconds
METADATA_VERSIONS = ("0.2", "0.3")
AUDIO_VERSIONS = ("0.3",)
LIMIT_KEYS = {"encoded_pixel_limit": "max_encoded_pixels", "encoded_byte_limit": "max_encoded_bytes"}
FOLDER_CHARS, PART_CHARS = 200, 80
FIRST_DELAY, LAST_DELAY = 30_000, 300_000
NEXT_ACTION = "Inspect the capture before explicitly submitting a new operation ID."

# fixed values: characters that no part of a path may have, and names of devices
_FORBIDDEN = r'[\x00-\x1f\x7f-\x9f\\:%<>"|?*]'
_RESERVED = r"(?i)^(con|prn|aux|nul|com[0-9]|lpt[0-9])(\.|$)"


def json_without_nulls(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "true"})


def streams_by(streams: DataFrame, key: str, order: str, fields: list[str], name: str) -> DataFrame:
    """(key, name): the streams of each key as a list in the order of their index; equal indexes follow
    the fields, absent ones first."""
    return streams.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("index"), *fields))).alias(name))


def media_metadata(container: Column, seconds: Column, audio: Column, video: Column) -> Column:
    """JSON of a probe. Lists of streams stay when they are empty (a null list is empty), the
    counts are their sizes, and what a container doesn't declare is absent."""
    sizes = [F.when(x.isNull(), 0).otherwise(F.size(x)) for x in (audio, video)]
    media = F.struct(container.alias("container"), seconds.alias("duration_seconds"), sizes[0].alias("audio_stream_count"), sizes[1].alias("video_stream_count"))
    lists = [F.when(n == 0, F.lit("[]")).otherwise(json_without_nulls(x)) for n, x in zip(sizes, (audio, video), strict=True)]
    return F.concat(F.lit('{"media":'), json_without_nulls(media), F.lit(',"audio_streams":'), lists[0], F.lit(',"video_streams":'), lists[1], F.lit("}"))


def recognition_metadata(refusal: Column, limit: Column, engine: Column, version: Column, settings: Column) -> Column:
    """JSON of a recognition: the engine, its version and settings if it ran; otherwise the bound
    that was crossed and its value, and nothing of an engine. An unknown refusal gives null."""
    ran = F.struct(F.lit(True).alias("engine_invoked"), engine.alias("engine"), version.alias("engine_version"), settings.alias("settings"))
    out = F.when(refusal.isNull(), json_without_nulls(ran))
    for reason, key in LIMIT_KEYS.items():
        out = out.when(refusal == reason, json_without_nulls(F.struct(F.lit(False).alias("engine_invoked"), refusal.alias("skipped_reason"), limit.alias(key))))
    return out


def page_list(pages: Column) -> Column:
    """Page numbers, ascending."""
    return F.array_sort(pages)


def versions_before(having: tuple[str, ...]) -> Column:
    """The known versions without those that have a feature."""
    return F.array_except(F.array(*map(F.lit, VERSIONS)), F.array(*map(F.lit, having)))


def operation_view(operations: DataFrame) -> DataFrame:
    """operations (state, ...) as a client sees them: the reserved id and the text of a result are
    left out; result_available and, for an interrupted one, the next action are added."""
    shown = operations.drop("reserved_capture_id", "markdown")
    action = F.when(F.col("state") == "interrupted", NEXT_ACTION)
    return shown.withColumns({"result_available": F.coalesce(F.col("state") == "complete", F.lit(False)), "next_action": action})


def composed(text: Column) -> Column:
    """Whether a text is in composed form (NFC). ASCII always is; the tables of Unicode that decide
    for the rest are Python's, so batches go there. Null: null."""

    @F.pandas_udf("boolean")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else unicodedata.is_normalized("NFC", x))

    return normal(text)


def utf16_units(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def folder_ok(folder: Column, settings_folder: str) -> Column:
    """Whether a receiver may write into a folder in composed form: parts of 1 to PART_CHARS UTF-16
    units that hide nothing, end in no space or full stop, hold no forbidden character, and are no
    device's name nor the folder of the settings. Null: false."""
    part_ok = lambda p: (
        utf16_units(p).between(1, PART_CHARS) & ~p.startswith(".") & ~p.rlike(r"[. ]$") & ~p.rlike(_FORBIDDEN) & ~p.rlike(_RESERVED) & (F.lower(p) != settings_folder.lower())
    )
    return F.coalesce(utf16_units(folder).between(1, FOLDER_CHARS) & composed(folder) & F.forall(F.split(folder, "/", -1), part_ok), F.lit(False))


def note_path(folder: Column, name: Column, settings_folder: str, extensions: str = "md") -> Column:
    """folder/name, or null where either is refused; extensions: alternatives of a pattern."""
    named = name.rlike(rf"\A{NAME_PREFIX}[0-9a-f]{{64}}\.({extensions})\z")
    return F.when(folder_ok(folder, settings_folder) & named, F.concat(folder, F.lit("/"), name))


def poll_delay(failures: Column) -> Column:
    """Milliseconds to the next poll after so many failures in a row: doubled for each, to a bound."""
    steps = F.least(failures, F.lit(10)).cast("int")
    return F.least(F.lit(FIRST_DELAY) * F.pow(F.lit(2), steps), F.lit(LAST_DELAY)).cast("long")


def peaks(samples: DataFrame, key: list[str], *measures: str) -> DataFrame:
    """The largest value of each measure."""
    return samples.groupBy(*key).agg(*[F.max(m).alias(m) for m in measures])


def destinations(rows: DataFrame, order: str) -> DataFrame:
    """Destinations in the order in which they were added."""
    return rows.orderBy(order)


def too_large(content: Column, limit: int) -> Column:
    """Whether content is beyond a reader's bound; null content isn't."""
    return F.coalesce(F.octet_length(content) > limit, F.lit(False))


def minted(rows: DataFrame, key: str, folder: str) -> DataFrame:
    """rows with an id that is random, not a digest, made once for each key and kept in folder,
    so that a row that comes again, or a task that runs again, has the id it had. One writer at
    a time. Null keys have no id."""
    spark = rows.sparkSession
    new = rows.select(key).where(F.col(key).isNotNull()).distinct()
    if store.exists(spark, folder):
        new = new.join(spark.read.parquet(folder).select(key), key, "left_anti")
    new.withColumn("id", F.expr("uuid()")).write.mode("append").parquet(folder)
    return rows.join(spark.read.parquet(folder), key, "left")
