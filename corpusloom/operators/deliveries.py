"""Deliveries: what a package has to be, how its parts meet, and what became of a submission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.digests import PNG_SIGNATURE, file_name
from corpusloom.functions.text import is_blank

# fixed values: bytes of Markdown and of attachments, entries of a client's history
MARKDOWN_BYTES, IMAGE_BYTES, FRAME_BYTES, FRAMES_BYTES, CLIENT_HISTORY = 1024 * 1024, 16 * 1024 * 1024, 2 * 1024 * 1024, 6 * 1024 * 1024, 50


def delivery_error(capture_id: Column, name: Column, markdown: Column, sha256: Column) -> Column:
    """null, or the first thing that is wrong with a delivery."""
    return (
        F.when(is_blank(capture_id), "capture_id")
        .when(~F.coalesce(name == file_name(capture_id), F.lit(False)), "name")
        .when(F.coalesce(F.octet_length(markdown), F.lit(0)) > MARKDOWN_BYTES, "markdown_too_large")
        .when(~F.coalesce(F.sha2(markdown, 256) == sha256, F.lit(False)), "digest")
    )


def submission_outcome(status: Column, same_id: Column, has_error: Column) -> Column:
    """complete for a success that names the capture, server_error for a failure that says so,
    protocol_error for all else."""
    return F.when(status.isin(200, 201) & F.coalesce(same_id, F.lit(False)), "complete").when(~status.between(200, 299) & F.coalesce(has_error, F.lit(False)), "server_error").otherwise("protocol_error")


def attachments(deliveries: DataFrame, assets: DataFrame, stored: DataFrame, most: int | None = None) -> DataFrame:
    """assets (delivery_id, digest, size) of the deliveries with fault: too_many (where a delivery
    has over `most`), missing, size, digest (if stored has content, it is hashed again) or null. All
    sides grow alike, so they are shuffled, none goes through the driver."""
    digest = F.when(F.col("content").isNotNull(), F.sha2("content", 256)) if "content" in stored.columns else F.lit(None).cast("string")
    known = stored.select("digest", F.col("length").alias("_length"), digest.alias("_again"))
    joined = deliveries.select("delivery_id").join(assets.hint("merge"), "delivery_id").join(known.hint("merge"), "digest", "left")
    fault = F.when(F.col("_length").isNull(), "missing").when(F.col("_length") != F.col("size"), "size").when(F.col("_again") != F.col("digest").cast("string"), "digest")
    if most is not None:
        counts = assets.groupBy("delivery_id").agg(F.count("*").alias("_n"))
        joined = joined.join(counts.hint("merge"), "delivery_id")
        fault = F.when(F.col("_n") > most, "too_many").otherwise(fault)
    return joined.withColumn("fault", fault).drop("_length", "_again", "_n")


def image_agrees(content: Column, mime: Column, pixels: Column) -> Column:
    """The declared type is what the first bytes tell, and size and area are within limits."""
    head = F.hex(F.substring(content, 1, 8))
    told = F.when(head == PNG_SIGNATURE, "image/png").when(head.startswith("FFD8FF"), "image/jpeg")
    return F.coalesce((told == mime) & (F.octet_length(content) <= IMAGE_BYTES) & (pixels <= 40_000_000), F.lit(False))


def transcript_error(outcome: Column, cues: Column, duration: Column, most_bytes: int = 2 * 1024 * 1024) -> Column:
    """Of cues (text, start, end): text is stripped and there, times don't go back or beyond the
    duration, bytes fit, and an outcome of speech has cues while silence has none."""
    step = lambda s, c: F.struct(
        F.coalesce(s["error"], F.when(is_blank(c["text"]), "text").when((c["end"] < c["start"]) | (c["start"] < s["until"]), "order").when(c["end"] > duration + 0.1, "duration")).alias("error"),
        c["end"].cast("double").alias("until"),
        (s["bytes"] + F.octet_length(c["text"])).cast("long").alias("bytes"),
    )
    start = F.struct(F.lit(None).cast("string").alias("error"), F.lit(0.0).alias("until"), F.lit(0).cast("long").alias("bytes"))
    told = F.aggregate(cues, start, step, lambda s: F.coalesce(s["error"], F.when(s["bytes"] > most_bytes, "bytes")))
    return F.when((outcome == "speech") != (F.size(cues) > 0), "outcome").otherwise(told)


def zipped(stored: Column, spoken: Column) -> Column:
    """Texts that are stored with the segments at the same places; lengths have to agree."""
    both = F.zip_with(stored, spoken, lambda a, b: F.struct(a.alias("stored"), b.alias("spoken")))
    return F.when(F.size(stored) == F.size(spoken), both).otherwise(F.raise_error(F.lit("transcript and segments differ in number")).cast("array<struct<stored:string,spoken:string>>"))


def keyframes(assets: Column, segments: Column) -> Column:
    """Each keyframe (id) with the text of the visual segment (asset_id, text) that is about it."""
    return F.transform(assets, lambda a: F.struct(a["id"].alias("id"), F.get(F.filter(segments, lambda s: s["asset_id"] == a["id"]), F.lit(0))["text"].alias("text")))


def table_rows(cells: DataFrame, key: list[str], table: str, row: str, text: str) -> DataFrame:
    """Adds table_index and row_index (from 0), counted before blank rows are left out. The rows are
    sorted once for both, so a task holds one sort."""
    cells = cells.repartition(*key).sortWithinPartitions(*key, table, row)
    df = cells.withColumn("table_index", F.dense_rank().over(Window.partitionBy(*key).orderBy(table)) - 1)
    df = df.withColumn("row_index", F.dense_rank().over(Window.partitionBy(*key, table).orderBy(row)) - 1)
    return df.where(~is_blank(F.col(text)))


def client_history(jobs: DataFrame, key: list[str], seq: str, cap: int = CLIENT_HISTORY) -> DataFrame:
    """jobs with accepted: a full history refuses what comes next and forgets nothing."""
    return jobs.withColumn("accepted", F.row_number().over(Window.partitionBy(*key).orderBy(seq)) <= cap)


def client_jobs(asked: DataFrame, client: str, job: str, same: list[str], seq: str, cap: int = CLIENT_HISTORY) -> DataFrame:
    """asked with outcome, kept_job and place. A request for what a client has asked for before (the
    same columns) is existing and gets the job of the first; new ones are accepted while the
    history has room and then told history_full, as nothing is forgotten. place counts a
    client's accepted jobs from the newest, 1; null for others."""
    first = asked.groupBy(client, *same).agg(F.min(seq).alias("_first"), F.min_by(job, seq).alias("_job"))
    order = Window.partitionBy(client).orderBy("_first")
    first = first.withColumn("_n", F.row_number().over(order)).withColumn("_kept", F.least(F.count("*").over(Window.partitionBy(client)), F.lit(cap)))
    names = {c: f"_k{i}" for i, c in enumerate((client, *same))}
    first = first.withColumnsRenamed(names)
    on = [F.col(c).eqNullSafe(F.col(k)) for c, k in names.items()]
    df = asked.join(first, on, "left")
    fits, new = F.col("_n") <= cap, F.col(seq) == F.col("_first")
    outcome = F.when(~fits, "history_full").when(new, "accepted").otherwise("existing")
    return df.select(*asked.columns, outcome.alias("outcome"), F.when(fits, F.col("_job")).alias("kept_job"), F.when(fits & new, F.col("_kept") - F.col("_n") + 1).alias("place"))


def new_for_receiver(deliveries: DataFrame, journal: DataFrame) -> DataFrame:
    """What a receiver hasn't written yet; a journal entry with another digest is a conflict."""
    seen = journal.select("delivery_id", F.col("sha256").alias("_was"))
    joined = deliveries.join(seen, "delivery_id", "left")
    return joined.withColumn("action", F.when(F.col("_was").isNull(), "write").when(F.col("_was") == F.col("sha256"), "acknowledge").otherwise("conflict")).drop("_was")
