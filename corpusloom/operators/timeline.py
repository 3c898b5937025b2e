"""Order-dependent operators: positions, timelines, budgets, as-of look-ups, latest snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import is_blank
from corpusloom.operators.running import neighbours, running


def positions(blocks: DataFrame, key: list[str], order: list[str], text: str = "text") -> DataFrame:
    """The blocks that aren't blank, with their running number from 0."""
    w = Window.partitionBy(*key).orderBy(*order)
    return blocks.where(~is_blank(F.col(text))).withColumn("position", F.row_number().over(w) - 1)


def split_segments(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, position, text): the lines that aren't blank, numbered within the row, so that
    nothing is shuffled."""
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda x: ~is_blank(x))
    return docs.select(id_col, F.posexplode(kept).alias("position", "text"))


def gaps(cues: DataFrame, key: list[str], order: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Adds gap, the time since the cue before ended (null for the first), and monotone."""
    w = Window.partitionBy(*key).orderBy(*order)
    df = cues.withColumn("gap", F.col(start) - F.lag(end).over(w))
    return df.withColumn("monotone", F.coalesce(F.col("gap") >= 0, F.lit(True)))


def stream_faults(packets: DataFrame, key: list[str], order: list[str], origin: float, finish: float, gap: float = 0.002, first: float = 0.002, last: float = 0.05) -> DataFrame:
    """(key, rising, gaps_ok, starts_ok, ends_ok) of packets (pts, end) in seconds."""
    w = Window.partitionBy(*key).orderBy(*order)
    df = packets.withColumn("_step", F.col("pts") - F.lag("pts").over(w)).withColumn("_gap", F.abs(F.col("pts") - F.lag("end").over(w)))
    return df.groupBy(*key).agg(
        F.coalesce(F.bool_and(F.col("_step") > 0), F.lit(True)).alias("rising"),
        F.coalesce(F.bool_and(F.col("_gap") <= gap), F.lit(True)).alias("gaps_ok"),
        (F.abs(F.min("pts") - origin) <= first).alias("starts_ok"),
        (F.abs(F.max("end") - finish) <= last).alias("ends_ok"),
    )


# fixed values: seconds that a container's and its streams' times may differ by, the longest
# container, and the bounds of decoding one
FIRST_OFF, LAST_OFF, MOST_SECONDS = 0.002, 0.05, 120
PIXELS, VIDEO_FRAMES, AUDIO_FRAMES, PACKETS = 7_500_000_000, 3600, 6000, 12_000
#: Packets of a range.
RANGE = 50_000


def container_timelines(tracks: DataFrame, packets: DataFrame, key: str, stream: str) -> DataFrame:
    """(key, stream, origin, length, frames, pixels, rising, gaps_ok, starts_ok, ends_ok, fault) of tracks
    (start, duration: as declared) and their packets (pts, duration, pixels; null for sound). The
    origin is the least declared start of the container, its length reaches to the greatest
    end. A stream's packets are cut into ranges of their numbers n, so a long one is many tasks;
    fault is the first test that fails. Times are in seconds."""
    fine = F.coalesce(F.col("start").isNotNull() & (F.col("duration") > 0), F.lit(False))
    span = tracks.groupBy(key).agg(F.min("start").alias("origin"), F.max(F.col("start") + F.col("duration")).alias("_end"), F.bool_and(fine).alias("_fine"))
    given = packets.withColumn("end", F.col("pts") + F.col("duration"))
    ordered = neighbours(given, [key, stream], ["n"], F.floor(F.col("n") / RANGE), _pts="pts", _end="end")
    out = ordered.groupBy(key, stream).agg(
        F.count("*").alias("frames"),
        F.coalesce(F.sum("pixels"), F.lit(0)).alias("pixels"),
        F.coalesce(F.bool_and(F.col("pts") > F.col("_pts")), F.lit(True)).alias("rising"),
        F.coalesce(F.bool_and(F.abs(F.col("pts") - F.col("_end")) <= FIRST_OFF), F.lit(True)).alias("gaps_ok"),
        F.min_by("pts", "n").alias("_first"),
        F.max("end").alias("_last"),
    )
    df = tracks.join(span, key).join(out, [key, stream], "left")
    df = df.withColumn("length", F.col("_end") - F.col("origin")).withColumn("starts_ok", F.abs(F.col("_first") - F.col("start")) <= FIRST_OFF)
    df = df.withColumn("ends_ok", F.abs(F.col("_last") - (F.col("start") + F.col("duration"))) <= LAST_OFF)
    fault = (
        F.when(~F.col("_fine"), "unsupported_timing")
        .when(~F.col("length").between(0, MOST_SECONDS) | (F.col("length") == 0), "duration_limit")
        .when(~F.col("rising"), "unsupported_timing")
        .when(~F.coalesce(F.col("starts_ok"), F.lit(False)), "inconsistent_timing")
        .when(~F.col("gaps_ok"), "unsupported_timing")
        .when(~F.col("ends_ok"), "inconsistent_timing")
    )
    return df.select(key, stream, "origin", "length", "frames", "pixels", "rising", "gaps_ok", "starts_ok", "ends_ok", fault.alias("fault"))


def container_budgets(packets: DataFrame, key: str, stream: str, pixels: int = PIXELS, video_frames: int = VIDEO_FRAMES, audio_frames: int = AUDIO_FRAMES, most: int = PACKETS) -> DataFrame:
    """packets (n, pixels; null for sound) with used_pixels and used_packets of the container and
    used_frames of the stream so far, and fault: decode_budget_exceeded from where one is beyond its
    bound (most: packets). The container's packets go by n, then stream, in ranges of n."""
    part = F.floor(F.col("n") / RANGE)
    df = packets.withColumn("_one", F.lit(1).cast("long"))
    df = running(df, [key], ["n", stream], part, used_pixels=("sum", "pixels"), used_packets=("sum", "_one"))
    df = running(df, [key, stream], ["n"], part, used_frames=("sum", "_one")).drop("_one")
    bound = F.when(F.col("pixels").isNull(), audio_frames).otherwise(video_frames)
    over = (F.col("used_pixels") > pixels) | (F.col("used_frames") > bound) | (F.col("used_packets") > most)
    return df.withColumn("fault", F.when(over, "decode_budget_exceeded"))


def within_budget(rows: DataFrame, key: list[str], order: list[str], size: str, budget: float, part: Column | None = None) -> DataFrame:
    """Adds used, the running sum, and within, whether the budget still holds. part cuts long keys
    into ranges of their order, so that each is many tasks."""
    if part is not None:
        df = running(rows, key, order, part, used=("sum", size))
    else:
        df = rows.withColumn("used", F.sum(size).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("within", F.col("used") <= budget)


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row for each key: the last in order. An aggregate, combined before the shuffle, where
    a window would sort every row."""
    names = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("_last")).select(*key, "_last.*")


def transitions(rows: DataFrame, key: list[str], order: list[str], state: str) -> DataFrame:
    """Adds previous, the state before, null for the first."""
    return rows.withColumn("previous", F.lag(state).over(Window.partitionBy(*key).orderBy(*order)))


def quarter_frames(frames: DataFrame, key: list[str], at: str, row_id: str, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The first frame at or after each share of the key's span, without repeats. A target is a
    bound on one aggregate, so the as-of look-up needs a span for each key and one more pass."""
    span = frames.groupBy(*key).agg(F.min(at).alias("_a"), F.max(at).alias("_z"))
    targets = span.select(*key, F.explode(F.array(*[F.col("_a") + (F.col("_z") - F.col("_a")) * s for s in shares])).alias("_target"))
    hit = frames.join(targets, key).where(F.col(at) >= F.col("_target"))
    return hit.groupBy(*key, "_target").agg(F.min_by(F.struct(at, row_id), F.struct(at, row_id)).alias("_f")).select(*key, "_f.*").distinct()


def shifted(cues: Column, offset: Column) -> Column:
    """Cues (text, start, end) on a timeline that begins so much earlier."""
    return F.transform(cues, lambda c: F.struct(c["text"].alias("text"), (c["start"] + offset).alias("start"), (c["end"] + offset).alias("end")))


def chosen_track(tracks: DataFrame, key: list[str], languages: list[str]) -> DataFrame:
    """Of tracks (code, generated, number): the first by order of languages, then made by hand
    before generated, then by number."""
    place = F.array_position(F.array(*map(F.lit, languages)), F.col("code"))
    return tracks.where(place > 0).groupBy(*key).agg(F.min_by(F.struct("code", "generated", "number"), F.struct(place, "generated", "number")).alias("track")).select(*key, "track.*")


def merged_pages(documents: DataFrame, embedded: DataFrame, recognised: DataFrame, key: str, pages: str = "pages") -> DataFrame:
    """(key, page, text, origin): each page's own text if it isn't blank, else what was
    recognised; pages without either are left out."""
    every = documents.select(key, F.explode(F.sequence(F.lit(1), F.col(pages))).alias("page"))
    own = embedded.where(~is_blank(F.col("text"))).select(key, "page", F.col("text").alias("_own"))
    read = recognised.where(~is_blank(F.col("text"))).select(key, "page", F.col("text").alias("_read"))
    return (
        every.join(own, [key, "page"], "left")
        .join(read, [key, "page"], "left")
        .select(key, "page", F.coalesce("_own", "_read").alias("text"), F.when(F.col("_own").isNotNull(), "text").when(F.col("_read").isNotNull(), "ocr").alias("origin"))
        .where("origin is not null")
    )
