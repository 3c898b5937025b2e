"""Notes of a video: speech and described frames on one timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.digests import asset_name
from corpusloom.functions.text import frontmatter
from corpusloom.operators.timeline import quarter_frames, shifted
from corpusloom.plans.render import _two


def notes(videos: DataFrame, cues: DataFrame, frames: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(id, segments, keyframes). videos (id, offset); cues (id, text, start, end); frames (id,
    frame_id, at); descriptions (frame_id, text). Keyframes stand at the quarters of the frames'
    span; speech is shifted by the offset."""
    spoken = cues.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("cues"))
    picked = quarter_frames(frames, ["id"], "at", "frame_id").join(descriptions.withColumnRenamed("text", "about"), "frame_id", "left")
    seen = picked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("at").cast("double").alias("at"), "frame_id", "about"))).alias("frames"))
    joined = videos.join(spoken, "id", "left").join(seen, "id", "left")
    none = F.array().cast("array<struct<type:string,start:double,end:double,text:string,asset_id:string>>")
    speech = F.transform(shifted(F.col("cues"), F.col("offset")), lambda c: F.struct(F.lit("transcript").alias("type"), c["start"].cast("double").alias("start"), c["end"].cast("double").alias("end"), c["text"].alias("text"), F.lit(None).cast("string").alias("asset_id")))
    visual = F.transform(F.filter("frames", lambda f: f["about"].isNotNull()), lambda f: F.struct(F.lit("visual").alias("type"), f["at"].alias("start"), f["at"].alias("end"), f["about"].alias("text"), f["frame_id"].cast("string").alias("asset_id")))
    keyframes = F.transform("frames", lambda f: F.struct(f["frame_id"].cast("string").alias("id"), asset_name(F.col("id").cast("string"), f["frame_id"].cast("string")).alias("name")))
    return joined.select("id", F.concat(F.coalesce(speech, none), F.coalesce(visual, none)).alias("segments"), F.coalesce(keyframes, F.array().cast("array<struct<id:string,name:string>>")).alias("keyframes"))


def markdown(fields: dict[str, Column], title: Column, segments: Column, keyframes: Column) -> Column:
    """Speech with its times, then each keyframe with what is seen."""
    line = lambda s: F.concat(F.lit("["), _two(s["start"]), F.lit(" - "), _two(s["end"]), F.lit(" sec] "), s["text"])
    speech = F.transform(F.filter(segments, lambda s: s["type"] == "transcript"), line)

    def frame(k):
        about = F.get(F.filter(segments, lambda s: s["asset_id"] == k["id"]), F.lit(0))
        return F.concat_ws("\n\n", F.concat(F.lit("![["), k["name"], F.lit("]]")), about["text"])

    return F.concat_ws(
        "\n\n",
        frontmatter(fields),
        F.concat(F.lit("# "), title),
        F.when(F.size(speech) > 0, F.concat(F.lit("## Speech\n\n"), F.array_join(speech, "\n"))),
        F.when(F.size(keyframes) > 0, F.concat(F.lit("## Frames\n\n"), F.array_join(F.transform(keyframes, frame), "\n\n"))),
    )
