"""Progress of work as a merge that only moves forward: reports may come late, twice or in any
order, as a table or a stream, and the last stage and the peaks stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

# fixed values: the stages of a video's notes, in their order
STAGES = ("waiting", "extracting", "transcribing", "frame_1", "frame_2", "frame_3", "saving")


def merged(reports: DataFrame, key: str = "id", stages: tuple[str, ...] = STAGES, *peaks: str) -> DataFrame:
    """(key, stage, reports, refused, peaks...): the furthest stage, and the largest of each measure. The
    merge is a maximum over the order of stages, so the order of reports changes nothing. A stage
    that isn't one counts as refused. As a stream (output mode update or complete), its state is
    one row for each key."""
    place = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    known = F.coalesce(place, F.lit(0)) > 0
    df = reports.groupBy(key).agg(F.max(F.when(known, place)).alias("_stage"), F.count_if(known).alias("reports"), F.count_if(~known).alias("refused"), *[F.max(p).alias(p) for p in peaks])
    return df.select(key, F.get(F.array(*map(F.lit, stages)), (F.col("_stage") - 1).cast("int")).alias("stage"), "reports", "refused", *peaks)


def observed(rows: DataFrame, name: str, *measures: str) -> tuple[DataFrame, Observation]:
    """rows, and what a run of them will have counted: rows, and the largest and the sum of each
    measure, without another pass."""
    watch = Observation(name)
    told = [F.count(F.lit(1)).alias("rows")]
    for m in measures:
        told += [F.max(m).alias(f"max_{m}"), F.sum(m).alias(f"sum_{m}")]
    return rows.observe(watch, *told), watch
