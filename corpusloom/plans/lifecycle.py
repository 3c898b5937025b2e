"""The life of a capture as rows that are only added: received, stored, processing, and then
complete or failed. All rows of a batch are one version of the tables, so a stop leaves the
version before, from which the work can be done again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.functions.digests import ref_error
from corpusloom.operators.route import PROCESSORS
from corpusloom.operators.validate import material
from corpusloom.plans.contents import admitted, text_contents, web_contents
from corpusloom.sources import folders, raw_objects, snapshots, store

# fixed values: which state may follow which
NEXT = {"received": ("stored",), "stored": ("processing",), "processing": ("complete", "failed")}


def _states(df: DataFrame, status, step: int, error=None) -> DataFrame:
    return df.select("id", (F.lit(status) if isinstance(status, str) else status).alias("status"), F.lit(step).alias("step"), (F.lit(None).cast("string") if error is None else error).alias("error"))


#: What each processor makes of its captures; services has more of them.
READERS = {"text@0.2": text_contents, "webpage@0.1": web_contents}
SEGMENTS = "array<struct<position:int,type:string,text:string,provenance:string,start:double,end:double,page:int>>"


def wide(contents: DataFrame) -> DataFrame:
    """contents with segments of one type and an error, whichever processor made them."""
    have = contents.schema["segments"].dataType.elementType.fieldNames()
    fields = [f.split(":") for f in SEGMENTS.removeprefix("array<struct<").removesuffix(">>").split(",")]
    one = lambda s: F.struct(*[(s[n] if n in have else F.lit(None)).cast(k).alias(n) for n, k in fields])
    error = F.col("error") if "error" in contents.columns else F.when(F.col("status") != "complete", "processing_failed")
    return contents.select("capture_id", "type", "title", "sha256", F.transform("segments", one).cast(SEGMENTS).alias("segments"), "status", error.alias("error"))


def ingest(captures: DataFrame, folder: str, writer: str | None = None, batch: int | None = None, attempts: int = 5, readers: dict | None = None, processors: dict | None = None) -> snapshots.Version:
    """One batch of envelopes into folder: originals into raw, and the states, contents and
    refusals of its captures as one version of the tables, so that they become visible together. Captures
    that came to an end, or were refused, aren't taken again, and a batch that comes again (with
    its writer's name and number) is known by the version. If another writer commits first, the
    batch is judged again by what is there then. readers: {processor: function of its captures to
    contents}; a capture of another processor is left alone. processors: those that
    captures are routed among. Material that is named by reference has to be in raw."""
    spark = captures.sparkSession
    for _ in range(attempts):
        base = snapshots.head(spark, folder)
        if base.has(writer, batch):
            return base
        try:
            return snapshots.commit(spark, folder, base, _parts(captures, folder, base, readers or READERS, processors), writer, batch)
        except snapshots.Conflict:
            continue
    raise snapshots.Conflict(f"{attempts} other writers committed first")


def _parts(captures: DataFrame, folder: str, base: snapshots.Version, readers: dict, processors: dict | None) -> dict[str, snapshots.Part]:
    """Writes the rows that a batch adds; {table: part}."""
    spark = captures.sparkSession
    ref = F.col("payload.file_ref")
    payload = [F.col(f"payload.{c}") for c in ("type", "text", "html", "file_ref")]
    judged = admitted(captures, processors).withColumn("digest", F.when(ref_error(ref).isNull(), F.substring(ref, 8, 64)))
    judged = judged.withColumn("_material", material(*payload, captions="captions@0.1" in (processors or PROCESSORS)))
    # written once, as it comes: texts needn't move to tell which captures are new
    work = f"{folder}/data/_judged/{uuid.uuid4().hex}"
    judged.withColumn("_row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(work)
    judged = spark.read.schema(StructType([*judged.schema.fields, StructField("_row", LongType())])).parquet(work)
    ids = judged.groupBy("id").agg(F.min("_row").alias("_row"))
    for table in ("states", "refusals"):
        known = snapshots.lookup(spark, folder, table, ids, "id", base)
        if known is not None:
            ids = ids.join(known.select("id").distinct(), "id", "left_anti")
    gone = judged.select("_row").join(ids.select("_row"), "_row", "left_anti")
    judged = judged.join(F.broadcast(gone) if folders.fits(gone) else gone, "_row", "left_anti").drop("_row")
    judged = raw_objects.present(judged, f"{folder}/raw")
    inline = F.when(F.col("_material.material") == "text", F.col("payload.text")).when(F.col("_material.material") == "html", F.col("payload.html"))
    unavailable = F.when(ref.isNotNull() & ~F.col("stored"), "capture_material_unavailable")
    judged = judged.withColumn("route_error", F.coalesce("route_error", "_material.error", unavailable))
    refused = judged.where("size(errors) > 0 or route_error is not null")
    good = judged.where("size(errors) = 0 and route_error is null")
    known = good.where(F.col("processor").isin(*readers)).where(inline.isNotNull() | F.col("stored"))
    store.put(known.where(inline.isNotNull()).select(F.encode(inline, "UTF-8").alias("content")), f"{folder}/raw")
    contents = None
    for name, read in readers.items():
        made = wide(read(known.where(F.col("processor") == name)))
        contents = made if contents is None else contents.unionByName(made)
    out = {"contents": snapshots.part(contents, folder, "contents", "capture_id")}
    ends = snapshots.rows_of(spark, folder, out["contents"]).groupBy(F.col("capture_id").alias("id")).agg(F.max(F.col("status") == "complete").alias("_has"), F.max("error").alias("_error"))
    ended = known.select("id").join(ends, "id", "left").withColumn("_has", F.coalesce("_has", F.lit(False)))
    states = _states(known, "received", 0).union(_states(known, "stored", 1)).union(_states(known, "processing", 2))
    states = states.union(_states(ended, F.when(F.col("_has"), "complete").otherwise("failed"), 3, F.when(~F.col("_has"), F.coalesce("_error", F.lit("processing_failed")))))
    out["states"] = snapshots.part(states, folder, "states", "id")
    told = refused.select("id", F.to_json("errors").alias("errors"), F.col("route_error").cast("string").alias("route_error"))
    out["refusals"] = snapshots.part(told, folder, "refusals", "id")
    folders.remove(spark, work)
    return out


def table(spark: SparkSession, folder: str, name: str, ids: DataFrame | None = None) -> DataFrame | None:
    """states, contents or refusals as of the last version; of the given ids (a column named as
    the table's key), found in their buckets, or of all."""
    key = "capture_id" if name == "contents" else "id"
    out = snapshots.read(spark, folder, name) if ids is None else snapshots.lookup(spark, folder, name, ids, key)
    # what a failed capture's processor told is kept, but is no content
    return out if out is None or name != "contents" else out.where("status = 'complete'")


def illegal(states: DataFrame) -> DataFrame:
    """States that don't follow from the one before."""
    from corpusloom.operators.timeline import transitions

    table = F.create_map(*[x for k, v in NEXT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    after = transitions(states, ["id"], ["step"], "status")
    return after.where(F.when(F.col("previous").isNull(), F.col("status") != "received").otherwise(~F.coalesce(F.array_contains(F.try_element_at(table, F.col("previous")), F.col("status")), F.lit(False))))
