"""A receiver as an idempotent sink on tables of versions: notes and the journal of what was written
become visible together, and deliveries are looked up in the journal by their keys' buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.deliveries import delivery_error, new_for_receiver
from corpusloom.sources import snapshots

JOURNAL = "delivery_id string, sha256 string, name string"


def receive(deliveries: DataFrame, folder: str, writer: str | None = None, batch: int | None = None, attempts: int = 5) -> snapshots.Version:
    """One batch (delivery_id, capture_id, name, markdown, sha256) into folder. A batch that comes
    again is known by the version, a delivery by the journal."""
    spark = deliveries.sparkSession
    good = deliveries.dropDuplicates(["delivery_id"]).where(delivery_error(F.col("capture_id"), F.col("name"), F.col("markdown"), F.col("sha256")).isNull())
    for _ in range(attempts):
        base = snapshots.head(spark, folder)
        if base.has(writer, batch):
            return base
        journal = snapshots.lookup(spark, folder, "journal", good, "delivery_id", base)
        new = new_for_receiver(good, spark.createDataFrame([], JOURNAL) if journal is None else journal).where("action = 'write'")
        notes = snapshots.part(new.select("delivery_id", "name", "markdown", "sha256"), folder, "notes", "delivery_id")
        # of what was written, as deliveries may be made anew each time they are read
        told = snapshots.rows_of(spark, folder, notes).select("delivery_id", "sha256", "name")
        try:
            return snapshots.commit(spark, folder, base, {"notes": notes, "journal": snapshots.part(told, folder, "journal", "delivery_id")}, writer, batch)
        except snapshots.Conflict:
            continue
    raise snapshots.Conflict(f"{attempts} other writers committed first")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """notes or journal as of the last version."""
    return snapshots.read(spark, folder, name)


def run(deliveries: DataFrame, folder: str, checkpoint: str):
    return deliveries.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: receive(batch, folder, checkpoint, n)).trigger(availableNow=True).start()
