"""Content-addressed objects, and rows that are created or replaced.

The objects' files are the data source of raw_objects; tables of versions are in snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.digests import digest, raw_ref, ref_error
from corpusloom.sources import raw_objects
from corpusloom.sources.folders import exists  # noqa: F401


def objects(content: DataFrame, content_col: str = "content") -> DataFrame:
    """(digest, shard, length, content): each different content once."""
    return content.select(digest(F.col(content_col)).alias("digest"), F.col(content_col).alias("content")).dropDuplicates(["digest"]).select("digest", F.substring("digest", 1, 2).alias("shard"), F.octet_length("content").alias("length"), "content")


def copies(content: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(digest, first_id, copies, length): what the store would keep once, and for how many."""
    found = content.groupBy(digest(F.col(content_col)).alias("digest"))
    return found.agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies"), F.max(F.octet_length(content_col)).alias("length"))


def put(content: DataFrame, path: str, content_col: str = "content") -> None:
    """Adds what the store doesn't have; what is there wins. Only the shards of the batch are
    looked at."""
    raw_objects.put(content.select(digest(F.col(content_col)).alias("digest"), F.col(content_col).alias("content")).where("content is not null"), path)


def get(spark: SparkSession, path: str, *refs: str) -> DataFrame:
    """The objects of the references; only their shards are read, and contents are verified."""
    return raw_objects.scan(spark, path).where(F.col("digest").isin([r.removeprefix("sha256:") for r in refs]))


def present(refs: DataFrame, stored: DataFrame, ref_col: str = "ref") -> DataFrame:
    """refs with stored, whether their object is there; a malformed reference is an error."""
    bad = ref_error(F.col(ref_col))
    checked = refs.withColumn("_d", F.when(bad.isNull(), F.substring(F.col(ref_col), 8, 64)).otherwise(F.raise_error(F.concat(F.lit("malformed reference: "), bad))))
    return checked.join(stored.select(F.col("digest").alias("_d"), F.lit(True).alias("_has")).distinct(), "_d", "left").withColumn("stored", F.coalesce("_has", F.lit(False))).drop("_d", "_has")


def create(new: DataFrame, table: DataFrame, *unique: tuple[str, str]) -> DataFrame:
    """new with outcome: created, or the code of the first (column, code) whose value the table
    has already, or an earlier row of new has (in the order of all its columns; of rows that are
    the same in all of them, one is created)."""
    out, told = new, F.lit(None).cast("string")
    for i, (column, _) in enumerate(unique):
        order = Window.partitionBy(column).orderBy(*new.columns)
        out = out.withColumn(f"_n{i}", F.row_number().over(order))
    for i, (column, code) in reversed([*enumerate(unique)]):
        out = out.join(table.select(F.col(column).alias(f"_k{i}")).distinct().withColumn(f"_f{i}", F.lit(True)), F.col(column) == F.col(f"_k{i}"), "left")
        told = F.when(F.coalesce(F.col(f"_f{i}"), F.lit(False)) | (F.col(column).isNotNull() & (F.col(f"_n{i}") > 1)), code).otherwise(told)
    return out.withColumn("outcome", F.coalesce(told, F.lit("created"))).select(*new.columns, "outcome")


def replaced(table: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """The table with the latest version of each row; updates of unknown keys are left out."""
    known = updates.join(table.select(key), key, "left_semi")
    names = [c for c in table.columns if c != key]
    return table.unionByName(known).groupBy(key).agg(F.max_by(F.struct(*names), version).alias("_r")).select(key, "_r.*").select(*table.columns)


def stage(files: DataFrame, path: str, content_col: str = "content", mime: Column | None = None) -> DataFrame:
    """Stores the files' bytes, makes no capture of them, and returns the files without their
    bytes but with raw, the reference by which a capture may name them."""
    put(files.select(F.col(content_col).alias("content")), path)
    return files.withColumn("raw", raw_ref(F.col(content_col), mime)).drop(content_col)


def snapshot_fault(payload: Column, key: Column, versions: tuple[str, ...], id_path: str = "$.id", version_path: str = "$.schema_version", also: tuple[str, Column] | None = None) -> Column:
    """null, or what is wrong with a stored JSON snapshot: missing, not_json, version, key, or
    second_key (also: the path and the column of a second key that it is filed under)."""
    second = F.lit(False) if also is None else ~F.get_json_object(payload, also[0]).eqNullSafe(also[1])
    return (
        F.when(payload.isNull(), "missing")
        .when(F.try_parse_json(payload).isNull(), "not_json")
        .when(~F.coalesce(F.get_json_object(payload, version_path).isin(*versions), F.lit(False)), "version")
        .when(~F.get_json_object(payload, id_path).eqNullSafe(key), "key")
        .when(second, "second_key")
    )
