"""What several operators share: tables in the shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark removes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or, where
    that is unset and all runs on one machine (tests), a temporary folder that is then set there."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(folder)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, so the loss of
    an executor costs at most the tasks that were running. The write's shuffle files go when it
    ends, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *frames: DataFrame) -> None:
    """Removes tables that stored() wrote and that nothing reads any more."""
    jvm = spark._jvm
    for frame in frames:
        for file in frame.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fits(df: DataFrame, rows: int) -> bool:
    """True if df has at most that many rows; looks at no more than it needs to."""
    return df.limit(rows + 1).count() <= rows


def kept_rows(df: DataFrame, condition) -> DataFrame:
    """df.where(condition), tested after the columns are computed: a filter that moves below
    them would repeat their expressions, even for each element of an array."""
    return df.withColumn("_row", F.monotonically_increasing_id()).where((F.col("_row") >= 0) & condition).drop("_row")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: (a, b), undirected, of any type with an order; repeated edges, loops and rows with
    a null end are allowed and change nothing. Returns (node, component) for every node that
    has an edge to another node; component is the smallest node of its component. Each round
    is stored in the shared folder. A node with very many edges is met by a minimum (which is
    combined before the shuffle) and by a join (whose large partitions Spark splits).
    """
    spark = edges.sparkSession
    now = stored(
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        name,
    )
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or tuple(seen) == mark:
            break
        mark = tuple(seen)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .where("v > m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = stored(small, name)
        delete(spark, now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
