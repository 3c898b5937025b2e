"""Folders that the driver and the executors share, and files that only one writer can make."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """What is in a folder; nothing if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in system.listStatus(p)) if system.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    source = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a whole file of that name, or tells that there is one: of several writers, one
    wins. The text is written under another name first, which is then given the right one without
    replacing: by a hard link on a local (shared) folder, by a rename elsewhere."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(path)
    system = to.getFileSystem(conf)
    made = jvm.org.apache.hadoop.fs.Path(to.getParent(), f"_{uuid.uuid4().hex}")
    system.mkdirs(to.getParent())
    out = system.create(made, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if system.getUri().getScheme() == "file":
            os.link(made.toUri().getPath(), to.toUri().getPath())
            return True
        return not system.exists(to) and system.rename(made, to)
    except FileExistsError:
        return False
    finally:
        system.delete(made, False)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of a few numbers or digests up to which a table is broadcast (about 20 MB).
BROADCAST_ROWS = 200_000


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if df has at most that many rows; looks at no more than it needs to."""
    return df.limit(rows + 1).count() <= rows


def shared(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, or, where that is unset and all runs on one machine, in
    a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
