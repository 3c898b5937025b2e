"""Tables whose rows become visible together: versions by manifest, committed optimistically.

A folder has data/<table>/<id>/ (Parquet, dealt into buckets by a hash of the key, with a bloom
filter on it) and versions/<number>.json, each a whole list of the parts of every table. A writer
reads the last version, writes parts that no version names yet, and commits by creating the next
number, which one writer alone can do; another gets Conflict and begins anew from what is there
then. So a stop between any two writes leaves the version before, and readers of a version see
all tables as of one commit. A writer that takes batches names itself and its batch's number: a
batch that comes again is known by the manifest, with no look at the rows.

Keys are looked up in the buckets that they fall into, by their column alone; where they are
few, they also go to the scan, whose bloom filters leave out the other row groups.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from corpusloom.sources import folders

BUCKETS = 64
#: Keys up to which the scan gets them as a filter.
FEW = 500


class Conflict(Exception):
    """Another writer committed first."""


class Part(NamedTuple):
    """Rows that were written: a path in the folder, and their schema as JSON."""

    path: str
    schema: str


@dataclass(frozen=True)
class Version:
    """tables: of each, its parts in the order of their commits."""

    number: int = 0
    tables: dict[str, list[Part]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def has(self, writer: str | None, batch: int | None) -> bool:
        return writer is not None and batch is not None and batch <= self.batches.get(writer, -1)


def _file(folder: str, number: int) -> str:
    return f"{folder}/versions/{number:012d}.json"


def head(spark: SparkSession, folder: str) -> Version:
    found = [x for x in folders.names(spark, f"{folder}/versions") if x.endswith(".json") and not x.startswith("_")]
    return version(spark, folder, int(found[-1].removesuffix(".json"))) if found else Version()


def version(spark: SparkSession, folder: str, number: int) -> Version:
    told = json.loads(folders.read_text(spark, _file(folder, number)))
    return Version(told["number"], {t: [Part(*p) for p in parts] for t, parts in told["tables"].items()}, told["batches"])


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(BUCKETS)).cast("int")


def part(rows: DataFrame, folder: str, table: str, key: str) -> Part:
    """Writes rows where no version names them yet."""
    name = f"data/{table}/snapshot_part={uuid.uuid4().hex}"
    dealt = rows.withColumn("bucket", bucket(F.col(key))).repartition("bucket").sortWithinPartitions("bucket", key)
    dealt.write.partitionBy("bucket").option("compression", "zstd").option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(f"{folder}/{name}")
    return Part(name, rows.schema.json())


def commit(spark: SparkSession, folder: str, base: Version, parts: dict[str, Part], writer: str | None = None, batch: int | None = None, instead: bool = False) -> Version:
    """The version after base, with the parts added (or, of their tables, in place of all)."""
    tables = base.tables | {t: [*([] if instead else base.tables.get(t, [])), p] for t, p in parts.items()}
    batches = base.batches | ({writer: batch} if writer is not None and batch is not None else {})
    new = Version(base.number + 1, tables, batches)
    if not folders.create_text(spark, _file(folder, new.number), json.dumps(new.__dict__)):
        raise Conflict(f"version {new.number} of {folder} is another writer's")
    return new


def read(spark: SparkSession, folder: str, table: str, at: Version | None = None) -> DataFrame | None:
    """The table's rows in a version (the last); None before its first commit."""
    parts = (at or head(spark, folder)).tables.get(table)
    return None if not parts else rows_of(spark, folder, *parts).drop("bucket")


def rows_of(spark: SparkSession, folder: str, *parts: Part) -> DataFrame:
    """The rows of parts, with their bucket. Parts of one schema are one scan."""
    by_schema: dict[str, list[str]] = {}
    for p in parts:
        by_schema.setdefault(p.schema, []).append(p.path)
    out = None
    for schema, paths in by_schema.items():
        kind = StructType.fromJson(json.loads(schema)).add("bucket", IntegerType())
        base = f"{folder}/{paths[0].rsplit('/', 1)[0]}"
        found = spark.read.schema(kind).option("basePath", base).parquet(*[f"{folder}/{p}" for p in paths]).drop("snapshot_part")
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    return out


def lookup(spark: SparkSession, folder: str, table: str, keys: DataFrame, key: str, at: Version | None = None) -> DataFrame | None:
    """The table's rows of the keys (a column named key)."""
    parts = (at or head(spark, folder)).tables.get(table)
    if not parts:
        return None
    asked = keys.select(key).where(F.col(key).isNotNull()).distinct()
    in_buckets = [r[0] for r in asked.select(bucket(F.col(key))).distinct().collect()]  # at most BUCKETS
    rows = rows_of(spark, folder, *parts).where(F.col("bucket").isin(in_buckets))
    few = [r[0] for r in asked.limit(FEW + 1).collect()]
    if len(few) <= FEW:
        return rows.where(F.col(key).isin(few)).drop("bucket")
    return rows.join(asked, key, "left_semi").select(*[c for c in rows.columns if c != "bucket"])


def compact(spark: SparkSession, folder: str, table: str, key: str) -> Version:
    """One part in place of a table's many; readers of earlier versions keep theirs."""
    base = head(spark, folder)
    rows = read(spark, folder, table, base)
    return base if rows is None or len(base.tables[table]) == 1 else commit(spark, folder, base, {table: part(rows, folder, table, key)}, instead=True)


def vacuum(spark: SparkSession, folder: str, keep: int = 10) -> list[str]:
    """Removes versions before the last `keep`, and parts that none of those names. Not while
    another writer is at work: its parts aren't named yet."""
    last = head(spark, folder)
    stay = [version(spark, folder, n) for n in range(max(1, last.number - keep + 1), last.number + 1)]
    named = {p.path for v in stay for parts in v.tables.values() for p in parts}
    gone = [f"data/{t}/{p}" for t in folders.names(spark, f"{folder}/data") for p in folders.names(spark, f"{folder}/data/{t}")]
    gone = [p for p in gone if p not in named] + [f"versions/{x}" for x in folders.names(spark, f"{folder}/versions") if x.endswith(".json") and int(x[:-5]) < (stay[0].number if stay else 0)]
    for p in gone:
        folders.remove(spark, f"{folder}/{p}")
    return gone
