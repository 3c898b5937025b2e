"""Running totals over long streams, by ranges, so that one key is many tasks.

The rows of a key are cut into ranges of their order (of time, for instance). Within a range, a
window adds up; before it stands the total of the ranges before, which a window over one row for
each range gives. Totals and rows are dealt alike, so the rows move once; the window comes before the
join, whose order its sort has already, so a task sorts them once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_KINDS = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def running(rows: DataFrame, key: list[str], order: list[str], part: Column, before: bool = False, **measures: tuple[str, str]) -> DataFrame:
    """Adds a column for each measure name=(kind, column), with kind sum, max or min over the rows of
    the key up to this one (with before: up to the one before; null, or 0 for sums, at the
    first). part numbers the ranges: it must not fall as the order rises."""
    df = rows.withColumn("_part", part)
    own = df.groupBy(*key, "_part").agg(*[_KINDS[kind][0](c).alias(f"_t_{name}") for name, (kind, c) in measures.items()])
    past = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = own.select(*key, "_part", *[_KINDS[kind][0](f"_t_{name}").over(past).alias(f"_b_{name}") for name, (kind, _) in measures.items()])
    here = Window.partitionBy(*key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    own = {f"_o_{name}": _KINDS[kind][0](c).over(here) for name, (kind, c) in measures.items()}
    df = df.withColumns(own).join(base.hint("merge"), [*key, "_part"])
    out = {name: _KINDS[kind][1](F.col(f"_b_{name}"), F.col(f"_o_{name}")) for name, (kind, _) in measures.items()}
    return df.withColumns(out).select(*rows.columns, *measures)


def neighbours(rows: DataFrame, key: list[str], order: list[str], part: Column, **values: str) -> DataFrame:
    """Adds name=(column of the row before, null for the first of the key). The last row of each
    range goes on to the next range that has rows."""
    df = rows.withColumn("_part", part)
    ends = df.groupBy(*key, "_part").agg(F.max_by(F.struct(*values.values()), F.struct(*order)).alias("_last"))
    past = Window.partitionBy(*key).orderBy("_part")
    ends = ends.select(*key, "_part", F.lag("_last").over(past).alias("_before"))
    here = Window.partitionBy(*key, "_part").orderBy(*order)
    df = df.join(ends, [*key, "_part"]).withColumn("_n", F.row_number().over(here))
    out = {name: F.when(F.col("_n") == 1, F.col("_before")[c]).otherwise(F.lag(c).over(here)) for name, c in values.items()}
    return df.withColumns(out).select(*rows.columns, *values)
