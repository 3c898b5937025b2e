"""What a task has to sort, and what passes through the driver."""

import pytest
from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.operators import running

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["frame_attachments", "delivery_attachments"])
def test_nothing_is_broadcast(spark, name):
    assert "Broadcast" not in _plan(catalog.queries()[name](spark, SF))


def test_tables_are_sorted_once(spark):
    assert _plan(catalog.queries()["table_numbering"](spark, SF)).count("Sort [") == 1


def test_ranges_are_sorted_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(100).select((F.col("id") % 3).alias("k"), "id", F.lit(1).alias("n"))
        df = running.running(rows, ["k"], ["id"], F.floor(F.col("id") / 10), used=("sum", "n"))
        # the rows, and the ranges' totals by key and for the join
        assert _plan(df).count("Sort [") == 3
        assert {r.id: r.used for r in df.collect()} == {i: i // 3 + 1 for i in range(100)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
