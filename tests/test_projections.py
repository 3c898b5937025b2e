"""Ids that are minted once, and what a receiver's paths refuse."""

from pyspark.sql import functions as F

from corpusloom.operators import projections


def test_minted_once(spark, tmp_path):
    folder = str(tmp_path / "ids")
    first = {r.k: r.id for r in projections.minted(spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "k string"), "k", folder).collect()}
    again = {r.k: r.id for r in projections.minted(spark.createDataFrame([("b",), ("c",)], "k string"), "k", folder).collect()}
    assert first["a"] and first["a"] != first["b"] and first[None] is None
    assert again["b"] == first["b"] and again["c"] not in first.values()


def test_folders(spark):
    good = ["Inbox", "Inbox/a b", "x" * 80]
    bad = [None, "", "a//b", "/a", "a/", ".a", "a.", "a ", "a:b", "a\\b", "NUL", "com1.txt", "x" * 81, "A/Settings", "/".join(["x" * 60] * 4)]
    frame = spark.createDataFrame([(f,) for f in good + bad], "folder string")
    got = [r[0] for r in frame.select(projections.folder_ok(F.col("folder"), "settings")).collect()]
    assert got == [True] * len(good) + [False] * len(bad)
    name = F.concat(F.lit("capture-"), F.sha2(F.lit("1"), 256), F.lit(".png"))
    row = spark.range(1).select(projections.note_path(F.lit("a"), name, "s").alias("md"), projections.note_path(F.lit("a"), name, "s", "png|jpg").alias("asset")).first()
    assert row.md is None and row.asset.startswith("a/capture-")
