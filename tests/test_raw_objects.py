"""The content-addressed data source: phases, pruning, verification."""

import hashlib
import os
import pathlib

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import raw_objects, store


def _put(spark, path, texts):
    store.put(spark.createDataFrame([(t.encode(),) for t in texts], "content binary"), path)


def _digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _files(folder):
    return sorted(str(p.relative_to(folder)) for p in pathlib.Path(folder).rglob("*.parquet"))


@pytest.fixture
def path(spark, tmp_path):
    out = f"file://{tmp_path}/raw"
    _put(spark, out, [f"text {i}" for i in range(300)])
    return out


def test_whole_and_once(spark, path, tmp_path):
    before = _files(tmp_path)
    _put(spark, path, [f"text {i}" for i in range(250, 300)])
    assert _files(tmp_path) == before
    _put(spark, path, [f"text {i}" for i in range(200, 400)] * 2)
    rows = raw_objects.scan(spark, path).collect()
    assert {r.content.decode() for r in rows} == {f"text {i}" for i in range(400)} and len(rows) == 400
    assert all(r.digest == _digest(r.content.decode()) and r.shard == r.digest[:2] and r.length == len(r.content) for r in rows)
    assert not list(pathlib.Path(tmp_path, "raw", "_staged").rglob("*.parquet"))
    assert raw_objects.scan(spark, path, content=False).columns == ["digest", "shard", "length"]


def test_only_the_shards_of_a_batch_are_opened(spark, path, tmp_path):
    """All files but those of two shards are spoilt: put and get of those two don't notice."""
    texts = [f"new {i}" for i in range(2000)]
    shards = {_digest("text 1")[:2], _digest("text 2")[:2]}
    mine = [t for t in texts if _digest(t)[:2] in shards]
    for f in pathlib.Path(tmp_path).rglob("*.parquet"):
        if f.parent.name not in shards:
            f.write_bytes(b"spoilt")
    _put(spark, path, [*mine, "text 1", "text 2"])
    got = store.get(spark, path, f"sha256:{_digest('text 1')}", _digest(mine[0]), "sha256:" + _digest("text 2")[:2] + "0" * 62)
    assert {r.content.decode() for r in got.collect()} == {"text 1", mine[0]}
    refs = spark.createDataFrame([(_digest(t),) for t in [*mine, "text 1"]] + [(min(shards) + "f" * 62,), (None,)], "digest string")
    told = {r.digest: r.stored for r in raw_objects.present(refs, path).collect()}
    assert sum(told.values()) == len(mine) + 1 and told[None] is False and told[min(shards) + "f" * 62] is False
    assert raw_objects.scan(spark, path).where(F.col("shard").isin(*shards)).where("length > 0").count() >= len(mine) + 2
    with pytest.raises(Exception, match="(?i)parquet"):
        raw_objects.scan(spark, path).count()


def test_contents_are_verified(spark, path, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    file = next(pathlib.Path(tmp_path).rglob("*.parquet"))
    table = pq.read_table(file, partitioning=None)
    pq.write_table(table.set_column(3, "content", pa.array([b"other"] * len(table), pa.binary())), file)
    with pytest.raises(Exception, match="isn't what its digest says"):
        raw_objects.scan(spark, path).collect()
    assert raw_objects.scan(spark, path, content=False).count() == 300
    wrong = spark.createDataFrame([("0" * 64, b"x")], "digest string, content binary")
    with pytest.raises(Exception, match="another digest"):
        raw_objects.put(wrong, path)
    assert not list(pathlib.Path(tmp_path, "raw", "_staged").rglob("*.parquet"))


def test_two_writers_store_once_for_readers(spark, path, tmp_path):
    """The same object in two files, as of two writers at once, is read once."""
    import pyarrow.parquet as pq

    text = "text 5"
    folder = pathlib.Path(tmp_path, "raw", "objects", _digest(text)[:2])
    for f in list(folder.glob("*.parquet")):
        table = pq.read_table(f, partitioning=None)
        only = table.filter([d == _digest(text) for d in table["digest"].to_pylist()])
        if len(only):
            pq.write_table(only, folder / f"{_digest(text)[:16]}-{_digest(text)[:16]}-ffff.parquet")
    assert raw_objects.scan(spark, path).count() == 300 == raw_objects.scan(spark, path).select("digest").distinct().count()


def test_written_by_the_format(spark, path, tmp_path):
    rows = spark.createDataFrame([(_digest(t), t.encode()) for t in ("text 3", "written", "again")], "digest string, content binary")
    for _ in range(2):
        rows.repartition(F.substring("digest", 1, 2)).sortWithinPartitions("digest").write.format(raw_objects.NAME).mode("append").save(path)
    assert raw_objects.scan(spark, path).count() == 302 and store.get(spark, path, _digest("written")).count() == 1
    assert not list(pathlib.Path(tmp_path, "raw", "_staged").rglob("*.parquet"))


def test_empty_and_refused(spark, tmp_path):
    path = f"{tmp_path}/none"
    assert raw_objects.scan(spark, path).count() == 0 and raw_objects.stored_among(path, ["0" * 64]) == set()
    _put(spark, path, [])
    assert raw_objects.scan(spark, path).count() == 0
    _put(spark, path, ["", "é" * 100_000])
    assert sorted(r.length for r in raw_objects.scan(spark, path).collect()) == [0, 200_000]
    with pytest.raises(Exception, match="never replaced"):
        raw_objects.scan(spark, path).select("digest", "content").write.format(raw_objects.NAME).mode("overwrite").save(path)
    assert os.path.isdir(f"{path}/objects")


def test_batches_are_cut(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(raw_objects, "GROUP", 1000)
    batch = pa.RecordBatch.from_pydict({"digest": [str(i) for i in range(50)], "content": [b"x" * 100] * 50})
    cut = list(raw_objects.slices(iter([batch, batch.slice(0, 0)])))
    assert pa.Table.from_batches(cut) == pa.Table.from_batches([batch]) and max(x.nbytes for x in cut) <= 1000
