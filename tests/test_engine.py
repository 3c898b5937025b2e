"""Lifecycle, stream and state operators."""

import json
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import queue
from corpusloom.plans import contents, lifecycle, render
from corpusloom.sources import raw_objects, store
from corpusloom.streaming import captures


def _captures(spark):
    docs = spark.createDataFrame([(1, "hello"), (2, " "), (3, None)], "doc_id long, text string")
    pages = spark.createDataFrame([(4, "<p>hi</p>"), (5, "<script>x</script>")], "page_id long, html string")
    return contents.envelopes(docs, F.col("doc_id"), "text", text=F.col("text")).union(contents.envelopes(pages, F.col("page_id"), "webpage", html=F.col("html")))


def test_ingest_twice(spark, tmp_path):
    folder = f"file://{tmp_path}/lake"
    for _ in range(2):
        lifecycle.ingest(_captures(spark), folder)
    states = lifecycle.table(spark, folder, "states")
    ended = {(r.id, r.status) for r in states.where("step = 3").collect()}
    assert ended == {("1", "complete"), ("4", "complete"), ("5", "failed")}
    assert states.count() == 12 and lifecycle.illegal(states).count() == 0
    assert lifecycle.table(spark, folder, "contents").count() == 2
    assert raw_objects.scan(spark, f"{folder}/raw").count() == 3
    asked = spark.createDataFrame([("1",), ("9",)], "capture_id string")
    assert [r.capture_id for r in lifecycle.table(spark, folder, "contents", asked).collect()] == ["1"]


def test_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    rows = [json.loads(x) for x in _captures(spark).toJSON().collect()]
    (inbox / "a.json").write_text("\n".join(map(json.dumps, rows)))
    run = captures.run(captures.source(spark, str(inbox)), f"file://{tmp_path}/lake", f"file://{tmp_path}/cp")
    run.awaitTermination(120)
    assert lifecycle.table(spark, f"file://{tmp_path}/lake", "contents").count() == 2


def test_markdown_and_json(spark):
    row = spark.range(1).select(
        render.markdown(F.lit(None).cast("string"), F.array(F.lit(None).cast("string"))),
        render.markdown(F.lit("T"), F.array(F.lit("a"), F.lit(None), F.lit("b"))),
        render.json(F.struct(F.lit("é").alias("a"), F.lit(None).cast("int").alias("b"))),
        render.transcript({"id": F.lit("x")}, F.lit("T"), F.array(F.struct(F.lit("hi").alias("text"), F.lit(1.005).alias("start"), F.lit(2.5).alias("end")))),
        tx.fenced(F.lit("a ```` b")),
    ).first()
    assert row[0] == "" and row[1] == "# T\n\na\n\nb" and row[2] == '{"a":"é","b":null}'
    assert row[3] == '---\nid: "x"\n---\n\n# T\n\n[1.00 - 2.50 sec] hi'
    assert row[4] == "`````text\na ```` b\n`````"


def test_blank_differs(spark):
    row = spark.range(1).select(*[tx.is_blank(F.lit(c), s) for c in ("﻿", "\x1c", " ") for s in (tx.PY_SPACE, tx.JS_SPACE)]).first()
    assert list(row) == [False, True, True, False, True, True]


def test_utf8(spark):
    rows = spark.createDataFrame([(b"ok",), (b"\xff",), (b"",), (b" \n",)], "c binary").select(tx.decode_utf8(F.col("c")).alias("r")).select("r.*").collect()
    assert [(r.text, r.error) for r in rows] == [("ok", None), (None, "invalid_utf8"), (None, "empty"), (None, "blank")]


def test_table_functions(spark):
    from corpusloom.functions.sql import register

    register(spark)
    assert [tuple(r) for r in spark.sql("select * from visible_html('<title>t</title><p>a</p><p>b</p>')").collect()] == [("a\n\nb", "t")]
    rows = spark.sql("select c.text, c.end from values ('<transcript><text start=\"1\" dur=\"2\">x</text></transcript>') v(x), lateral caption_cues(x) c").collect()
    assert [tuple(r) for r in rows] == [("x", 3.0)]


def test_receiver_writes_once(spark, tmp_path):
    from corpusloom.functions.digests import file_name
    from corpusloom.streaming.receiver import receive, table

    rows = spark.createDataFrame([("d1", "c1", "m"), ("d2", "c2", "n")], "delivery_id string, capture_id string, markdown string")
    good = rows.select("delivery_id", "capture_id", file_name(F.col("capture_id")).alias("name"), "markdown", F.sha2("markdown", 256).alias("sha256"))
    bad = good.withColumn("delivery_id", F.concat(F.lit("x"), "delivery_id")).withColumn("sha256", F.lit("0"))
    for n in (0, 0, None):
        receive(good.union(bad), f"file://{tmp_path}/r", "w", n)
    receive(good.withColumn("markdown", F.lit("z")).withColumn("sha256", F.sha2(F.lit("z"), 256)), f"file://{tmp_path}/r")
    assert {(r.delivery_id, r.markdown) for r in table(spark, f"file://{tmp_path}/r", "notes").collect()} == {("d1", "m"), ("d2", "n")}
    assert table(spark, f"file://{tmp_path}/r", "journal").count() == 2


def test_lease_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    events = [("d", "claim", "a", 0), ("d", "claim", "b", 60), ("d", "claim", "a", 100), ("d", "claim", "b", 130), ("d", "ack", "a", 140), ("d", "ack", "b", 150), ("d", "ack", "b", 900), ("d", "claim", "a", 901)]
    (inbox / "a.json").write_text("\n".join(json.dumps(dict(zip(("delivery_id", "action", "claim_id", "at"), e, strict=True))) for e in events))
    stream = spark.readStream.schema("delivery_id string, action string, claim_id string, at long").json(str(inbox))
    run = captures.lease_states(stream).writeStream.format("memory").queryName("leases").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [r.outcome for r in spark.table("leases").orderBy("at").collect()] == ["claimed", "lease_active", "unchanged", "claimed", "wrong_claim", "delivered", "delivered", "delivery_terminal"]


def test_store(spark, tmp_path):
    import pytest

    from corpusloom.sources import store

    path = f"file://{tmp_path}/raw"
    for words in (["a", "b", "a"], ["b", "c"]):
        store.put(spark.createDataFrame([(w.encode(),) for w in words], "content binary"), path)
    held = raw_objects.scan(spark, path)
    assert held.count() == 3
    one = held.where(F.col("content") == b"b").first()
    assert store.get(spark, path, f"sha256:{one.digest}").count() == 1
    refs = spark.createDataFrame([(f"sha256:{one.digest}",), (f"sha256:{'0' * 64}",)], "ref string")
    assert sorted(r.stored for r in store.present(refs, held).collect()) == [False, True]
    with pytest.raises(Exception, match="malformed reference"):
        store.present(spark.createDataFrame([("md5:x",)], "ref string"), held).collect()


def test_answers(spark):
    from corpusloom.operators.recognition import answers

    given = ['{"status":"described","description":"a cat"}', '{"status":"refused"}', '{"status":"refused","status":"described"}', "[]", None, '{"status":"described","description":" "}', '{"status":"x"}', '{"status":"unclear","n":NaN}']
    rows = answers(spark.createDataFrame(list(enumerate(given)), "id long, answer string")).orderBy("id").collect()
    assert [(r.status, r.description, r.error) for r in rows] == [
        ("described", "a cat", None), ("refused", None, None), (None, None, "repeated_key"), (None, None, "not_an_object"), (None, None, "not_json"), (None, None, "description"), (None, None, "status"), (None, None, "not_a_number"),
    ]


def test_video_markdown(spark):
    from corpusloom.plans.video import markdown, notes

    videos = spark.createDataFrame([(1, 0.5), (2, 0.0)], "id long, offset double")
    cues = spark.createDataFrame([(1, "hi", 0.0, 1.0)], "id long, text string, start double, end double")
    frames = spark.createDataFrame([(1, k, float(k)) for k in range(9)], "id long, frame_id long, at double")
    about = spark.createDataFrame([(4, "a tree")], "frame_id long, text string")
    rows = notes(videos, cues, frames, about).withColumn("md", markdown({"id": F.col("id").cast("string")}, F.lit("T"), F.col("segments"), F.col("keyframes"))).orderBy("id").collect()
    assert [k.id for k in rows[0].keyframes] == ["2", "4", "6"] and [s.type for s in rows[0].segments] == ["transcript", "visual"]
    assert "[0.50 - 1.50 sec] hi" in rows[0].md and "a tree" in rows[0].md
    assert rows[1].segments == [] and rows[1].md == '---\nid: "2"\n---\n\n# T'


def test_create_within_a_batch(spark):
    new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "c"), (4, "d"), (None, "x"), (None, "y")], "id int, name string")
    table = spark.createDataFrame([(4, "z")], "id int, name string")
    got = sorted(((r.id or 0), r.name, r.outcome) for r in store.create(new, table, ("id", "known_id"), ("name", "known_name")).collect())
    assert got == [(0, "x", "created"), (0, "y", "created"), (1, "a", "created"), (1, "b", "known_id"), (2, "c", "created"), (3, "c", "known_name"), (4, "d", "known_id")]


def test_register_limits(spark):
    ops = spark.createDataFrame([(1, "a", "queued"), (2, "b", "complete")], "id int, request string, state string")
    asked = spark.createDataFrame([(1, "a", 1), (2, "x", 2), (3, "c", 3), (4, "d", 4)], "id int, request string, seq int")
    told = lambda **kw: [r.outcome for r in queue.register(asked, ops, **kw).orderBy("id").collect()]
    assert told() == ["existing", "operation_conflict", "queued", "queued"]
    assert told(capacity=2, history=3)[2:] == ["queued", "queue_full"]
    assert told(capacity=1, history=2)[2:] == ["queue_full", "queue_full"]
    assert told(capacity=9, history=3)[2:] == ["queued", "operation_history_full"]


def test_json_of_texts_and_numbers(spark):
    kind = "a array<double>, b string"
    good = spark.createDataFrame([([1.5, None], "NaN")], kind)
    assert good.select(render.json(F.struct("a", "b"), good.schema)).first()[0] == '{"a":[1.5,null],"b":"NaN"}'
    bad = spark.createDataFrame([([float("inf")], "x")], kind)
    with pytest.raises(Exception, match="not a JSON number"):
        bad.select(render.json(F.struct("a", "b"), bad.schema)).first()


def test_request_windows(spark):
    from corpusloom.streaming.captures import request_rate

    rows = [("a", i, s) for i, s in enumerate([0, 10, 59, 60, 61, 125])] + [("b", 9, 30)]
    events = spark.createDataFrame(rows, "who string, event_id int, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.who, r.event_id): (r.window_start.timestamp(), r.number, r.allowed) for r in request_rate(events, "who", limit=2).collect()}
    assert [got["a", i][1:] for i in range(6)] == [(1, True), (2, True), (3, False), (1, True), (2, True), (1, True)] and got["b", 9][0] - got["a", 0][0] == 30


def test_request_windows_of_a_stream(spark, tmp_path):
    """The windows of a stream, in batches, are those of the table; what comes a batch too late
    counts in the window that is open."""
    inbox = tmp_path / "in"
    inbox.mkdir()
    batches = [[("a", 0, 0), ("b", 1, 5), ("a", 2, 59)], [("a", 3, 60), ("a", 4, 61)], [("a", 5, 20), ("a", 6, 130), ("b", 7, 64)]]
    for i, rows in enumerate(batches):
        file = inbox / f"{i}.json"
        file.write_text("\n".join(json.dumps({"who": w, "event_id": n, "s": s}) for w, n, s in rows))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("who string, event_id int, s int").option("maxFilesPerTrigger", 1).json(str(inbox)).withColumn("ts", F.timestamp_seconds("s"))
    run = captures.request_rate(stream, "who", limit=2).writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert run.awaitTermination(240)
    got = {(r.who, r.event_id): (int(r.window_start.timestamp()), r.number, r.allowed) for r in spark.table("rates").collect()}
    assert got == {("a", 0): (0, 1, True), ("a", 2): (0, 2, True), ("a", 3): (60, 1, True), ("a", 4): (60, 2, True), ("a", 5): (60, 3, False), ("a", 6): (130, 1, True), ("b", 1): (5, 1, True), ("b", 7): (5, 2, True)}


def test_ingest_is_one_version(spark, tmp_path, monkeypatch):
    """Whatever write a stop comes before, the version before stands, and the batch can be given again."""
    from corpusloom.sources import snapshots

    folder = f"file://{tmp_path}/lake"
    first = spark.createDataFrame([(7, "first")], "doc_id long, text string")
    lifecycle.ingest(contents.envelopes(first, F.col("doc_id"), "text", text=F.col("text")), folder)
    real = {"part": snapshots.part, "commit": snapshots.commit}
    for stop in range(4):
        calls = []

        def counted(*args, _f="part", **kw):
            calls.append(_f)
            if len(calls) > stop:
                raise RuntimeError("stopped")
            return real[_f](*args, **kw)

        monkeypatch.setattr(snapshots, "part", lambda *a, **k: counted(*a, _f="part", **k))
        monkeypatch.setattr(snapshots, "commit", lambda *a, **k: counted(*a, _f="commit", **k))
        with pytest.raises(RuntimeError, match="stopped"):
            lifecycle.ingest(_captures(spark), folder, "w", 3)
        assert snapshots.head(spark, folder).number == 1 and [r.id for r in lifecycle.table(spark, folder, "states").where("step = 3").collect()] == ["7"]
    monkeypatch.undo()
    assert lifecycle.ingest(_captures(spark), folder, "w", 3).number == 2
    states = lifecycle.table(spark, folder, "states")
    assert states.count() == 16 and lifecycle.illegal(states).count() == 0
    # the batch is known by its number; under another number its captures are known by their ids
    assert lifecycle.ingest(_captures(spark), folder, "w", 3).number == 2
    lifecycle.ingest(_captures(spark), folder, "w", 4)
    assert lifecycle.table(spark, folder, "states").count() == 16
    refused = lifecycle.table(spark, folder, "refusals")
    assert refused.count() == refused.select("id").distinct().count()


def test_ambiguous_pages_are_refused(spark, tmp_path):
    folder, rows = f"file://{tmp_path}/lake", spark.createDataFrame([(1, "<p>a</p>", "x"), (2, "<p>a</p>", None)], "page_id long, html string, text string")
    lifecycle.ingest(contents.envelopes(rows, F.col("page_id"), "webpage", html=F.col("html"), text=F.col("text")), folder)
    assert [(r.id, r.route_error) for r in lifecycle.table(spark, folder, "refusals").collect()] == [("1", "unsupported_payload")]
    assert [r.capture_id for r in lifecycle.table(spark, folder, "contents").collect()] == ["2"]


def test_two_writers_one_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from corpusloom.sources import snapshots

    folder = f"file://{tmp_path}/t"
    rows = lambda n: spark.createDataFrame([(f"k{n}", n), ("both", n)], "id string, n int")
    base = snapshots.head(spark, folder)
    parts = [snapshots.part(rows(n), folder, "t", "id") for n in range(6)]

    def run(n):
        try:
            return snapshots.commit(spark, folder, base, {"t": parts[n]}).number
        except snapshots.Conflict:
            return None

    with ThreadPoolExecutor(6) as pool:
        won = list(pool.map(run, range(6)))
    assert sorted(x for x in won if x) == [1]
    assert {r.n for r in snapshots.read(spark, folder, "t").collect()} == {won.index(1)}
    old = snapshots.head(spark, folder)
    for n in range(6):
        snapshots.commit(spark, folder, snapshots.head(spark, folder), {"t": parts[n]} if not won[n] else {})
    found = snapshots.lookup(spark, folder, "t", spark.createDataFrame([("k3",), (None,), ("no",)], "id string"), "id")
    assert [tuple(r) for r in found.collect()] == [("k3", 3)]
    before = sorted(map(tuple, snapshots.read(spark, folder, "t").collect()))
    assert len(snapshots.compact(spark, folder, "t", "id").tables["t"]) == 1
    assert sorted(map(tuple, snapshots.read(spark, folder, "t").collect())) == before and snapshots.read(spark, folder, "t", old).count() == 2
    gone = snapshots.vacuum(spark, folder, keep=1)
    assert sum(x.startswith("data/") for x in gone) == 6 and sorted(map(tuple, snapshots.read(spark, folder, "t").collect())) == before


def test_many_keys_are_looked_up_in_their_buckets(spark, tmp_path, monkeypatch):
    from corpusloom.sources import snapshots

    folder = f"file://{tmp_path}/t"
    rows = spark.range(3000).select(F.col("id").cast("string").alias("id"), "id").toDF("id", "n")
    snapshots.commit(spark, folder, snapshots.Version(), {"t": snapshots.part(rows, folder, "t", "id")})
    asked = spark.range(0, 4000, 3).select(F.col("id").cast("string").alias("id"))
    assert sorted(r.n for r in snapshots.lookup(spark, folder, "t", asked, "id").collect()) == list(range(0, 3000, 3))
    one = snapshots.lookup(spark, folder, "t", asked.where("id = '9'"), "id")
    assert [r.n for r in one.collect()] == [9] and "PartitionFilters: [bucket" in one._jdf.queryExecution().toString().replace("isnotnull(bucket#", "[bucket").replace("PartitionFilters: [[", "PartitionFilters: [")
