"""Registers as keyed state: equal to the batch form in any batching, and leases that run out."""

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import queue
from corpusloom.streaming import registers

START = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)


def _event(q, action, seq, name=None, request=None, token=None, refused=None, at=0):
    return {"queue": q, "action": action, "id": name, "request": request, "token": token, "refused": refused, "seq": seq, "at": (START + dt.timedelta(seconds=at)).isoformat()}


def _run(spark, tmp_path, batches, name, operations=None, **kw):
    inbox = tmp_path / f"{name}-in"
    inbox.mkdir(exist_ok=True)
    n = len(list(inbox.iterdir()))
    for i, rows in enumerate(batches):
        file = inbox / f"{n + i:05d}.json"
        file.write_text("\n".join(map(json.dumps, rows)))
        stamp = time.time() - 10_000 + n + i
        import os

        os.utime(file, (stamp, stamp))
    events = spark.readStream.schema(registers.EVENT).option("maxFilesPerTrigger", 1).json(str(inbox))
    out = registers.outcomes(events, operations, **kw).writeStream.format("parquet").option("path", f"{tmp_path}/{name}-out").option("checkpointLocation", f"{tmp_path}/{name}-cp")
    run = out.trigger(availableNow=True).start()
    assert run.awaitTermination(100) and run.exception() is None
    return [r.asDict() for r in spark.read.parquet(f"{tmp_path}/{name}-out").collect()]


@pytest.mark.parametrize("size", [1000, 9])
def test_any_batching_equals_the_batch_form(spark, tmp_path, size):
    rng = random.Random(6)
    before = [("a", f"o{i}", f"r{i}", rng.choice(["queued", "complete", "failed"]), i) for i in range(12)] + [("b", "o1", "r1", "queued", 1)]
    operations = spark.createDataFrame(before, "queue string, id string, request string, state string, seq int")
    asked = [(rng.choice("aabc"), f"o{rng.randrange(40)}", f"r{rng.randrange(40)}", n) for n in range(60)]
    want = set()
    for q in "abc":
        mine = spark.createDataFrame([x[1:] for x in asked if x[0] == q], "id string, request string, seq int")
        # the batch form gives no seq: the outcomes of an id, counted
        want |= {(q, r.id, r.outcome, r.n) for r in queue.register(mine, operations.where(F.col("queue") == q), capacity=9, history=17).groupBy("id", "outcome").agg(F.count("*").alias("n")).collect()}
    events = [_event(q, "register", n, name, request) for q, name, request, n in asked]
    got = _run(spark, tmp_path, [events[i : i + size] for i in range(0, len(events), size)], "r", operations, capacity=9, history=17, clock="none")
    counts = {}
    for r in got:
        key = (r["queue"], r["id"], r["outcome"])
        counts[key] = counts.get(key, 0) + 1
    assert {(*k, n) for k, n in counts.items()} == want and {"queued", "existing", "operation_conflict", "queue_full"} <= {r["outcome"] for r in got}
    held = registers.held(spark, f"{tmp_path}/r-cp").collect()
    assert len(held) == len(before) + sum(r["outcome"] == "queued" for r in got)


def test_claims_finishes_and_restarts(spark, tmp_path):
    first = [_event("q", "register", 1, "a", "x"), _event("q", "claim", 2), _event("q", "register", 3, "b", "y"), _event("q", "claim", 4), _event("p", "claim", 5)]
    second = [
        _event("q", "finish", 6, "b", "complete"), _event("q", "finish", 7, "a", "complete", token=9), _event("q", "finish", 8, "a", "lost", token=1), _event("q", "finish", 9, "a", "complete", token=1), _event("q", "finish", 10, "a", "complete", token=1),
        _event("q", "finish", 11, "zz", "complete"), _event("q", "claim", 12), _event("q", "register", 13, "c", "z", refused="markdown_too_large"), _event("q", "register", 14, "a", "other", refused="markdown_too_large"), _event("q", "dance", 15),
    ]
    _run(spark, tmp_path, [first], "c", same_request=False, clock="none")
    got = sorted(_run(spark, tmp_path, [second], "c", same_request=False, clock="none"), key=lambda r: r["seq"])
    assert [(r["id"], r["outcome"], r["token"]) for r in got] == [
        ("a", "queued", None), ("a", "running", 1), ("b", "queued", None), (None, "busy", None), (None, "empty", None),
        ("b", "unchanged", None), ("a", "lease_expired", 9), ("a", "invalid_state", 1), ("a", "complete", 1), ("a", "complete", 1),
        ("zz", "operation_not_found", None), ("b", "running", 2), ("c", "markdown_too_large", None), ("a", "existing", None), (None, "invalid_action", None),
    ]
    assert {(r.id, r.state) for r in registers.held(spark, f"{tmp_path}/c-cp").collect()} == {("a", "complete"), ("b", "running")}


@pytest.mark.parametrize("expire_to", ["queued", "interrupted"])
def test_a_lease_runs_out_by_the_clock_alone(spark, tmp_path, expire_to):
    """The watermark is the clock, set by hand with events of another queue."""
    tick = lambda seq, at: [_event("clock", "claim", seq, at=at)]
    batches = [
        [_event("q", "register", 1, "a", "x"), _event("q", "register", 2, "b", "y"), _event("q", "claim", 3, at=0)],
        tick(4, 119), tick(5, 120), [_event("q", "claim", 6, at=121)], tick(7, 122), tick(8, 200), tick(9, 300), [_event("q", "finish", 10, "a", "complete", token=1, at=301)], tick(11, 400),
    ]
    got = _run(spark, tmp_path, batches, f"x-{expire_to}", clock="watermark", expire_to=expire_to, lease_seconds=120)
    mine = [(r["action"], r["id"], r["outcome"], r["token"], r["error"]) for r in sorted((r for r in got if r["queue"] == "q" and r["action"] != "register"), key=lambda r: (r["token"] or 0, r["action"] != "claim", r["seq"] or 0))]
    if expire_to == "queued":
        assert mine == [("claim", "a", "running", 1, None), ("expire", "a", "queued", 1, None), ("finish", "a", "lease_expired", 1, None), ("claim", "a", "running", 2, None), ("expire", "a", "queued", 2, None)]
    else:
        assert mine == [("claim", "a", "running", 1, None), ("expire", "a", "interrupted", 1, "budget_exceeded"), ("finish", "a", "lease_expired", 1, None), ("claim", "b", "running", 2, None), ("expire", "b", "interrupted", 2, "budget_exceeded")]
    # no operation runs twice at once: between two claims of a queue there is an end
    runs = [r for r in got if r["queue"] == "q" and r["outcome"] == "running"]
    assert len(runs) == len({r["token"] for r in runs}) == 2


def test_a_lease_runs_out_on_the_machines_clock(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.json").write_text("\n".join(map(json.dumps, [_event("q", "register", 1, "a", "x"), _event("q", "claim", 2)])))
    events = spark.readStream.schema(registers.EVENT).json(str(inbox))
    run = registers.outcomes(events, lease_seconds=1).writeStream.format("memory").queryName("clocked").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            if any(r.action == "expire" for r in spark.table("clocked").collect()):
                break
            time.sleep(0.5)
    finally:
        run.stop()
    assert [(r.action, r.outcome) for r in spark.table("clocked").collect()][:3] == [("register", "queued"), ("claim", "running"), ("expire", "queued")]


def test_expired_work_is_reconciled(spark):
    expired = spark.createDataFrame([("q", "expire", i, None, "interrupted", 1, "budget_exceeded") for i in "abcd"] + [("q", "claim", "e", 1, "running", 1, None)], registers.OUTCOME)
    records = spark.createDataFrame([("a", "complete", 2), ("a", "processing", 1), ("b", "failed", 1), ("c", "complete", 1)], "id string, status string, updated_at int")
    have = spark.createDataFrame([(("a",),), (("d",),)], "source struct<capture_id:string>")
    got = {(r.id, r.state, r.error) for r in registers.expired_reconciled(expired, records, have).collect()}
    assert got == {("a", "complete", None), ("b", "failed", "budget_exceeded"), ("c", "interrupted", "budget_exceeded"), ("d", "interrupted", "budget_exceeded")}
