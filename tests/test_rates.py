"""Windows, admissions and running totals cut into ranges, against loops."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import rates, running, timeline


def _events(n, seed, keys="ab", gap=20.0):
    rng, out = random.Random(seed), []
    t = {k: rng.random() * 100 for k in keys}
    for i in range(n):
        k = rng.choice(keys)
        t[k] += rng.choice([0, 0.5, gap, 3 * gap]) if rng.random() < 0.9 else rng.random() * 900
        out.append((k, i, round(t[k], 3), round(t[k] + rng.choice([0, 1, 30, 200]), 3)))
    return out


def _windows(rows, span):
    out = {}
    for k in {r[0] for r in rows}:
        start, n = None, 0
        for _, i, at, _ in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            if start is None or round(at * 1e6) - start >= span * 1_000_000:
                start, n = round(at * 1e6), 0
            n += 1
            out[k, i] = (start, n)
    return out


@pytest.mark.parametrize(("spans", "gap"), [(1, 20), (3, 7), (60, 61)])
def test_windows(spark, spans, gap):
    rows = _events(400, spans, gap=gap) + [("c", 1000, 5.0, 6.0), (None, 1001, 5.0, 6.0)]
    events = spark.createDataFrame(rows, "who string, event_id long, s double, e double").withColumn("ts", F.timestamp_micros(F.round(F.col("s") * 1_000_000).cast("long")))
    got = {(r.who, r.event_id): (r.window_us, r.number) for r in rates.windows(events, "who", spans=spans).collect()}
    assert got == _windows(rows, 60)
    assert rates.windows(events.limit(0), "who").count() == 0


def test_a_hot_key_is_many_tasks(spark):
    """A key of 10^6 requests: ranges are groups of their own, and tell few numbers each."""
    n = 1_000_000
    events = spark.range(n).select(F.lit("hot").alias("who"), F.col("id").alias("event_id"), F.timestamp_micros(F.col("id") * 250_000).alias("ts"))
    out = rates.windows(events, "who").groupBy("window_us").agg(F.max("number").alias("n"), F.count("*").alias("rows"))
    told = out.agg(F.count("*"), F.min("n"), F.max("n"), F.sum("rows")).first()
    assert tuple(told) == (-(-n // 240), n % 240 or 240, 240, n)
    spread = rates.windows(events, "who").withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("rows"))
    assert spread.count() > 1 and spread.agg(F.max("rows")).first()[0] < n


@pytest.mark.parametrize("most", [1, 3])
def test_at_work(spark, most):
    rows = _events(400, 9, gap=25.0) + [("z", 2000, 10.0, 9.0), ("z", 2001, 10.0, 12.0)]
    events = spark.createDataFrame(rows, "who string, event_id long, s double, e double")
    got = {(r.who, r.event_id): (r.active, r.admitted) for r in rates.at_work(events, "who", "s", "e", "event_id", most, range_seconds=100).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        ends = []
        for _, i, s, e in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            ends = [x for x in ends if x > s]
            want[k, i] = (len(ends), len(ends) < most)
            if len(ends) < most:
                ends.append(e)
    assert got == want
    parts = rates.stretches(events, "who", "s", "e", "event_id", 100).groupBy("who").agg(F.countDistinct("stretch").alias("n"))
    assert all(r.n > 1 for r in parts.where("who != 'z'").collect())


def test_running_and_neighbours(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, rng.choice([None, *range(9)])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = {r.i: r for r in running.neighbours(running.running(df, ["k"], ["i"], F.floor(F.col("i") / 7), total=("sum", "v"), top=("max", "v")), ["k"], ["i"], F.floor(F.col("i") / 7), last="i").collect()}
    for k in "ab":
        total, top, last = 0, None, None
        for _, i, v in (r for r in rows if r[0] == k):
            total, top = total + (v or 0), v if top is None else max(top, v if v is not None else top)
            assert (got[i].total, got[i].top, got[i].last) == (total, top, last)
            last = i


def test_stream_timelines(spark):
    """Origin, duration, counts and pixels of containers, and what is wrong with their streams."""
    tracks = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 0.5, 9.5), (2, 0, 1.0, 4.0), (3, 0, None, 4.0), (4, 0, 0.0, 0.0)], "id int, stream int, start double, duration double")
    frames = [(1, 0, i, i * 1.0, 1.0, 4) for i in range(10)] + [(1, 1, i, 0.5 + i * 0.5, 0.5, None) for i in range(18)]
    frames += [(2, 0, 0, 1.0, 1.0, 4), (2, 0, 1, 3.0, 1.0, 4), (2, 0, 2, 2.5, 1.0, 4)]
    packets = spark.createDataFrame(frames, "id int, stream int, n int, pts double, duration double, pixels int")
    rows = {(r.id, r.stream): r for r in timeline.container_timelines(tracks, packets, "id", "stream").collect()}
    a, b = rows[1, 0], rows[1, 1]
    assert (a.origin, a.length, a.frames, a.pixels, a.rising, a.gaps_ok, a.starts_ok, a.ends_ok, a.fault) == (0.0, 10.0, 10, 40, True, True, True, True, None)
    assert (b.origin, b.frames, b.pixels, b.ends_ok, b.fault) == (0.0, 18, 0, False, "inconsistent_timing")
    assert rows[2, 0].fault == "unsupported_timing" and not rows[2, 0].rising
    assert {rows[3, 0].fault, rows[4, 0].fault} == {"unsupported_timing"}
    used = timeline.container_budgets(packets, "id", "stream", pixels=20, video_frames=4, audio_frames=9, most=25)
    got = {(r.id, r.stream, r.n): r.fault for r in used.collect()}
    assert [got[1, 0, n] for n in range(10)] == [None] * 4 + ["decode_budget_exceeded"] * 6 and got[2, 0, 2] is None
