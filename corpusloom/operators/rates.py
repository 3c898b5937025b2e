"""Limits of requests: windows that begin with a request, and how many are at work at once.

Where a window begins depends on every window before it, and whether a request is let in on those
that were, so a key would be one task. Both are cut instead:

* Windows: a key's time is cut into ranges of many windows. Whatever comes before a range, its
  first window begins at one of the requests of its first span (or at its very first), so a
  range is told by what it comes to from each of those: when its last window ends, and how
  many requests that has. These few numbers are composed in order, and then all ranges are
  numbered at the same time.
* At work: where all earlier requests have ended, nothing of them matters, let in or not. A running
  maximum of the ends finds those places, and the stretches between them go to tasks of their own.
  A key that is never idle is one stretch: there, each admission does depend on the one before.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.running import running

# fixed values: seconds of a window, requests in it, and requests at work at once
SECONDS, REQUESTS, AT_ONCE = 60, 600, 8
#: Windows of a range, at least 1.
SPANS = 60


def _ends(us, span: int):
    """For a sorted array: from each place as a window's begin, (the end of the last window, how
    many requests it has)."""
    import numpy as np

    n = len(us)
    after = np.searchsorted(us, us + span)  # where the next window begins
    last, count = us + span, n - np.arange(n)
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            last[i], count[i] = last[after[i]], count[after[i]]
    return last, count


def windows(events: DataFrame, key: str, at: str = "ts", order: str = "event_id", seconds: float = SECONDS, spans: int = SPANS) -> DataFrame:
    """(key, order, window_us, number): when each request's window began, and which of its requests it
    is. Equal times follow the order. Rows without a time are left out; null keys are one key."""
    import numpy as np

    span = int(seconds * 1_000_000)
    given = events.select(key, order, F.unix_micros(F.col(at).cast("timestamp")).alias("us")).where("us is not null").withColumn("part", F.floor(F.col("us") / (span * spans)))
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}

    def told(table: pa.Table) -> pa.Table:
        us = np.sort(table["us"].to_numpy())
        first = us[: max(1, int(np.searchsorted(us, (us[0] // (span * spans)) * span * spans + span, side="right")))]
        last, count = _ends(us, span)
        return pa.table({key: table[key].slice(0, 1), "part": table["part"].slice(0, 1), "n": pa.array([len(us)]), "at": pa.array([first.tolist()]), "last": pa.array([last[: len(first)].tolist()]), "count": pa.array([count[: len(first)].tolist()]), "high": pa.array([int(us[-1])])})

    parts = given.groupBy(key, "part").applyInArrow(told, f"{key} {kinds[key]}, part long, n long, at array<long>, last array<long>, count array<long>, high long")

    def composed(table: pa.Table) -> pa.Table:
        """The end and the count with which each range is entered; one row for each range."""
        table = table.sort_by("part")
        end, count, entered = None, 0, []
        for r in table.select(["n", "at", "last", "count", "high"]).to_pylist():
            entered.append((end, count))
            if end is not None and r["high"] < end:
                count += r["n"]
                continue
            # the first request at or after the end; beyond the listed ones it can't be
            i = 0 if end is None else int(np.searchsorted(np.asarray(r["at"]), end))
            if i == len(r["at"]):
                raise AssertionError("a window reaches beyond the first span of a range")
            end, count = r["last"][i], r["count"][i]
        return pa.table({key: table[key], "part": table["part"], "end": pa.array([e for e, _ in entered], pa.int64()), "before": pa.array([c for _, c in entered], pa.int64())})

    entry = parts.groupBy(key).applyInArrow(composed, f"{key} {kinds[key]}, part long, end long, before long")

    def numbered(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.sort_by([("us", "ascending"), (order, "ascending")])
        us, n = rows["us"].to_numpy(), len(rows)
        end, before = right["end"][0].as_py(), right["before"][0].as_py()
        begin, number = np.empty(n, np.int64), np.empty(n, np.int64)
        i = 0 if end is None else int(np.searchsorted(us, end))
        begin[:i], number[:i] = (end or 0) - span, before + 1 + np.arange(i)
        while i < n:
            j = int(np.searchsorted(us, us[i] + span))
            begin[i:j], number[i:j] = us[i], 1 + np.arange(j - i)
            i = j
        return pa.table({key: rows[key], order: rows[order], "window_us": begin, "number": number})

    return given.groupBy(key, "part").cogroup(entry.groupBy(key, "part")).applyInArrow(numbered, f"{key} {kinds[key]}, {order} {kinds[order]}, window_us long, number long")


def stretches(events: DataFrame, key: str, start: str, end: str, order: str, range_seconds: float = 3600) -> DataFrame:
    """events with stretch: how many times the key was idle before."""
    part = F.floor(F.col(start) / range_seconds)
    df = running(events, [key], [start, order], part, before=True, _until=("max", end))
    # a request of no length, or one that ends as the next begins, keeps nothing at work
    df = df.withColumn("_idle", (F.col("_until").isNull() | (F.col("_until") <= F.col(start))).cast("long"))
    return running(df, [key], [start, order], part, stretch=("sum", "_idle")).drop("_until", "_idle")


def at_work(events: DataFrame, key: str, start: str, end: str, order: str, most: int = AT_ONCE, range_seconds: float = 3600) -> DataFrame:
    """events (times in seconds) with active, how many requests are at work when it comes, and
    admitted, whether it is one more. A request that is refused is never at work. Rows
    without a time are left out; one that ends before it starts is over at once."""
    import heapq

    given = stretches(events.where(F.col(start).isNotNull() & F.col(end).isNotNull()), key, start, end, order, range_seconds)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "stretch")

    def swept(table: pa.Table) -> pa.Table:
        table = table.sort_by([(start, "ascending"), (order, "ascending")])
        running_ends, active, admitted = [], [], []
        for a, z in zip(table[start].to_pylist(), table[end].to_pylist(), strict=True):
            while running_ends and running_ends[0] <= a:
                heapq.heappop(running_ends)
            active.append(len(running_ends))
            admitted.append(len(running_ends) < most)
            if admitted[-1]:
                heapq.heappush(running_ends, z)
        return table.drop_columns("stretch").append_column("active", pa.array(active, pa.int64())).append_column("admitted", pa.array(admitted, pa.bool_()))

    return given.groupBy(key, "stretch").applyInArrow(swept, f"{kind}, active long, admitted boolean")
