"""Durable registers as keyed state: operations that are registered, claimed and finished, with
leases that run out by a timer.

A register's state is three variables by queue: counts and what is running (a value), the
operations by id (a map) and the ids that wait, in order (a list). Capacity and history bound all
three. They live in the state store, survive restarts with the checkpoint, and can be read as
tables (`held`). A batch's events of one queue are put in order in memory; the source's limit of
rows for a trigger bounds them.

A claim starts the oldest waiting operation if nothing of its queue runs, gives it a token (the
number of the claim) and sets a timer. If the lease runs out first, the timer ends it, with no
event: the operation goes back to wait (expire_to="queued", as deliveries do) or ends as
"interrupted" or "failed" with a code. Whoever finishes with a token that isn't the running one's
gets lease_expired, so work that was given up can't overwrite what came after it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from corpusloom.operators.queue import CAPACITY, HISTORY

#: Events: action is register, claim or finish; request is what is registered, or the state that a
#: finish asks for; refused, if it isn't null, is why a new operation isn't taken.
EVENT = "queue string, action string, id string, request string, token long, refused string, seq long, at timestamp"
OUTCOME = "queue string, action string, id string, seq long, outcome string, token long, error string"
#: Spark's time modes by clock; without one there are no timers.
TIMES = {"machine": "ProcessingTime", "watermark": "EventTime"}
ENDS = ("complete", "failed", "interrupted", "delivered", "conflict", "ambiguous")


class Register(StatefulProcessor):
    def __init__(self, capacity: int, history: int, lease_ms: int, expire_to: str, error: str | None, same_request: bool, clock: str) -> None:
        self.capacity, self.history, self.lease_ms = capacity, history, lease_ms
        self.expire_to, self.error, self.same_request, self.clock = expire_to, error, same_request, clock

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "open long, history long, claims long, running string, until long")
        self.operations = handle.getMapState("operations", "id string", "request string, state string, n long")
        self.waiting = handle.getListState("waiting", "id string")

    def _load(self) -> None:
        self.open, self.known, self.claims, self.running, self.until = tuple(self.counts.get()) if self.counts.exists() else (0, 0, 0, None, None)
        self.line = [r[0] for r in self.waiting.get()]
        self.line_before = list(self.line)

    def _store(self) -> None:
        self.counts.update((self.open, self.known, self.claims, self.running, self.until))
        if self.line != self.line_before:
            self.waiting.put([(x,) for x in self.line]) if self.line else self.waiting.clear()

    def _set(self, name: str, state: str) -> None:
        request, _, n = self.operations.getValue((name,))
        self.operations.updateValue((name,), (request, state, n))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """initialState: (queue, operations) with operations as structs (id, request, state), in order.
        What was running when its worker stopped is running still, and its lease begins now."""
        self._load()
        for before in initialState["operations"]:
            name, request, state = before["id"], before["request"], before["state"]
            self.known += 1
            self.operations.updateValue((name,), (request, state, self.known))
            if state in ("queued", "running"):
                self.open += 1
                if state == "queued":
                    self.line.append(name)
                else:
                    self.claims += 1
                    self._run(name, self._now(timerValues, None))
        self._store()

    def _now(self, timers, at) -> int:
        if self.clock == "watermark":
            return int(at.timestamp() * 1000) if at is not None else max(timers.getCurrentWatermarkInMs(), 0)
        return timers.getCurrentProcessingTimeInMs() if self.clock == "machine" else 0

    def _run(self, name: str, now: int) -> None:
        self.running, self.until = name, now + self.lease_ms
        if self.clock in TIMES:
            self.handle.registerTimer(self.until)

    def _stop(self) -> None:
        if self.clock in TIMES:
            self.handle.deleteTimer(self.until)
        self.running = self.until = None

    def _register(self, r) -> str:
        if self.operations.containsKey((r.id,)):
            same = not self.same_request or self.operations.getValue((r.id,))[0] == r.request
            return "existing" if same else "operation_conflict"
        if r.refused is not None:
            return r.refused
        if self.open >= self.capacity:
            return "queue_full"
        if self.known >= self.history:
            return "operation_history_full"
        self.open, self.known = self.open + 1, self.known + 1
        self.operations.updateValue((r.id,), (r.request, "queued", self.known))
        self.line.append(r.id)
        return "queued"

    def _finish(self, r) -> str:
        if r.id is None or not self.operations.containsKey((r.id,)):
            return "operation_not_found"
        state = self.operations.getValue((r.id,))[1]
        if self.running != r.id:
            return state if state == r.request else "lease_expired" if r.token is not None else "unchanged"
        if r.token is not None and r.token != self.claims:
            return "lease_expired"
        if r.request not in ENDS:
            return "invalid_state"
        self._stop()
        self.open -= 1
        self._set(r.id, r.request)
        return r.request

    def _expired(self, queue: str) -> Row:
        name, token = self.running, self.claims
        self.running = self.until = None
        self._set(name, self.expire_to)
        if self.expire_to == "queued":
            self.line.insert(0, name)  # it was the oldest
        else:
            self.open -= 1
        return Row(queue=queue, action="expire", id=name, seq=None, outcome=self.expire_to, token=token, error=None if self.expire_to == "queued" else self.error)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self._load()
        for r in sorted(rows, key=lambda r: r.seq):
            now = self._now(timerValues, r.at)
            if self.running is not None and self.clock in TIMES and self.until <= now:
                # the timer comes after the batch's rows
                self.handle.deleteTimer(self.until)
                yield self._expired(key[0])
            name, token = r.id, None
            if r.action == "register":
                told = self._register(r)
            elif r.action == "finish":
                told, token = self._finish(r), r.token
            elif r.action != "claim":
                told = "invalid_action"
            elif self.running is not None:
                told = "busy"
            elif not self.line:
                told = "empty"
            else:
                name, told = self.line.pop(0), "running"
                self.claims += 1
                token = self.claims
                self._set(name, "running")
                self._run(name, now)
            yield Row(queue=key[0], action=r.action, id=name, seq=r.seq, outcome=told, token=token, error=None)
        self._store()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._load()
        if self.running is None or expiredTimerInfo.getExpiryTimeInMs() < self.until:
            return
        out = self._expired(key[0])
        self._store()
        yield out

    def close(self) -> None:
        pass


def outcomes(
    events: DataFrame,
    operations: DataFrame | None = None,
    capacity: int = CAPACITY,
    history: int = HISTORY,
    lease_seconds: float = 120,
    expire_to: str = "queued",
    error: str | None = "budget_exceeded",
    same_request: bool = True,
    clock: str = "machine",
) -> DataFrame:
    """OUTCOME rows for a stream of EVENT rows, and for leases that run out. operations (queue, id,
    request, state, seq) are what is there before the first batch. same_request=False: an
    operation stays as it was registered first, whatever is asked later (deliveries). clock: machine (a
    stream with it never ends by itself, as a timer may always come), watermark (of `at`; events
    that aren't after it are late and dropped), or none, by which no lease runs out."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    given = events.withWatermark("at", "0 seconds") if clock == "watermark" else events
    step = Register(capacity, history, int(lease_seconds * 1000), expire_to, error, same_request, clock)
    before = None
    if operations is not None:
        one = F.transform(F.sort_array(F.collect_list(F.struct("seq", "id", "request", "state"))), lambda x: F.struct(x["id"].alias("id"), x["request"].alias("request"), x["state"].alias("state")))
        before = operations.groupBy("queue").agg(one.alias("operations")).groupBy("queue")  # at most `history` for a queue
    return given.groupBy("queue").transformWithState(statefulProcessor=step, outputStructType=OUTCOME, outputMode="Append", timeMode=TIMES.get(clock, "None"), initialState=before)


def held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(queue, id, request, state, n) of the operations that a stream's last batch left."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "operations").load()
    return state.select("key.queue", "user_map_key.id", "user_map_value.*")


def expired_reconciled(expired: DataFrame, records: DataFrame, contents: DataFrame) -> DataFrame:
    """(queue, id, state, error) of operations whose budget ran out (rows of `outcomes` with
    action expire), by what their worker had made durable before: a failed or complete
    capture decides, and else what the timer told."""
    ends = records.groupBy("id").agg(F.max_by("status", "updated_at").alias("status"))
    have = contents.select(F.col("source.capture_id").alias("id")).distinct().withColumn("_has", F.lit(True))
    found = expired.where("action = 'expire'").join(ends, "id", "left").join(have, "id", "left")
    done = (F.col("status") == "complete") & F.col("_has")
    state = F.when(F.col("status") == "failed", "failed").when(done, "complete").otherwise(F.col("outcome"))
    return found.select("queue", "id", state.alias("state"), F.when(~F.coalesce(done, F.lit(False)), F.col("error")).alias("error"))
