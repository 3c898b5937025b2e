"""Captures as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import schema
from corpusloom.operators import rates
from corpusloom.plans.lifecycle import ingest


def source(spark: SparkSession, folder: str) -> DataFrame:
    """Envelopes from JSON files that arrive in a folder; nothing is inferred."""
    return spark.readStream.schema(schema.ENVELOPE).json(folder)


def run(captures: DataFrame, folder: str, checkpoint: str, available_now: bool = True):
    """Ingests each micro-batch. A batch that comes again after a stop changes nothing: the
    versions know the last one of this checkpoint."""
    writer = captures.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: ingest(batch, folder, checkpoint, n))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def request_rate(events: DataFrame, key: str, at: str = "ts", order: str = "event_id", seconds: int = 60, limit: int = 600) -> DataFrame:
    """(key, order, window_start, number, allowed) for each request. A window begins with the first
    request that comes when the one before is over, and requests beyond the limit are refused.
    Tables are cut into ranges (see rates). A stream keeps each key's window as state: a
    batch's rows of a key are put in order, and a row of a time before the window that is
    open, which comes a batch too late, counts in the window that is open."""
    if not events.isStreaming:
        counted = rates.windows(events, key, at, order, seconds)
    else:
        from pyspark.sql.streaming.state import GroupStateTimeout

        span = seconds * 1_000_000
        given = events.select(key, order, F.unix_micros(F.col(at).cast("timestamp")).alias("us")).where("us is not null")
        kinds = [given.schema[c].dataType.simpleString() for c in (key, order)]

        def step(name, batches, state):
            import pandas as pd

            rows = pd.concat(list(batches)).sort_values(["us", order])
            start, n = state.get if state.exists else (None, 0)
            out = []
            for us in rows["us"].tolist():
                if start is None or us - start >= span:
                    start, n = us, 0
                n += 1
                out.append((start, n))
            state.update((start, n))
            yield pd.DataFrame({key: rows[key], order: rows[order], "window_us": [x[0] for x in out], "number": [x[1] for x in out]})

        counted = given.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[0]}, {order} {kinds[1]}, window_us long, number long", "start long, n long", "append", GroupStateTimeout.NoTimeout)
    return counted.select(key, order, F.timestamp_micros("window_us").alias("window_start"), "number", (F.col("number") <= limit).alias("allowed"))


def lease_states(events: DataFrame, seconds: int = 120) -> DataFrame:
    """(delivery_id, at, outcome) for a stream of claims and ends (delivery_id, action, claim_id,
    at): the state of each delivery is kept by key, and a lease that ran out can be claimed anew."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        import pandas as pd

        status, holder, until = state.get if state.exists else ("pending", "", 0)
        rows = pd.concat(list(batches)).sort_values(["at", "claim_id"])
        out = []
        for action, claim_id, at in zip(rows["action"], rows["claim_id"], rows["at"], strict=True):
            live = status == "claimed" and at < until
            if status == "delivered":
                told = "delivered" if action == "ack" and claim_id == holder else "delivery_terminal"
            elif action == "claim":
                told = "unchanged" if live and claim_id == holder else "lease_active" if live else "claimed"
                if told == "claimed":
                    status, holder, until = "claimed", claim_id, at + seconds
            else:
                told = "wrong_claim" if claim_id != holder else "delivered" if live else "lease_expired"
                if told == "delivered":
                    status = "delivered"
            out.append((key[0], at, told))
        state.update((status, holder, int(until)))
        yield pd.DataFrame(out, columns=["delivery_id", "at", "outcome"])

    return events.groupBy("delivery_id").applyInPandasWithState(step, "delivery_id string, at long, outcome string", "status string, holder string, until long", "append", GroupStateTimeout.NoTimeout)
