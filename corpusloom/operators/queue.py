"""Durable queues and leased deliveries, as set operations on tables of states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: limits of the queues and the seconds that a lease lasts
CAPACITY, HISTORY, DELIVERY_HISTORY, LEASE_SECONDS = 32, 10_000, 1_000, 120
FAILURES = {"file_exists": "conflict", "write_ambiguous": "ambiguous"}


def register(requests: DataFrame, operations: DataFrame, capacity: int = CAPACITY, history: int = HISTORY) -> DataFrame:
    """(id, outcome) of requests (id, request, seq): existing for the same request,
    operation_conflict for another one; new ones in their order are queued while there is room,
    and then queue_full, or operation_history_full where only the history is. An id that comes
    again among the requests is held against its first one."""
    have = operations.agg(F.count("*").alias("n"), F.count_if(F.col("state").isin("queued", "running")).alias("open")).first()
    room, left = max(capacity - have["open"], 0), max(history - have["n"], 0)
    known = requests.alias("q").join(operations.select("id", F.col("request").alias("before")), "id", "left")
    new = F.col("before").isNull()
    # only the first of the new ones can find room: the others needn't be ordered
    mine = known.where(new).groupBy("id").agg(F.min("seq").alias("_seq"), F.min_by("request", "seq").alias("_mine"))
    first = mine.orderBy("_seq").limit(min(room, left))
    again = F.when(F.col("seq") == F.col("_seq"), "queued").when(F.col("request").eqNullSafe(F.col("_mine")), "existing").otherwise("operation_conflict")
    told = F.when(~new & (F.col("before") == F.col("request")), "existing").when(~new, "operation_conflict").when(F.col("_seq").isNotNull(), again)
    return known.join(F.broadcast(first), "id", "left").select("id", told.otherwise("queue_full" if room <= left else "operation_history_full").alias("outcome"))


def depth(operations: DataFrame, key: list[str], history: int = HISTORY) -> DataFrame:
    """(key, open, history, full) of each queue."""
    return operations.groupBy(*key).agg(F.count_if(F.col("state").isin("queued", "running")).alias("open"), F.count("*").alias("history"), (F.count("*") >= history).alias("full"))


def claim(operations: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """The oldest queued operation of each key in which nothing is running."""
    names = [c for c in operations.columns if c not in key]
    found = operations.groupBy(*key).agg(
        F.min_by(F.struct(*names), F.when(F.col("state") == "queued", F.col(seq))).alias("_first"), F.count_if(F.col("state") == "running").alias("_running"), F.count_if(F.col("state") == "queued").alias("_queued")
    )
    return found.where("_running = 0 and _queued > 0").select(*key, "_first.*")


def next_delivery(deliveries: DataFrame, key: list[str], now: Column, seq: str = "seq") -> DataFrame:
    """The oldest delivery of each key that is pending, or claimed with its lease run out."""
    open_ = deliveries.where(F.col("state").isin("pending", "claimed") & (F.col("lease_until").isNull() | (F.col("lease_until") <= now)))
    names = [c for c in deliveries.columns if c not in key]
    return open_.groupBy(*key).agg(F.min_by(F.struct(*names), seq).alias("_first")).select(*key, "_first.*")


def claim_outcome(state: Column, lease_until: Column, holder: Column, claim_id: Column, now: Column) -> Column:
    live = (state == "claimed") & (lease_until > now)
    return F.when(~state.isin("pending", "claimed"), "delivery_terminal").when(live & (holder == claim_id), "unchanged").when(live, "lease_active").otherwise("claimed")


def finish_outcome(state: Column, lease_until: Column, owner_ok: Column, claim_ok: Column, digest_ok: Column, wanted: Column, failure: Column, now: Column) -> Column:
    """What an acknowledgement or a failure comes to; the tests stand in the order in which
    they are told. The same end told again is no error, even after the lease."""
    table = F.create_map(*[F.lit(x) for pair in FAILURES.items() for x in pair])
    end = F.when(wanted == "delivered", F.lit("delivered")).otherwise(F.coalesce(F.try_element_at(table, failure), F.lit("failed")))
    return (
        F.when(~owner_ok, "wrong_receiver")
        .when(~claim_ok, "wrong_claim")
        .when(~digest_ok, "digest_mismatch")
        .when(state == end, end)
        .when(state != "claimed", "not_claimed")
        .when(lease_until <= now, "lease_expired")
        .otherwise(end)
    )


def reconcile(operations: DataFrame, records: DataFrame, contents: DataFrame, incomplete: str = "interrupted") -> DataFrame:
    """(id, state) after a stop, from what is durable."""
    joined = operations.select("id").join(records.select("id", "status"), "id", "left").join(contents.select(F.col("source.capture_id").alias("id"), F.lit(True).alias("_has")).distinct(), "id", "left")
    state = F.when(F.col("status") == "failed", "failed").when((F.col("status") == "complete") & F.col("_has"), "complete").otherwise(incomplete)
    return joined.select("id", state.alias("state"))
