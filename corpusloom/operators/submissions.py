"""Submissions whose response may be lost: an intent is written first, one resend of the same id
and one look at what is there may follow, and then it is ambiguous.

The log of a submission has rows (id, seq, token, step, result). Steps: save, post, resend, probe
and restart (after a stop, under a higher token). Results: ok, conflict (the id is taken), error
(another answer) and lost (none). Rows of a lower token than one before them are those of a
worker that was given up, and change nothing. After a restart nothing is sent again: what was
under way is looked at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (state, step, result) to state; what isn't here leaves the state as it is.
MOVES = {
    ("none", "save", "ok"): "saved",
    ("saved", "post", "ok"): "accepted",
    ("saved", "post", "conflict"): "refused",
    ("saved", "post", "error"): "refused",
    ("saved", "post", "lost"): "unconfirmed",
    ("saved", "restart", "ok"): "doubtful",
    ("unconfirmed", "resend", "ok"): "accepted",
    ("unconfirmed", "resend", "error"): "refused",
    ("unconfirmed", "resend", "conflict"): "doubtful",
    ("unconfirmed", "resend", "lost"): "doubtful",
    ("unconfirmed", "restart", "ok"): "doubtful",
    ("doubtful", "probe", "ok"): "observed",
    ("doubtful", "probe", "conflict"): "ambiguous",
    ("doubtful", "probe", "error"): "ambiguous",
    ("doubtful", "probe", "lost"): "ambiguous",
}
#: What is to be done in each state; all others are ends.
NEXT = {"none": "save", "saved": "post", "unconfirmed": "resend", "doubtful": "probe"}


def _table(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def state_of(log: Column) -> Column:
    """The state after the rows of a log, array<struct<token,step,result>> in order."""
    moves = _table({"|".join(k): v for k, v in MOVES.items()})

    def step(s: Column, r: Column) -> Column:
        after = F.try_element_at(moves, F.concat_ws("|", s["state"], r["step"], r["result"]))
        live = r["token"] >= s["token"]
        return F.struct(F.when(live, F.coalesce(after, s["state"])).otherwise(s["state"]).alias("state"), F.greatest(s["token"], r["token"]).cast("long").alias("token"))

    return F.aggregate(log, F.struct(F.lit("none").alias("state"), F.lit(0).cast("long").alias("token")), step, lambda s: s["state"])


def states(log: DataFrame, key: str = "id") -> DataFrame:
    """(key, state, next, n): where each submission stands, and what is to be done, if anything. A log
    has few rows, as every step is made at most once; repeated rows count once."""
    rows = log.select(key, "seq", "token", "step", "result").distinct()
    one = F.struct("seq", F.col("token").cast("long").alias("token"), "step", "result")
    found = rows.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("_log"))
    state = state_of(F.transform("_log", lambda r: F.struct(r["token"].alias("token"), r["step"].alias("step"), r["result"].alias("result"))))
    return found.select(key, state.alias("state"), F.size("_log").alias("n")).withColumn("next", F.try_element_at(_table(NEXT), F.col("state")))
