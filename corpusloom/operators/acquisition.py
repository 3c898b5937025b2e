"""Acquisition of caption tracks from recorded responses, within budgets: what a bounded client
would have told for each request, and the track it would have taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: requests, bytes of a response, of a caption track and of all, seconds of all, and
# the places that may be asked
REQUESTS, RESPONSE_BYTES, TRACK_BYTES, TOTAL_BYTES, SECONDS = 3, 4 * 1024 * 1024, 2 * 1024 * 1024, 10 * 1024 * 1024, 45.0
TRACK_PATH = "/api/timedtext"
PLACES = (("GET", "/watch"), ("POST", "/youtubei/v1/player"), ("GET", TRACK_PATH))


def response_error(method: Column, path: Column, status: Column, size: Column, number: Column, total: Column, seconds: Column) -> Column:
    """null, or why a response ends the acquisition; the tests stand in the order in which a client
    meets them: the place, the number of requests, the time, the status, the bytes."""
    allowed = F.lit(False)
    for m, p in PLACES:
        allowed = allowed | ((method == m) & (path == p))
    limit = F.when(path == TRACK_PATH, TRACK_BYTES).otherwise(RESPONSE_BYTES)
    return (
        F.when(~F.coalesce(allowed, F.lit(False)), "destination_denied")
        .when(number > REQUESTS, "request_limit")
        .when(F.coalesce(seconds, F.lit(0.0)) > SECONDS, "timeout")
        .when(status.between(300, 399), "redirect_denied")
        .when(status.isin(401, 403, 429), "request_blocked")
        .when(~F.coalesce(status == 200, F.lit(False)), "http_error")
        .when((size > limit) | (total > TOTAL_BYTES), "response_limit")
    )


def acquired(requests: DataFrame, responses: DataFrame, tracks: DataFrame, key: str = "id") -> DataFrame:
    """(key, error, code, generated, number, n_requests, n_bytes) of requests (key, languages). responses (key, n,
    method, path, status, bytes, seconds) are told in the order n; the first that fails ends it.
    Of the tracks (key, code, generated, number) the first by the order of the languages is taken,
    made by hand before generated within each. Responses beyond the first that are
    refused for their number change nothing, so no more than those are put in order."""
    w = Window.partitionBy(key).orderBy("n")
    told = responses.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= REQUESTS + 1)
    told = told.withColumn("_total", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    told = told.withColumn("_error", response_error(F.col("method"), F.col("path"), F.col("status"), F.col("bytes"), F.col("_i"), F.col("_total"), F.col("seconds")))
    ends = told.groupBy(key).agg(F.min_by("_error", F.when(F.col("_error").isNotNull(), F.col("_i"))).alias("_error"), F.min(F.when(F.col("_error").isNotNull(), F.col("_i"))).alias("_at"), F.count("*").alias("n_requests"), F.max("_total").alias("n_bytes"))
    have = tracks.join(requests.select(key, "languages"), key).withColumn("_place", F.array_position("languages", F.col("code")))
    taken = have.groupBy(key).agg(F.min_by(F.struct("code", "generated", "number"), F.when(F.col("_place") > 0, F.struct("_place", "generated", "number"))).alias("_t"))
    df = requests.select(key).join(ends, key, "left").join(taken.withColumn("_any", F.lit(True)), key, "left")
    error = F.coalesce("_error", F.when(F.col("_any").isNull(), "captions_unavailable").when(F.col("_t").isNull(), "language_unavailable"))
    ok = error.isNull()
    shown = {"error": error, "code": F.when(ok, F.col("_t.code")), "generated": F.when(ok, F.col("_t.generated")), "number": F.when(ok, F.col("_t.number"))}
    return df.select(key, *[c.alias(n) for n, c in shown.items()], F.when(F.col("n_requests").isNull(), 0).otherwise(F.least("n_requests", F.coalesce("_at", F.lit(REQUESTS)))).cast("long").alias("n_requests"), F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes"))
