"""The streaming source of recorded acquisitions: offsets and budgets."""

from pyspark.sql import functions as F

from corpusloom.operators import acquisition
from corpusloom.sources import caption_stream

KIND = "id string, n int, method string, path string, status int, seconds double, body binary"
MB = 1024 * 1024


def _responses(case):
    xml = b'<transcript><text start="1">x</text></transcript>'
    ok = [("GET", "/watch", 200, 1.0, b"w"), ("POST", "/youtubei/v1/player", 200, 2.0, b"p"), ("GET", "/api/timedtext", 200, 3.0, xml)]
    return {
        "fine": ok, "place": [("GET", "/else", 200, 1.0, b"")], "fourth": [*ok, ok[2]], "late": [ok[0], ("POST", "/youtubei/v1/player", 200, 46.0, b"")], "moved": [("GET", "/watch", 302, 1.0, b"")],
        "blocked": [ok[0], ("POST", "/youtubei/v1/player", 403, 2.0, b"")], "broken": [("GET", "/watch", 500, 1.0, b"")], "track": [*ok[:2], ("GET", "/api/timedtext", 200, 3.0, b"x" * (2 * MB + 1))],
        "big": [("GET", "/watch", 200, 1.0, b"x" * (4 * MB + 1))], "bytes": [*ok[:2], ("GET", "/api/timedtext", 200, 3.0, b"\xff\xfe")], "empty": ok[:2],
    }[case]


def test_budgets_and_offsets(spark, tmp_path):
    folder = tmp_path / "in"
    files = [["fine", "place", "fourth"], ["late", "moved", "blocked"], ["broken", "track", "big", "bytes", "empty"]]

    def add(k):
        rows = [(c, n, *r) for c in files[k] for n, r in enumerate(_responses(c))]
        spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(f"{tmp_path}/made{k}")
        folder.mkdir(exist_ok=True)
        next((tmp_path / f"made{k}").glob("*.parquet")).rename(folder / f"{k:05d}.parquet")

    def run():
        stream = caption_stream.acquisitions(spark, f"file://{folder}").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
        q = stream.trigger(availableNow=True).start()
        assert q.awaitTermination(200) and q.exception() is None
        return [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("id", "error").collect()]

    add(0)
    add(1)
    assert len(run()) == 6
    # goes on from its offset: files that were read are gone, and nothing is told twice
    add(2)
    got = dict(run())
    assert len(run()) == 11 == len(got)
    assert got == {"fine": None, "place": "destination_denied", "fourth": "request_limit", "late": "timeout", "moved": "redirect_denied", "blocked": "request_blocked", "broken": "http_error", "track": "response_limit", "big": "response_limit", "bytes": "invalid_response", "empty": "invalid_response"}
    rows = {r.id: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert rows["fine"].captions_xml.startswith("<transcript>") and rows["fourth"].captions_xml is None and rows["fourth"].n_requests == 3
    # the table form refuses the same
    every = spark.read.parquet(str(folder)).withColumn("bytes", F.octet_length("body").cast("long"))
    requests = every.select("id").distinct().withColumn("languages", F.array(F.lit("en")))
    tracks = requests.select("id", F.lit("en").alias("code"), F.lit(False).alias("generated"), F.lit(1).alias("number"))
    told = {r.id: r.error for r in acquisition.acquired(requests, every, tracks).collect()}
    assert {k: v for k, v in told.items() if v} == {k: v for k, v in got.items() if v and v != "invalid_response"}
