"""Acquisition, progress and submissions."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import acquisition, deliveries, progress, submissions


def test_budgets_refuse_as_a_client_does(spark):
    mb = 1024 * 1024
    ok = [("GET", "/watch", 200, mb, 1.0), ("POST", "/youtubei/v1/player", 200, mb, 2.0), ("GET", "/api/timedtext", 200, mb, 3.0)]
    cases = {
        "fine": (ok, None), "place": ([("GET", "/else", 302, 1, 1.0)], "destination_denied"), "fourth": ([*ok, ok[2]], "request_limit"), "late": ([("GET", "/watch", 403, 1, 46.0)], "timeout"),
        "moved": ([("GET", "/watch", 301, 9 * mb, 1.0)], "redirect_denied"), "blocked": ([ok[0], ("POST", "/youtubei/v1/player", 429, 1, 2.0)], "request_blocked"), "broken": ([("GET", "/watch", 500, 1, 1.0)], "http_error"),
        "track": ([*ok[:2], ("GET", "/api/timedtext", 200, 2 * mb + 1, 3.0)], "response_limit"), "big": ([("GET", "/watch", 200, 4 * mb + 1, 1.0)], "response_limit"), "none": ([], None), "other": (ok, "language_unavailable"),
    }
    rows = [(name, n, *r) for name, (given, _) in cases.items() for n, r in enumerate(given)]
    responses = spark.createDataFrame(rows, "id string, n int, method string, path string, status int, bytes long, seconds double")
    tracks = spark.createDataFrame([(n, c, g, i) for n in cases if n != "none" for i, (c, g) in enumerate([("fr", False), ("en", True), ("en", False)] if n != "other" else [("fr", False)])], "id string, code string, generated boolean, number int")
    requests = spark.createDataFrame([(n, ["de", "en"]) for n in cases], "id string, languages array<string>")
    got = {r.id: r for r in acquisition.acquired(requests, responses, tracks).collect()}
    assert {n: r.error for n, r in got.items()} == {n: "captions_unavailable" if n == "none" else e for n, (_, e) in cases.items()}
    assert (got["fine"].code, got["fine"].generated, got["fine"].number, got["fine"].n_requests, got["fine"].n_bytes) == ("en", False, 2, 3, 3 * mb)
    assert got["late"].code is None and got["none"].n_requests == 0


def test_progress_never_goes_back(spark, tmp_path):
    """In any order and any batches, with repeats, a stream comes to what the table does, and no
    update is behind the one before."""
    rng = random.Random(8)
    reports = [(i, s, rng.randrange(100)) for i in range(4) for s in rng.sample(progress.STAGES, rng.randrange(1, 7))] * 2 + [(0, "dancing", 500), (9, None, 1)]
    rng.shuffle(reports)
    want = {r.id: tuple(r) for r in progress.merged(spark.createDataFrame(reports, "id int, stage string, rss long"), "id", progress.STAGES, "rss").collect()}
    for i in range(4):
        mine = [progress.STAGES.index(s) for j, s, _ in reports if j == i and s in progress.STAGES]
        assert want[i][1] == progress.STAGES[max(mine)] and want[i][2] == len(mine) and want[i][4] == max(p for j, _, p in reports if j == i)
    assert want[9][1:4] == (None, 0, 1)
    for k in range(3):
        file = tmp_path / f"{k}.json"
        file.write_text("\n".join(json.dumps({"id": i, "stage": s, "rss": p}) for i, s, p in reports[k::3]))
        os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))
    seen = []
    stream = spark.readStream.schema("id int, stage string, rss long").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    run = progress.merged(stream, "id", progress.STAGES, "rss").writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend((n, *r) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert run.awaitTermination(200)
    for i in want:
        steps = [x for x in seen if x[1] == i]
        places = [progress.STAGES.index(x[2]) if x[2] else -1 for x in steps]
        assert places == sorted(places) and steps[-1][1:] == want[i]
    rows, watch = progress.observed(spark.range(10), "told", "id")
    rows.collect()
    assert watch.get == {"rows": 10, "max_id": 9, "sum_id": 45}


class _Server:
    """A server that makes a capture once for each id, whose answers may be lost."""

    def __init__(self, rng):
        self.rng, self.made, self.posts, self.probes = rng, {}, {}, {}

    def _answer(self, told):
        return "lost" if self.rng.random() < 0.4 else told

    def post(self, name):
        self.posts[name] = self.posts.get(name, 0) + 1
        if self.rng.random() < 0.2:
            return "lost"  # never came
        if self.rng.random() < 0.2:
            return self._answer("error")
        if name in self.made:
            return self._answer(self.rng.choice(["ok", "conflict"]))
        self.made[name] = 1
        return self._answer("ok")

    def probe(self, name):
        self.probes[name] = self.probes.get(name, 0) + 1
        return self._answer("ok" if name in self.made else "error")


def _state(log):
    state, token = "none", 0
    for _, t, step, result in sorted(log):
        if t >= token:
            state, token = submissions.MOVES.get((state, step, result), state), t
    return state


def test_every_stop_of_a_submission(spark):
    """A stop may come before or after each step, with its result told or not: a capture is made once
    at most, nothing is sent a third time or after a restart, and what is told as accepted or
    observed was made."""
    logs, servers = [], {}
    for seed in range(300):
        rng, name = random.Random(seed), f"s{seed}"
        server, log, token, seq = _Server(rng), [], 1, 0
        sent_after_restart = 0
        for _ in range(20):
            step = submissions.NEXT.get(_state(log))
            if step is None:
                break
            result = {"save": lambda: "ok", "post": lambda: server.post(name), "resend": lambda: server.post(name), "probe": lambda: server.probe(name)}[step]()
            sent_after_restart += step in ("post", "resend") and any(x[2] == "restart" and y[2] == "save" for x in log for y in log if y[0] < x[0])
            seq += 1
            if rng.random() < 0.25:  # a stop: the result is told late, under the old token, or never
                late = (seq + 1, token, step, result)
                token += 1
                log.append((seq, token, "restart", "ok"))
                seq += 1
                if rng.random() < 0.5 and step != "save":
                    log.append(late)
            else:
                log.append((seq, token, step, result))
        logs += [(name, *x) for x in log] + [(name, *log[-1])]
        servers[name] = (server, _state(log))
        assert server.posts.get(name, 0) <= 2 and not sent_after_restart
        if servers[name][1] in ("accepted", "observed"):
            assert server.made.get(name) == 1
    got = {r.id: (r.state, r.next) for r in submissions.states(spark.createDataFrame(logs, "id string, seq int, token int, step string, result string")).collect()}
    assert {n: s for n, (s, _) in got.items()} == {n: s for n, (_, s) in servers.items()}
    assert {"accepted", "refused", "observed", "ambiguous"} <= {s for s, _ in got.values()} and all(nxt == submissions.NEXT.get(s) for s, nxt in got.values())


def test_client_jobs(spark):
    rows = [("c", i, f"u{i % 4}", ["en"] if i % 2 else None, i) for i in range(8)] + [("d", 100, None, None, 1), ("d", 101, None, None, 2)]
    got = {r.job: (r.outcome, r.kept_job, r.place) for r in deliveries.client_jobs(spark.createDataFrame(rows, "client string, job int, url string, languages array<string>, seq int"), "client", "job", ["url", "languages"], "seq", cap=3).collect()}
    assert got == {0: ("accepted", 0, 3), 1: ("accepted", 1, 2), 2: ("accepted", 2, 1), 3: ("history_full", None, None), 4: ("existing", 0, None), 5: ("existing", 1, None), 6: ("existing", 2, None), 7: ("history_full", None, None), 100: ("accepted", 100, 1), 101: ("existing", 100, None)}


@pytest.mark.parametrize(("folder", "ok"), [("a" * 80, True), ("a" * 81, False), ("😀" * 40, True), ("😀" * 41, False), ("é", True), ("é", False), ("a/é b/c", True), ("/".join(["a" * 66] * 3), True), ("/".join(["a" * 67] * 3), False), (None, False), ("", False)])
def test_folders(spark, folder, ok):
    from corpusloom.operators.projections import folder_ok

    assert spark.createDataFrame([(folder,)], "f string").select(folder_ok(F.col("f"), ".settings")).first()[0] is ok


def test_sounds_and_films(spark):
    from corpusloom.functions import digests

    wav, ogg, mp3 = b"RIFF0000WAVEfmt ", b"OggS" + b"x" * 12, b"\xff\xfb\x90\x00" + b"x" * 12
    cases = [(wav, "audio/x-wav", None), (wav, " AUDIO/WAVE ", None), (wav, "", None), (wav, None, None), (wav, "audio/mpeg", "mime_mismatch"), (ogg, "audio/ogg; codecs=opus", None), (ogg, "application/ogg", None), (mp3, "audio/mp3", None), (b"\xff\xe2xx", "application/octet-stream", None), (b"\xff\x1f", "audio/mpeg", "unsupported_format"), (b"", "audio/wav", "input_size_limit"), (None, None, "input_size_limit")]
    rows = spark.createDataFrame([(i, c, m) for i, (c, m, _) in enumerate(cases)], "i int, c binary, m string").select("i", digests.audio_error(F.col("c"), F.col("m")).alias("e")).collect()
    assert [r.e for r in sorted(rows)] == [e for _, _, e in cases]
    box = lambda size, *brands: size.to_bytes(4, "big") + b"ftyp" + brands[0] + b"0000" + b"".join(brands[1:])
    films = [(box(20, b"xxxx", b"mp42"), True), (box(16, b"isom"), True), (box(20, b"xxxx", b"qt  "), False), (box(18, b"isom", b"mp42"), False), (b"", False), (None, False)]
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(films)], "i int, c binary").select("i", digests.film_ok(F.col("c")).alias("ok")).collect()
    assert [r.ok for r in sorted(rows)] == [ok for _, ok in films]


def test_materials_and_snapshots(spark, tmp_path):
    from corpusloom.operators import validate
    from corpusloom.sources import raw_objects, store

    cases = [
        (("text", "x", None, None), "text", None), (("text", None, None, None), None, "invalid_capture_envelope"), (("webpage", None, "<p>", None), "html", None), (("webpage", "x", "<p>", None), None, "unsupported_payload"),
        (("webpage", None, "<p>", "r"), None, "unsupported_payload"), (("webpage", "x", None, None), None, "unsupported_payload"), (("webpage", None, None, None), None, "invalid_capture_envelope"), (("image", None, None, "r"), "file_ref", None),
        (("image", "x", None, "r"), None, "unsupported_payload"), (("file", None, None, "r"), None, "unsupported_payload"), (("url", None, None, None), None, "unsupported_payload"), ((None, "x", None, None), None, "unsupported_payload"),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _, _) in enumerate(cases)], "i int, kind string, text string, html string, ref string")
    rows = sorted(df.select("i", validate.material(*[F.col(c) for c in ("kind", "text", "html", "ref")]).alias("m")).collect())
    assert [(r.m.material, r.m.error) for r in rows] == [(m, e) for _, m, e in cases]
    held = [('{"id":"a","source":{"capture_id":"c"},"schema_version":"0.3"}', "a", "c", None), ('{"id":"a","source":{"capture_id":"x"},"schema_version":"0.3"}', "a", "c", "second_key"), ('{"id":"b","schema_version":"0.3"}', "a", "c", "key"), ('{"id":"a","schema_version":"9"}', "a", "c", "version"), ("{", "a", "c", "not_json"), (None, "a", "c", "missing")]
    df = spark.createDataFrame([(i, *h[:3]) for i, h in enumerate(held)], "i int, p string, id string, capture string")
    fault = store.snapshot_fault(F.col("p"), F.col("id"), ("0.3",), also=("$.source.capture_id", F.col("capture")))
    assert [r.f for r in sorted(df.select("i", fault.alias("f")).collect())] == [h[3] for h in held]
    staged = store.stage(spark.createDataFrame([("n", b"bytes")], "name string, content binary"), f"file://{tmp_path}/raw", mime=F.lit("image/png"))
    r = staged.first()
    assert staged.columns == ["name", "raw"] and r.raw.mime_type == "image/png" and raw_objects.stored_among(f"file://{tmp_path}/raw", [r.raw.sha256]) == {r.raw.sha256}
    times = spark.createDataFrame([(1, 2), (2, 1), (1, None)], "a int, z int")
    assert [r[0] for r in times.select(validate.ran_in_order(F.col("a"), F.col("z"))).collect()] == [True, False, True]
