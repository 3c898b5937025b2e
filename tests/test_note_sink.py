"""The create-only sink: once, refused names, and a stop at every point."""

import hashlib
import json
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusloom.streaming import note_sink


def _sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def _note(i, text="text", **kw):
    return {"delivery_id": f"d{i}", "name": f"{note_sink.NAME_PREFIX}{_sha(str(i))}.md", "markdown": text, "sha256": _sha(text), "attachments": None} | kw


def _file(inbox, name, rows):
    inbox.mkdir(exist_ok=True)
    (inbox / name).write_text("\n".join(map(json.dumps, rows)))


def _stream(spark, inbox):
    kind = "delivery_id string, name string, markdown string, sha256 string, attachments array<struct<name:string,sha256:string,content:string>>"
    s = spark.readStream.schema(kind).json(str(inbox))
    return s.withColumn("attachments", F.transform("attachments", lambda a: F.struct(a["name"].alias("name"), a["sha256"].alias("sha256"), F.encode(a["content"], "UTF-8").alias("content"))))


def test_stream_writes_once(spark, tmp_path):
    vault, inbox = f"{tmp_path}/vault", tmp_path / "in"
    asset = {"name": f"{_sha('a')}.png", "sha256": _sha("pixels"), "content": "pixels"}
    _file(inbox, "a.json", [_note(1), _note(1), _note(2, sha256="0" * 64), _note(3, name="../x.md"), _note(4, attachments=[asset]), _note(5, attachments=[asset] * 4)])
    os.makedirs(f"{vault}/notes")
    foreign = f"{vault}/notes/{_note(6)['name']}"
    with open(foreign, "w") as f:
        f.write("text")
    _file(inbox, "b.json", [_note(6)])

    def run(checkpoint):
        q = note_sink.write(_stream(spark, inbox), vault, "notes", f"{tmp_path}/{checkpoint}")
        assert q.awaitTermination(120) and q.exception() is None

    run("cp")
    want = {("d1", "written"), ("d2", "digest_mismatch"), ("d3", "path_rejected"), ("d4", "written"), ("d5", "invalid_package"), ("d6", "file_exists")}
    assert {(r.delivery_id, r.outcome) for r in note_sink.outcomes(spark, vault).collect()} == want
    before = {x: os.stat(f"{vault}/notes/{x}").st_mtime_ns for x in os.listdir(f"{vault}/notes")}
    assert len(before) == 4
    # all again, as a batch of the same number under another checkpoint: nothing is written or told anew
    run("cp2")
    assert {x: os.stat(f"{vault}/notes/{x}").st_mtime_ns for x in os.listdir(f"{vault}/notes")} == before
    _file(inbox, "c.json", [_note(1, "other")])
    run("cp")
    assert {(r.delivery_id, r.outcome) for r in note_sink.outcomes(spark, vault).collect()} == want | {("d1", "receipt_mismatch")}
    assert not [x for _, _, names in os.walk(f"{vault}-journal/staged") for x in names]


class _Stop(Exception):
    pass


def _rows(n):
    return [Row(**(_note(i, f"text {i}") | {"attachments": [Row(name=f"{_sha(f'p{i}')}.png", sha256=_sha(b"p"), content=b"p")]})) for i in range(n)]


@pytest.mark.parametrize("at", range(1, 16))
def test_a_stop_anywhere(tmp_path, monkeypatch, at):
    """Any link or creation may be the last before a stop: the batch given again ends with each note
    written once and whole, or told ambiguous, never overwritten."""
    options = {"path": f"{tmp_path}/v", "inbox": "notes"}
    first = note_sink._Writer(options)
    message = first.write(iter(_rows(2)))
    real, calls = os.link, []

    def link(a, b, **kw):
        calls.append(b)
        if len(calls) == at:
            raise _Stop
        real(a, b, **kw)

    class Serial:
        def __init__(self, n):
            pass

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        map = staticmethod(map)

    monkeypatch.setattr(note_sink, "ThreadPoolExecutor", Serial)
    monkeypatch.setattr(os, "link", link)
    stopped = False
    try:
        first.commit([message], 0)
    except _Stop:
        stopped = True
    monkeypatch.setattr(os, "link", real)
    assert stopped == (at <= 11)
    again = note_sink._Writer(options)
    again.commit([again.write(iter(_rows(2)))], 0)
    told = {r["delivery_id"]: r["outcome"] for r in map(json.loads, open(f"{tmp_path}/v-journal/outcomes/0000000000.json"))}
    assert set(told) == {"d0", "d1"} and set(told.values()) <= {"written", "write_ambiguous"}
    for i in range(2):
        target = f"{tmp_path}/v/notes/{_note(i)['name']}"
        if told[f"d{i}"] == "written":
            assert open(target).read() == f"text {i}" and open(f"{tmp_path}/v/notes/{_sha(f'p{i}')}.png", "rb").read() == b"p"
    third = note_sink._Writer(options)
    third.commit([third.write(iter(_rows(2)))], 1)
    assert {r["delivery_id"]: r["outcome"] for r in map(json.loads, open(f"{tmp_path}/v-journal/outcomes/0000000001.json"))} == told


def test_spoilt_and_linked_targets(tmp_path):
    options = {"path": f"{tmp_path}/v", "inbox": "notes"}
    writer = note_sink._Writer(options)
    os.makedirs(f"{tmp_path}/v/notes")
    os.symlink(f"{tmp_path}/elsewhere", f"{tmp_path}/v/notes/{_note(0)['name']}")
    assert [n[3] for n in writer.write(iter(_rows(2))).notes] == ["path_rejected", None]
    message = writer.write(iter(_rows(2)[1:]))
    writer._entry("d1", "x")
    note_sink.create(writer._entry("d1", "prepared"), json.dumps([[n, d] for n, d, _ in message.notes[0][2]]).encode())
    note_sink.create(writer._entry("d1", "creating"), b"")
    for name, _, _ in message.notes[0][2]:
        with open(f"{tmp_path}/v/notes/{name}", "w") as f:
            f.write("spoilt")
    assert writer.publish(*message.notes[0])["outcome"] == "digest_mismatch"


def test_bad_folders_are_refused(spark, tmp_path):
    for bad in ("a/../b", ".hidden", "con", "é"):
        with pytest.raises(ValueError, match="path_rejected"):
            note_sink.write(spark.readStream.format("rate").load(), str(tmp_path), bad, f"{tmp_path}/cp")
