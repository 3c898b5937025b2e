"""Notes as files that are only created, never replaced: a streaming data source writer with a
write-ahead journal.

Tasks verify digests and names and put complete files into <journal>/staged/<run>/; the driver
publishes them at the commit of the batch, a note and its attachments at a time, under a journal
of files that are only created, too. Of each delivery it tells prepared (nothing of it exists
yet), creating (its files may exist) and its end. So a batch that comes again, after a stop at
any point, goes on from what is told:

* nothing or prepared: if a target exists, somebody else made it: file_exists;
* creating: what exists is read and held against its digest (digest_mismatch), and what doesn't
  exist may have been there: write_ambiguous, which is never tried again by itself;
* an end: it stands. The same delivery with other digests is receipt_mismatch.

The vault is a folder that the driver and the tasks share, as are notes for people; the number
of files is that of the notes.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from corpusloom.functions.digests import NAME_PREFIX
from corpusloom.operators.projections import folder_ok

NAME = "create_only_notes"
#: What a stream of notes has to have.
NOTE = "delivery_id string, name string, markdown string, sha256 string, attachments array<struct<name:string,sha256:string,content:binary>>"
# fixed values: attachments of a note at most
MOST_ATTACHMENTS = 3
_NOTE_NAME, _ASSET_NAME = rf"{NAME_PREFIX}[0-9a-f]{{64}}\.md", r"(?:[a-z]+-)?[0-9a-f]{64}\.(?:png|jpg)"


def create(path: str, data: bytes) -> bool:
    """A whole file that wasn't there, or false: another name first, then a hard link."""
    made = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(made, "xb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    try:
        os.link(made, path)
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(made)


def guard(base: str, relative: str) -> bool:
    """No part of the path below the base is a link."""
    path = base
    for part in relative.split("/"):
        path = os.path.join(path, part)
        if os.path.islink(path):
            return False
    return True


@dataclass
class _Staged(WriterCommitMessage):
    notes: list


class _Writer(DataSourceStreamWriter):
    def __init__(self, options) -> None:
        self.base, self.inbox = options["path"], options["inbox"]
        self.journal = options.get("journal") or f"{self.base.rstrip('/')}-journal"
        self.run = uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> _Staged:
        folder, out = f"{self.journal}/staged/{self.run}", []
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            files = [(a.name, a.sha256, bytes(a.content or b"")) for a in (r.attachments or [])] + [(r.name, r.sha256, (r.markdown or "").encode())]
            told = None
            if r.delivery_id is None or len(files) > MOST_ATTACHMENTS + 1 or len({f[0] for f in files}) < len(files):
                told = "invalid_package"
            elif not all(n and re.fullmatch(_NOTE_NAME if i == len(files) - 1 else _ASSET_NAME, n) and guard(self.base, f"{self.inbox}/{n}") for i, (n, _, _) in enumerate(files)):
                told = "path_rejected"
            elif any(hashlib.sha256(c).hexdigest() != d for _, d, c in files):
                told = "digest_mismatch"
            staged = []
            for name, d, content in files if told is None else ():
                path = f"{folder}/{uuid.uuid4().hex}"
                create(path, content)
                staged.append((name, d, path))
            out.append((r.delivery_id, r.name, staged, told))
        return _Staged(out)

    def _entry(self, delivery: str, state: str) -> str:
        key = hashlib.sha256(delivery.encode()).hexdigest()
        folder = f"{self.journal}/deliveries/{key[:2]}"
        os.makedirs(folder, exist_ok=True)
        return f"{folder}/{key}.{state}"

    def publish(self, delivery: str | None, name: str | None, staged: list, refused: str | None) -> dict:
        told = refused
        if delivery is not None and refused is None:
            told = self._published(delivery, staged)
        return {"delivery_id": delivery, "name": name, "outcome": told}

    def _published(self, delivery: str, staged: list) -> str:
        package = json.dumps([[n, d] for n, d, _ in staged])
        if not create(self._entry(delivery, "prepared"), package.encode()):
            with open(self._entry(delivery, "prepared")) as f:
                if f.read() != package:
                    return "receipt_mismatch"
        end = self._entry(delivery, "end")
        if os.path.exists(end):
            with open(end) as f:
                return f.read()
        targets = [(f"{self.base}/{self.inbox}/{n}", d, path) for n, d, path in staged]
        if os.path.exists(self._entry(delivery, "creating")):
            told = "written" if all(os.path.lexists(t) for t, _, _ in targets) else "write_ambiguous"
        elif any(os.path.lexists(t) for t, _, _ in targets):
            told = "file_exists"
        else:
            create(self._entry(delivery, "creating"), b"")
            told = "written"
            for target, _, path in targets:
                try:
                    os.link(path, target)
                except FileExistsError:
                    told = "file_exists"
                    break
        if told == "written":
            for target, d, _ in targets:
                with open(target, "rb") as f:
                    if hashlib.file_digest(f, "sha256").hexdigest() != d:
                        told = "digest_mismatch"
        create(end, told.encode())
        return told

    def commit(self, messages: list, batch: int) -> None:
        os.makedirs(f"{self.base}/{self.inbox}", exist_ok=True)
        os.makedirs(f"{self.journal}/outcomes", exist_ok=True)
        notes = sorted((n for m in messages if m is not None for n in m.notes), key=lambda n: (n[0] or "", n[1] or ""))
        # a delivery that comes twice in a batch is one
        with ThreadPoolExecutor(16) as pool:
            told = list(pool.map(lambda n: self.publish(*n), {(n[0], n[1], json.dumps([s[:2] for s in n[2]]), n[3]): n for n in notes}.values()))
        create(f"{self.journal}/outcomes/{batch:010d}.json", "".join(json.dumps(t) + "\n" for t in told).encode())
        self.abort(messages, batch)

    def abort(self, messages: list, batch: int) -> None:
        """Staged files go; those of tasks that failed tell nothing and stay under their run."""
        for _, _, staged, _ in (n for m in messages if m is not None for n in m.notes):
            for _, _, path in staged:
                with contextlib.suppress(FileNotFoundError):
                    os.unlink(path)


class Notes(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def streamWriter(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def write(notes: DataFrame, vault: str, inbox: str, checkpoint: str, journal: str | None = None, settings_folder: str = ".settings"):
    """Starts a stream of NOTE rows into vault/inbox. vault and journal are paths of a mounted
    folder."""
    spark = notes.sparkSession
    if not spark.range(1).select(folder_ok(F.lit(inbox), settings_folder)).first()[0] or not guard(vault, inbox):
        raise ValueError("path_rejected")
    spark.dataSource.register(Notes)
    out = notes.writeStream.format(NAME).option("path", vault).option("inbox", inbox).option("checkpointLocation", checkpoint)
    return (out.option("journal", journal) if journal else out).trigger(availableNow=True).start()


def outcomes(spark: SparkSession, vault: str, journal: str | None = None) -> DataFrame:
    """(delivery_id, name, outcome) of all batches."""
    return spark.read.schema("delivery_id string, name string, outcome string").json(f"{journal or vault.rstrip('/') + '-journal'}/outcomes")
