"""Recorded acquisitions of captions as a streaming source: format "recorded_captions".

A folder has Parquet files of responses (id, n, method, path, status, seconds, body), all
responses of a request in one file and in the order of n; files are only added, under names that rise (a time or a
number first). The offset is how many files, by name, have been read, so a stream goes on from
its checkpoint. Each file is a partition, read a batch at a time; a request's responses are
judged as they come, and nothing of a request is held after the response that ends it. What
comes out is a row for each request: (id, error, captions_xml, n_requests, n_bytes)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from corpusloom.operators.acquisition import PLACES, REQUESTS, RESPONSE_BYTES, SECONDS, TOTAL_BYTES, TRACK_BYTES, TRACK_PATH

if TYPE_CHECKING:
    import pyarrow as pa

NAME = "recorded_captions"
SCHEMA = "id string, error string, captions_xml string, n_requests long, n_bytes long"


@dataclass
class _File(InputPartition):
    path: str


class _Acquisition:
    """A request's responses in order, up to the one that ends it."""

    def __init__(self) -> None:
        self.n = self.size = 0
        self.error: str | None = None
        self.body: bytes | None = None

    def take(self, method: str, path: str, status: int, seconds: float, body: bytes) -> None:
        if self.error:
            return
        self.n += 1
        self.size += len(body)
        self.error = self._error(method, path, status, seconds, len(body))
        if self.error:
            self.body = None
        elif path == TRACK_PATH:
            self.body = body

    def _error(self, method: str, path: str, status: int, seconds: float, size: int) -> str | None:
        if (method, path) not in PLACES:
            return "destination_denied"
        if self.n > REQUESTS:
            return "request_limit"
        if seconds > SECONDS:
            return "timeout"
        if 300 <= status < 400:
            return "redirect_denied"
        if status in (401, 403, 429):
            return "request_blocked"
        if status != 200:
            return "http_error"
        if size > (TRACK_BYTES if path == TRACK_PATH else RESPONSE_BYTES) or self.size > TOTAL_BYTES:
            return "response_limit"
        return None

    def row(self, name: str) -> tuple:
        error, xml = self.error, None
        if error is None:
            try:
                xml = self.body.decode("utf-8") if self.body else None
            except UnicodeDecodeError:
                xml = None
            error = None if xml else "invalid_response"
        return name, error, xml, min(self.n, REQUESTS), self.size


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def _names(self) -> list[str]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(x.base_name for x in found if x.is_file and x.base_name.endswith(".parquet") and x.base_name[0] not in "._")

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(self._names())}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return [_File(n) for n in self._names()[start["files"] : end["files"]]]

    def read(self, part: _File) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        asked: dict[str, _Acquisition] = {}
        with system.open_input_file(f"{root}/{part.path}") as source:
            for batch in pq.ParquetFile(source).iter_batches(64, columns=["id", "n", "method", "path", "status", "seconds", "body"]):
                for r in sorted(batch.to_pylist(), key=lambda r: r["n"]):
                    asked.setdefault(r["id"], _Acquisition()).take(r["method"], r["path"], r["status"], r["seconds"] or 0.0, r["body"] or b"")
        rows = [a.row(name) for name, a in asked.items()]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["id", "error", "captions_xml", "n_requests", "n_bytes"])

    def commit(self, end: dict) -> None:
        pass


class RecordedCaptions(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def acquisitions(spark: SparkSession, path: str) -> DataFrame:
    """A stream of SCHEMA rows; path: a URI."""
    spark.dataSource.register(RecordedCaptions)
    return spark.readStream.format(NAME).load(path)
