"""The content-addressed store as a data source: spark.read and df.write with format
"raw_objects".

A store is a folder of shards, objects/<first digits of the digest>/, of Parquet files sorted by
digest. A file's name begins with its first and last digest, so the listing of a shard is its
index: who asks for some digests opens the files of their shards whose range holds them, and in
those the row groups that may. Objects never change, so a file's name also tells its digests:
writing the same batch again gives the same file, and what is there wins.

Writing has two phases. Tasks put new objects into _staged/<run>/, where no reader looks; the
driver moves the files of the tasks that ended well into their shards and removes the rest. A
stop between two moves leaves some objects stored, and the batch can be given again. Two
writers at once may store an object twice; readers give it once.

Rows are (digest, shard, length, content). Contents are hashed when they are read, and one that
isn't what its digest says is an error; option("content", "false") reads no contents. Filters on
digest and shard (=, IN) are pushed down.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from corpusloom.sources.folders import fits

if TYPE_CHECKING:  # Spark plans a source in several small processes of the driver, which needn't load it
    import pyarrow as pa

NAME = "raw_objects"
#: Digits of a shard's name, digits of digests in the name of a file.
WIDTH, RANGE = 2, 16
#: Bytes of contents of a row group, and of what a task takes of a batch at a time.
GROUP = 8 << 20


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most about GROUP bytes, so that copies of a part, not of a whole batch, are held."""
    for batch in batches:
        step = max(1, len(batch) * GROUP // max(1, batch.nbytes))
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(system, root: str, shard: str) -> list[tuple[str, str, str]]:
    """(first, last, path) of the files of a shard, by name."""
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(f"{root}/objects/{shard}", allow_not_found=True))
    names = sorted(x.path for x in found if x.is_file and x.base_name.endswith(".parquet"))
    return [(*p.rsplit("/", 1)[1].split("-")[:2], p) for p in names]


def _among(system, files, digests: list[str]):
    """Which of the sorted digests the files hold; their digest columns alone are read, where
    they may hold one."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    held = set()
    for first, last, path in files:
        asked = [d for d in digests if first <= d[:RANGE] <= last]
        if asked:
            found = pq.read_table(path, columns=["digest"], filters=(pc.field("digest") >= asked[0]) & (pc.field("digest") <= asked[-1]), filesystem=system)["digest"]
            held.update(found.filter(pc.is_in(found, pa.array(asked))).to_pylist())
    return held


def stored_among(path: str, digests: Iterable[str]) -> set[str]:
    """Which of the digests are stored. Opens the files of their shards that may hold them."""
    system, root = _place(path)
    by_shard: dict[str, list[str]] = {}
    for d in sorted({*digests}):
        by_shard.setdefault(d[:WIDTH], []).append(d)
    return set().union(*[_among(system, _files(system, root, shard), asked) for shard, asked in by_shard.items()])


@dataclass
class _Part(InputPartition):
    path: str
    earlier: list
    digests: list | None


class _Reader(DataSourceReader):
    def __init__(self, path: str, content: bool) -> None:
        self.path, self.content, self.digests, self.shards = path, content, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else {*f.value} if isinstance(f, In) else None
            if values is None or f.attribute not in (("digest",), ("shard",)):
                yield f
            elif f.attribute == ("digest",):
                self.digests = values if self.digests is None else self.digests & values
            else:
                self.shards = values if self.shards is None else self.shards & values

    def partitions(self) -> list[_Part]:
        from pyarrow import fs

        system, root = _place(self.path)
        if self.digests is not None:
            shards = {d[:WIDTH] for d in self.digests}
        elif self.shards is not None:
            shards = self.shards
        else:
            shards = {x.base_name for x in system.get_file_info(fs.FileSelector(f"{root}/objects", allow_not_found=True)) if not x.is_file}
        out = []
        for shard in sorted(shards if self.shards is None else shards & self.shards):
            files = _files(system, root, shard)
            for i, (first, last, path) in enumerate(files):
                asked = None if self.digests is None else sorted(d for d in self.digests if first <= d[:RANGE] <= last)
                if asked != []:
                    out.append(_Part(path, [f for f in files[:i] if f[0] <= last and first <= f[1]], asked))
        return out or [_Part("", [], [])]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        if not part.path:
            return
        system, _ = _place(self.path)
        with system.open_input_file(part.path) as source:
            file = pq.ParquetFile(source)
            for group in range(file.num_row_groups):
                about = file.metadata.row_group(group).column(0).statistics
                if part.digests is not None and about is not None and about.has_min_max and not any(about.min <= d <= about.max for d in part.digests):
                    continue
                rows = file.read_row_group(group, columns=None if self.content else ["digest", "shard", "length"])
                if part.digests is not None:
                    rows = rows.filter(pc.is_in(rows["digest"], pa.array(part.digests, pa.string())))
                if part.earlier and len(rows):
                    twice = _among(system, part.earlier, rows["digest"].to_pylist())
                    rows = rows.filter(pc.invert(pc.is_in(rows["digest"], pa.array(sorted(twice), pa.string()))))
                for batch in rows.to_batches():
                    if self.content:
                        for d, c in zip(batch["digest"].to_pylist(), batch["content"], strict=True):
                            if hashlib.sha256(c.as_buffer()).hexdigest() != d:
                                raise ValueError(f"raw object sha256:{d} isn't what its digest says")
                    yield batch


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path, self.run = path, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        """The task's rows come sorted by digest."""
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        system, root = _place(self.path)
        system.create_dir(f"{root}/_staged/{self.run}")
        made, kind = [], pa.schema([("digest", pa.string()), ("shard", pa.string()), ("length", pa.int64()), ("content", pa.binary())])
        out = held = last = None

        def close():
            if out is not None:
                out["file"].close()
                name = f"{out['first'][:RANGE]}-{out['last'][:RANGE]}-{out['names'].hexdigest()[:16]}.parquet"
                made.append((out["path"], f"{root}/objects/{out['shard']}/{name}"))

        listed: dict[str, list] = {}
        for batch in slices(batches):
            rows = batch.select(["digest", "content"])
            digests = rows["digest"].to_pylist()
            for d, c in zip(digests, rows["content"], strict=True):
                if hashlib.sha256(c.as_buffer()).hexdigest() != d:
                    raise ValueError(f"content given for sha256:{d} has another digest")
            for shard in sorted({d[:WIDTH] for d in digests}):
                if shard not in listed:
                    listed = {shard: _files(system, root, shard)}
                mine = rows.filter(pc.equal(pc.utf8_slice_codeunits(rows["digest"], 0, WIDTH), shard))
                held = _among(system, listed[shard], mine["digest"].to_pylist())
                # in order, so equal ones are neighbours, in the batch before too
                own = mine["digest"].to_pylist()
                new = [d not in held and d != before for d, before in zip(own, [last, *own], strict=False)]
                last = own[-1]
                names = [d for d, n in zip(own, new, strict=True) if n]
                if not names:
                    continue
                mine = mine.filter(pa.array(new))
                if out is None or out["shard"] != shard:
                    close()
                    path = f"{root}/_staged/{self.run}/{uuid.uuid4().hex}.parquet"
                    out = {"shard": shard, "path": path, "first": names[0], "names": hashlib.sha256(), "file": pq.ParquetWriter(path, kind, filesystem=system, compression="zstd")}
                out["last"] = names[-1]
                out["names"].update("".join(names).encode())
                length = pc.cast(pc.binary_length(mine["content"]), pa.int64())
                table = pa.table([mine["digest"], pa.array([shard] * len(mine)), length, mine["content"]], schema=kind)
                step = max(1, GROUP // max(1, (pc.sum(length).as_py() or 0) // len(mine)))
                out["file"].write_table(table, row_group_size=step)
        close()
        return _Written(made)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, root = _place(self.path)
        for message in messages:
            for staged, final in message.files if message is not None else ():
                system.create_dir(final.rsplit("/", 1)[0])
                if system.get_file_info(final).type == fs.FileType.NotFound:
                    system.move(staged, final)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        system, root = _place(self.path)
        system.delete_dir_contents(f"{root}/_staged/{self.run}", missing_dir_ok=True)


class RawObjects(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _content(self) -> bool:
        return self.options.get("content", "true") == "true"

    def schema(self) -> str:
        return "digest string, shard string, length long" + (", content binary" if self._content() else "")

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self._content())

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("raw objects are never replaced: use mode('append')")
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(RawObjects)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


#: Digests that a task remembers of what it has sent on.
REMEMBERED = 200_000


def thinned(rows: DataFrame) -> DataFrame:
    """rows (digest, content) without those that a task has had already, before they are moved: of
    an object that many rows have, few go on. A task that has seen too many forgets and
    begins anew, so what goes on may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        seen: set[str] = set()
        for batch in slices(batches):
            keep = []
            for d in batch.column(0).to_pylist():
                keep.append(d not in seen)
                seen.add(d)
            yield batch.filter(pa.array(keep, pa.bool_()))
            if len(seen) > REMEMBERED:
                seen.clear()

    return rows.select("digest", "content").mapInArrow(run, "digest string, content binary")


def put(objects: DataFrame, path: str) -> None:
    """Stores objects (digest, content), which may repeat; each shard goes through one task, in
    order, so contents move once. The same two phases as a write of the format; as the tasks' files
    (a few for each shard) are told by rows, the driver plans no source for it."""
    writer = _Writer(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        made = writer.write(batches).files
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in made], pa.string()) for i in (0, 1)], names=["staged", "final"])

    dealt = thinned(objects).withColumn("shard", F.substring("digest", 1, WIDTH)).repartition("shard").sortWithinPartitions("digest")
    try:
        made = dealt.mapInArrow(run, "staged string, final string").collect()
    except Exception:
        writer.abort([])
        raise
    writer.commit([_Written([tuple(r) for r in made])])


def scan(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    return register(spark).read.format(NAME).option("content", str(content).lower()).load(path)


def present(refs: DataFrame, path: str, digest_col: str = "digest") -> DataFrame:
    """refs with stored; each task opens the shards of its digests alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            held = stored_among(path, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d in held for d in batch.column(0).to_pylist()])], names=["_d", "stored"])

    asked = refs.select(F.col(digest_col).alias("_d")).where("_d is not null").distinct().repartition(F.substring("_d", 1, WIDTH)).sortWithinPartitions("_d")
    told = asked.mapInArrow(run, "_d string, stored boolean")
    # one row for a digest, and none where nothing is asked for: mostly few
    return refs.join(F.broadcast(told) if fits(told) else told, F.col(digest_col) == F.col("_d"), "left").withColumn("stored", F.coalesce("stored", F.lit(False))).drop("_d")


def contents_of(refs: DataFrame, path: str, digest_col: str = "digest") -> DataFrame:
    """(digest, content) of the stored ones among refs, verified; each task opens the shards of its
    digests alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reader = _Reader(path, True)
            reader.digests = set(batch.column(0).to_pylist())
            for part in reader.partitions():
                for found in reader.read(part):
                    yield found.select(["digest", "content"])

    asked = refs.select(F.col(digest_col).alias("digest")).where("digest is not null").distinct().repartition(F.substring("digest", 1, WIDTH)).sortWithinPartitions("digest")
    return asked.mapInArrow(run, "digest string, content binary")
