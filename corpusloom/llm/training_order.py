"""Training-order materialisation.

Documents become sequences of a fixed number of ids. A keyed Feistel network with
cycle-walking permutes 0 .. N-1, so each sequence knows its place in the order (its slot)
without a sort and without a table; no two share one. Slot ranges are shards, and a shard is
one file of records of a fixed stride, so record i of a shard is at i * stride and reading can
go on from any slot.

A record: document's id (8 bytes), number of the sequence in the document (4), number of ids
(4), the ids (2 or 4 bytes each; after the last, zeros), and a line feed. Numbers are
little-endian. Spark's own writer makes the files (a line of text is bytes), so a lost
executor leaves no half-written shard, and the folder may be in any store.

Null and empty texts have no sequence. Ids are integers of any sign (other types are refused);
a null one is NO_ID in the record and null again when it is read. Repeated rows have a sequence
each. An empty table writes no file. Texts may be of any length: a batch is taken in portions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from corpusloom.llm.tokens import default_path, encoder, portions

SEQUENCE_TOKENS = 256
SHARD_RECORDS = 32768
ROUNDS = 6
#: What stands for a null id in a record.
NO_ID = -(1 << 63)
#: Bytes of text whose sequences a task makes at a time; they take many times that memory.
PORTION = 2 << 20
#: Tasks that write shards, at most; beyond, each writes several.
WRITERS = 20_000


def _mixed(half, key: int, round_: int, bits: int):
    """A keyed function of half blocks."""
    import numpy as np

    x = half + np.uint64((key * 0x9E3779B97F4A7C15 + (round_ + 1) * 0xD1B54A32D192ED03) & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (x ^ x >> np.uint64(31)) & np.uint64((1 << bits) - 1)


def permuted(index, n: int, key: int, inverse: bool = False):
    """The slot of each index of 0 .. n-1 (or, inverse, the index of each slot)."""
    import numpy as np

    bits = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    rounds = [*range(ROUNDS)][:: -1 if inverse else 1]

    def once(x):
        left, right = x >> shift, x & mask
        for r in rounds:
            if inverse:
                left, right = right ^ _mixed(left, key, r, bits), left
            else:
                left, right = right, left ^ _mixed(right, key, r, bits)
        return left << shift | right

    with np.errstate(over="ignore"):
        out = once(np.asarray(index).astype(np.uint64))
        # walk along the cycle until within the domain: at most about four times its size
        while len(beyond := np.flatnonzero(out >= n)):
            out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def _layout(path: str, length: int):
    import numpy as np

    return np.dtype([("doc_id", "<i8"), ("part", "<i4"), ("n", "<i4"), ("ids", encoder(path).dtype, (length,)), ("end", "u1")])


def _records(docs: DataFrame, path: str, length: int, first, n: int, key: int, shard_records: int) -> DataFrame:
    """(shard, slot, record) of all sequences. first: a broadcast (tasks, indices, counts): of
    each task that has sequences its first index and how many they are."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, layout = encoder(path), _layout(path, length)
        tasks, indices, counts = first.value
        at = int(np.searchsorted(tasks, task := TaskContext.get().partitionId()))
        index, count = (int(indices[at]), int(counts[at])) if at < len(tasks) and tasks[at] == task else (0, 0)
        for whole in batches:
            for batch in portions(whole, whole.column(1), PORTION):
                ids, bounds = own.encode_all(batch.column(1))
                n_ids = np.diff(bounds)
                parts = -(-n_ids // length)
                starts = np.cumsum(parts) - parts
                padded = np.zeros(parts.sum() * length, own.dtype)
                padded[np.arange(len(ids)) + np.repeat(starts * length - bounds[:-1], n_ids)] = ids
                block = np.zeros(parts.sum(), layout)
                block["ids"] = padded.reshape(-1, length)
                block["doc_id"] = np.repeat(batch.column(0).fill_null(NO_ID).to_numpy(), parts)
                block["part"] = np.arange(len(block)) - np.repeat(starts, parts)
                block["n"] = np.minimum(length, np.repeat(n_ids, parts) - length * block["part"].astype(np.int64))
                slots = permuted(np.arange(index, index + len(block)), n, key)
                index, count = index + len(block), count - len(block)
                # the writer ends each record with the line feed
                stride = layout.itemsize - 1
                raw = np.ascontiguousarray(block.view(np.uint8).reshape(-1, stride + 1)[:, :-1])
                ends = np.arange(len(block) + 1, dtype=np.int32) * stride
                records = pa.Array.from_buffers(pa.binary(), len(block), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(slots // shard_records, pa.int64()), pa.array(slots, pa.int64()), records], names=["shard", "slot", "record"])
        if count:
            raise RuntimeError("the rows were dealt to tasks otherwise than when they were counted; store the table before")

    return docs.mapInArrow(run, "shard long, slot long, record binary")


def _counted(docs: DataFrame, path: str, length: int) -> DataFrame:
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = encoder(path), 0
        for whole in batches:
            for batch in portions(whole, whole.column(1), PORTION):
                n += int((-(-np.diff(own.encode_all(batch.column(1))[1]) // length)).sum())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64())], names=["task", "n"])

    return docs.mapInArrow(run, "task long, n long")


def write(docs: DataFrame, folder: str, key: int = 20_240_229, path: str | None = None, length: int = SEQUENCE_TOKENS, shard_records: int = SHARD_RECORDS, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Writes the shards to folder/shard=K and returns the number of sequences.

    Ids are found twice (to count, then to write): that is cheaper than to keep all of them on
    disk in between. Indices follow the tasks of the scan; docs has to be a table, whose tasks
    are the same both times, and that is checked."""
    import numpy as np

    path = path or default_path()
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} has to be an integer")
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # a pair of numbers for each task of the scan, far less than the driver keeps of a task anyway
    counted = _counted(given, path, length).where("n > 0").toArrow().sort_by("task")
    tasks, counts = (counted[c].to_numpy() for c in ("task", "n"))
    n = int(counts.sum())
    if n:
        first = docs.sparkSession.sparkContext.broadcast((tasks, np.cumsum(counts) - counts, counts))
        records = _records(given, path, length, first, n, key, shard_records)
        shards = -(-n // shard_records)
        writers = min(shards, WRITERS)
        (
            records.repartitionById(writers, (F.col("shard") * F.lit(writers) / F.lit(shards)).cast("int"))
            .sortWithinPartitions("shard", "slot")
            .select("shard", F.col("record").cast("string").alias("value"))
            .write.partitionBy("shard")
            .text(folder)
        )
    return n


def read(spark: SparkSession, folder: str, path: str | None = None, length: int = SEQUENCE_TOKENS, shard_records: int = SHARD_RECORDS, start: int = 0, with_ids: bool = True) -> DataFrame:
    """(slot, shard, doc_id, part, n_tokens, ids_crc32) and, if asked for, ids, of the records
    from slot start on: shards before it aren't opened, records before it are passed over by their stride."""
    path = path or default_path()
    kinds = "slot long, shard long, doc_id long, part int, n_tokens int, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    names = [x.split()[0] for x in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        layout = _layout(path, length)
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = np.frombuffer(content.as_buffer(), layout)
                if (block["end"] != 10).any():
                    raise ValueError(f"shard {shard} has a broken record")
                skip = max(0, start - shard * shard_records)
                slots = np.arange(len(block)) + shard * shard_records
                for a in range(skip, len(block), 1024):
                    some = block[a : a + 1024]
                    ids = [x[:n] for x, n in zip(some["ids"], some["n"], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(slots[a : a + 1024], pa.int64()),
                            pa.array(np.full(len(some), shard), pa.int64()),
                            pa.array([None if x == NO_ID else x for x in some["doc_id"].tolist()], pa.int64()),
                            pa.array(some["part"], pa.int32()),
                            pa.array(some["n"], pa.int32()),
                            pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                            *([pa.array([x.astype("<i4") for x in ids], pa.list_(pa.int32()))] if with_ids else []),
                        ],
                        names=names,
                    )

    files = spark.read.format("binaryFile").load(folder).select(F.col("shard").cast("long").alias("shard"), "content")
    return files.where(F.col("shard") >= start // shard_records).mapInArrow(run, kinds)
