"""Lexical retrieval packing.

Each document becomes its ids and an end id. Whole windows of a long document are sequences
of their own; what remains of each document (under one window) goes to a shard of a bounded
number of ids, near in order to those with which it shares its rarest ids: shards are ranges of
(rarest id that another remainder has too, second rarest, hash of the row), so a near copy or a
text on the same matter is in the same shard, and a group too large for one is split by the next
of the three. A shard has a BM25 inverted index over its remainders: the first unused one is the
seed of a window, and the unused neighbours with the highest score fill it greedily; the one that
doesn't fit is cut, and its rest is the next seed. The last ids of a shard are cut at powers of
two. So sequences need no padding at all. How many documents have an id, and mean lengths, are
counted over all remainders of the corpus. Documents that share common ids alone may lie in
different shards and don't meet.

Null and empty texts are the end id alone. Repeated rows are packed each. Null ids of
documents are kept. An empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._shared import stored
from corpusloom.llm.tokens import default_path, encoder, portions

#: Ids of a shard, about.
SHARD_TOKENS = 1_000_000
K1, B = 1.2, 0.75


def crc(ids) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _encoded(docs: DataFrame, path: str, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc_tokens, crcs, rest): crcs of the document's whole windows, and its other ids."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for given in batches:
            for batch in portions(given, given.column(1)):
                ids, bounds = own.encode_all(batch.column(1))
                ids, bounds = np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))
                n, crcs, rest = np.diff(bounds), [], []
                for a, k in zip(bounds.tolist(), n.tolist(), strict=False):
                    whole = k // window * window
                    crcs.append([crc(ids[x : x + window]) for x in range(a, a + whole, window)])
                    rest.append(ids[a + whole : a + k].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rest, pa.binary())], names=["doc_id", "doc_tokens", "crcs", "rest"]
                )

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, doc_tokens long, crcs array<long>, rest binary")


def _document_frequencies(encoded: DataFrame, path: str):
    """How many remainders hold each id: one number for each id of the vocabulary."""
    import numpy as np

    own = encoder(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(path).dtype
        found = np.zeros(encoder(path).size, np.int64)
        for batch in batches:
            for rest in batch.column(0):
                found[np.unique(np.frombuffer(rest.as_py(), dtype))] += 1
        ids = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found[ids], pa.int64())], names=["id", "n"])

    # one row for each id of the vocabulary at most, whatever the corpus' size
    counted = encoded.select("rest").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(own.size, np.int64)
    out[counted["id"].to_numpy()] = counted["n"].to_numpy()
    return out


class Index:
    """BM25 postings of a shard, by id."""

    def __init__(self, docs: list, weights, mean: float):
        import numpy as np

        terms, tfs = zip(*[np.unique(x, return_counts=True) for x in docs], strict=True)
        self.n, self.terms, self.weights = len(docs), terms, weights
        lengths = np.array([len(x) for x in docs])
        doc = np.repeat(np.arange(self.n), [len(x) for x in terms])
        term, tf = np.concatenate(terms), np.concatenate(tfs)
        score = weights[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean))
        order = np.argsort(term, kind="stable")
        self.doc, self.score = doc[order], score[order]
        self.known, self.at = np.unique(term[order], return_index=True)
        self.at = np.append(self.at, len(term))

    def neighbours(self, seed: int, unused):
        """The unused documents by falling score over all different ids of the seed (ties: by
        their order), those without a shared id left out."""
        import numpy as np

        where = np.searchsorted(self.known, self.terms[seed])
        spans = list(zip(self.at[where].tolist(), self.at[where + 1].tolist(), strict=True))
        total = np.bincount(np.concatenate([self.doc[a:b] for a, b in spans]), np.concatenate([self.score[a:b] for a, b in spans]), self.n)
        total[~unused] = 0
        found = np.flatnonzero(total)
        return found[np.argsort(-total[found], kind="stable")]


def fill(docs: list, weights, mean: float, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents that are all shorter
    than the window and not empty."""
    import numpy as np

    index, unused, first = Index(docs, weights, mean), np.ones(len(docs), bool), 0
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence, rest = 0, None
    while True:
        if rest is None:
            while first < len(docs) and not unused[first]:
                first += 1
            if first == len(docs):
                return pieces
            seed, start = first, 0
            unused[first] = False
        else:
            seed, start = rest
        held, rest = [(seed, start, len(docs[seed]) - start)], None
        room = window - held[0][2]
        near = iter(index.neighbours(seed, unused).tolist())
        while room:
            if (other := next(near, None)) is None:
                while first < len(docs) and not unused[first]:
                    first += 1
                if first == len(docs):
                    break
                other = first
            elif not unused[other]:
                continue
            unused[other] = False
            n = min(room, len(docs[other]))
            held.append((other, 0, n))
            room -= n
            if n < len(docs[other]):
                rest = (other, n)
        # a full window is one sequence; the ids of the last are cut at powers of two
        cuts = [window] if not room else [1 << i for i in range(window.bit_length(), -1, -1) if (window - room) >> i & 1]
        offset = 0
        for doc, at, n in held:
            while n:
                take = min(n, cuts[0] - offset)
                pieces.append((doc, at, take, sequence, offset))
                at, n, offset = at + take, n - take, offset + take
                if offset == cuts[0]:
                    cuts.pop(0)
                    sequence, offset = sequence + 1, 0


def pack(docs: DataFrame, path: str | None = None, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece."""
    import numpy as np

    path = path or default_path()
    encoded = stored(_encoded(docs, path, window, end_id, id_col, text_col), "encoded")
    kind = encoded.schema["doc_id"].dataType.simpleString()
    whole = (
        encoded.select("doc_id", "doc_tokens", F.posexplode("crcs").alias("k", "ids_crc32"))
        .select("doc_id", (F.col("k") * F.lit(window).cast("long")).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens")
        .withColumn("sequence_id", F.monotonically_increasing_id() * 2)
        .withColumn("offset", F.lit(0).cast("long"))
    )
    size = encoder(path).dtype.itemsize
    rests = encoded.where(F.length("rest") > 0)
    n, total = rests.agg(F.count("*"), F.sum(F.length("rest"))).first()
    if not n:
        return whole
    shards = max(1, round(total / size / shard_tokens))
    frequency = _document_frequencies(rests, path)
    names = whole.columns
    weights, mean = np.log1p((n - frequency + 0.5) / (frequency + 0.5)), total / size / n
    # ids by how rare they are; those of one remainder alone are last
    rank = np.empty(len(frequency), np.int64)
    rank[np.lexsort((np.arange(len(frequency)), frequency, frequency < 2))] = np.arange(len(frequency))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(path).dtype
        for batch in batches:
            rarest = np.full((len(batch), 2), -1)
            for i, rest in enumerate(batch["rest"]):
                order = np.sort(rank[np.unique(np.frombuffer(rest.as_py(), dtype))])[:2]
                rarest[i, : len(order)] = order
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rarest[:, 0]), pa.array(rarest[:, 1])], names=[*batch.schema.names, "first", "second"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one shard, of a bounded number of ids
        held = list(batches)
        if not held:
            return
        dtype = encoder(path).dtype
        # by row, as a lost task's rows may come in another order when they come again
        table = pa.Table.from_batches(held).sort_by("row").combine_chunks()
        docs = [np.frombuffer(x.as_py(), dtype) for x in table["rest"]]
        doc, start, length, sequence, offset = map(np.array, zip(*(pieces := fill(docs, weights, mean, window)), strict=True))
        base = (table["doc_tokens"].to_numpy() - np.array([len(x) for x in docs]))[doc]
        # the shard's number above, the window's number below, and a 1 that whole windows don't have
        name = (np.int64(TaskContext.get().partitionId()) << 24 | sequence) * 2 + 1
        crcs = [crc(docs[d][a : a + k]) for d, a, k, _, _ in pieces]
        picked = table.take(pa.array(doc)).combine_chunks()
        out = pa.table([picked["doc_id"], base + start, length, pa.array(crcs, pa.int64()), picked["doc_tokens"], name, offset], names=names)
        yield from out.to_batches(max_chunksize=10_000)

    given = rests.select("doc_id", "doc_tokens", "rest", F.monotonically_increasing_id().alias("row"))
    ranged = given.mapInArrow(keyed, f"doc_id {kind}, doc_tokens long, rest binary, row long, first long, second long").repartitionByRange(shards, "first", "second", F.xxhash64("row"))
    packed = ranged.select("doc_id", "doc_tokens", "rest", "row").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return whole.union(packed)
