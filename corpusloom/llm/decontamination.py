"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared as lower-case letters and digits with one space for each run of other
characters. An item is cut into overlapping windows (a short item is one window), so that a
part of a long item is found too. A window of m characters that occurs with at most e edits
shares at least m - q + 1 - q * e of its q-grams with the text, all on diagonals (text
position less window position) that lie within e of each other. So shared q-grams are counted
in overlapping bands of diagonals, regions below that bound are passed over, and those that
remain are verified by an alignment within the band.

Items go to the executors in blocks of a bounded number of characters; each block meets all
documents whole. Null texts and texts without a letter or digit match nothing, nor do items
under q letters, digits and spaces. Repeated rows of documents give repeated results; repeated
items each match. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 8
WINDOW = 96
#: Edits that a window may have, for each of its characters.
EDITS = 0.08
#: Characters of items in a block, which each worker holds about 30 bytes each of.
BLOCK_CHARS = 2_000_000


@lru_cache(maxsize=1)
def _table():
    """For each of the first 65536 code points, what it counts as; 32 stands for no letter or digit."""
    import numpy as np

    low = [ord(y) if c.isalnum() and len(y := c.lower()) == 1 and ord(y) < 1 << 16 else (i if c.isalnum() else 32) for i, c in enumerate(map(chr, range(1 << 16)))]
    return np.array(low, np.uint32)


def normalised(text: str):
    """The code points that are compared, and the place of each in the text."""
    import numpy as np

    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _table()
    high = raw >= len(table)
    out = table[np.where(high, 32, raw)] if high.any() else table[raw]
    if high.any():
        out = np.where(high, raw, out)
    kept = out != 32
    kept[1:] |= out[:-1] != 32  # the first of a run of others stays, as a space
    where = np.flatnonzero(kept)
    if len(where) and out[where[0]] == 32:
        where = where[1:]
    if len(where) and out[where[-1]] == 32:
        where = where[:-1]
    return out[where], where


def qgrams(points):
    """A hash of the Q points from each place on; Q is a power of two."""
    import numpy as np

    h, n = points.astype(np.uint64), 1
    while n < Q:
        h = h[:-n] * np.uint64(pow(0x9E3779B97F4A7C15, n, 1 << 64)) + h[n:]
        n *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def edits_in_band(window, text, low: int, high: int) -> tuple[int, int]:
    """The fewest edits that turn the window into a part of the text, over alignments whose
    diagonals lie in low..high, and the place in the text where that part ends."""
    import numpy as np

    k = np.arange(high - low + 1)
    far, n = len(window) + len(text) + 1, len(text)
    at = low + k
    row = np.where((at >= 0) & (at <= n), 0, far)
    for i in range(1, len(window) + 1):
        at = at + 1
        inside = (at >= 1) & (at <= n)
        other = np.where(inside, text[np.clip(at - 1, 0, n - 1)], 0)
        step = np.minimum(row + (other != window[i - 1]), np.append(row[1:] + 1, far))
        step = np.where(at >= 1, step, np.where(at == 0, i, far))
        row = np.minimum.accumulate(step - k) + k
        row = np.where(at <= n, row, far)
    best = int(row.argmin())
    return int(row[best]), int(at[best])


def _place(window, region) -> int:
    """Where the window's points stand in the region, or -1."""
    whole, part, at = region.tobytes(), window.tobytes(), -1
    while (at := whole.find(part, at + 1)) >= 0:
        if at % 4 == 0:
            return at // 4
    return -1


class Index:
    """The q-grams of the windows of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        import numpy as np

        self.item, self.windows, self.start = [], [], []
        for item_id, text in items:
            points, _ = normalised(text)
            if len(points) < Q:
                continue
            n = max(1, -(-(len(points) - WINDOW) // (WINDOW // 2)) + 1)
            for k in range(n):
                at = max(0, (len(points) - WINDOW) * k // max(1, n - 1))
                self.item.append(item_id)
                self.windows.append(points[at : at + WINDOW])
                self.start.append(at)
        m = np.array([len(x) for x in self.windows], np.int64)
        self.budget = np.minimum((EDITS * m).astype(np.int64), np.maximum((m - Q) // Q, 0))
        self.least = m - Q + 1 - Q * self.budget
        grams = [qgrams(x) for x in self.windows]
        gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        window = np.repeat(np.arange(len(grams)), [len(x) for x in grams])
        place = np.concatenate([np.arange(len(x)) for x in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self.window, self.place = window[order].astype(np.int32), place[order].astype(np.int32)
        self.known, self.at = np.unique(gram[order], return_index=True)
        self.at = np.append(self.at, len(gram))
        self.shift = np.uint64(64 - max(10, (32 * len(gram)).bit_length()))
        self.seen = np.zeros(1 << int(64 - self.shift), bool)
        self.seen[self.known >> self.shift] = True

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) for each item of which a window occurs in the text: the
        span of its windows in the text, and the fewest edits of one."""
        import numpy as np

        if not text or not self.windows:
            return []
        points, where = normalised(text)
        if len(points) < Q:
            return []
        gram = qgrams(points)
        maybe = np.flatnonzero(self.seen[gram >> self.shift])
        if not len(maybe):
            return []
        slot = np.minimum(np.searchsorted(self.known, gram[maybe]), len(self.known) - 1)
        real = self.known[slot] == gram[maybe]
        maybe, slot = maybe[real], slot[real]
        found: dict[int, list[int]] = {}
        # by blocks, so that a very long text of frequent q-grams needs bounded memory; blocks
        # overlap by more than a region's length
        total = np.cumsum(self.at[slot + 1] - self.at[slot])
        a = 0
        while a < len(maybe):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + 2_000_000)))
            self._regions(points, maybe[a:b], slot[a:b], where, found)
            if b >= len(maybe):
                break
            a = max(a + 1, int(np.searchsorted(maybe, maybe[b - 1] - 4 * WINDOW)))
        return [(item, *span) for item, span in found.items()]

    def _regions(self, points, maybe, slot, where, found: dict) -> None:
        import numpy as np

        count = self.at[slot + 1] - self.at[slot]
        entry = np.repeat(self.at[slot] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        window = self.window[entry].astype(np.int64)
        diagonal = np.repeat(maybe, count) - self.place[entry]
        width = self.budget[window] + 1
        # bands of twice the width that start at each multiple of it: a diagonal is in two
        band = diagonal // width
        names = len(points) + 2 * WINDOW
        key, n = np.unique(np.concatenate([window * names + band + WINDOW, window * names + band - 1 + WINDOW]), return_counts=True)
        key = key[n >= self.least[key // names]]
        for w, b in zip((key // names).tolist(), (key % names - WINDOW).tolist(), strict=True):
            budget, own = int(self.budget[w]), self.windows[w]
            low, high = b * (budget + 1), (b + 2) * (budget + 1) - 1
            first = max(0, low - budget)
            region = points[first : max(0, high + budget + len(own))]
            if not len(region):
                continue
            # an exact copy needs no alignment
            end = _place(own, region)
            edits, end = (0, end + len(own)) if end >= 0 else edits_in_band(own, region, low - budget - first, high + budget - first)
            if edits <= budget:
                a = where[max(0, first + end - len(own))]
                z = where[first + end - 1] + 1
                old = found.setdefault(self.item[w], [int(a), int(z), edits])
                old[:] = min(old[0], int(a)), max(old[1], int(z)), min(old[2], edits)


def _indices(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    given = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    chars = given.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    for k in range(blocks):
        part = given.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).orderBy("id", "text").toArrow()
        yield Index(list(zip(part["id"].to_pylist(), part["text"].to_pylist(), strict=True)))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, edits): a row for each document and item of which a window
    occurs in it; start and end are characters of the text."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    out = None
    for index in _indices(benchmark, "item_id", "text"):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, *m) for i, text in enumerate(batch.column(1)) for m in held.value.matches(text.as_py())]
                columns = [list(x) for x in zip(*rows, strict=True)] or [[]] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *[pa.array(x, pa.int64()) for x in columns[1:]]], names=["doc_id", "item_id", "start", "end", "edits"])

        part = given.mapInArrow(run, f"doc_id {kind}, item_id long, start long, end long, edits long")
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents in which no window of an item occurs; all columns as given."""
    at = docs.columns.index(text_col)
    for index in _indices(benchmark, "item_id", "text"):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not held.value.matches(x.as_py()) for x in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
