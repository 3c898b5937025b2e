"""Vector code compression: product codes by exact integer arithmetic.

Components become integers floor(1024 * x), vectors are cut into 4 equal consecutive parts, and
each part position has a codebook of at most 256 entries, which starts as that part of the
vectors with the smallest ids and is refined by rounds of assignment and floored means.

Squared distances are |x|^2 - 2 x.c + |c|^2. The dot products are matrix products of limbs:
integers are split into limbs of so many bits that a float64 sum of limb products stays below
2^53 and so is exact whatever the order BLAS adds in; the products are shifted and added up as
int64. The first least distance is the code.

Each round is one pass over the vectors that keeps, for a task, a table of sums as large as the
codebooks; only those tables, of a size that doesn't depend on the number of vectors, are
shuffled and reach the driver. A common vector or label needs nothing special, as no row moves.

Defined results: vectors that are null, or hold null or non-finite components, give no row.
Repeated rows give a row each; among rows of one vec_id, the order of components decides which
seed the codebooks come first; null ids come last. A vector whose length isn't that of the first
(by id), or any vector if that length isn't a multiple of 4, has null code and error and takes
no part; if none takes part, the digest is that of the empty text. With fewer than 256 vectors
the codebooks have as many entries. An empty table gives an empty result. Components from 2^29
on (after scaling) stop the query with an error, as a long couldn't hold their distances. Other
columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._shared import fits, stored

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Scaled components stay below this, so that distances of parts of up to 32 fit a long.
LARGEST = 1 << 29
#: Vectors that are assigned at a time.
BLOCK = 8192
#: Labels up to which their sums are broadcast (under 10 MB).
BROADCAST_ROWS = 200_000


def limbs(x, bits: int) -> list:
    """float64 arrays l with x = sum(l[i] << i * bits); all but the last are in [0, 2^bits)."""
    import numpy as np

    out = []
    while True:
        if not x.size or (x.min() >= -(1 << bits) and x.max() < 1 << bits):
            return [*out, x.astype(np.float64)]
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits


def dots(x, c):
    """x @ c.T of int64 arrays, exactly: float64 products of limbs, added up as int64."""
    import numpy as np

    # |limb| <= 2^bits, so a sum of that many products is at most 2^53
    bits = (53 - max(x.shape[1] - 1, 0).bit_length()) // 2
    total = np.zeros((len(x), len(c)), np.int64)
    right = limbs(c, bits)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            total += (a @ b.T).astype(np.int64) << ((i + j) * bits)
    return total


def nearest(x, c):
    """The first nearest row of c for each row of x, and its squared distance."""
    import numpy as np

    own, at, far = (c * c).sum(1), np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for k in range(0, len(x), BLOCK):
        rows = x[k : k + BLOCK]
        d = own - 2 * dots(rows, c)
        at[k : k + BLOCK] = best = d.argmin(1)
        far[k : k + BLOCK] = d[np.arange(len(rows)), best] + (rows * rows).sum(1)
    return at, far


def scaled(column: pa.Array, width: int):
    """An int64 array (rows, width) of floor(SCALE * x) for a column of lists of that width."""
    import numpy as np

    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(x) and np.abs(x).max() >= LARGEST:
        raise ValueError(f"a component is {LARGEST} or more after scaling")
    return x.astype(np.int64).reshape(-1, width)


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, v, label) of the vectors without null and non-finite components."""
    v = F.col("v")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    given = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    return given.where(fine)


def refined(rows: DataFrame, books: list) -> list:
    """The codebooks after one round; rows: (v), all of the books' width."""
    import numpy as np

    part = books[0].shape[1]
    kept = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, object) for b in kept.value]
        counts = [np.zeros(len(b), np.int64) for b in kept.value]
        for batch in batches:
            x = scaled(batch.column(0), PARTS * part)
            for k, book in enumerate(kept.value):
                mine = x[:, k * part : (k + 1) * part]
                at, _ = nearest(mine, book)
                order = np.argsort(at, kind="stable")
                used, starts, n = np.unique(at[order], return_index=True, return_counts=True)
                if len(used):
                    # a batch's sums fit an int64; those of a task are Python's integers
                    sums[k][used] += np.add.reduceat(mine[order], starts, axis=0).astype(object)
                    counts[k][used] += n
        for k, book in enumerate(kept.value):
            used = np.flatnonzero(counts[k])
            grid = np.repeat(used, part)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(grid), k), pa.int32()),
                    pa.array(grid, pa.int32()),
                    pa.array(np.tile(np.arange(part), len(used)), pa.int32()),
                    pa.array([str(s) for s in sums[k][used].ravel()], pa.string()),
                    pa.array(np.repeat(counts[k][used], part), pa.int64()),
                ],
                names=["part", "entry", "at", "total", "n"],
            )

    found = rows.select("v").mapInArrow(run, "part int, entry int, at int, total string, n long")
    found = found.groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = [b.copy() for b in books]
    for x in found.collect():  # at most PARTS x ENTRIES x width of a part
        out[x["part"]][x["entry"], x["at"]] = int(x["total"]) // x["n"]
    kept.unpersist()
    return out


def codebooks(rows: DataFrame, rounds: int = ROUNDS) -> list:
    """The codebook of each part, an int64 array (entries, width of a part); rows: (vec_id, v),
    all of one width that is a multiple of PARTS."""
    import numpy as np

    seeds = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).toArrow()
    width = len(seeds["v"][0])
    first = scaled(seeds["v"].combine_chunks(), width)
    books = [np.ascontiguousarray(first[:, k * width // PARTS : (k + 1) * width // PARTS]) for k in range(PARTS)]
    for _ in range(rounds):
        books = refined(rows, books)
    return books


def digest(books: list) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def encode(rows: DataFrame, books: list) -> DataFrame:
    """(vec_id, label, code, error) of rows (vec_id, v, label) of the books' width."""
    import numpy as np

    part = books[0].shape[1]
    kept = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = scaled(batch.column(1), PARTS * part)
            codes, error = np.empty((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
            for k, book in enumerate(kept.value):
                at, far = nearest(x[:, k * part : (k + 1) * part], book)
                codes[:, k] = at
                error += far
            text = codes.tobytes().hex()
            each = [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(each, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select("vec_id", "v", "label").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256): the code of each vector, its
    squared distance to what the code stands for, and the sum of those for its label."""
    rows = usable(vectors, id_col, vector_col, label_col)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("n")).first()
    width = first["n"] if first else 0
    if width and width % PARTS == 0:
        same = rows.where(F.size("v") == width)
        books = codebooks(same)
        found = stored(encode(same, books), "vector-codes")
        odd = rows.where(F.size("v") != width)
    else:
        books, found, odd = [], None, rows
    none = odd.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    every = none if found is None else found.unionByName(none)
    by_label = every.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    by_label = F.broadcast(by_label) if fits(by_label, BROADCAST_ROWS) else by_label
    out = every.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left")
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
