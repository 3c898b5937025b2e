"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. If two fingerprints differ in at most 4 bits, and the
segments' radii r satisfy sum(r + 1) > 4, then in some segment they differ in at most r bits.
So every fingerprint looks up the Hamming ball of radius r of each of its segments in the
table of segments, and complete distances decide. The plan follows the number of different
fingerprints: about as many bits in a segment as their number has, so that a look-up meets few
others by chance; each plan finds all links.

Rows with null text count as empty; an empty text has fingerprint zero. Repeated rows each
get a result row. Rows with a null doc_id take part, but can't name a component unless all of
a component's ids are null. Other columns of the input are not touched. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._shared import components, stored

LINK_BITS = 4
#: Fingerprints up to which the plan of three segments is used; from there on, two of 32 bits.
THREE_SEGMENTS_UP_TO = 1 << 26


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64 bits: 1 where over half of the XXH64 of the text's shingles have a 1; 0 if there is no word."""
    import numpy as np
    import xxhash

    # bytes.lower() changes A-Z alone, and bytes.split() parts at the six ASCII white spaces
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths).tolist()
    ends = (ends - 1).tolist()
    digest = xxhash.xxh64_digest
    # by blocks, so that a very long text needs no more memory for its bits
    ones, n = np.zeros(64, np.int64), len(tokens) - words + 1
    for at in range(0, n, 4096):
        to = min(n, at + 4096)
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[at:to], ends[at + words - 1 : to + words - 1], strict=True)])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fingerprint(x.as_py()) for x in batch.column(1)]
            signed = [x - (1 << 64) if x >> 63 else x for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed, pa.int64())], names=["doc_id", "fp"])

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, fp long")


def segment_plan(n: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each segment for n different fingerprints."""
    return [(0, 23, 1), (23, 23, 1), (46, 18, 0)] if n <= THREE_SEGMENTS_UP_TO else [(0, 32, 2), (32, 32, 1)]


def ball(bits: int, radius: int) -> list[int]:
    """All masks of at most radius ones among that many bits."""
    masks = [0]
    if radius >= 1:
        masks += [1 << i for i in range(bits)]
    if radius >= 2:
        masks += [1 << i | 1 << j for i in range(bits) for j in range(i)]
    return masks


def links(fps: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    """(a, b) with a < b for different fingerprints of a column fp that differ in at most 4
    bits; a pair may come more than once. Distances are verified inside the join, so rows
    that met by chance aren't written."""
    assert sum(r + 1 for _, _, r in plan) > LINK_BITS and sum(w for _, w, _ in plan) == 64

    def segment(fp, first, bits):
        return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))

    # the segment's number stands above its bits, so that one long is the whole key
    def around(k, first, bits, radius):
        here = segment(F.col("fp"), first, bits)
        masks = F.array(*[F.lit(m).cast("long") for m in ball(bits, radius)])
        return F.transform(masks, lambda m: m.bitwiseXOR(here) + F.lit(k << 40))

    own = F.array(*[segment(F.col("fp"), f, w) + F.lit(k << 40) for k, (f, w, _) in enumerate(plan)])
    table = fps.select(F.col("fp").alias("b"), F.explode(own).alias("key"))
    probes = fps.select(F.col("fp").alias("a"), F.explode(F.concat(*[around(k, *x) for k, x in enumerate(plan)])).alias("key"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LINK_BITS
    return probes.join(table, (probes.key == table.key) & (F.col("a") < F.col("b")) & near).select("a", "b")


def forest(edges: DataFrame) -> DataFrame:
    """The edges (a, b) that join parts within a task: at most one fewer than its nodes. A
    large group of near copies so sends on a number of edges in proportion to its members. Which
    edges stay follows from their order, so they are sorted first: a task that runs again after
    an executor was lost, with rows that come in another order, gives the same forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(p, p)
            return x

        for batch in batches:
            kept = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return edges.sortWithinPartitions("a", "b").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that can be reached over
    links of at most 4 differing bits, the document's own included."""
    fps = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-classes")
    plan = segment_plan(classes.count())
    found = components(forest(links(classes.select("fp"), plan)), "fingerprint-links")
    member = classes.join(found, classes.fp == found.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = member.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_class = member.join(least, "component").select("fp", "component_id")
    return fps.join(of_class, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents whose doc_id is the smallest of its component; all columns as given. Of
    rows that repeat an id, all stay or go together. A row with a null doc_id stays."""
    gone = near_duplicates(docs).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
