"""Word error rates: alignments counted by kind, and pooled."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower().replace("ё", "е"))


def score(reference: list[str], heard: list[str]) -> tuple[int, int, int, int]:
    """(words, substitutions, deletions, insertions) of the cheapest alignment; of several, that
    which ends in a substitution, else a deletion, else an insertion, is taken at each step."""
    row = [(j, 0, 0, j) for j in range(len(heard) + 1)]  # cost, substituted, deleted, inserted
    for i, a in enumerate(reference, 1):
        before, row = row, [(i, 0, i, 0)]
        for j, b in enumerate(heard, 1):
            if a == b:
                row.append(before[j - 1])
                continue
            c, s, d, n = before[j - 1]
            best = (c + 1, s + 1, d, n)
            c, s, d, n = before[j]
            if c + 1 < best[0]:
                best = (c + 1, s, d + 1, n)
            c, s, d, n = row[j - 1]
            if c + 1 < best[0]:
                best = (c + 1, s, d, n + 1)
            row.append(best)
    _, s, d, n = row[-1]
    return len(reference), s, d, n


def scored(pairs: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, n, s, d, i) of pairs (id, reference, heard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [score(words(a or ""), words(b or "")) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[k] for x in out], pa.int64()) for k in range(4)]], names=[id_col, "n", "s", "d", "i"])

    given = pairs.select(id_col, "reference", "heard")
    return given.mapInArrow(run, f"{id_col} {given.schema[id_col].dataType.simpleString()}, n long, s long, d long, i long")


def pooled(scores: DataFrame, *by: str) -> DataFrame:
    """Errors over words, summed before they are divided."""
    return scores.groupBy(*by).agg(F.sum("n").alias("words"), F.sum(F.col("s") + F.col("d") + F.col("i")).alias("errors")).withColumn("wer", F.when(F.col("words") > 0, F.col("errors") / F.col("words")))
