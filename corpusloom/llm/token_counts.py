"""Exact token counts from a histogram of encoded lengths.

A histogram (length, n_docs) holds all that totals, quantiles and truncated totals need: with
suffix sums, "documents longer than L" and "their tokens" are two columns, and what remains of
the corpus at a context limit of L is total - tokens_longer + L * docs_longer.

Null and empty texts have length 0 and count as documents. Repeated rows count each. Other
columns aren't read. An empty table gives an empty histogram.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm._shared import stored
from corpusloom.llm.tokens import default_path, token_counts

#: Lengths in a block of the two-level suffix sums: sums over blocks are few, and a block is short.
BLOCK = 1024


def length_histogram(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs); documents are counted before the shuffle."""
    counted = token_counts(docs.select(F.lit(0).alias("doc_id"), text_col), path or default_path(), text_col=text_col)
    return counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Adds to each length: docs_longer and tokens_longer (of documents with more tokens),
    total_docs, total_tokens, truncated_tokens (of all documents cut to this length) and
    share_not_longer (the quantile at which this length stands)."""
    # it is met twice, and finding it means encoding all texts
    h = stored(histogram, "length-histogram").withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(every).alias("total_docs"),
        F.sum("t").over(every).alias("total_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = h.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.col("docs_after") + F.coalesce(F.sum("n_docs").over(within), F.lit(0))).alias("docs_longer"),
        (F.col("tokens_after") + F.coalesce(F.sum("tokens").over(within), F.lit(0))).alias("tokens_longer"),
        "total_docs",
        "total_tokens",
    )
    return out.withColumn("truncated_tokens", F.expr("total_tokens - tokens_longer + n_tokens * docs_longer")).withColumn(
        "share_not_longer", F.expr("cast(total_docs - docs_longer as double) / total_docs")
    )


def truncated_totals(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """(context_limit, tokens): the corpus' tokens if each document is cut to the limit, for
    any limits (a column context_limit), from suffix_sums()."""
    least = sums.agg(F.first("total_docs").alias("all_docs"), F.first("total_tokens").alias("all_tokens"))
    known = sums.select("n_tokens", "docs_longer", "tokens_longer")
    # the suffix sums at the longest length that isn't over the limit hold for the limit too
    at = limits.distinct().join(F.broadcast(least)).join(known, F.col("n_tokens") <= F.col("context_limit"), "left")
    return (
        at.groupBy("context_limit", "all_docs", "all_tokens")
        .agg(F.max_by(F.struct("docs_longer", "tokens_longer"), "n_tokens").alias("s"))
        .select("context_limit", F.expr("all_tokens - coalesce(s.tokens_longer, all_tokens) + context_limit * coalesce(s.docs_longer, all_docs)").alias("tokens"))
    )


def quantile(sums: DataFrame, share: float) -> DataFrame:
    """One row: the least length that at least this share of documents doesn't exceed. The share
    counts as the decimal it is written as, so that 0.07 of 100 documents are 7."""
    least = F.ceil(F.lit(Decimal(repr(float(share)))).cast("decimal(19,18)") * F.col("total_docs").cast("decimal(19,0)"))
    return sums.where(F.col("total_docs") - F.col("docs_longer") >= least).agg(F.min("n_tokens").alias("n_tokens"))
