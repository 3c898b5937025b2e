"""Toxicity by class-conditional Kneser-Ney models.

Two models of characters give the likelihood of an expression (a word, from its start to its
end): one of toxic expressions, one of ordinary ones. A gram is a character after up to ORDER
characters of its word. Each class discounts its counts absolutely and backs off to counts that
both share: the pooled counts of the gram, then continuation counts of the last LOW characters,
then those of the character alone. SHARED pseudo-counts of the pooled model stand in each class,
so a context that one class hardly knows says little; a gram of fewer than CUTOFF documents
says what its context says. So inflected and made-up forms count by the stem that toxic texts
share.

Toxic documents are ordinary language with toxic expressions in it, so training goes twice: after
the first time, expressions of toxic documents that the models don't hold for toxic count as
ordinary. The likelihood of a document's expressions as ordinary is compared with that as a
mixture of MIXED toxic and the rest ordinary ones; the difference, divided by the square root of
the number of different expressions, goes through a logistic function that is fitted to a fifth of
the training labels, which the models don't learn from.

Counts are gathered from all training documents and so grow with them: by word (each once a
document), then by gram. Models of up to BROADCAST_GRAMS entries are broadcast as sorted
arrays; larger ones stay tables, and the different words of all documents are joined with them.
Both give the same scores, as all sums are of integers. The logistic function is fitted to at
most MAX_TUNE rows (the first by a hash of the id).

Defined results: null and empty texts, and texts without letters and digits, are scored by the
logistic function's value at zero. Labels that disagree about an id count as the lower; labels
of ids without a document are not used. If labels of a class are lacking, all scores are the
share of toxic ones (0 without labels). Repeated rows are scored each; each counts as a
document. Texts may be of any length. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm._shared import delete, fits, stored
from corpusloom.llm.tokens import portions

ORDER, LOW, CUTOFF = 7, 2, 2
SHARED, MIXED = 1.0, 0.01
MAX_TUNE = 20_000
#: Entries (of 12 bytes) of models that are broadcast, and labels (ids and a number) that are.
BROADCAST_GRAMS, BROADCAST_LABELS = 8_000_000, 500_000
#: Bytes of text whose words a task takes at a time; they take many times that memory.
PORTION = 2 << 20
#: Log-likelihoods are whole numbers of this part.
UNIT = 1 << 20
NO_WORD = r"[^\pL\pN]+"
START, END = "\x02", "\x03"


def words_of(texts: pa.Array):
    """(rows, codes, words): the different words of each text as pairs of row and code."""
    import numpy as np
    import pyarrow.compute as pc

    split = pc.split_pattern_regex(pc.utf8_lower(texts), NO_WORD)
    flat, row = split.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
    some = pc.not_equal(flat, "")
    coded = flat.filter(some).dictionary_encode()
    n = max(len(coded.dictionary), 1)
    pairs = np.unique(row[some.to_numpy(zero_copy_only=False)] * n + coded.indices.to_numpy(zero_copy_only=False))
    return pairs // n, pairs % n, coded.dictionary


def mixed(h, x):
    import numpy as np

    h = (h ^ (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def grams(words: pa.Array):
    """(word, context, low, x) of every gram: the word's index, hashes of ORDER and of LOW
    characters before, and the character."""
    import numpy as np

    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    codes = np.frombuffer((START + (END + START).join(words.to_pylist()) + END).encode("utf-32-le"), np.uint32)
    first = codes == ord(START)
    word = np.cumsum(first) - 1
    at = np.arange(len(codes)) - np.flatnonzero(first)[word]
    hashes = []
    for order in (ORDER, LOW):
        h = np.full(len(codes), order, np.uint64)
        for j in range(order, 0, -1):
            h[j:] = np.where(at[j:] >= j, mixed(h[j:], codes[:-j]), h[j:])
        hashes.append(h[~first])
    return word[~first], *hashes, codes[~first]


def key(context, x):
    """An entry's key; x = 0 stands for the context as such."""
    import numpy as np

    return mixed(mixed(context, x), np.full(len(context), 77, np.uint32)).view(np.int64)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def tuning(doc_id: Column) -> Column:
    return F.floor(F.crc32(doc_id.cast("string")) / 5) % 5 == 0


def counted_words(docs: DataFrame) -> DataFrame:
    """(word, toxic, ordinary): documents of each class that have the word; docs: (text, toxic)."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, whole.column(0), PORTION)):
            rows, codes, words = words_of(batch.column(0))
            toxic = batch.column(1).to_numpy(zero_copy_only=False)[rows] == 1
            n = [np.bincount(codes[m], minlength=len(words)) for m in (toxic, ~toxic)]
            yield pa.RecordBatch.from_arrays([words, *[pa.array(x, pa.int64()) for x in n]], names=["word", "toxic", "ordinary"])

    found = docs.select("text", "toxic").mapInArrow(run, "word string, toxic long, ordinary long")
    return found.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def counted_grams(words: DataFrame) -> DataFrame:
    """(context, low, x, toxic, ordinary). Words are sorted first, so that neighbours share the
    grams of their beginnings within a batch."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, context, low, x = grams(batch.column(0))
            _, first, back = np.unique(key(context, x), return_index=True, return_inverse=True)
            n = []
            for c in (1, 2):
                total = np.zeros(len(first), np.int64)
                np.add.at(total, back, batch.column(c).to_numpy()[word])
                n.append(pa.array(total))
            each = [pa.array(v[first].view(np.int64)) for v in (context, low)]
            yield pa.RecordBatch.from_arrays([*each, pa.array(x[first].astype(np.int32)), *n], names=["context", "low", "x", "toxic", "ordinary"])

    ranged = words.repartitionByRange("word").sortWithinPartitions("word").select("word", "toxic", "ordinary")
    found = ranged.mapInArrow(run, "context long, low long, x int, toxic long, ordinary long")
    # by context, so that the sums of a context need no further shuffle
    return found.repartition("context").groupBy("context", "low", "x").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def discount(ones: int, twos: int) -> float:
    return ones / (ones + 2 * twos) if ones else 0.5


def entries(words: DataFrame) -> DataFrame:
    """(k, v), stored: the models of words (word, toxic, ordinary) as log-ratios by key."""
    import numpy as np

    spark = words.sparkSession
    of_context = W.partitionBy("context")
    table = counted_grams(words).withColumn("both", F.col("toxic") + F.col("ordinary"))
    sums = {f"{name}_{what}": f for name in ("toxic", "ordinary", "both") for what, f in (("sum", F.sum(name).over(of_context)), ("kinds", F.sum((F.col(name) > 0).cast("long")).over(of_context)))}
    table = stored(table.withColumns(sums), "toxicity-grams")
    once = lambda name, n: F.sum((F.col(name) == n).cast("long"))
    seen = table.agg(*[F.coalesce(once(name, n), F.lit(0)).alias(f"{name}{n}") for name in ("toxic", "ordinary", "both") for n in (1, 2)]).first()
    d = {name: discount(seen[f"{name}1"], seen[f"{name}2"]) for name in ("toxic", "ordinary", "both")}

    of_low = W.partitionBy("low")
    lower = stored(table.groupBy("low", "x").agg(F.count("*").alias("n")), "toxicity-lower")
    seen = lower.agg(F.coalesce(once("n", 1), F.lit(0)), F.coalesce(once("n", 2), F.lit(0)), F.count("*")).first()
    least, all_kinds = discount(seen[0], seen[1]), max(seen[2], 1)
    alone = lower.groupBy("x").agg((F.count("*") / all_kinds).alias("alone"))  # at most a row for each code point of Unicode
    lower_p = (F.col("n") - least + least * F.count("*").over(of_low) * F.col("alone")) / F.sum("n").over(of_low)
    lower_p = lower.join(F.broadcast(alone), "x").select("low", "x", lower_p.alias("p"))
    full = table.join(F.broadcast(lower_p) if fits(lower, 200_000) else lower_p, ["low", "x"])
    less = lambda name: F.greatest(F.col(name) - d[name], F.lit(0.0))
    pooled = (less("both") + d["both"] * F.col("both_kinds") * F.col("p")) / F.col("both_sum")
    full = full.withColumn("pooled", pooled)

    def left(name):
        return d[name] * F.col(f"{name}_kinds") + SHARED

    def p(name):
        return (less(name) + left(name) * F.col("pooled")) / (F.col(f"{name}_sum") + SHARED)

    def known(x, ratio):
        return F.struct(x.alias("x"), F.round(F.log(ratio) * UNIT).cast("long").alias("v"))

    own = known(F.col("x"), p("toxic") / p("ordinary"))
    rest = known(F.lit(0), left("toxic") / (F.col("toxic_sum") + SHARED) / (left("ordinary") / (F.col("ordinary_sum") + SHARED)))
    first = F.col("x") == F.min("x").over(of_context)
    told = full.withColumn("first", first).select("context", F.explode(F.array_compact(F.array(F.when(F.col("both") >= CUTOFF, own), F.when(F.col("first") & (F.col("both_sum") >= CUTOFF), rest)))).alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = key(batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array(k), batch.column(2)], names=["k", "v"])

    out = stored(told.select("context", "e.x", "e.v").mapInArrow(run, "k long, v long"), "toxicity-models")
    delete(spark, table, lower)
    return out


def ratios(words: pa.Array, keys, values):
    """The log-ratio of each word, in UNITs, from sorted keys and their values."""
    import numpy as np

    word, context, _, x = grams(words)

    def find(k):
        if not len(keys):
            return np.zeros(len(k), np.int64), np.zeros(len(k), bool)
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        return values[at].astype(np.int64), keys[at] == k

    v, seen = find(key(context, x))
    rest = np.flatnonzero(~seen)
    u, known = find(key(context[rest], np.zeros(len(rest), np.uint32)))
    v[rest] = np.where(known, u, 0)
    return np.bincount(word, v, minlength=len(words)).astype(np.int64)  # sums of integers far below 2^53


def gained(ratio):
    """What an expression adds to the mixture's log-likelihood over the ordinary one, in UNITs."""
    import numpy as np

    return np.rint(np.logaddexp(np.log1p(-MIXED), np.log(MIXED) + ratio / UNIT) * UNIT).astype(np.int64)


def arrays(model: DataFrame):
    """The model as sorted arrays, for a broadcast; None if it is too large for one."""
    import numpy as np

    if not fits(model, BROADCAST_GRAMS):
        return None
    table = model.toArrow()
    k, v = table["k"].to_numpy(), table["v"].to_numpy()
    at = np.argsort(k, kind="stable")
    return model.sparkSession.sparkContext.broadcast((k[at], v[at].astype(np.int32)))


def word_ratios(words: DataFrame, model: DataFrame, kept=None) -> DataFrame:
    """words (word, ...) with ratio; kept: the model's arrays, if it has any."""
    import numpy as np

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    if kept is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = pa.array(ratios(batch.column("word"), *kept.value))
                yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "ratio"])

        return words.mapInArrow(run, f"{kind}, ratio long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, context, _, x = grams(batch.column("word"))
            each = [batch.column("word").take(pa.array(word)), pa.array(key(context, x)), pa.array(key(context, np.zeros(len(x), np.uint32)))]
            yield pa.RecordBatch.from_arrays(each, names=["word", "k", "rest"])

    model = model.groupBy("k").agg(F.first("v").alias("v"))
    each = words.select("word").mapInArrow(cut, "word string, k long, rest long").join(model, "k", "left")
    each = each.join(model.select(F.col("k").alias("rest"), F.col("v").alias("rest_v")), "rest", "left")
    total = each.groupBy("word").agg(F.sum(F.coalesce("v", "rest_v", F.lit(0))).alias("ratio"))
    return words.join(total, "word")


def statistic(docs: DataFrame, model: DataFrame | None, kept=None) -> DataFrame:
    """docs with x, the gain of a document's expressions by the square root of their number, in
    place of text (docs: text first, not null)."""
    import numpy as np

    others = [c for c in docs.columns if c != "text"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    if model is None:
        return docs.select(*others, F.lit(0.0).alias("x"))
    if kept is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in portions(whole, whole.column(0), PORTION)):
                rows, codes, words = words_of(batch.column(0))
                gain = gained(ratios(words, *kept.value))
                total, n = np.bincount(rows, gain[codes], minlength=batch.num_rows), np.bincount(rows, minlength=batch.num_rows)
                x = total / UNIT / np.sqrt(np.maximum(n, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(x)], names=[*others, "x"])

        return docs.select("text", *others).mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in others], "x double"]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, whole.column(1), PORTION)):
            rows, codes, words = words_of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), words.take(pa.array(codes))], names=["row", "word"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gained(batch.column(1).to_numpy()))], names=["word", "gain"])

    # numbered in a stored table, so that a task that runs again gives the same numbers
    docs = stored(docs.withColumn("row", F.monotonically_increasing_id()), "toxicity-rows")
    each = docs.select("row", "text").mapInArrow(cut, "row long, word string")
    gains = word_ratios(each.select("word").distinct(), model).select("word", "ratio").mapInArrow(added, "word string, gain long")
    total = each.join(gains, "word").groupBy("row").agg((F.sum("gain") / UNIT / F.sqrt(F.count("*"))).alias("x"))
    return docs.join(total, "row", "left").select(*others, F.coalesce("x", F.lit(0.0)).alias("x"))


def train(labelled: DataFrame) -> DataFrame | None:
    """The models of labelled (doc_id, text, toxic), or None if a class is lacking."""
    words = stored(counted_words(labelled), "toxicity-words")
    n = words.agg(F.max("toxic"), F.max("ordinary")).first()
    if not n[0] or not n[1]:
        return None
    first = entries(words)
    likely = F.col("ratio") / UNIT + math.log(MIXED / (1 - MIXED)) > 0
    kept = arrays(first)
    again = word_ratios(words, first, kept).select(
        "word", F.when(likely, F.col("toxic")).otherwise(0).alias("toxic"), F.when(likely, F.col("ordinary")).otherwise(F.col("ordinary") + F.col("toxic")).alias("ordinary")
    )
    again = stored(again, "toxicity-words")
    if kept is not None:
        kept.destroy()
    out = entries(again)
    delete(words.sparkSession, words, first, again)
    return out


def logistic(x, y, rounds: int = 50) -> tuple[float, float]:
    """(slope, intercept) by Newton's steps, with a small penalty on both."""
    import numpy as np

    a, w = np.stack([x, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(2), a.T @ (y - p) - 0.01 * w)
        w += np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    given = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "doc_id")
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.least(F.greatest(F.min("toxic"), F.lit(0)), F.lit(1)).cast("int").alias("toxic"))
    known = stored(known, "toxicity-labels")
    labelled = given.join(F.broadcast(known) if fits(known, BROADCAST_LABELS) else known, "doc_id")
    tune = tuning(F.col("doc_id"))
    model = train(labelled.where(~tune))
    kept = None if model is None else arrays(model)

    def sample(rows: DataFrame):
        found = statistic(rows.select("text", "doc_id", "toxic"), model, kept)
        table = found.orderBy(F.xxhash64("doc_id"), *found.columns).limit(MAX_TUNE).toArrow()
        return table["x"].to_numpy(), table["toxic"].to_numpy().astype(float)

    x, y = sample(labelled.where(tune))
    if not len(y) or y.min() == y.max():
        x, y = sample(labelled)
    if not len(y) or y.min() == y.max():
        value = F.lit(float(y.mean()) if len(y) else 0.0)
    else:
        a, b = logistic(x, y)
        value = 1 / (1 + F.exp(-(F.col("x") * a + b)))
    out = statistic(given, model, kept).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), value.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
