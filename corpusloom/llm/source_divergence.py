"""Source divergence audit: how the sources of a language differ in their terms.

Each group (language, source) has the counts of the language's kept terms. A block is a run of
up to BLOCK terms of similar frequency, in the order of their text; over a block, each group has
a segment tree of its counts. Trees are hash-consed: a leaf is a count, a node is a pair of
nodes, and equal subtrees are one node, whichever group or terms they stand for (the many terms
that a group lacks, or has once, are a few nodes). Two trees are priced by going down both at
the same time, level by level; a pair of nodes that comes up again, anywhere in the block, is
priced once. Prices are added on the way up. For the terms that mark a group, its tree
is walked together with that of the language: the greatest price below each pair of nodes is
kept, and the best terms are drawn by going down to the greatest first.

Blocks are tasks of a bounded size: at most BLOCK terms by 2 x TILE groups, as groups of a
language are dealt into tiles and every two tiles meet. A source that holds a third of all
rows, or a term that all have, is still one number in its cell: texts are counted within their
batch, then before the shuffle, then after it.

Defined results: null text, language and source count as empty texts. Each row is a document,
repeated ids included. A group without kept terms, or of a language that keeps none, has pair
rows of value 0 (or what its smoothed shares give) and no term rows. A language with one
source has no pair rows. Equal values rank by the item's bytes. An empty table gives an empty
result. Texts may be of any length. Other columns are not touched.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm._shared import stored

#: What separates terms: all ASCII but letters.
NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS = 10
UNIT, SMOOTHING, TOP = 1_000_000_000, 2, 10
#: Terms of a block (the leaves of a tree, a power of two), and groups of a tile.
BLOCK, TILE = 4096, 32


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and the rows with one; term is null for a
    group's documents as such, so that groups without terms are there as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        for batch in batches:
            if not batch.num_rows:
                continue
            words = pc.split_pattern_regex(pc.ascii_lower(batch.column(2)), NO_TERM)
            flat = words.flatten()
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
            some = pc.not_equal(flat, "")
            flat, row = flat.filter(some), row[some.to_numpy(zero_copy_only=False)]
            coded = flat.dictionary_encode()
            term, terms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(coded.dictionary), 1)
            # a group's number stands above the term's
            pairs = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], names=["lang", "source"])
            both = pc.binary_join_element_wise(pc.cast(pc.binary_length(batch.column(0)), pa.string()), pc.binary_join_element_wise(batch.column(0), batch.column(1), ""), ":")
            names = both.dictionary_encode()
            group = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            _, first = np.unique(group, return_index=True)
            each, times = np.unique(row * terms + term, return_counts=True)
            key, back = np.unique(group[each // terms] * terms + each % terms, return_inverse=True)
            n, docs_with = np.zeros(len(key), np.int64), np.bincount(back, minlength=len(key))
            np.add.at(n, back, times)
            of = pairs.take(pa.array(np.concatenate([first[key // terms], first])))
            text = pa.concat_arrays([coded.dictionary.take(pa.array(key % terms)), pa.nulls(len(first), pa.string())])
            n, docs_with = np.concatenate([n, np.zeros(len(first), np.int64)]), np.concatenate([docs_with, np.bincount(group)])
            yield pa.RecordBatch.from_arrays([of.field(0), of.field(1), text, pa.array(n), pa.array(docs_with, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    given = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    found = given.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def placed(terms: DataFrame) -> DataFrame:
    """terms (lang, term, n, docs) with block and at: a block holds up to BLOCK terms of a
    language that are near each other in number of documents, at is the place of the term's
    text among the block's. No order of all terms is needed: each range of the sort is cut
    into blocks of its own."""
    ranged = terms.repartitionByRange("lang", F.col("docs").desc(), "term").sortWithinPartitions("lang", F.col("docs").desc(), "term")
    # the id is the range's number above the row's number in the range
    numbered = stored(ranged.withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK)), "divergence-terms")
    return numbered.withColumn("at", F.row_number().over(W.partitionBy("lang", "block").orderBy("term")) - 1)


def consed(leaves):
    """Hash-consed trees over the rows of leaves (trees, BLOCK): levels from the leaves up, each
    (left, right) by node (for the leaves: their values, None), and the trees' roots."""
    import numpy as np

    values, ids = np.unique(leaves, return_inverse=True)
    levels, ids = [(values, None)], ids.reshape(leaves.shape)
    while ids.shape[1] > 1:
        left, right = ids[:, ::2], ids[:, 1::2]
        span = int(ids.max()) + 1
        nodes, new = np.unique(left.astype(np.int64) * span + right, return_inverse=True)
        levels.append((nodes // span, nodes % span))
        ids = new.reshape(left.shape)
    return levels, ids[:, 0]


def met(levels, a, b, tag):
    """Goes down two trees at once, for each i from the roots a[i] and b[i]: for each level, from
    the leaves up, (tag, left node, right node, below left, below right), every pair of nodes of
    one tag once; below: the places of its children in the level below. Also the places of
    the pairs that were asked."""
    import numpy as np

    def once(t, x, y, nodes):
        key, back = np.unique((t * nodes + x) * nodes + y, return_inverse=True)
        return key // nodes // nodes, key // nodes % nodes, key % nodes, back

    t, x, y, asked = once(tag.astype(np.int64), a.astype(np.int64), b.astype(np.int64), len(levels[-1][0]))
    out = []
    for k in range(len(levels) - 1, 0, -1):
        left, right = levels[k]
        t2, x2, y2, back = once(np.concatenate([t, t]), np.concatenate([left[x], right[x]]), np.concatenate([left[y], right[y]]), len(levels[k - 1][0]))
        out.append((t, x, y, back[: len(t)], back[len(t) :]))
        t, x, y = t2, x2, y2
    out.append((t, x, y, None, None))
    return out[::-1], asked


def share(count, total, terms):
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), exactly. Where a long can't hold the
    product, Python's integers do the work."""
    import numpy as np

    over = np.maximum(total + SMOOTHING * terms, 1)
    if len(count) == 0 or int(count.max()) + SMOOTHING < (1 << 63) // UNIT:
        return 1 + UNIT * (count + SMOOTHING) // over
    return np.array([1 + UNIT * (int(c) + SMOOTHING) // int(n) for c, n in zip(count, over, strict=True)], np.int64)


def price(p, q):
    return (p - q) ** 2 // (p + q)


def block_rows(cells: dict, totals: dict, terms: int, size: int, tiles: tuple[int, int]):
    """Of one block and two tiles: [(source, other, value)] and [(source, at, value)]. cells:
    {group: (places, counts)}; totals: {group: (tile, N)}; group None is the language."""
    import numpy as np

    names = sorted((x for x in totals if x is not None), key=lambda x: (totals[x][0], x))
    whole = [None] if None in totals else []
    leaves = np.zeros((len(names) + len(whole), BLOCK), np.int64)
    leaves[:, size:] = -1  # no term
    for i, name in enumerate([*names, *whole]):
        if name in cells:
            at, n = cells[name]
            leaves[i, at] = n
    levels, roots = consed(leaves)
    tile = np.array([totals[x][0] for x in names])
    total = np.array([totals[x][1] for x in [*names, *whole]], np.int64)
    counts = levels[0][0]

    i, j = np.nonzero((tile[:, None] == tiles[0]) & (tile[None, :] == tiles[1]))
    i, j = (i[i < j], j[i < j]) if tiles[0] == tiles[1] else (i, j)
    pairs = []
    # at most so many pairs at a time, so that memory has a bound
    for k in range(0, len(i), 128):
        a, b = i[k : k + 128], j[k : k + 128]
        down, asked = met(levels, roots[a], roots[b], np.arange(len(a)))
        t, x, y, _, _ = down[0]
        value = price(share(counts[x], total[a[t]], terms), share(counts[y], total[b[t]], terms))
        value[counts[x] < 0] = 0
        for _, _, _, left, right in down[1:]:
            value = value[left] + value[right]
        pairs += zip([names[m] for m in a], [names[m] for m in b], value[asked].tolist(), strict=True)

    best = []
    if whole:
        n = len(names)
        down, asked = met(levels, roots[:n], np.repeat(roots[n], n), np.arange(n))
        t, x, y, _, _ = down[0]
        p, q = share(counts[x], total[t], terms), share(counts[y], np.repeat(total[n], len(t)), terms)
        values = [np.where((counts[x] > 0) & (p > q), price(p, q), -1)]
        for _, _, _, left, right in down[1:]:
            values.append(np.maximum(values[-1][left], values[-1][right]))
        for name, root in zip(names, asked.tolist(), strict=True):
            # greatest first, of equal ones the first place; a pair of nodes starts at `at`
            heap, left_to_find = [(-int(values[-1][root]), 0, len(down) - 1, root)], TOP
            while heap and left_to_find:
                v, at, k, node = heapq.heappop(heap)
                if v == 1:
                    break
                if k == 0:
                    best.append((name, at, -v))
                    left_to_find -= 1
                    continue
                for child, start in ((down[k][3][node], at), (down[k][4][node], at + (1 << (k - 1)))):
                    heapq.heappush(heap, (-int(values[k - 1][child]), start, k - 1, int(child)))
    return pairs, best


def audited(table: pa.Table) -> pa.Table:
    """block_rows for a group (lang, block, tile_a, tile_b) of a table (lang, block, tile_a,
    tile_b, source, tile, total, terms, size, at, n); source is null for the language."""
    import numpy as np

    first = table.slice(0, 1).to_pylist()[0]
    cells, totals = {}, {}
    for i, (source, tile, total) in enumerate(zip(table["source"].to_pylist(), table["tile"].to_pylist(), table["total"].to_pylist(), strict=True)):
        totals[source] = (tile, total)
        at, n = table["at"][i].values, table["n"][i].values
        if at is not None and len(at):
            cells[source] = (at.to_numpy(), n.to_numpy(zero_copy_only=False).astype(np.int64))
    pairs, best = block_rows(cells, totals, first["terms"], first["size"], (first["tile_a"], first["tile_b"]))
    n = len(pairs) + len(best)
    return pa.table(
        {
            "lang": pa.array([first["lang"]] * n, pa.string()),
            "block": pa.array([first["block"]] * n, pa.int64()),
            "source": pa.array([x[0] for x in pairs] + [x[0] for x in best], pa.string()),
            "other": pa.array([x[1] for x in pairs] + [None] * len(best), pa.string()),
            "at": pa.array([None] * len(pairs) + [x[1] for x in best], pa.int32()),
            "value": pa.array([x[2] for x in pairs] + [x[2] for x in best], pa.int64()),
        }
    )


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank)."""
    counts = stored(term_counts(docs, text_col, lang_col, source_col), "divergence-counts")
    groups = counts.where("term is null").select("lang", "source")
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vocabulary = stored(placed(terms.where(F.col("docs") >= LEAST_DOCUMENTS)), "divergence-vocabulary")
    blocks = vocabulary.groupBy("lang", "block").agg(F.count("*").cast("int").alias("size"))
    sizes = blocks.groupBy("lang").agg(F.sum("size").alias("terms"))

    # cells of a group in a block: at most BLOCK
    kept = counts.where("term is not null").join(vocabulary.select("lang", "term", "block", "at"), ["lang", "term"])
    cell = F.struct("at", "n")
    own = stored(kept.groupBy("lang", "block", "source").agg(F.sort_array(F.collect_list(cell)).alias("cells")), "divergence-cells")
    whole = vocabulary.groupBy("lang", "block").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    added = F.aggregate("cells", F.lit(0).cast("long"), lambda n, c: n + c["n"])
    total = own.groupBy("lang", "source").agg(F.sum(added).alias("total"))
    named = groups.join(total, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "terms"])
    numbered = named.withColumn("tile", F.floor((F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1) / TILE).cast("int"))
    named = stored(numbered, "divergence-groups")
    tiles = named.groupBy("lang").agg(F.max("tile").alias("last"), F.sum("total").alias("total"), F.max("terms").alias("terms"))

    every = F.sequence(F.lit(0), F.col("last"))
    here = named.join(tiles.select("lang", "last"), "lang").join(blocks, "lang").join(own, ["lang", "block", "source"], "left")
    here = here.withColumn("with", F.explode(every)).select(
        "lang", "block", F.least("tile", "with").alias("tile_a"), F.greatest("tile", "with").alias("tile_b"), "source", "tile", "total", "terms", "size", "cells"
    )
    of_lang = whole.join(blocks, ["lang", "block"]).join(tiles, "lang").withColumn("tile_a", F.explode(every))
    of_lang = of_lang.select("lang", "block", "tile_a", F.col("tile_a").alias("tile_b"), F.lit(None).cast("string").alias("source"), F.lit(-1).alias("tile"), "total", "terms", "size", "cells")
    given = here.unionByName(of_lang).select("*", F.col("cells.at").alias("at"), F.col("cells.n").alias("n")).drop("cells")
    kind = "lang string, block long, source string, other string, at int, value long"
    found = stored(given.groupBy("lang", "block", "tile_a", "tile_b").applyInArrow(audited, kind), "divergence-found")

    priced = found.where("other is not null").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"))))
    pairs = priced.select("lang", "value", ends.alias("e")).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    # a language that keeps no terms has no blocks: its pairs are of value 0
    bare = named.where("terms = 0").select("lang", "source")
    others = bare.select("lang", F.col("source").alias("item"))
    none = bare.join(others, "lang").where("source != item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.unionByName(none).withColumn("rank", F.row_number().over(order))
    best = found.where("other is null").join(vocabulary.select("lang", "block", "at", F.col("term").alias("item")), ["lang", "block", "at"])
    best = best.select("lang", "source", F.lit("term").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return pairs.unionByName(best)
