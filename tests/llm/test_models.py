"""Vector codes, toxicity and source divergence against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest


def _codes(rows):
    """(vec_id, code, error, label_error) by hand for rows (vec_id, vector, label), and the digest."""
    fine = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(x * 1024) for x in r[1]] for r in fine]
    w = len(ints[0]) // 4
    cut = lambda v, k: v[k * w : (k + 1) * w]
    books = [[cut(v, k) for v in ints[:256]] for k in range(4)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(4):
        for k in range(4):
            of = defaultdict(list)
            for v in ints:
                of[near(cut(v, k), books[k])[1]].append(cut(v, k))
            books[k] = [[sum(x) // len(of[e]) for x in zip(*of[e], strict=True)] if e in of else c for e, c in enumerate(books[k])]
    out, by_label = [], Counter()
    for r, v in zip(fine, ints, strict=True):
        best = [near(cut(v, k), books[k]) for k in range(4)]
        out.append((r[0], "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), r[2]))
        by_label[r[2]] += out[-1][2]
    return sorted((i or -1, c, d, by_label[label]) for i, c, d, label in out), hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


@pytest.mark.parametrize("n", [5, 300])
def test_vector_codes(spark, n):
    from corpusloom.llm.vector_codes import compress

    rng = random.Random(n)
    rows = [(i * 7 % 997, [rng.gauss(0, 1 + i % 3) for _ in range(8)], i % 4 or None) for i in range(n)]
    rows += [rows[0], (rows[1][0], rows[2][1], 1), (None, rows[3][1], 2), (1001, [0.5] * 8, 1), (1002, [0.5] * 8, 1)]
    rows += [(2001, None, 1), (2002, [*rows[0][1][:7], None], 1), (2003, [*rows[0][1][:7], float("nan")], 1), (2004, [*rows[0][1][:7], float("-inf")], 3)]
    vectors = spark.createDataFrame([(*r, "v", "c", 1) for r in rows], "vec_id long, embedding array<double>, label int, v string, code string, error int")
    got = compress(vectors).collect()
    want, digest = _codes(rows)
    assert sorted((r.vec_id or -1, r.code, r.error, r.label_error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_vector_codes_of_odd_tables(spark):
    from corpusloom.llm.vector_codes import compress

    kind = "vec_id long, embedding array<float>, label int"
    assert compress(spark.createDataFrame([], kind)).count() == 0
    got = {r.vec_id: (r.code, r.error) for r in compress(spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 4, 1), (3, [], None)], kind)).collect()}
    assert got == {1: ("00000000", 0), 2: (None, None), 3: (None, None)}
    got = compress(spark.createDataFrame([(1, [1.0] * 6, 1)], kind)).collect()
    assert [(r.code, r.codebooks_sha256) for r in got] == [(None, hashlib.sha256(b"").hexdigest())]
    with pytest.raises(Exception, match="after scaling"):
        compress(spark.createDataFrame([(1, [1e9] * 8, 1)], kind)).count()


@pytest.mark.parametrize("top", [5, 1 << 12, (1 << 29) - 1])
def test_dots_are_exact(top):
    import numpy as np

    from corpusloom.llm.vector_codes import dots, limbs, nearest

    rng = np.random.default_rng(top)
    x, c = rng.integers(-top, top + 1, (40, 19)), rng.integers(-top, top + 1, (30, 19))
    x[0], c[0] = top, -top
    assert (dots(x, c).astype(object) == x.astype(object) @ c.T.astype(object)).all()
    for bits in (3, 24):
        assert (sum(v.astype(np.int64) << (i * bits) for i, v in enumerate(limbs(x, bits))) == x).all()
    at, far = nearest(np.vstack([x, c[:2]]), np.vstack([c, c]))
    assert (at < 30).all() and far[-2:].tolist() == [0, 0]


def _divergence(rows, least, top):
    docs = [(lang or "", source or "", [w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(w for d in mine for w in set(d[2]))
        kept = {w for w, n in df.items() if n >= least}
        groups = defaultdict(Counter)
        for _, s, words in mine:
            groups[s].update(w for w in words if w in kept)
        whole = sum(groups.values(), Counter())
        p = lambda c, w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in groups.items():
            pairs = [(-sum(f(p(c, w), p(o, w)) for w in kept), t) for t, o in groups.items() if t != s]
            terms = [(-f(p(c, w), p(whole, w)), w) for w in kept if c[w] and p(c, w) > p(whole, w)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize("tile", [2, 32])
def test_source_divergence(spark, monkeypatch, tile):
    from corpusloom.llm import source_divergence as module

    monkeypatch.setattr(module, "TILE", tile)
    monkeypatch.setattr(module, "LEAST_DOCUMENTS", 2)
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("Wo", "ä", "şü", "x y") for b in ("", "a", "B", "ц", "é")]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "é", "ab", None]), " ".join(rng.choices(words, k=rng.randrange(30))) + "_1\x7f2-") for _ in range(90)]
    rows += [rows[0], ("fr", "only", "un deux"), ("fr", "other", None), ("it", "one", "uno uno"), ("it", "one", "uno"), ("en", "none", ""), ("en", "all", "the " * 3000 + "\x00")]
    docs = spark.createDataFrame([(*r, 1, "t", "n") for r in rows], "lang string, source string, text string, n int, term string, total string")
    got = sorted(tuple(r) for r in module.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == _divergence(rows, 2, 10)
    assert module.audit(docs.limit(0)).count() == 0


def test_trees_share_nodes_and_price_each_pair_once():
    import numpy as np

    from corpusloom.llm.source_divergence import BLOCK, block_rows, consed, met, price, share

    rng = random.Random(5)
    size = 3000
    counts = {g: {at: rng.choice([1, 1, 2, 5, 90]) for at in rng.sample(range(size), n)} for g, n in (("a", 10), ("b", 900), ("c", 900), ("d", 0))}
    counts["c"] = counts["b"]
    counts[None] = Counter()
    for c in [c for g, c in counts.items() if g]:
        counts[None].update(c)
    cells = {g: (np.array(sorted(c), np.int64), np.array([c[x] for x in sorted(c)], np.int64)) for g, c in counts.items() if c}
    totals = {g: (0 if g else -1, sum(c.values())) for g, c in counts.items()}
    pairs, best = block_rows(cells, totals, size, size, (0, 0))
    p = lambda g, at: 1 + 10**9 * (counts[g].get(at, 0) + 2) // (totals[g][1] + 2 * size)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    assert {(a, b): v for a, b, v in pairs} == {(a, b): sum(f(p(a, at), p(b, at)) for at in range(size)) for a in "abcd" for b in "abcd" if a < b}
    for g in "abcd":
        want = sorted((-f(p(g, at), p(None, at)), at) for at in counts[g] if p(g, at) > p(None, at))[:10]
        assert [(-v, at) for s, at, v in best if s == g] == want
    leaves = np.zeros((3, BLOCK), np.int64)
    leaves[0, 7] = leaves[1, 7] = 4
    levels, roots = consed(leaves)
    assert roots[0] == roots[1] != roots[2] and [len(x[0]) for x in levels] == [2] * 13
    down, asked = met(levels, roots[:2], roots[1:], np.zeros(2, int))
    assert sum(len(x[0]) for x in down) <= 13 * 4 and asked.tolist() != [0, 0]
    many = np.array([(1 << 62) // 3, 5])
    assert share(many, np.array([1 << 62, 1 << 62]), 7).tolist() == [1 + 10**9 * (int(c) + 2) // ((1 << 62) + 14) for c in many]
    assert price(np.array([10**9 + 1]), np.array([1])).tolist() == [10**18 // (10**9 + 2)]


SYLLABLES = "ra no ti lem os du ke vi sta gor pel mun".split()


def _labelled(n, seed=1):
    """(doc_id, text, toxic): toxic ones hold forms of two stems among words that all share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(SYLLABLES, k=rng.randrange(1, 4)))
    out = []
    for i in range(n):
        words, bad = [word() for _ in range(rng.randrange(20, 90))], i % 5 == 0
        for _ in range(len(words) // 12 if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["Zwuxar", "blikhof"]) + rng.choice(SYLLABLES)
        out.append((i, " ".join(words) + ".", int(bad)))
    return out


def _kneser_ney(words):
    """{word: log-ratio} as a function, from {word: (toxic, ordinary)}, by loops over grams."""
    def cut(w):
        s = "\x02" + w + "\x03"
        return [(s[max(0, i - 7) : i], s[i]) for i in range(1, len(s))]

    table = defaultdict(lambda: [0, 0])
    for w, n in words.items():
        for g in cut(w):
            for c in (0, 1):
                table[g][c] += n[c]

    def discount(v):
        ones, twos = sum(x == 1 for x in v), sum(x == 2 for x in v)
        return ones / (ones + 2 * twos) if ones else 0.5

    d, every = [discount([v[c] for v in table.values()]) for c in (0, 1)], discount([sum(v) for v in table.values()])
    low = Counter((h[-2:], x) for h, x in table)
    least, alone = discount(low.values()), Counter(x for _, x in low)
    low_sum, low_kinds, sums, kinds = Counter(), Counter(), defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (h, _), n in low.items():
        low_sum[h] += n
        low_kinds[h] += 1
    for (h, _), v in table.items():
        for c in (0, 1):
            sums[h][c] += v[c]
            kinds[h][c] += v[c] > 0
    all_kinds = Counter(h for h, _ in table)

    def ratio(w):
        total = 0.0
        for h, x in cut(w):
            v = table.get((h, x), [0, 0])
            spare = [d[c] * kinds[h][c] + 1 for c in (0, 1)] if h in sums else None
            if sum(v) >= 2:
                p = (low[h[-2:], x] - least + least * low_kinds[h[-2:]] * alone[x] / len(low)) / low_sum[h[-2:]]
                p = (max(sum(v) - every, 0) + every * all_kinds[h] * p) / sum(sums[h])
                q = [(max(v[c] - d[c], 0) + spare[c] * p) / (sums[h][c] + 1) for c in (0, 1)]
                total += math.log(q[0] / q[1])
            elif spare and sum(sums[h]) >= 2:
                total += math.log(spare[0] / (sums[h][0] + 1) / (spare[1] / (sums[h][1] + 1)))
        return total

    return ratio


def _words(text):
    return {w for w in re.split(r"[\W_]+", (text or "").lower()) if w}


def _by_hand(rows, labels):
    """{doc_id: x} of the method by hand."""
    crc = lambda i: zlib.crc32(str(i).encode())
    words = defaultdict(lambda: [0, 0])
    for i, text in rows:
        if i in labels and crc(i) % 5 and crc(i) // 5 % 5:
            for w in _words(text):
                words[w][1 - labels[i]] += 1
    first = _kneser_ney(words)
    again = {w: (n[0], n[1]) if first(w) + math.log(0.01 / 0.99) > 0 else (0, sum(n)) for w, n in words.items()}
    second = _kneser_ney(again)
    out = {}
    for i, text in rows:
        s = [math.log(0.99 + 0.01 * math.exp(second(w))) for w in _words(text)]
        out[i] = sum(s) / math.sqrt(max(len(s), 1))
    return out


def _frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 1.0, "w") for i, t in rows], "doc_id long, text string, lang string, source string, x double, word string")
    return docs


@pytest.mark.parametrize("most", [8_000_000, 0])
def test_toxicity_by_hand(spark, monkeypatch, most):
    from pyspark.sql import functions as F

    from corpusloom.llm import toxicity

    monkeypatch.setattr(toxicity, "BROADCAST_GRAMS", most)
    made = _labelled(150)
    labels = {i: t for i, _, t in made}
    rows = [*[(i, t) for i, t, _ in made], (1000, None), (1001, ""), (1002, "... !"), (1003, "Zwuxarno zwuxarlem"), (1004, "x" * 3000)]
    docs = _frames(spark, rows)
    labelled = docs.join(spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"), "doc_id").where(~toxicity.held_out(F.col("doc_id")) & ~toxicity.tuning(F.col("doc_id")))
    model = toxicity.train(labelled)
    got = {r.doc_id: r.x for r in toxicity.statistic(docs.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id"), model, toxicity.arrays(model)).collect()}
    want = _by_hand(rows, labels)
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-3 for i in want)


def test_toxicity_held_out(spark):
    from corpusloom.llm.toxicity import score

    made = _labelled(600, 2)
    rows = [*[(i, t) for i, t, _ in made], (None, "x"), (9000, None), (9001, "")]
    docs = _frames(spark, rows)
    labels = spark.createDataFrame([*[(i, 0, t) for i, _, t in made], (1, 0, 1), (None, 0, 1), (77777, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in score(docs, labels).collect()}
    assert len(got) == len(rows) and not got[None].held_out
    out = [(got[i].predicted, t) for i, _, t in made if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    assert sum(p == t for p, t in out) >= 0.97 * len(out) and got[9000].score == got[9001].score < 0.5
    # labels of held-out rows change nothing
    other = spark.createDataFrame([(i, 0, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, _, t in made], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in score(docs, other).collect()}
    assert all(again[i] == got[i].score for i in got)


def test_toxicity_without_labels(spark):
    from corpusloom.llm.toxicity import score

    docs = _frames(spark, [(2, "a b"), (3, None), (3, None)])
    kind = "doc_id long, toxic int"
    assert [r.score for r in score(docs, spark.createDataFrame([], kind)).collect()] == [0.0] * 3
    assert {r.score for r in score(docs, spark.createDataFrame([(2, 1), (3, 1)], kind)).collect()} <= {0.0, 1.0}
    assert score(docs.limit(0), spark.createDataFrame([(2, 1)], kind)).count() == 0
