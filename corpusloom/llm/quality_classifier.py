"""A quality classifier of sparse rules.

Shallow boosted trees are grown on statistics of labelled texts; each path of a tree is a
conjunctive rule. A logistic regression with a lasso penalty weighs the rules and drops most
of them. What remains is compiled to one Spark column expression, so scoring is a projection
of the documents, with no model to ship and no Python on the executors.

It learns from at most MAX_TRAIN labelled rows (the first by a hash of the id); the
statistics of texts, and scores, are of whole texts and of all documents. Null and empty texts
have statistics of zero and get a score like all others. If labels are of one kind or there
are none, the score is their share (or 0.5). Labels that disagree about an id count as the
lower. Repeated rows are scored each; labels of ids without a document are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.quality_rules import judge
from corpusloom.llm.trees import cuts, grow, paths, predict

MAX_TRAIN = 20_000
TREES, DEPTH, STEP = 40, 3, 0.3
#: The lasso's weight, as a share of the least that drops every rule.
LASSO = 0.01

FEATURES = (
    "words",
    "word_length",
    "symbols",
    "marks",
    "capitals",
    "digits",
    "stops",
    "dup_lines",
    "repeats",
    "distinct",
    "line_words",
    "lines_removed",
)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a column _x_<feature> for each statistic."""
    df = judge(docs, text_col).withColumn("_raw", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    df = df.withColumn("_distinct", F.size(F.array_distinct(F.split(F.lower("_raw"), r"[\x20\x09-\x0D]+"))))
    df = df.withColumn("_chars", F.greatest(F.length("_raw"), F.lit(1))).withColumn("_n", F.greatest(F.col("n_words"), F.lit(1)))
    df = df.withColumn("_n_lines", F.regexp_count("_raw", F.lit("\n")) + 1)

    def share(of: Column | str, over: str) -> Column:
        return (F.col(of) if isinstance(of, str) else of).cast("double") / F.col(over)

    values = {
        "words": F.log1p("n_words"),
        "word_length": share("word_chars", "_n"),
        "symbols": share("n_symbols", "_n"),
        "marks": share(F.regexp_count("_raw", F.lit(r"[^\p{L}\p{N}\s.,]")), "_n"),
        "capitals": share(F.regexp_count("_raw", F.lit(r"\p{Lu}")), "_n"),
        "digits": share(F.regexp_count("_raw", F.lit("[0-9]")), "_n"),
        "stops": share(F.regexp_count("_raw", F.lit("[.!?]")), "_n"),
        "dup_lines": share("n_dup_lines", "_n_lines"),
        "repeats": share("n_repeat_words", "_n"),
        "distinct": share("_distinct", "_n"),
        "line_words": share("n_words", "_n_lines"),
        "lines_removed": share("n_lines_removed", "_n_lines"),
    }
    return df.withColumns({f"_x_{k}": values[k] for k in FEATURES})


def lasso_logistic(r, y, penalty: float, rounds: int = 400):
    """Weights of the rules (columns of zeros and ones) and an intercept, by accelerated
    proximal gradient steps; the intercept isn't penalised."""
    import numpy as np

    centre = r.mean(axis=0)
    a = r - centre
    bound = 0.25 * (np.linalg.norm(a, 2) ** 2 / len(y) + 1)
    w, b = np.zeros(a.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    most = np.abs(a.T @ (y - y.mean())).max() / len(y)
    v, c, t = w, b, 1.0
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-np.clip(a @ v + c, -30, 30))) - y
        new = v - a.T @ g / len(y) / bound
        new = np.sign(new) * np.maximum(np.abs(new) - penalty * most / bound, 0)
        new_b = c - g.mean() / bound
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new + (t - 1) / s * (new - w), new_b + (t - 1) / s * (new_b - b)
        w, b, t = new, new_b, s
    return w, b - float(centre @ w)


def fit(x, y, seed: int = 7) -> tuple[list[tuple[tuple, float]], float]:
    """([(rule, weight)], intercept) from statistics and labels of 0 and 1."""
    import numpy as np

    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return [], float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    rng, thresholds = np.random.default_rng(seed), cuts(x)
    score, rules = np.zeros(len(y)), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = grow(x, (y - p) / np.maximum(p * (1 - p), 1e-3), np.maximum(p * (1 - p), 1e-3), thresholds, DEPTH, max(3, x.shape[1] // 2), rng)
        score = np.clip(score + STEP * predict(tree, x), -8, 8)
        rules |= dict.fromkeys(paths(tree))
    known: dict[bytes, tuple] = {}
    for rule in rules:  # rules that hold for the same rows are one
        hold = np.logical_and.reduce([(x[:, f] <= at) == low for f, low, at in rule])
        if 0 < hold.sum() < len(y):
            known.setdefault(hold.tobytes(), rule)
    r = np.array([np.frombuffer(k, bool) for k in known], float).T
    w, b = lasso_logistic(r, y, LASSO)
    return [(rule, float(v)) for rule, v in zip(known.values(), w, strict=True) if v], b


def compiled(rules: list[tuple[tuple, float]], intercept: float) -> Column:
    """The score as one expression of the columns _x_<feature>."""
    total = F.lit(intercept)
    for rule, weight in rules:
        hold = F.lit(True)
        for f, low, at in rule:
            x = F.col(f"_x_{FEATURES[f]}")
            hold = hold & (x <= F.lit(at) if low else x > F.lit(at))
        total = total + F.when(hold, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[tuple, float]], float]:
    import numpy as np

    known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # at most MAX_TRAIN short rows, so a broadcast of bounded size
    known = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN))
    rows = statistics(docs.select("doc_id", "text").join(known, "doc_id")).select("doc_id", "quality", *[f"_x_{k}" for k in FEATURES])
    table = rows.orderBy(F.xxhash64("doc_id"), *rows.columns).limit(MAX_TRAIN).toArrow()
    x = np.stack([table[f"_x_{k}"].to_numpy() for k in FEATURES], axis=1) if len(table) else np.zeros((0, len(FEATURES)))
    return fit(x, table["quality"].to_numpy().astype(float) if len(table) else np.zeros(0))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    out = statistics(docs.select("doc_id", "text")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), compiled(*train(docs, labels)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
