"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.decontamination import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.html_text import extract

    return extract(_table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.quality_classifier import score

    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.token_counts import length_histogram, suffix_sums

    return suffix_sums(length_histogram(_table(spark, sf_dir, "documents")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.quality_rules import judge

    return judge(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed"
    )


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm._shared import new_path
    from corpusloom.llm.training_order import read, write

    folder = new_path(spark, "training-order")
    if not write(_table(spark, sf_dir, "documents"), folder):
        return spark.createDataFrame([], "slot long, shard long, doc_id long, part int, n_tokens int, ids_crc32 long")
    return read(spark, folder, with_ids=False)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.secret_scan import scan

    return scan(_table(spark, sf_dir, "documents"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.simhash_dedup import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.line_dedup import dedup

    return dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.vector_codes import compress

    return compress(_table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.toxicity import score

    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.source_divergence import audit

    return audit(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def _count(pattern: str) -> str:
    return f"length(x) - length(regexp_replace(x, '{pattern}', '', 'g'))"


def _op6_sql() -> str:
    from corpusloom.llm.quality_rules import BOILERPLATE, MOST_LOST

    word = r"[^\x20\x09-\x0D]+"
    fails = (
        f"(({_count('[|»›→•·]')}) * 4 > n + 4 OR ({_count(chr(91) + '#*$%&|<>{}' + chr(92) * 2 + '^~=_]')}) * 10 > c OR ({_count('[!?]')}) * 2 > n + 2) "
        f"OR ({_count(r'[^' + chr(92) + 'p{L}' + chr(92) + 's]')}) * 2 > c - n "
        f"OR (n >= 4 AND ({_count(chr(92) + 'p{Lu}')}) * 2 > c - n) "
        "OR (n >= 10 AND len(list_distinct(w)) * 4 < n) "
        "OR (n >= 40 AND NOT regexp_matches(x, '[.,;:!?…。]')) "
        f"OR (n <= 12 AND regexp_matches(lower(x), '{BOILERPLATE}'))"
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS words FROM documents),
windows AS (SELECT doc_id, i, concat_ws(' ', words[i], words[i + 1], words[i + 2]) AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
l AS (SELECT doc_id, x, length(x) AS c, regexp_extract_all(x, '{word}') AS w FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)),
f AS (SELECT doc_id, x, c, n, n > 0 AND ({fails}) AS failed FROM (SELECT *, len(w) AS n FROM l)),
g AS (SELECT doc_id, count(*) FILTER (WHERE n > 0) - count(DISTINCT x) FILTER (WHERE n > 0) AS dups, count(*) FILTER (WHERE failed) AS removed,
  coalesce(sum(c) FILTER (WHERE failed), 0) - CASE WHEN bool_and(failed) THEN 1 ELSE 0 END AS lost FROM f GROUP BY 1),
o AS (SELECT doc_id, t, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  dups AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, removed, lost FROM d JOIN g USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= CAST({MOST_LOST} AS DOUBLE) * length(t) AS kept, removed AS n_lines_removed FROM o
"""


def _op11_sql() -> str:
    """Rounds as common table expressions. Dot products are of doubles, exact for integers this
    small."""
    norm = "list_inner_product({0}, {0})".format
    nearest = (
        "SELECT p.r, p.k, any_value(p.x) AS x, min({{'d': p.n - 2 * list_inner_product(p.x, b.c) + b.n, 'e': b.e}}) AS best "
        "FROM parts p JOIN book{0} b USING (k) GROUP BY 1, 2"
    ).format
    ctes = [
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024.0 * x::DOUBLE)) AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT *, {norm('x')} AS n FROM (SELECT r, k, v[k * (len(v) // 4) + 1:(k + 1) * (len(v) // 4)] AS x FROM kept, range(4) AS t(k)))",
        "book0 AS MATERIALIZED (SELECT k, r - 1 AS e, x AS c, n FROM parts WHERE r <= 256)",
    ]
    for i in range(4):
        ctes += [
            f"assigned{i} AS MATERIALIZED ({nearest(i)})",
            f"means{i} AS (SELECT k, e, list(m ORDER BY i) AS c FROM (SELECT k, best.e AS e, i, floor(sum(x[i]) / count(*)) AS m FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM assigned{i}) GROUP BY 1, 2, 3) GROUP BY 1, 2)",
            f"book{i + 1} AS MATERIALIZED (SELECT *, {norm('c')} AS n FROM (SELECT k, e, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN means{i} m USING (k, e)))",
        ]
    ctes += [
        f"final AS ({nearest(4)})",
        "codes AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY k) AS code, sum(best.d)::BIGINT AS error FROM final GROUP BY 1)",
        "told AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY k, e)) AS s FROM book4)",
    ]
    return (
        f"WITH {', '.join(ctes)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 "
        "FROM kept JOIN codes USING (r), told"
    )


def _op13_sql() -> str:
    from corpusloom.llm.source_divergence import LEAST_DOCUMENTS, SMOOTHING, TOP, UNIT

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    share = f"1 + ({UNIT}::HUGEINT * ({{}} + {SMOOTHING})) // ({{}} + {SMOOTHING} * v)".format
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT id, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{upper}', '{upper.lower()}') AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS whole FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= {LEAST_DOCUMENTS}),
langs AS (SELECT lang, count(*) AS v, sum(whole) AS n FROM kept GROUP BY 1),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS k FROM w GROUP BY 1, 2, 3),
grid AS MATERIALIZED (SELECT g.lang, g.source, kept.term, whole, coalesce(k, 0) AS k, sum(coalesce(k, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM groups g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
s AS MATERIALIZED (SELECT grid.*, {share('k', 'total')} AS p, {share('whole', 'n')} AS q FROM grid JOIN langs USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY 1, 2, 3),
found AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups g JOIN groups o ON o.lang = g.lang AND o.source != g.source LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = o.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM s WHERE k > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM found QUALIFY part = 'pair' OR rank <= {TOP}
"""


def oracle_sql() -> dict[str, str]:
    """SQL has neither XXH64 nor the vocabulary's ids, nor trees of elements or alignments in
    bands: the other queries are held against brute force in the tests."""
    return {"op6_quality_rules": _op6_sql(), "op11_vector_codes": _op11_sql(), "op13_source_divergence": _op13_sql()}
