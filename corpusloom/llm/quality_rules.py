"""Line-first cleaning with DataFrame functions alone.

Each line is judged by rules of punctuation, navigation and boilerplate; lines that fail are
removed, and a document that loses too much of its text is rejected. Counts over the whole
text (words, symbols, repeated lines, repeated windows of three words) stand beside them, with
base limits that reject a document whatever its lines are.

Everything is computed within a row, so no row is shuffled and no text meets another. Null
texts count as without words. An empty text fails the base limits. Lines without a word are
neither kept nor lost. Repeated rows are judged each. The functions read the column text;
judge() puts its columns beside those given, in the place of any of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._shared import kept_rows

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: At most this share of a kept document's characters may stand in lines that fail.
MOST_LOST = 0.3

#: Phrases of boilerplate, any of which marks a short line.
BOILERPLATE = (
    "all rights reserved|cookie policy|we use cookies|accept cookies|privacy policy|terms of (?:use|service)|"
    "enable javascript|javascript is (?:disabled|required)|lorem ipsum|click here|read more|subscribe (?:to|now)|"
    "sign (?:up|in)|log ?in|share (?:this|on)|follow us|skip to (?:main )?content|back to top|powered by|page not found|"
    "tous droits réservés|alle rechte vorbehalten|todos los derechos reservados"
)


def words_of(text: Column) -> Column:
    """The runs of characters that aren't one of six ASCII white spaces; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def with_repeats(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds how many words stand in a window of three that occurs twice or more in the row.

    Windows are compared by 64 bits of hash. Equal ones lie side by side once sorted, so the
    work is n log n, however many repeat; places that are covered twice count once."""
    at = F.expr(f"if(size({words}) > 2, sequence(0, size({words}) - 3), array())").cast("array<int>")
    hashes = F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    df = df.withColumn("_h", hashes)
    # most short texts repeat no window, which the number of different ones tells
    some = F.size(F.array_distinct("_h")) < F.size("_h")
    nothing = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn("_s", F.when(some, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(nothing))
    twice = F.filter("_s", lambda x, k: (x["h"] == F.get("_s", k - 1)["h"]) | (x["h"] == F.get("_s", k + 1)["h"]))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).cast("long").alias("n"), p.alias("last")),
    )
    return df.withColumn(out, covered["n"]).drop("_h", "_s")


def line_fails(line: Column, words: Column) -> Column:
    """True for a line (and its words) that a rule removes. Tests that seldom hold stand first,
    and those that need a pass over the line of their own follow only where these hold."""
    n_chars, n_words = F.length(line), F.size(words)
    # any mark that prose seldom has; where there is none, the next three rules can't hold
    odd = line.rlike(r"[^\p{L}\p{N}\s.,;:'\u2019\"()-]")
    # navigation: separators between most words, or arrows and bullets in a row
    navigation = F.regexp_count(line, F.lit(r"[|»›→•·]")) * 4 > n_words + 4
    # marks that prose doesn't have, one in ten characters
    marked = F.regexp_count(line, F.lit(r"[#*$%&|<>{}\\^~=_]")) * 10 > n_chars
    # punctuation: exclamation after most words
    loud = F.regexp_count(line, F.lit("[!?]")) * 2 > n_words + 2
    # few letters at all: tables, rules, numbers
    others = F.regexp_count(line, F.lit(r"[^\p{L}\s]"))
    bare = others * 2 > n_chars - n_words
    # capitals for most characters, in more than a heading
    shouting = (n_words >= 4) & (F.regexp_count(line, F.lit(r"\p{Lu}")) * 2 > n_chars - n_words)
    # the same few words over and over
    repeated = (n_words >= 10) & (F.size(F.array_distinct(words)) * 4 < n_words)
    # a long line without one mark of a sentence
    unpunctuated = (n_words >= 40) & ~line.rlike(r"[.,;:!?…。]")
    boilerplate = (n_words <= 12) & F.lower(line).rlike(BOILERPLATE)
    return (odd & (navigation | marked | loud)) | bare | shouting | repeated | unpunctuated | boilerplate


def judge(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_lines_removed and clean_text (the text without the lines that fail), which take the place
    of columns of those names; all other columns are as given, whatever their names."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    text = F.coalesce(F.col(own[docs.columns.index(text_col)]).cast("string"), F.lit(""))
    df = docs.toDF(*own).withColumn("_text", text).withColumn("_all", F.split("_text", "\n", -1))
    # a line feed parts words too, so the lines' words are the text's
    df = df.withColumn("_by_line", F.transform("_all", words_of)).withColumn("_words", F.flatten("_by_line"))
    df = df.withColumn("_lines", F.filter("_all", lambda x, i: F.size(F.get("_by_line", i)) > 0))
    df = with_repeats(df, "_words", "n_repeat_words")
    df = df.withColumn("_good", F.filter("_all", lambda x, i: (F.size(F.get("_by_line", i)) == 0) | ~line_fails(x, F.get("_by_line", i))))
    df = df.withColumn("clean_text", F.array_join("_good", "\n"))
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count("_text", F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_lines_removed": (F.size("_all") - F.size("_good")).cast("long"),
            "_lost": F.length("_text") - F.length("clean_text") - (F.size("_all") - F.size("_good")),
        }
    )
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("_lost") <= MOST_LOST * F.length("_text")))
    added = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines_removed base_failed kept clean_text".split()
    return df.select(*[F.col(c).alias(name) for c, name in zip(own, docs.columns, strict=True) if name not in added], *added)


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, without the lines that fail; n_chars follows the text, all
    other columns are as given, whatever their names."""
    df = kept_rows(judge(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_given"), "text")), F.col("kept"))
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text")}
    return df.select(*[new.get(f.name, F.col(f"_given.`{f.name}`")).cast(f.dataType).alias(f.name) for f in docs.schema])
