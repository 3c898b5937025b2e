"""Text functions as Catalyst expressions.

Two notions of blank exist side by side and are kept apart: a server's (Python's str.strip)
and a browser's (ECMAScript's String.trim)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the white space that Python's str.strip and ECMAScript's trim remove
PY_SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
JS_SPACE = r"[\t-\r\x20\xa0  -     　﻿]"
# fixed values: the white space that HTML text collapses
HTML_SPACE = r"[ \t\n\r\f\x0B]+"
# fixed values: what media tools print where they know nothing
PLACEHOLDERS = ("", "n/a", "na", "unknown", "none", "null")


def is_blank(text: Column, space: str = PY_SPACE) -> Column:
    """True for null, empty or only white space."""
    return F.coalesce(text, F.lit("")).rlike(rf"\A{space}*\z")


def strip(text: Column, space: str = PY_SPACE) -> Column:
    return F.regexp_replace(text, rf"\A{space}+|{space}+\z", "")


def decode_utf8(content: Column) -> Column:
    """struct(text, error): error is one of empty, invalid_utf8, blank, or null."""
    text = F.try_validate_utf8(content.cast("string"))
    error = F.when(F.octet_length(content) == 0, "empty").when(text.isNull(), "invalid_utf8").when(is_blank(text), "blank")
    return F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error"))


def collapse_html_space(text: Column) -> Column:
    """ASCII white space becomes one space; other spaces, such as U+00A0, stay."""
    return F.regexp_replace(text, HTML_SPACE, " ")


def normal_lines(text: Column) -> Column:
    """Each line collapsed and trimmed, at most one empty line between others, none at the edges."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(collapse_html_space(x)))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"\A\n+|\n+\z", "")


def placeholder_to_null(text: Column) -> Column:
    """Lower-cased and stripped; null where a tool printed that it doesn't know."""
    low = F.lower(strip(text))
    return F.when(~low.isin(*PLACEHOLDERS), low)


def fence(text: Column) -> Column:
    """As many backticks as fence the text in: at least three, one more than its longest run."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def fenced(text: Column) -> Column:
    """The text as a literal block."""
    return F.concat(fence(text), F.lit("text\n"), text, F.lit("\n"), fence(text))


def wer_words(text: Column) -> Column:
    """Words for word error rates: lower case, one letter folded, letters and digits."""
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("ё"), F.lit("е")), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def frontmatter(fields: dict[str, Column]) -> Column:
    """Lines of key: value between two rules; values are JSON strings. Null fields are left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), json_string(v))) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---"))


def json_string(text: Column) -> Column:
    """The text as a JSON string."""
    inner = F.to_json(F.array(text.cast("string")))
    return F.substring(inner, F.lit(2), F.length(inner) - 2)


def language_code(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"\A[A-Za-z]{2,3}(?:-[A-Za-z0-9]{2,8})*\z")
