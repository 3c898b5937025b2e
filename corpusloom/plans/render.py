"""Renderings of canonical documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from corpusloom.functions.text import fenced, frontmatter, is_blank


def _not_finite(value: Column, kind: DataType) -> Column | None:
    """True where a number within the value isn't finite; None if there can't be any."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.isnan(value) | (F.abs(value) == float("inf"))
    if isinstance(kind, StructType):
        tests = [_not_finite(value[f.name], f.dataType) for f in kind.fields]
    elif isinstance(kind, ArrayType):
        within = _not_finite(F.get(value, F.lit(0)), kind.elementType)
        tests = [within if within is None else F.exists(value, lambda x: F.coalesce(_not_finite(x, kind.elementType), F.lit(False)))]
    elif isinstance(kind, MapType):
        return _not_finite(F.map_values(value), ArrayType(kind.valueType))
    else:
        return None
    found = [F.coalesce(x, F.lit(False)) for x in tests if x is not None]
    return reduce(Column.__or__, found) if found else None


def json(record: Column, kind: DataType | None = None) -> Column:
    """Lossless compact JSON: nulls are kept. Structs have to declare their fields in
    alphabetical order. A number that isn't finite, which JSON doesn't have, is an error; it is
    looked for in the numbers of the record's type, so that texts may say NaN."""
    text = F.to_json(record, {"ignoreNullFields": "false"})
    bad = None if kind is None else _not_finite(record, kind)
    return text if bad is None else F.when(bad, F.raise_error(F.lit("not a JSON number"))).otherwise(text)


def markdown(title: Column, texts: Column) -> Column:
    """A heading and the texts, in their stored order, parted by blank lines; what is null is
    left out, and a document of nothing is an empty text."""
    heading = F.when(~is_blank(title), F.concat(F.lit("# "), title))
    return F.concat_ws("\n\n", heading, F.when(F.size(F.array_compact(texts)) > 0, F.array_join(F.array_compact(texts), "\n\n")))


def _two(x: Column) -> Column:
    """Two decimals of the exact binary value of x >= 0, ties to even: a cast to decimal would
    round the shortest text of the number instead. 2**52 parts of one are counted."""
    one = 1 << 52
    whole = F.floor(x).cast("long")
    n = ((x - whole) * F.lit(float(one))).cast("long") * 100
    q, r = F.shiftright(n, 52), n.bitwiseAND(F.lit(one - 1).cast("long"))
    cents = whole * 100 + q + F.when((r > one // 2) | ((r == one // 2) & (q % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def transcript(fields: dict[str, Column], title: Column, cues: Column) -> Column:
    """Cues (text, start, end) with their times in seconds."""
    line = F.transform(cues, lambda c: F.concat(F.lit("["), _two(c["start"]), F.lit(" - "), _two(c["end"]), F.lit(" sec] "), c["text"]))
    return F.concat_ws("\n\n", frontmatter(fields), F.concat(F.lit("# "), title), F.array_join(line, "\n"))


def captions(fields: dict[str, Column], title: Column, cues: Column, url: Column) -> Column:
    """Cues with links to their second in the video."""

    def line(c):
        second = F.floor(c["start"]).cast("long")
        clock = F.format_string("%02d:%02d:%02d", F.floor(second / 3600), F.floor(second / 60) % 60, second % 60)
        return F.concat(F.lit("- ["), clock, F.lit("]("), url, F.lit("&t="), second.cast("string"), F.lit("s) "), c["text"])

    return F.concat_ws("\n\n", frontmatter(fields), F.concat(F.lit("# "), title), F.array_join(F.transform(F.filter(cues, lambda c: ~is_blank(c["text"])), line), "\n"))


def image(fields: dict[str, Column], title: Column, name: Column, recognised: Column) -> Column:
    """The picture and, as a literal block, the text that was recognised in it."""
    return F.concat_ws("\n\n", frontmatter(fields), F.concat(F.lit("# "), title), F.concat(F.lit("![["), name, F.lit("]]")), F.when(~is_blank(recognised), fenced(recognised)))


def renderer(metadata: Column) -> Column:
    """Which of the renderings a document's metadata asks for."""
    has = lambda key: F.get_json_object(metadata, f"$.{key}").isNotNull()
    return F.when(has("video_notes"), "video-notes").when(has("transcription"), "transcript").when(has("captions"), "captions").when(has("image"), "image").otherwise("markdown")
