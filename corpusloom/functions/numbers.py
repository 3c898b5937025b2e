"""Numbers of media: strict parsing, exact fractions, sizes that fit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration(text: Column) -> Column:
    """A finite number of seconds of 0 or more, or null."""
    x = F.when(text.rlike(r"\A[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"), text.try_cast("double"))
    return F.when(x < float("inf"), x)


def positive_int(text: Column) -> Column:
    x = F.when(text.rlike(r"\A[0-9]{1,18}\z"), text.try_cast("long"))
    return F.when(x > 0, x)


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm as a fold: 90 steps are enough for 64 bits."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(90)), start, step, lambda s: s["a"])


def frame_rate(text: Column) -> Column:
    """n/d in lowest terms; null for 0/x and for what isn't a fraction with d > 0."""
    n = F.regexp_extract(text, r"\A([0-9]{1,18})/[0-9]{1,18}\z", 1).try_cast("long")
    d = F.regexp_extract(text, r"\A[0-9]{1,18}/([0-9]{1,18})\z", 1).try_cast("long")
    g = gcd(n, d)
    return F.when((n > 0) & (d > 0), F.concat_ws("/", _div(n, g), _div(d, g)))


def _div(a: Column, b: Column) -> Column:
    return F.floor((a.cast("decimal(20,0)") / b.cast("decimal(20,0)"))).cast("long").cast("string")


def seconds(pts: Column, num: Column, den: Column) -> Column:
    """A time stamp of num/den seconds a unit, exactly."""
    return (pts.cast("decimal(20,0)") * num.cast("decimal(9,0)")).cast("decimal(30,9)") / den.cast("decimal(9,0)")


def fitted(width: Column, height: Column, side: int, pixels: int | None = None) -> Column:
    """struct(width, height) scaled down to a longest side and, if given, a number of pixels."""
    scale = F.least(F.lit(1.0), side / F.greatest(width, height))
    if pixels:
        scale = F.least(scale, F.sqrt(F.lit(float(pixels)) / (width * height)))
    to = lambda x: F.greatest(F.lit(1), F.floor(x * scale)).cast("int")
    return F.struct(to(width).alias("width"), to(height).alias("height"))


def raster_pixels(width: Column, height: Column, scale: Column) -> Column:
    return F.ceil(width * scale) * F.ceil(height * scale)


def timestamp_with_offset(text: Column) -> Column:
    """A time stamp, or null if the text doesn't say its offset."""
    return F.when(text.rlike(r"(?:[zZ]|[+-][0-9]{2}:?[0-9]{2})\z"), F.try_to_timestamp(text))
