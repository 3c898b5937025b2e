"""Digests, references and headers of bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What suggested file names begin with.
NAME_PREFIX = "capture-"
# fixed values: PNG's signature, and the bit depths that each colour type may have
PNG_SIGNATURE = "89504E470D0A1A0A"
PNG_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def raw_ref(content: Column, mime: Column | None = None) -> Column:
    """struct(id, mime_type, sha256, ref): identity is the digest of the bytes and nothing else."""
    d = digest(content)
    return F.struct(d.alias("id"), (mime if mime is not None else F.lit(None).cast("string")).alias("mime_type"), d.alias("sha256"), F.concat(F.lit("sha256:"), d).alias("ref"))


def ref_error(ref: Column) -> Column:
    """missing, scheme, digest, or null for a good reference."""
    return F.when(ref.isNull(), "missing").when(~ref.startswith("sha256:"), "scheme").when(~ref.rlike(r"\Asha256:[0-9a-f]{64}\z"), "digest")


def file_name(capture_id: Column, prefix: str = NAME_PREFIX) -> Column:
    return F.concat(F.lit(prefix), F.sha2(capture_id, 256), F.lit(".md"))


def asset_name(capture_id: Column, asset_id: Column, extension: str = ".png") -> Column:
    return F.concat(F.sha2(F.concat(capture_id, F.lit(":"), asset_id), 256), F.lit(extension))


def _ascii_json(text: Column) -> Column:
    """A JSON string in ASCII: code units beyond it are escaped."""
    from corpusloom.functions.text import json_string

    def escaped(c):
        code = F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long")
        units = F.hex(F.encode(c, "UTF-16BE"))
        one = F.concat(F.lit("\\u"), F.lower(F.substring(units, 1, 4)))
        two = F.concat(one, F.lit("\\u"), F.lower(F.substring(units, 5, 4)))
        return F.when(code < 128, c).when(F.length(units) > 4, two).otherwise(one)

    plain = json_string(text)
    whole = F.array_join(F.transform(F.split(plain, ""), escaped), "")
    return F.when(plain.rlike(r"\A[\x00-\x7f]*\z"), plain).otherwise(whole)


def package_json(fields: list[Column]) -> Column:
    """A compact JSON array; strings are escaped, columns of numbers or of ready JSON (structs
    made by raw_json) are put in as they are."""
    return F.concat(F.lit("["), F.concat_ws(",", *fields), F.lit("]"))


def json_text(text: Column) -> Column:
    return _ascii_json(text)


def package_digest(fields: list[Column]) -> Column:
    return F.sha2(package_json(fields), 256)


def _number(content: Column, at: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(content, at, size)), 16, 10).cast("long")


def png_header(content: Column) -> Column:
    """struct(width, height, error) of a PNG's first chunk; the first test that fails names the error."""
    part = lambda at, size: F.hex(F.substring(content, at, size))
    width, height, depth, colour = _number(content, 17, 4), _number(content, 21, 4), _number(content, 25, 1), _number(content, 26, 1)
    legal = F.lit(False)
    for kind, depths in PNG_DEPTHS.items():
        legal = legal | ((colour == kind) & depth.isin(*depths))
    tests = [
        ("truncated", F.octet_length(content) < 33),
        ("signature", part(1, 8) != PNG_SIGNATURE),
        ("first_chunk", part(13, 4) != "49484452"),
        ("chunk_length", _number(content, 9, 4) != 13),
        ("crc", F.crc32(F.substring(content, 13, 17)) != _number(content, 30, 4)),
        ("zero_dimension", (width == 0) | (height == 0)),
        ("dimension", (width > 2**31 - 1) | (height > 2**31 - 1)),
        ("compression", _number(content, 27, 1) != 0),
        ("filter", _number(content, 28, 1) != 0),
        ("interlace", _number(content, 29, 1) > 1),
        ("colour_type", ~colour.isin(*PNG_DEPTHS)),
        ("bit_depth", ~legal),
    ]
    error = F.lit(None).cast("string")
    for name, failed in reversed(tests):
        error = F.when(failed, name).otherwise(error)
    return F.struct(F.when(error.isNull(), width).alias("width"), F.when(error.isNull(), height).alias("height"), error.alias("error"))


def audio_kind(content: Column) -> Column:
    """The mime type that the first bytes tell, or null."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57415645"), "audio/wav")
        .when(head.startswith("4F676753"), "audio/ogg")
        .when(head.startswith("494433") | head.rlike("^FF[EF]"), "audio/mpeg")
    )


# fixed values: other names of audio types, those that tell nothing, the bytes of a sound or a film at
# most, and the brands of films that are read
AUDIO_ALIASES = {
    "audio/x-wav": "audio/wav",
    "audio/wave": "audio/wav",
    "audio/vnd.wave": "audio/wav",
    "audio/mp3": "audio/mpeg",
    "application/ogg": "audio/ogg",
    "audio/ogg; codecs=opus": "audio/ogg",
}
GENERIC_TYPES = ("", "application/octet-stream")
AUDIO_BYTES = 32 * 1024 * 1024
FILM_BRANDS = ("isom", "iso2", "mp41", "mp42", "avc1")


def audio_error(content: Column, declared: Column) -> Column:
    """null, or why a sound isn't taken: its size, its first bytes, or a declared type that isn't
    what they tell. Types go by their aliases; a generic one leaves it to the bytes."""
    size, kind = F.octet_length(content), audio_kind(content)
    named = F.lower(F.trim(F.coalesce(declared, F.lit(""))))
    table = F.create_map(*[F.lit(x) for pair in AUDIO_ALIASES.items() for x in pair])
    told = F.coalesce(F.try_element_at(table, named), named)
    return (
        F.when(~F.coalesce(size.between(1, AUDIO_BYTES), F.lit(False)), "input_size_limit")
        .when(kind.isNull(), "unsupported_format")
        .when(~told.isin(*GENERIC_TYPES) & (told != kind), "mime_mismatch")
    )


def film_ok(content: Column) -> Column:
    """One of a film's brands is among those that are read."""
    return F.coalesce(F.arrays_overlap(mp4_brands(content), F.array(*map(F.lit, FILM_BRANDS))), F.lit(False))


def mp4_brands(content: Column) -> Column:
    """The brands in an ftyp box of 16 to 64 bytes, a multiple of 4; null otherwise."""
    size = _number(content, 1, 4)
    ok = (F.hex(F.substring(content, 5, 4)) == "66747970") & size.between(16, 64) & (size % 4 == 0) & (F.octet_length(content) >= size)
    at = F.filter(F.sequence(F.lit(9), size.cast("int") - 3, F.lit(4)), lambda i: i != 13)
    return F.when(ok, F.transform(at, lambda i: F.substring(content, i, F.lit(4)).cast("string")))
