"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: hosts that serve videos, and the host of short links
WATCH_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com")
SHORT_HOST = "youtu.be"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)", 1))


def capturable(url: Column) -> Column:
    """Only pages of http and https can be captured."""
    return F.coalesce(scheme(url).isin("http", "https"), F.lit(False))


def video_id(url: Column) -> Column:
    """The 11 characters that name a video in one of the known forms of address; null for all
    others, and for addresses with user data, a port, control characters or v given twice."""
    clean = ~url.rlike(r"[\x00-\x20\x7f\\]") & url.rlike(r"\A[Hh][Tt][Tt][Pp][Ss]?://[^/?#:@]+(?:[/?#]|\z)")
    query = F.regexp_extract(url, r"\A[^?#]*\?([^#]*)", 1)
    fields = F.split(query, "&", -1)
    given = F.filter(fields, lambda x: x.rlike(r"\Av="))
    path = F.regexp_extract(url, r"\A[A-Za-z]+://[^/?#]+([^?#]*)", 1)
    watch = F.when((path == "/watch") & (F.size(given) == 1) & (F.size(fields) <= 40), F.substring(F.get(given, 0), 3, 64))
    inside = F.regexp_extract(path, r"\A/(?:shorts|embed|live)/([^/]+)/?\z", 1)
    short = F.regexp_extract(path, r"\A/([^/]+)/?\z", 1)
    found = F.when(host(url).isin(*WATCH_HOSTS), F.coalesce(watch, inside)).when(host(url) == SHORT_HOST, short)
    return F.when(clean & found.rlike(r"\A[A-Za-z0-9_-]{11}\z"), found)


def watch_url(identity: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), identity)


def allowed_destination(url: Column, method: Column, allowed: list[tuple[str, str, str]]) -> Column:
    """True for https addresses whose (host, method, path) is listed."""
    path = F.regexp_extract(url, r"\A[A-Za-z]+://[^/?#]+([^?#]*)", 1)
    hit = F.lit(False)
    for h, m, p in allowed:
        hit = hit | ((host(url) == h) & (F.upper(method) == m) & (path == p))
    return (scheme(url) == "https") & hit
