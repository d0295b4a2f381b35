"""URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of articles that report no event, by what their URLs contain; the first that fits counts.
NON_EVENT = {
    "horoscopo": "horoscopo|zodiaco|zodiacal|astrolog",
    "recetas": "receta",
    "juegos": "loteria|quiniela",
    "opinion": "/opinion[/-]|/columnistas/|/editorial(?:es)?/|/modo-fontevecchia/",
}
AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def _balanced(url: Column) -> Column:
    host = F.regexp_extract(url, AUTHORITY, 1)
    count = lambda c: F.length(host) - F.length(F.replace(host, F.lit(c), F.lit("")))
    return count("[") == count("]")


def usable(url: Column) -> Column:
    """Has a scheme and a host, before and after percent-decoding, and no open bracket in the host."""
    decoded = F.coalesce(F.try_url_decode(url), url)
    return F.coalesce(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+") & _balanced(url) & _balanced(decoded), F.lit(False))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, AUTHORITY, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)


def segments(url: Column, n: int = 2) -> Column:
    """The first n non-empty segments of the path, in lower case."""
    return F.slice(F.filter(F.split(F.lower(path(url)), "/"), lambda s: s != ""), 1, n)


def non_event(url: Column) -> Column:
    """The kind of non-event article, or null."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(NON_EVENT.items()):
        out = F.when(url.rlike(f"(?i){pattern}"), kind).otherwise(out)
    return out
