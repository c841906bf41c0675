"""Addresses: canonical form and key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Beginnings of tracking parameters' names.
TRACKING = ("utm_", "srsltid", "fbclid", "gclid")
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _encode(c: Column) -> Column:
    """Form encoding of a decoded value; what can't be decoded is encoded as it stands."""
    enc = F.url_encode(F.coalesce(F.try_url_decode(c), c))
    return F.replace(F.replace(enc, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, no slash at the end of the path, no tracking parameters, query re-encoded, no fragment.

    What doesn't look like an address stays as it is; null stays null.
    """
    part = lambda i: F.regexp_extract(url, _URL, i)
    pairs = F.filter(F.split(part(4), "&"), lambda p: p != "")
    kept = F.filter(pairs, lambda p: ~F.lower(p).rlike("^(?:" + "|".join(TRACKING) + ")"))
    coded = F.transform(kept, lambda p: F.concat(_encode(F.substring_index(p, "=", 1)), F.lit("="), _encode(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise(""))))
    query = F.array_join(coded, "&")
    text = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.regexp_replace(part(3), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.rlike(_URL), text).otherwise(url)


def url_key(url: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the normalised address."""
    return F.left(F.sha2(normalize_url(url), 256), F.lit(16))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 2))


def slug_title(url: Column) -> Column:
    """A readable title from the last path segment."""
    seg = F.regexp_extract(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", ""), r"([^/]*)$", 1)
    return F.trim(F.regexp_replace(F.coalesce(F.try_url_decode(seg), seg), r"[-_]+", " "))


def has_terms(url: Column, include: Column, exclude: Column) -> Column:
    """Whether the address holds one of include (if it has any) and none of exclude; null arrays are empty."""
    low = F.lower(url)
    inc = F.coalesce(F.size(include) <= 0, F.lit(True)) | F.coalesce(F.exists(include, lambda t: low.contains(F.lower(t))), F.lit(True))
    exc = F.coalesce(F.exists(exclude, lambda t: low.contains(F.lower(t))), F.lit(False))
    return inc & ~exc
