"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid", "msclkid")
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(F.regexp_replace(url, r"[\t\n\r]", ""), _URL, i)


def _decode(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def _encode(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _front(url: Column) -> Column:
    scheme, place = F.lower(_part(url, 1)), _part(url, 2)
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(place != "", F.concat(F.lit("//"), place)).otherwise(""))


def canonical_url(url: Column) -> Column:
    """Without tracking parameters and fragment. Values of one key meet at its first place; blanks stay."""
    given = F.filter(F.split(_part(url, 4), "&"), lambda p: p != "")
    pairs = F.transform(
        given, lambda p: F.struct(_decode(F.split(p, "=", 2)[0]).alias("key"), F.coalesce(_decode(F.get(F.split(p, "=", 2), F.lit(1))), F.lit("")).alias("value"))
    )
    kept = F.filter(pairs, lambda p: ~F.lower(p["key"]).isin(*TRACKING))
    keys = F.array_distinct(F.transform(kept, lambda p: p["key"]))
    grouped = F.flatten(F.transform(keys, lambda k: F.filter(kept, lambda p: p["key"] == k)))
    query = F.array_join(F.transform(grouped, lambda p: F.concat(_encode(p["key"]), F.lit("="), _encode(p["value"]))), "&")
    return F.concat(_front(url), _part(url, 3), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def key_url(url: Column) -> Column:
    """Scheme, host and path without parameters, less one trailing slash."""
    path = F.regexp_replace(_part(url, 3), r";[^/]*$", "")
    return F.regexp_replace(F.concat(F.lower(_part(url, 1)), F.lit("://"), _part(url, 2), path), "/$", "")


def domain(url: Column) -> Column:
    return F.replace(_part(url, 2), F.lit("www."), F.lit(""))
