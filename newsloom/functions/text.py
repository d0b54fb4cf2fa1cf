"""Text and hash functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the separators 1C-1F; and the controls without \t \n \r.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def normalize_text(text: Column) -> Column:
    """Runs of white space become one space, then controls go, then the ends are stripped."""
    flat = F.regexp_replace(text, SPACE, " ")
    return F.regexp_replace(F.regexp_replace(flat, r"[\x00-\x08\x0b-\x1f]", ""), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def clean_text(text: Column) -> Column:
    """Controls go, lines are stripped, blank lines go; null gives the empty string."""
    lines = F.split(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), "\n")
    stripped = F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.coalesce(F.array_join(F.filter(stripped, lambda x: x != ""), "\n"), F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def sha256(value: Column) -> Column:
    return F.sha2(value.cast("string"), 256)


def md5(value: Column) -> Column:
    return F.md5(value.cast("string"))


def verify_checksum(value: Column, checksum: Column, algorithm: str = "sha256") -> Column:
    """Case does not matter; an algorithm that is not known verifies nothing."""
    digest = {"sha256": sha256, "md5": md5}.get(algorithm.lower())
    return F.coalesce(F.lower(digest(value)) == F.lower(checksum), F.lit(False)) if digest else F.lit(False)


def valid_utf8(value: Column) -> Column:
    return F.is_valid_utf8(value)


def ensure_utf8(value: Column) -> Column:
    return F.make_valid_utf8(value)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value bound to a lambda variable: a plain column would be worked out at each mention."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def shingles(text: Column, n: int = 4) -> Column:
    """Distinct runs of n words of the lower-cased text; fewer words give none."""

    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (n - 1))
        return F.when(F.size(w) >= n, F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " ")))).otherwise(F.array().cast("array<string>"))

    return once(words(F.lower(text)), runs)


def country_of(metadata: Column) -> Column:
    value = metadata["country"]
    return F.when(F.length(value) == 2, F.upper(value))


def socket_feed_id(url: Column) -> Column:
    return F.concat(F.lit("ws_"), F.replace(F.replace(url, F.lit("://"), F.lit("_")), F.lit("/"), F.lit("_")))


def proxy_url(url: Column, protocol: Column | None = None) -> Column:
    own = protocol if protocol is not None else F.lit("http")
    return F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(F.concat(own, F.lit("://"), url))


def backoff(base: Column, attempt: Column) -> Column:
    return base * F.pow(F.lit(2), attempt)
