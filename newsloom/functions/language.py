"""Language by function words, else by script: deterministic, and plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import once

#: Codes that are supported.
SUPPORTED = ("en", "es", "fr", "de", "it", "pt", "ru", "ja", "zh", "ar", "hi", "ko", "nl", "pl", "tr", "vi", "th", "id", "sv", "no")
#: Common function words; a tie goes to the language named first.
WORDS = {
    "en": "the of and to in is that it for was on are as with be this at from by an or have not but they which you were".split(),
    "fr": "le la les de des et un une du en est que qui dans pour par sur avec au aux il elle ce ne pas plus ou nous vous sont".split(),
    "de": "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "es": "el la los las de que y en un una ser se no por con su para como más pero sus le ya o este sí porque del al es".split(),
}
#: Scripts that name a language, as character classes.
SCRIPTS = {"ja": r"[\x{3040}-\x{30ff}]", "ko": r"[\x{ac00}-\x{d7af}]", "zh": r"[\x{4e00}-\x{9fff}]", "ru": r"[\x{0400}-\x{04ff}]", "ar": r"[\x{0600}-\x{06ff}]", "hi": r"[\x{0900}-\x{097f}]", "th": r"[\x{0e00}-\x{0e7f}]"}


def tokens(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}]+")


def detect(text: Column) -> Column:
    """struct(language, confidence): the best language's share of all function words found; nulls if there are none."""
    # only function words go on to the counts by language
    known = F.filter(tokens(text), lambda w: w.isin(*sorted({w for words in WORDS.values() for w in words})))
    counts = once(known, lambda found: F.struct(*[_count(found, words).alias(lang) for lang, words in WORDS.items()]))
    return once(counts, lambda counted: _best(text, {lang: counted[lang] for lang in WORDS}))


def _count(words: Column, known: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*known)))


def _best(text: Column, counts: dict[str, Column]) -> Column:
    total = sum(counts.values(), F.lit(0))
    best = F.greatest(*counts.values())
    language = F.coalesce(*[F.when(c == best, F.lit(lang)) for lang, c in counts.items()])
    signs = {lang: F.regexp_count(text, F.lit(p)) for lang, p in SCRIPTS.items()}
    most = F.greatest(*signs.values())
    script = F.coalesce(*[F.when(c == most, F.lit(lang)) for lang, c in signs.items()])
    share = most / sum(signs.values(), F.lit(0))
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    found = F.when(blank, F.lit(None)).when(total > 0, F.struct(language.alias("language"), (best / total).alias("confidence")))
    return found.when(most > 0, F.struct(script.alias("language"), share.alias("confidence")))


def supported(code: Column) -> Column:
    return F.lower(code).isin(*SUPPORTED)
