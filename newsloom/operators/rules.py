"""Quality rules: one ordered CASE for each rule, then a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import language, text, times

#: A rule's penalty, in the order of evaluation.
PENALTIES = {"R1": 0.15, "R2": 0.15, "R3": 0.10, "R6": 0.15, "R9": 0.15, "CONTENT": 0.15}
MIN_SCORE = 0.7
SHORT, CONF_SHORT, CONF_LONG = 500, 0.80, 0.90


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def rule_columns(as_of: Column) -> dict[str, Column]:
    """Each rule's error message, or null. Needs title, body, canonical_url, published_at, source and lang_*."""
    body, title = F.col("body"), F.col("title")
    size = F.length(body)
    n_words = F.col("n_words")
    return {
        "R1": F.when(F.col("published_at").isNull(), F.lit("Timestamp validation failed")).when(
            ~times.reasonable(F.col("published_at"), as_of), F.lit("Timestamp is unreasonable (too far in past or future)")
        ),
        "R2": F.when(blank(body), F.lit("Cannot detect language of empty body"))
        .when(F.col("lang_confidence").isNull() | (F.col("lang_confidence") < CONF_SHORT), F.lit("Language detection failed"))
        .when((size >= SHORT) & (F.col("lang_confidence") < CONF_LONG), F.lit("Language confidence below 0.9 threshold")),
        "R3": F.when(blank(F.col("canonical_url")), F.lit("Missing canonical_url for deduplication")).when(blank(body), F.lit("Missing body for deduplication")),
        "R6": F.when(blank(F.col("source")), F.lit("Missing source field")),
        "R9": F.when(~text.valid_utf8(title) | ~text.valid_utf8(body), F.lit("Invalid UTF-8 encoding")).when(F.length(text.sha256(body)) != 64, F.lit("Invalid checksum generated")),
        "CONTENT": F.when(F.length(title) < 5, F.lit("Title too short (minimum 5 characters)"))
        .when(size < 50, F.lit("Body too short (minimum 50 characters)"))
        .when((size < SHORT) & (n_words < 5), F.lit("Body has too few words (minimum 5)"))
        .when((size >= SHORT) & (n_words < 20), F.lit("Body has too few words (minimum 20)")),
    }


def evaluate(articles: DataFrame, as_of: Column) -> DataFrame:
    """articles with lang_code, lang_confidence, n_words, rule_errors, errors, validation_score and is_valid."""
    found = articles.withColumn("_lang", language.detect(F.col("body"))).withColumn("n_words", text.word_count(F.col("body")))
    found = found.withColumn("lang_code", F.col("_lang.language")).withColumn("lang_confidence", F.col("_lang.confidence")).drop("_lang")
    rules = rule_columns(as_of)
    found = found.withColumn("rule_errors", F.struct(*[c.alias(r) for r, c in rules.items()]))
    score = F.lit(1.0)
    for rule, penalty in PENALTIES.items():
        score = score - F.when(F.col("rule_errors")[rule].isNotNull(), F.lit(penalty)).otherwise(F.lit(0.0))
    listed = F.array(*[F.concat(F.lit(f"{r}: "), F.col("rule_errors")[r]) for r in PENALTIES])
    found = found.withColumn("errors", F.filter(listed, lambda x: x.isNotNull())).withColumn("validation_score", F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)))
    return found.withColumn("is_valid", (F.size("errors") == 0) & (F.col("validation_score") >= MIN_SCORE))


def validation_log(evaluated: DataFrame, as_of: Column, schema_version: str = "v1.0") -> DataFrame:
    """A row for each failed rule."""
    e = F.col("error")
    rows = evaluated.select("*", F.posexplode("errors").alias("place", "error"))
    return rows.select(
        F.concat_ws(":", "article_key", "place").alias("record_id"), as_of.alias("timestamp"), F.split(e, ": ", 2)[0].alias("rule_id"), e.alias("error_message"),
        F.lit("error").alias("severity"), F.lit(schema_version).alias("schema_version"), F.col("source").alias("feed_id"),
    )
