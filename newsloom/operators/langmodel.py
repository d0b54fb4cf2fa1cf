"""Language by character trigrams: naive Bayes over profiles that Spark sums up.

A profile holds the commonest trigrams of a language's labelled texts; the model's vocabulary is all
profiles together, so it has at most len(SUPPORTED) * PROFILE rows and is sent to every task.
Weights are thousandths of log probabilities, as whole numbers, so sums do not depend on their order.
Tasks count and weigh the trigrams of their texts, so no row of a trigram's place is ever shuffled: fitting sends on
a row for each language and trigram of a slice of texts, detecting a row for each text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.language import SUPPORTED
from newsloom.lineage import checkpointed

PROFILE = 300


#: Characters of a slice of texts, or of one text that is longer.
SLICE = 1 << 20


def plain(text: Column) -> Column:
    """The lower-cased text, whose runs of other characters than letters are one space each."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")


def code(grams: np.ndarray) -> np.ndarray:
    """Trigrams, as rows of three code points, in one number each that orders as they do."""
    return grams[:, 0] << 42 | grams[:, 1] << 21 | grams[:, 2]


def trigrams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of texts its first and end, and its trigrams' texts, from 0 up, and codes; with repeats."""
    some = texts.to_pylist()
    i = 0
    while i < len(some):
        j, size = i, 0
        while j < len(some) and (j == i or size + len(some[j]) <= SLICE):
            size += len(some[j])
            j += 1
        points = np.frombuffer("".join(some[i:j]).encode("utf-32-le"), np.uint32).astype(np.int64)
        of = np.repeat(np.arange(j - i), [len(x) for x in some[i:j]])
        inside = np.flatnonzero(of[:-2] == of[2:])
        yield i, j, of[inside], code(np.stack((points[inside], points[inside + 1], points[inside + 2]), axis=1))
        i = j


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang").to_numpy(zero_copy_only=False)
        for i, j, of, codes in trigrams(batch.column("plain")):
            own = langs[i:j]
            for lang in sorted(set(own)):
                found, n = np.unique(codes[(own == lang)[of]], return_counts=True)
                points = np.stack((found >> 42, found >> 21 & 0x1FFFFF, found & 0x1FFFFF), axis=1).astype("<u4")
                whole = points.tobytes().decode("utf-32-le")
                grams = [whole[k : k + 3] for k in range(0, len(whole), 3)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(grams, pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


def _scores(batches: Iterator[pa.RecordBatch], known: np.ndarray, weights: np.ndarray, key: str, languages: list[str]) -> Iterator[pa.RecordBatch]:
    """key, and sums by language; nulls where no trigram is known."""
    for batch in batches:
        for i, j, of, codes in trigrams(batch.column("plain")):
            place = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
            hit = known[place] == codes if len(known) else np.zeros(len(codes), bool)
            of, place = of[hit], place[hit]
            none = np.bincount(of, minlength=j - i) == 0
            # whole numbers, which doubles hold exactly up to 2 ** 53
            sums = [pa.array(np.bincount(of, weights[place, k], minlength=j - i).astype(np.int64), mask=none) for k in range(len(languages))]
            yield pa.RecordBatch.from_arrays([batch.column(key).slice(i, j - i), *sums], names=[key, *languages])


@dataclass
class LanguageModel:
    #: gram, and weights by language
    weights: DataFrame
    languages: list[str]

    @classmethod
    def fit(cls, labelled: DataFrame, profile: int = PROFILE) -> LanguageModel:
        """labelled: text, lang. Texts of languages that are not supported are left out."""
        known = labelled.filter(F.lower("lang").isin(*SUPPORTED)).select(F.lower("lang").alias("lang"), plain(F.col("text")).alias("plain"))
        counts = known.mapInArrow(_counts, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        counts = checkpointed(counts)
        languages = sorted(r.lang for r in counts.select("lang").distinct().collect())
        place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
        vocabulary = counts.withColumn("place", place).filter(F.col("place") <= profile).select("gram").distinct()
        seen = counts.join(F.broadcast(vocabulary), "gram").groupBy("gram").agg(*[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(x) for x in languages])
        seen = checkpointed(seen)
        totals = seen.agg(F.count(F.lit(1)).alias("size"), *[F.sum(x).alias(f"all_{x}") for x in languages])
        log = lambda x: F.round(1000 * F.log((F.col(x) + 1) / (F.col(f"all_{x}") + F.col("size")))).cast("long")
        return cls(checkpointed(seen.join(F.broadcast(totals)).select("gram", *[log(x).alias(x) for x in languages])), languages)

    def detect(self, texts: DataFrame, key: str, text: str = "text") -> DataFrame:
        """key (unique), language, confidence: the posterior of the likeliest language, all being as likely before. Nulls where no trigram is known."""
        rows = self.weights.select("gram", *self.languages).collect()  # at most len(SUPPORTED) * PROFILE
        points = np.frombuffer("".join(r.gram for r in rows).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(-1, 3)
        known = code(points)
        order = np.argsort(known)
        known, weights = known[order], np.array([r[1:] for r in rows], np.float64).reshape(len(rows), -1)[order]
        languages = self.languages
        kind = T.StructType([texts.schema[key], *[T.StructField(x, T.LongType()) for x in languages]])
        scored = texts.select(key, plain(F.col(text)).alias("plain")).mapInArrow(lambda it: _scores(it, known, weights, key, languages), kind)
        best = F.greatest(*self.languages) if len(self.languages) > 1 else F.col(self.languages[0])
        name = F.coalesce(*[F.when(F.col(x) == F.col("_best"), F.lit(x)) for x in self.languages])
        odds = sum((F.exp((F.col(x) - F.col("_best")) / 1000.0) for x in self.languages), F.lit(0.0))
        there = F.col(key).isNotNull() & F.col("_best").isNotNull()
        found = scored.withColumn("_best", best)
        return found.select(key, F.when(there, name).alias("language"), F.when(there, F.round(1 / odds, 6)).alias("confidence"))
