"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities and counts of insults (a fixed list, and words and
word beginnings whose labels tell), insults near a second person, capitals, shouting,
punctuation, and obfuscated spellings. Labels are learned from at most TRAIN_ROWS
labelled rows, a hashed sample of those that are not held out: one part gives the
lexicon, one the trees, one the calibration. Everything else reads whole texts of all
documents; model and lexicon are bounded and go along with the tasks.

Defined results: null and empty texts are scored by their features, all 0; labels that
are null are left out, and of repeated labels the highest counts; without labels every
score is 0; repeated rows are scored alike; an empty table gives no rows; a null doc_id
is not held out; only doc_id and text are read, and doc_id and toxic of the labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm import textscan as ts
from newsloom.llm.boosting import BoostedTrees, Isotonic
from newsloom.llm.durable import cut, hash_bound

TRAIN_ROWS = 24_000
LEXICON_ROWS = 4_000
CUTOFF = 0.3
STEMS = (4, 5, 6)
NEAR = 5

#: Common insults, and second persons in the languages of the corpus.
INSULTS = (
    "idiot idiots moron morons stupid loser losers pathetic scum worthless trash clown clowns disgusting garbage dumb imbecile filth filthy vermin "
    "retard fool foolish jerk bastard cretin pig pigs hate ugly freak creep coward liar parasite nazi "
    "idiota estupido estúpido imbécil basura asqueroso patético escoria tonto "
    "idiote imbécile stupide crétin ordure pathétique débile abruti connard "
    "trottel dumm dummkopf abschaum erbärmlich wertlos arschloch widerlich"
).split()
SECOND_PERSONS = "you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split()

FEATURES = 24
_U = np.uint64
#: Tokens are runs of letters and digits; the wide kind takes signs used for letters too.
_CORE = np.ones(256, bool)
_CORE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_WIDE = _CORE.copy()
_WIDE[[ord(c) for c in "@$!*"]] = False
#: Signs read as letters.
_LEET = ts.LOWER.copy()
for _a, _b in zip("013457@$!", "oieastasi", strict=True):
    _LEET[ord(_a)] = ord(_b)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[range(65, 91)] = True


def hashes_of(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(x) for x in raw])
    return np.sort(ts.word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - np.array([len(x) for x in raw]), ends))


def _known(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places of values in a sorted table; -1 where absent."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def _forms(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of the token and of its beginnings; a beginning as long as the token is marked as one all the same."""
    sums = ts.prefix(low)
    return [ts.stretches(sums, starts, ends), *(ts.mix(ts.stretches(sums, starts, np.minimum(ends, starts + k)) + _U(k)) for k in STEMS)]


def features(data: np.ndarray, at: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A row of FEATURES for each document. lexicon: sorted hashes of telling forms and their weights."""
    n = len(at) - 1
    low = ts.LOWER[data]
    starts, ends, off = ts.words(low, at, _CORE)
    doc = np.repeat(np.arange(n), np.diff(off))
    per = lambda flag, w=None: np.bincount(doc[flag], None if w is None else w[flag], n).astype(float)
    count = np.diff(off).astype(float)
    words = np.maximum(count, 1)
    forms = _forms(low, starts, ends)
    insult = _known(forms[0], hashes_of(INSULTS)) >= 0
    weight = np.zeros(len(starts))
    telling = np.zeros((len(forms), len(starts)), bool)
    for k, form in enumerate(forms):
        place = _known(form, lexicon[0])
        telling[k] = place >= 0
        weight = np.maximum(weight, np.where(place >= 0, lexicon[1][np.maximum(place, 0)] if len(lexicon[1]) else 0, 0))
    you = _known(forms[0], hashes_of(SECOND_PERSONS)) >= 0
    beside = np.concatenate(([0], np.cumsum(you)))
    left, right = np.maximum(np.arange(len(you)) - NEAR, off[doc]), np.minimum(np.arange(len(you)) + NEAR + 1, off[doc + 1])
    aimed = (insult | (weight > 0)) & (beside[right] > beside[left])
    caps = np.concatenate(([0], np.cumsum(_UPPER[data])))
    letters = np.concatenate(([0], np.cumsum(_LETTER[data])))
    shout = (ends - starts >= 3) & (caps[ends] - caps[starts] == ends - starts)
    wide_s, wide_e, wide_off = ts.words(data, at, _WIDE)
    odd = (letters[wide_e] - letters[wide_s] < wide_e - wide_s) & (letters[wide_e] > letters[wide_s])
    wide_doc = np.repeat(np.arange(n), np.diff(wide_off))
    plain = ts.word_hashes(_LEET[data], wide_s, wide_e)
    hidden = odd & ((_known(plain, hashes_of(INSULTS)) >= 0) | (_known(plain, lexicon[0]) >= 0))
    size = np.maximum(np.diff(at), 1).astype(float)
    marks = {c: np.concatenate(([0], np.cumsum(data == ord(c)))) for c in "!?*#"}
    total = lambda sums: (sums[at[1:]] - sums[at[:-1]]).astype(float)
    odds = np.bincount(wide_doc[odd], None, n).astype(float)
    concealed = np.bincount(wide_doc[hidden], None, n).astype(float)
    peak = np.zeros(n)
    np.maximum.at(peak, doc, weight)
    heavy = weight > 2
    return np.stack(
        [
            np.log1p(count), per(insult), per(insult) / words, per(telling[0]), per(telling[0]) / words,
            *(per(telling[k]) for k in (1, 2, 3)), *(per(telling[k]) / words for k in (1, 2, 3)),
            per(weight > 0, weight), per(weight > 0, weight) / words, per(heavy), per(aimed), per(you) / words,
            total(caps) / np.maximum(total(letters), 1), per(shout) / words, total(marks["!"]) / size, total(marks["?"]) / size,
            odds / words, concealed, peak, concealed / words,
        ],
        1,
    )


def _form_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(form, toxic, clean): documents with a form, for each slice."""
    for batch in batches:
        for rows, data, at in ts.pieces(batch):
            low = ts.LOWER[data]
            starts, ends, off = ts.words(low, at, _CORE)
            doc = np.repeat(np.arange(len(rows)), np.diff(off))
            h = np.concatenate(_forms(low, starts, ends))
            d = np.tile(doc, len(STEMS) + 1)
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            h, d = h[new], d[new]
            toxic = np.asarray(rows.column("toxic"))[d]
            if len(h):
                first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                bad, all_of = np.add.reduceat(toxic, first), np.diff(np.append(first, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(ts.signed(h[first])), pa.array(bad.astype(np.int64)), pa.array((all_of - bad).astype(np.int64))], names=["form", "toxic", "clean"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS):
    """Lexicon, trees and calibration from at most `rows` labelled documents that are not held out."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # thinned by the same hash first, so that what tasks send for the sample does not grow with the labels
    rank, share = F.xxhash64("doc_id"), min(1.0, 2 * rows / max(usable.count(), 1))
    usable = usable.filter(rank <= F.lit(hash_bound(share)))
    sample = cut(usable.orderBy(rank, "doc_id").limit(rows).withColumn("part", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(10))))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    counts = texts.filter("part < 4").select("text", "toxic").mapInArrow(_form_counts, "form long, toxic long, clean long")
    sizes = sample.filter("part < 4").agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    bad, good = sizes[0], sizes[1] - sizes[0]
    tell = F.log(((F.col("toxic") + 0.5) / F.lit(bad + 1.0)) / ((F.col("clean") + 0.5) / F.lit(good + 1.0)))
    found = counts.groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter("toxic >= 3").withColumn("weight", tell).filter("weight > 1.5")
    found = found.orderBy(F.col("toxic").desc(), F.col("weight").desc(), "form").limit(LEXICON_ROWS).select("form", "weight").collect()
    forms = np.array([r["form"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(forms)
    lexicon = forms[order], np.array([r["weight"] for r in found])[order] if len(found) else np.zeros(0)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, at in ts.pieces(batch):
                x = features(data, at, lexicon)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("part"), piece.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "part", "toxic", "x"])

    # a row for each labelled document, however many rows it has
    got = texts.filter("part >= 4").select("doc_id", "part", "toxic", "text").mapInArrow(rows_of, "doc_id long, part long, toxic int, x array<double>")
    got = got.groupBy("doc_id").agg(F.min(F.struct("part", "toxic", "x")).alias("r")).select("r.*").toPandas()
    got = got.sample(frac=1, random_state=0) if len(got) else got
    x = np.array(got["x"].tolist(), float).reshape(-1, FEATURES)
    y, part = got["toxic"].to_numpy(float), got["part"].to_numpy()
    order = np.lexsort((*x.T, y, part))  # rows come in any order; the model must not
    x, y, part = x[order], y[order], part[order]
    trees = BoostedTrees().fit(x[part < 8], y[part < 8])
    return lexicon, trees, Isotonic(trees.raw(x[part >= 8]), y[part >= 8]), bool(len(y))


def _scored(docs: DataFrame, labels: DataFrame, rows: int, columns: list[str]) -> DataFrame:
    """These columns of docs as _c0, _c1 and so on, and _score. The second is text."""
    lexicon, trees, calibrate, trained = train(docs, labels, rows)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, at in ts.pieces(batch, "_c1"):
                s = calibrate(trees.raw(features(data, at, lexicon))) if trained else np.zeros(len(piece))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(np.clip(s, 0, 1))], names=[*piece.schema.names, "_score"])

    taken = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)])
    return taken.mapInArrow(scored, T.StructType([*taken.schema.fields, T.StructField("_score", T.DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    doc_id, s = F.col("_c0"), F.col("_score")
    out = _scored(docs, labels, rows, ["doc_id", "text"])
    return out.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), s.alias("score"), (s >= CUTOFF).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns, whatever their names."""
    columns = list(dict.fromkeys(("doc_id", "text", *docs.columns)))
    out = _scored(docs, labels, rows, columns).filter(F.col("_score") < CUTOFF)
    return out.select(*[F.col(f"_c{columns.index(c)}").alias(c) for c in docs.columns])
