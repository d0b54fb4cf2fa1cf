r"""Personal data by patterns, and terms that disclose it by information theory.

Base spans are found by pattern: e-mail addresses, IP addresses, card numbers with a
valid check digit, phone numbers; leftmost and non-overlapping per kind.

A base span's value is a protected entity. The terms of a document are its distinct words
outside base spans, wherever they stand. They are weighed by how strongly they reveal the
entities of their documents: with document counts of the whole corpus (copies count as
documents of their own), pmi(entity, term) = log2(N * n(entity, term) / (n(entity) * n(term)))
over the entity's information content log2(N / n(entity)) is the share of it that the term
gives away. A term that gives away at least THRESHOLD, in at least SUPPORT documents and
at least TIES of the entity's own, is a span of its own (kind "term") at each place where
it stands outside base spans, in any document. Counts alone would make each rare word of a
mail that was copied once a term, so the entity's documents must also use the term in
different surroundings. A side of a term is the least hash (31 bits) of the SIDE words before
or after it, least over its places in the document; none at a text's end. Of all different
pairs of sides in the entity's documents, more than half must differ on the left, and more
than half on the right. Exact copies have one pair, and near copies mostly change one side
at a time; so a term that is only ever used in one passage is not told from that passage. Sanitising removes base spans for their kind
and generalises terms: a term that is a number to [number], else to its coarser class
[name] or [word].

Entities of the same documents have the same counts, and are weighed as one. Pairs with a
term that is too common for its entity, even if it were in all of the entity's documents,
are dropped before they are counted where the term is among the few very common ones. The
places of terms are screened by a bitmap of BITS bits, then joined with the terms.

Counts of terms are partial sums per task of word hashes, added up by shuffle; a term in
every document is one row of each task.

Defined results: null is the empty text; texts without spans give empty strings and the
hash of the empty string; repeated rows count as documents of their own; an empty table
gives no rows; only doc_id and text are read. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import textscan as ts
from newsloom.llm.durable import cut, narrow

KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.8
SUPPORT = 2
TIES = 0.5
FLUSH = 400_000
#: Words before and after a term that are its surroundings.
SIDE = 6
#: A term in more than this share of the documents is very common.
COMMON = 0.001
BITS = 1 << 26
#: Each block of the bitmap is made by one task.
BLOCK = 1 << 20

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a number run that fails from its start fails from within, so only starts of runs are tried
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DIGIT = re.compile(r"[0-9]")
_SIGNS = np.zeros(256, bool)
_SIGNS[list(b"@+0123456789")] = True


def emails(text: str) -> list[tuple[int, int]]:
    """Found from their signs: the local part is the run before one, so no run is read twice."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            out.append((start, host.end()))
            free = host.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


def _hash64(kind: str, value: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


def _words(data: np.ndarray, at: np.ndarray) -> tuple:
    """Document, start, end (bytes) and hash of each word outside base spans; base spans as (document, text, spans); the documents' bounds in all words, all words' hashes, and which stand outside."""
    signs = np.concatenate(([0], np.cumsum(_SIGNS[data])))
    starts, ends, off = ts.words(data, at)
    h = ts.word_hashes(data, starts, ends)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(off))
    free, found = np.ones(len(h), bool), []
    for i in np.flatnonzero(signs[at[1:]] > signs[at[:-1]]).tolist():
        text = data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace")
        spans = base_spans(text)
        if spans:
            found.append((i, text, spans))
            a, b = at[i] + _in_bytes(text, np.array([x[1:] for x in spans]).T)
            # spans of several kinds may overlap: a word is taken if more spans begin before its end than end by its start
            mine = slice(off[i], off[i + 1])
            free[mine] = np.searchsorted(np.sort(a), ends[mine], "left") == np.searchsorted(np.sort(b), starts[mine], "right")
    return doc[free], starts[free], ends[free], h[free], found, off, h, free


def _in_bytes(text: str, places: np.ndarray) -> np.ndarray:
    """Places in code points as places in UTF-8."""
    if text.isascii():
        return places
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    size = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    return np.concatenate(([0], np.cumsum(size)))[places]


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def _sides(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least 31-bit hash of the SIDE words before and after each word of its document; -1 if there are none."""
    short = (h >> np.uint64(33)).astype(np.int32)
    none = np.iinfo(np.int32).max
    left, right = np.full(len(h), none, np.int32), np.full(len(h), none, np.int32)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    for k in range(1, SIDE + 1):
        same = doc[k:] == doc[:-k]
        left[k:] = np.minimum(left[k:], np.where(same, short[:-k], none))
        right[:-k] = np.minimum(right[:-k], np.where(same, short[k:], none))
    return np.where(left == none, -1, left), np.where(right == none, -1, right)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct entities and terms of each document that has base spans, terms with their sides."""
    for batch in batches:
        for _, data, at in ts.pieces(batch):
            doc, _, _, h, found, off, every, free = _words(data, at)
            owners = np.array([i for i, *_ in found], np.int64)
            left, right = (x[free] for x in _sides(every, off))
            mine = np.isin(doc, owners)
            doc, h, left, right = doc[mine], h[mine], left[mine], right[mine]
            order = np.lexsort((h, doc))
            doc, h, left, right = doc[order], h[order], left[order], right[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            at_new = np.flatnonzero(new)
            sides = [np.minimum.reduceat(x, at_new) if len(x) else x for x in (left, right)]
            terms = pa.StructArray.from_arrays([pa.array(ts.signed(h[new])), *map(pa.array, sides)], names=["term", "left", "right"])
            bounds = np.append(np.searchsorted(doc[new], owners), len(at_new)).astype(np.int32)
            entities = [sorted({_hash64(k, text[a:b].lower()) for k, a, b in spans}) for _, text, spans in found]
            yield pa.RecordBatch.from_arrays([pa.array(entities, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(bounds), terms)], names=["entities", "terms"])


def _mark(batches: Iterator[pa.RecordBatch], bits: np.ndarray, texts: bool) -> Iterator[pa.RecordBatch]:
    """Base spans of each document, and the places of words whose bit is set; with its text, if wanted."""
    base_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    near_type = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
    n = np.uint64(8 * len(bits))
    for batch in batches:
        for rows, data, at in ts.pieces(batch):
            doc, starts, ends, h, found, *_ = _words(data, at)
            bit = h % n
            some = (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
            doc, starts, ends, h = doc[some], starts[some], ends[some], h[some]
            points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            start, end = points[starts] - points[at[doc]], points[ends] - points[at[doc]]
            base = [[] for _ in range(len(rows))]
            for i, _, spans in found:
                base[i] = [{"kind": KINDS.index(k), "start": a, "end": b} for k, a, b in spans]
            flat = pa.StructArray.from_arrays([pa.array(ts.signed(h)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["term", "start", "end"])
            places = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(at))).astype(np.int32)), flat).cast(near_type)
            own = [rows.column(c) for c in ("doc_id", "text")[: 1 + texts]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(base, base_type), places], names=[*("doc_id", "text")[: 1 + texts], "base", "places"])


def _bitmap(terms: DataFrame, bits: int) -> np.ndarray:
    """The bits of terms by hash modulo bits; made in blocks, so the driver holds bits / 8 bytes."""
    block = min(BLOCK, bits)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        bit = pdf["term"].to_numpy().view(np.uint64) % np.uint64(bits)
        held = np.zeros(block, bool)
        held[(bit % np.uint64(block)).astype(np.int64)] = True
        return pd.DataFrame({"block": [int(bit[0]) // block], "held": [np.packbits(held, bitorder="little").tobytes()]})

    # bits is a power of two, so the low bits of a signed hash are those of the unsigned one
    out = np.zeros(bits // 8, np.uint8)
    for row in terms.groupBy(F.floor(F.col("term").bitwiseAND(F.lit(bits - 1)) / block).alias("of")).applyInPandas(fill, "block long, held binary").toLocalIterator():
        at = row.block * block // 8
        out[at : at + block // 8] = np.frombuffer(row.held, np.uint8)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each word hash, added up within a task as far as memory is bounded."""
    held = [np.zeros(0, np.uint64), np.zeros(0, np.int64)]

    def add(h, n):
        both = np.concatenate((held[0], h))
        u, inverse = np.unique(both, return_inverse=True)
        held[:] = u, np.bincount(inverse, weights=np.concatenate((held[1], n)), minlength=len(u)).astype(np.int64)

    def out():
        return pa.RecordBatch.from_arrays([pa.array(ts.signed(held[0])), pa.array(held[1])], names=["term", "n"])

    for batch in batches:
        for _, data, at in ts.pieces(batch):
            doc, _, _, h, *_ = _words(data, at)
            _, h = _distinct(doc, h)
            add(h, np.ones(len(h), np.int64))
            if len(held[0]) > FLUSH:
                yield out()
                held[:] = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    yield out()


def find(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT, ties: float = TIES, common: float = COMMON, bits: int = BITS, texts: bool = False) -> DataFrame:
    """doc_id, base, terms: the spans of every document, terms as array<struct<start, end>>; also its text, if wanted."""
    total = float(max(docs.count(), 1))
    content = F.log2(F.lit(total) / F.col("n_entity"))
    pmi = lambda both: F.log2(F.lit(total) * both / (F.col("n_entity") * F.col("n_term")))
    terms = cut(docs.select("text").mapInArrow(_count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term")).filter(F.col("n_term") >= support))
    read = docs.select("text").mapInArrow(_read, "entities array<bigint>, terms array<struct<term:bigint,left:int,right:int>>")
    # a number for each row, as doc_id may repeat or be null
    read = cut(read.withColumn("row", F.monotonically_increasing_id()))
    # an entity in fewer documents than the support has no term; class: the entities of the same documents
    of = [F.bit_xor(F.xxhash64("row", F.lit(i))) for i in range(2)]
    entities = read.select("row", F.explode("entities").alias("entity"))
    classes = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), F.struct(*of).alias("class")).filter((F.col("n_entity") >= support) & (content > 0))
    classes = cut(entities.join(classes, "entity").select("row", "class", "n_entity").distinct())
    pairs = classes.join(read.select("row", "terms"), "row").select("class", "n_entity", F.inline("terms"))
    often = narrow(terms.filter(F.col("n_term") > common * total))
    possible = F.col("n_term").isNull() | (pmi(F.least("n_entity", "n_term")) >= threshold * content)
    pairs = pairs.join(often, "term", "left").filter(possible).drop("n_term").groupBy("class", "n_entity", "term")
    pairs = pairs.agg(F.count(F.lit(1)).alias("both"), *[(F.min(c) != F.max(c)).alias(c) for c in ("left", "right")])
    pairs = pairs.filter((F.col("both") >= support) & (F.col("both") >= ties * F.col("n_entity")) & F.col("left") & F.col("right"))
    pairs = cut(pairs.join(terms, "term").filter(pmi(F.col("both")) >= threshold * content).select("class", "term"))
    met = read.select("row", F.inline("terms")).join(narrow(pairs.select("term").distinct()), "term").join(classes, "row").join(narrow(pairs), ["class", "term"])
    met = met.groupBy("class", "term").agg(F.count_distinct("left", "right").alias("n"), *[F.count_distinct(c).alias(c) for c in ("left", "right")])
    telling = cut(met.filter(2 * F.least("left", "right") > F.greatest("n", F.lit(2))).select("term").distinct())
    held = _bitmap(telling, bits)
    sent = docs.sparkSession.sparkContext.broadcast(held)
    place = "array<struct<term:bigint,start:int,end:int>>"
    whole = "text string, " if texts else ""
    marked = docs.select("doc_id", "text").mapInArrow(lambda it: _mark(it, sent.value, texts), f"doc_id long, {whole}base array<struct<kind:int,start:int,end:int>>, places {place}")
    marked = cut(marked.withColumn("row", F.monotonically_increasing_id()))
    spans = marked.select("row", F.inline("places")).join(telling, "term").groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("terms"))
    return marked.join(spans, "row", "left").select("doc_id", *["text"] * texts, "base", F.coalesce("terms", F.array().cast("array<struct<start:int,end:int>>")).alias("terms"))


def report(docs: DataFrame) -> DataFrame:
    """The counts and digests of find()."""
    s = find(docs)
    names = F.array(*[F.lit(k) for k in KINDS])
    written = F.transform("base", lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"]))
    extra = F.transform("terms", lambda x: F.concat_ws(":", F.lit("term"), x["start"], x["end"]))
    kinds = F.col("base.kind")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return s.select("doc_id", *counts, F.sha2(F.array_join(written, ","), 256).alias("base_sha256"), F.array_join(F.concat(written, extra), ",").alias("spans"), F.size("terms").cast("long").alias("n_term"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs' doc_id and text, base spans removed for [kind] and terms generalised; a null text gives the empty one, and each row, ids repeated or null, its own."""

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for text, base, terms in zip(pdf["text"], pdf["base"], pdf["terms"], strict=True):
                text = text or ""
                spans = [(x["start"], x["end"], KINDS[x["kind"]]) for x in base]
                for x in terms:
                    word = text[x["start"] : x["end"]]
                    spans.append((x["start"], x["end"], "number" if _DIGIT.search(word) else "name" if word[:1].isupper() else "word"))
                out, at = [], 0
                for a, b, kind in sorted(spans):
                    if b > at:
                        out += [text[at : max(a, at)], f"[{kind}]"] if a >= at else []
                        at = b
                texts.append("".join([*out, text[at:]]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts})

    return find(docs, texts=True).mapInPandas(rewrite, "doc_id long, text string")
