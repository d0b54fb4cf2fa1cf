r"""Substring dedup of word windows with suffix automata of reference shards.

A window is LENGTH consecutive words. Each window is filed under its anchor, the
lowest-ranked run of PART words in it, so equal windows are filed alike; the windows
of a document that share an anchor make one passage. Anchors of a single document
are dropped. For the others, the distinct passages of an anchor are reference text,
each with the smallest document that has it. References are dealt to shards of
bounded size by anchor; a shard's task builds one suffix automaton of its references,
entered by growing doc_id, so that every state knows the smallest document with its
strings, and streams the passages through it: matching statistics of at least LENGTH
give each window's first document. A window of a later document is removed. (Automata
of the whole corpus have no size bound, so they meet their passages by shuffle
instead of being broadcast.) Where only one distinct passage is left for an anchor,
its matching statistics are its own length and its first document is the answer.

An anchor with more than HOT_PASSAGES distinct passages is taken apart into its
windows, whose first documents are found by a grouped minimum, so that no shard
holds an unbounded group.

Defined results: words are [^\x20\x09-\x0D]+ unchanged; null or empty texts have no
words and keep the empty string; windows repeated within one document only are kept;
rows that repeat a doc_id must be equal and count as one document; rows whose doc_id is
null take no part and stay whole; an empty table gives no rows;
only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import textscan as ts
from newsloom.llm.candidates import shared_by_several
from newsloom.llm.durable import cut

LENGTH = 13
PART = 4
SHARD_PASSAGES = 20_000
HOT_PASSAGES = 2_000

_U = np.uint64


class SuffixAutomaton:
    """Of several sequences; the state of a string knows the first sequence's mark that has it."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def add(self, symbols: list[int], mark: int) -> None:
        """Marks must not fall from one call to the next."""
        following, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for c in symbols:
            q = following[last].get(c)
            if q is not None:
                if length[q] != length[last] + 1:
                    q = self._split(last, c, q)
                last = q
                continue
            new = len(link)
            following.append({})
            link.append(0)
            length.append(length[last] + 1)
            first.append(mark)
            p = last
            while p >= 0 and c not in following[p]:
                following[p][c] = new
                p = link[p]
            if p >= 0:
                q = following[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = new

    def _split(self, p: int, c: int, q: int) -> int:
        following, link = self.next, self.link
        copy = len(link)
        following.append(dict(following[q]))
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        self.first.append(self.first[q])
        link[q] = copy
        while p >= 0 and following[p].get(c) == q:
            following[p][c] = copy
            p = link[p]
        return copy

    def first_marks(self, symbols: list[int], size: int) -> list:
        """For each window of size symbols, the first mark that has it; None if none has."""
        out, state, match = [], 0, 0
        for i, c in enumerate(symbols):
            while state and c not in self.next[state]:
                state = self.link[state]
                match = self.length[state]
            if c in self.next[state]:
                state, match = self.next[state][c], match + 1
            while state and self.length[self.link[state]] >= size:
                state = self.link[state]
                match = min(match, self.length[state])
            if i + 1 >= size:
                out.append(self.first[state] if match >= size else None)
        return out


def _anchors(batches: Iterator[pa.RecordBatch], length: int, part: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, at in ts.pieces(batch):
            starts, ends, off = ts.words(data, at)
            h = ts.word_hashes(data, starts, ends)
            g = ts.grams(h, part)
            doc, window, count, anchor = ts.anchor_runs(g, off, length, part)
            sums = np.concatenate(([_U(0)], np.cumsum(h * ts.powers(len(h)))))
            whole = ts.stretches(sums, window, window + count + length - 1)
            ids = rows.column("doc_id").take(pa.array(doc))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ts.signed(g[anchor])), pa.array(ts.signed(ts.mix(whole + (anchor - window).astype(np.uint64)))), ids, pa.array((window - off[doc]) * 64 + count)],
                names=["key", "passage", "doc_id", "at"],
            )


def _read_passages(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, at in ts.pieces(batch):
            starts, ends, off = ts.words(data, at)
            h = ts.word_hashes(data, starts, ends)
            wanted = rows.column("wanted")
            flat = wanted.flatten()
            of = np.repeat(np.arange(len(rows)), np.diff(np.asarray(wanted.offsets)))
            where = np.asarray(flat.field("at"))
            a = off[of] + where // 64
            texts = [h[x:y].tobytes() for x, y in zip(a, a + where % 64 + length - 1, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [flat.field("key"), flat.field("passage"), rows.column("doc_id").take(pa.array(of)), flat.field("hot"), pa.array(texts, pa.binary())],
                names=["key", "passage", "first", "hot", "symbols"],
            )


def _stream(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    pdf = pdf.sort_values("first", kind="stable")
    automaton = SuffixAutomaton()
    texts = [np.frombuffer(x, np.int64).tolist() for x in pdf["symbols"]]
    for symbols, first in zip(texts, pdf["first"], strict=True):
        automaton.add(symbols, first)
    return pd.DataFrame({"key": pdf["key"], "passage": pdf["passage"], "firsts": [automaton.first_marks(symbols, length) for symbols in texts]})


def _windows(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        parts = []
        for key, passage, first, symbols in zip(pdf["key"], pdf["passage"], pdf["first"], pdf["symbols"], strict=True):
            w = ts.signed(ts.grams(np.frombuffer(symbols, np.uint64), length))
            parts.append(pd.DataFrame({"key": key, "passage": passage, "first": first, "place": np.arange(len(w)), "window": w}))
        yield pd.concat(parts) if parts else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("key", "passage", "first", "place", "window")})


def _keep(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, cuts, n_words, n_removed, kept = batch.column("text"), batch.column("cuts"), [], [], []
        for text, found in zip(texts, cuts, strict=True):
            w = (text.as_py() or "").encode().split()
            n = len(w)
            if found.is_valid:
                gone = np.zeros(n + 1, np.int32)
                for x in found.as_py():
                    low = x["at"] // 64
                    for j in range(x["at"] % 64):
                        if x["mask"] >> j & 1:
                            gone[low + j] += 1
                            gone[low + j + length] -= 1
                w = [x for x, g in zip(w, np.cumsum(gone[:n]).tolist(), strict=True) if not g]
            n_words.append(n)
            n_removed.append(n - len(w))
            kept.append(b" ".join(w))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
        )


def repeated_windows(docs: DataFrame, length: int = LENGTH, part: int = PART, hot: int = HOT_PASSAGES) -> DataFrame:
    """doc_id, cuts: the passages (at = first word * 64 + windows, mask of removed windows) of documents that lose words."""
    if not 0 < part <= length or length - part + 1 > 62:
        raise ValueError("part must be from 1 to length, and above length - 62")
    texts = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    filed = lambda d: d.mapInArrow(lambda it: _anchors(it, length, part), "key long, passage long, doc_id long, at long")
    shared = cut(shared_by_several(texts, filed, docs.count(), apart=True))
    distinct = shared.groupBy("key", "passage").agg(F.min(F.struct("doc_id", "at")).alias("f"))
    distinct = cut(distinct.select("key", "passage", F.col("f.doc_id").alias("first"), F.col("f.at").alias("at")))
    kinds = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    kinds = distinct.join(kinds, "key")
    alone = kinds.filter("n = 1").select("key", "passage", F.expr("array_repeat(first, int(at % 64))").alias("firsts"))
    wanted = kinds.filter("n > 1").groupBy(F.col("first").alias("doc_id")).agg(F.collect_list(F.struct("key", "passage", "at", (F.col("n") > hot).alias("hot"))).alias("wanted"))
    wanted = cut(wanted)
    passages = cut(
        texts.join(wanted, "doc_id").mapInArrow(lambda it: _read_passages(it, length), "key long, passage long, first long, hot boolean, symbols binary")
    )
    shards = max(1, -(-passages.filter("not hot").count() // SHARD_PASSAGES))
    streamed = (
        passages.filter("not hot")
        .withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(lambda pdf: _stream(pdf, length), "key long, passage long, firsts array<long>")
    )
    apart = passages.filter("hot").mapInPandas(lambda it: _windows(it, length), "key long, passage long, first long, place int, window long")
    least = apart.groupBy("window").agg(F.min("first").alias("least"))
    apart = apart.join(least, "window").groupBy("key", "passage").agg(F.sort_array(F.collect_list(F.struct("place", "least"))).alias("o")).select("key", "passage", F.col("o.least").alias("firsts"))
    firsts = cut(alone.unionByName(streamed).unionByName(apart))
    bits = F.aggregate(
        F.transform("firsts", lambda x, j: F.when(x < F.col("doc_id"), F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)
    )
    return shared.join(firsts, ["key", "passage"]).withColumn("mask", bits).filter("mask <> 0").groupBy("doc_id").agg(F.collect_list(F.struct("at", "mask")).alias("cuts"))


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept: every document without the windows that an earlier one has."""
    cuts = cut(repeated_windows(docs, length))
    joined = docs.select("doc_id", "text").join(cuts, "doc_id", "left")
    return joined.select("doc_id", "text", "cuts").mapInArrow(lambda it: _keep(it, length), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM p),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
x AS (SELECT doc_id, unnest(range(i, i + 13)) AS k FROM g JOIN f USING (g) WHERE first < doc_id),
r AS (SELECT doc_id, list(DISTINCT k) AS gone FROM x GROUP BY doc_id),
k AS (SELECT d.doc_id, w, list_filter(range(1, len(w) + 1), lambda i: gone IS NULL OR NOT list_contains(gone, i)) AS stay FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(stay))::BIGINT AS n_removed, sha256(array_to_string(list_transform(stay, lambda i: w[i]), ' ')) AS kept_sha256 FROM k
"""
