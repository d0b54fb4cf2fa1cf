"""Substring dedup of bytes with run-length indexes.

Every window of LENGTH bytes is filed under its anchor, the lowest-ranked stretch of
PART bytes in it, so equal windows are filed alike; the windows of a document that
share an anchor make one passage. Anchors that occur once are dropped. The distinct
passages of an anchor go, with those of other anchors, into a shard of bounded size.
A shard is indexed by its Burrows-Wheeler transform in runs. Within a run, the match
of a suffix with its neighbour is that of the suffix one byte earlier, less one, so
match lengths are only sampled at run ends; matching statistics of all positions
are streamed from these samples. A window is repeated if its position matches for at
least LENGTH bytes, or if its passage occurs more than once.

An anchor with more than HOT_PASSAGES distinct passages is taken apart into windows
that are counted by their hashes, so that no shard holds an unbounded group.

Defined results: null is the empty text; windows never cross documents; a repeat within
one document counts as well as one elsewhere; rows that repeat a doc_id must be equal and are repeats
of each other; rows whose doc_id is null take no part and stay whole; an empty table gives no rows; only doc_id and text are read.
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

LENGTH = 400
PART = 64
SHARD_BYTES = 1_000_000
HOT_PASSAGES = 2_000

_U = np.uint64
_SPAN = 1024
_STEP = 64


def _order(values: np.ndarray) -> np.ndarray:
    """argsort of values from 0 up; with the places in the lower bits a plain sort does, which is faster."""
    bits = len(values).bit_length()
    if len(values) and int(values.max()).bit_length() + bits > 63:
        return np.argsort(values)
    return np.sort((values << bits) | np.arange(len(values))) & ((1 << bits) - 1)


class RunLengthIndex:
    """Of several byte strings, each closed by an end mark. Matches shorter than least may count as 0."""

    def __init__(self, strings: list[bytes], least: int = 0) -> None:
        n = sum(map(len, strings)) + len(strings)
        self.starts = np.concatenate(([0], np.cumsum([len(s) + 1 for s in strings])))[:-1].astype(np.int64)
        ends = self.starts + np.array([len(s) for s in strings], np.int64)
        self.text = text = np.zeros(n + _STEP, np.int16)  # 0: an end mark
        text[:n] = np.frombuffer(b"\0".join([*strings, b""]), np.uint8).astype(np.int16) + 1
        text[ends] = 0
        self.n = n
        self.to_end = (np.repeat(ends, np.diff(np.concatenate((self.starts, [n])))) - np.arange(n)).astype(np.int32)
        order, alike = self._sort(text, n, least)
        before = text[order - 1]
        before[order == 0] = 0
        #: The transform's runs: heads[i] .. heads[i + 1] - 1 have one byte.
        self.heads = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        self.bytes = before[self.heads]
        last = np.concatenate((self.heads[1:], [n])) - 1
        # what follows an end mark is another string, so such runs are sampled throughout
        loose = np.flatnonzero(before == 0)
        first, last = np.union1d(self.heads, loose), np.union1d(last, loose)
        #: Samples, text position and match with the neighbour outside the run, for first and last suffix of each run.
        self.up = self._sample(order[first], order[first - 1], first > 0, alike)
        self.down = self._sample(order[last], order[(last + 1) % n], last < n - 1, alike)

    def _sample(self, at: np.ndarray, neighbour: np.ndarray, there: np.ndarray, alike: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        found = np.zeros(len(at), np.int64)
        on = np.flatnonzero(there if alike is None else there & (alike[at] == alike[neighbour]))
        found[on] = self._match(at[on], neighbour[on])
        return at, found

    @staticmethod
    def _sort(text: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray | None]:
        """Order of the suffixes: by 4 bytes, then doubling where suffixes still tie. Also groups of
        suffixes that are alike in the longest length of at most least that doubling passes."""
        alike = None
        key = np.zeros(n, np.int64)
        for k in range(4):
            key = (key << 9) | text[k : k + n]
        order = _order(key)
        new = np.concatenate(([True], np.diff(key[order]) != 0))
        del key
        rank = np.empty(n + 1, np.int64)  # the first place of a suffix's group; the empty suffix is first of all
        span = 4
        rank[n] = -1
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        while True:
            if span <= least < 2 * span:
                alike = rank[:n].copy()
            tied = np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))
            if not len(tied):
                return order, alike if alike is not None or span > least else rank[:n]
            suffix = order[tied]
            group = rank[suffix]
            both = group * (n + 1) + rank[np.minimum(suffix + span, n)] + 1
            by = _order(both)
            suffix, both = suffix[by], both[by]
            order[tied] = suffix  # groups are in order of their places, so all stay in their own
            fresh = np.concatenate(([True], both[1:] != both[:-1]))
            new[tied] = fresh
            rank[suffix] = np.maximum.accumulate(np.where(fresh, tied, 0))
            span *= 2

    def _match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix lengths of suffixes a and b, up to the nearer end mark."""
        out = np.zeros(len(a), np.int64)
        steps = np.arange(_STEP)
        for c in range(0, len(a), 1 << 14):
            x, y, found = a[c : c + (1 << 14)], b[c : c + (1 << 14)], out[c : c + (1 << 14)]
            on = np.arange(len(x))
            while len(on):
                # a block of bytes at a time for the pairs that still agree
                i, j = (x[on] + found[on])[:, None] + steps, (y[on] + found[on])[:, None] + steps
                left = self.text[i]
                agree = (left == self.text[j]) & (left != 0)
                run = np.where(agree.all(axis=1), _STEP, agree.argmin(axis=1))
                found[on] += run
                on = on[run == _STEP]
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each text position, the longest match of its suffix elsewhere, streamed from the samples."""
        n = self.n
        best = np.zeros(n, np.int64)
        for at, length in (self.up, self.down):
            end = np.full(n, -1, np.int64)
            known = np.zeros(n, np.int64)
            known[at] = at
            end[at] = at + length
            best = np.maximum(best, end[np.maximum.accumulate(known)] - np.arange(n))
        return np.maximum(best, 0)


def _anchors(batches: Iterator[pa.RecordBatch], length: int, part: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, at in ts.pieces(batch):
            sums = ts.prefix(data)
            m = max(len(data) - part + 1, 0)
            down = ts.powers(len(sums), ts._BASE_INVERSE, "down")
            order = (sums[part : part + m] - sums[:m]) * down[:m] * _U(0xFF51AFD7ED558CCD)
            order ^= order >> _U(29)
            order *= _U(0xC4CEB9FE1A85EC53)
            doc, window, count, anchor = ts.anchor_runs(order, at, length, part)
            whole = ts.stretches(sums, window, window + count + length - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ts.signed(ts.stretches(sums, anchor, anchor + part))),
                    pa.array(ts.signed(ts.mix(whole + (anchor - window).astype(np.uint64)))),
                    rows.column("doc_id").take(pa.array(doc)),
                    pa.array((window - at[doc]) * _SPAN + count),
                ],
                names=["key", "passage", "doc_id", "at"],
            )


def _read_passages(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, at in ts.pieces(batch):
            wanted = rows.column("wanted")
            flat = wanted.flatten()
            of = np.repeat(np.arange(len(rows)), np.diff(np.asarray(wanted.offsets)))
            where = np.asarray(flat.field("at"))
            a = at[of] + where // _SPAN
            texts = [data[x:y].tobytes() for x, y in zip(a, a + where % _SPAN + length - 1, strict=True)]
            yield pa.RecordBatch.from_arrays([flat.field("key"), flat.field("passage"), flat.field("hot"), pa.array(texts, pa.binary())], names=["key", "passage", "hot", "body"])


def _ranges(flags: np.ndarray) -> list[int]:
    """Alternating first and end of the runs of true flags."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge).tolist()


def _stream(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    pdf = pdf.drop_duplicates(["key", "passage"])
    bodies = list(pdf["body"])
    index = RunLengthIndex(bodies, length)
    found = index.matching_statistics() >= length
    out = [_ranges(found[s : s + len(b) - length + 1]) for s, b in zip(index.starts, bodies, strict=True)]
    return pd.DataFrame({"key": pdf["key"], "passage": pdf["passage"], "ranges": out})


def _windows(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        parts = []
        for key, passage, body in zip(pdf["key"], pdf["passage"], pdf["body"], strict=True):
            sums = ts.prefix(np.frombuffer(body, np.uint8))
            a = np.arange(len(body) - length + 1)
            parts.append(pd.DataFrame({"key": key, "passage": passage, "place": a, "window": ts.signed(ts.stretches(sums, a, a + length))}))
        if parts:
            yield pd.concat(parts)


def _keep(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, at in ts.pieces(batch):
            n_removed, n_spans, kept = [], [], []
            for i, found in enumerate(rows.column("cuts").to_pylist()):
                text = data[at[i] : at[i + 1]]
                if found:
                    gone = np.zeros(len(text) + 1, np.int32)
                    for x in found:
                        low, r = x["at"] // _SPAN, x["ranges"]
                        for a, b in zip(r[::2], r[1::2], strict=True):
                            gone[low + a] += 1
                            gone[low + b + length - 1] -= 1
                    gone = np.cumsum(gone[:-1]) > 0
                    n_removed.append(int(gone.sum()))
                    n_spans.append(int(np.count_nonzero(np.diff(np.concatenate(([False], gone)).astype(np.int8)) == 1)))
                    text = text[~gone]
                else:
                    n_removed.append(0)
                    n_spans.append(0)
                kept.append(text.tobytes())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.diff(at)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def repeated_bytes(docs: DataFrame, length: int = LENGTH, part: int = PART, hot: int = HOT_PASSAGES) -> DataFrame:
    """doc_id, cuts: the passages (at = first byte * 1024 + windows, ranges of repeated windows) of documents that lose bytes."""
    if not 0 < part <= length or length - part + 1 >= _SPAN:
        raise ValueError(f"part must be from 1 to length, and above length - {_SPAN - 1}")
    texts = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    filed = lambda d: d.mapInArrow(lambda it: _anchors(it, length, part), "key long, passage long, doc_id long, at long")
    shared = cut(shared_by_several(texts, filed, docs.count(), apart=False))
    distinct = shared.groupBy("key", "passage").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "at")).alias("f"))
    distinct = cut(distinct.select("key", "passage", "copies", F.col("f.doc_id").alias("doc_id"), F.col("f.at").alias("at")))
    kinds = distinct.join(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    copied = distinct.filter("copies > 1").select("key", "passage", F.array(F.lit(0), (F.col("at") % _SPAN).cast("int")).alias("ranges"))
    wanted = cut(kinds.filter("n > 1").groupBy("doc_id").agg(F.collect_list(F.struct("key", "passage", "at", (F.col("n") > hot).alias("hot"))).alias("wanted")))
    passages = cut(texts.join(wanted, "doc_id").mapInArrow(lambda it: _read_passages(it, length), "key long, passage long, hot boolean, body binary"))
    total = passages.filter("not hot").agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_BYTES))
    streamed = (
        passages.filter("not hot")
        .withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(lambda pdf: _stream(pdf, length), "key long, passage long, ranges array<int>")
    )
    apart = passages.filter("hot").dropDuplicates(["key", "passage"]).mapInPandas(lambda it: _windows(it, length), "key long, passage long, place int, window long")
    often = apart.groupBy("window").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("window")
    apart = apart.join(often, "window").select("key", "passage", F.array(F.col("place"), F.col("place") + 1).alias("ranges"))
    single = distinct.filter("copies = 1").select("key", "passage")
    ranges = cut(copied.unionByName(streamed.filter(F.size("ranges") > 0).join(single, ["key", "passage"], "left_semi")).unionByName(apart.join(single, ["key", "passage"], "left_semi")))
    return shared.join(ranges, ["key", "passage"]).groupBy("doc_id").agg(F.collect_list(F.struct("at", "ranges")).alias("cuts"))


def drop_repeats(docs: DataFrame, length: int = LENGTH, part: int = PART) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept: every document without its repeated bytes."""
    cuts = cut(repeated_bytes(docs, length, part))
    joined = docs.select("doc_id", "text").join(cuts, "doc_id", "left")
    return joined.mapInArrow(lambda it: _keep(it, length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
