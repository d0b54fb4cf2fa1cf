"""Repair of damaged conversations by alignment to an alternating grammar.

A conversation's rows, in turn order, are aligned to the strings of `(s?(ua)+)?`: keeping a
row costs 0, giving it the role user or assistant 1, deleting it 2, inserting an empty turn 5,
and a truncated row that stays 5 more; blank and duplicate rows must go. Strings of even
length are prefixes of `uaua...`, those of odd length of `suaua...`, so two Wagner-Fischer
matrices hold the alignments to all feasible lengths: their cells are the costs from
there to the end of any string. Ukkonen bands leave out the cells that no alignment as
cheap as the incumbent can touch; the incumbent is a greedy repair first, then the best of
the strings aligned before. A forward walk takes the least letter that stays optimal, which gives the
least audit of a matrix, and the audits of both are compared.

Faults are found by Spark. Rows reach the alignment as one byte each, sorted by
conversation, and stream: a task holds the bytes of one conversation and about the square root of its
length in rows of the matrix. Texts take a second shuffle, behind their conversation's audit, and are hashed one
by one. A conversation is one sequence with one audit and one hash, so it stays in one task; no task holds its texts.

Defined results: a null conv_id is a conversation of its own; null roles and texts are one
space; turns that are null come first; rows of one turn are ordered by role, then by digest of
role and text, with the copies that damage makes behind; repeated rows are duplicates; a conversation all of whose
rows were dropped has zeros, an empty audit and the hash of the empty string; an empty
table gives no rows; columns of other names are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FAR = 1 << 29
WORD = r"[^\x20\x09-\x0D]"
ORDER = ("turn", "role", "digest", "copy")
#: Bits of a row's byte beside its initial: 0 other, 1 s, 2 u, 3 a.
GO, CUT_OFF, BLANK, DUPLICATE = 4, 8, 16, 32
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy, and gone for rows that only say that their conversation is there."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), fate.alias("fate"))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("fate") == 0).alias("gone"))


def undamaged(conversations: DataFrame) -> DataFrame:
    """The columns of damage() for conversations as they are."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", "turn", known("role"), known("text"), F.lit(0).alias("copy"), F.lit(False).alias("gone"))


def _keyed(rows: DataFrame) -> DataFrame:
    """With digest: of role and text, the same for rows that are alike."""
    return rows.withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, copy and byte (null for rows that are gone), dealt by conversation."""
    shown = F.regexp_extract("text", rf"({WORD})[\x20\x09-\x0D]*$", 1)
    blank, off = ~F.col("text").rlike(WORD), ~shown.isin(".", "!", "?")
    initial = F.array_position(F.array(*map(F.lit, "sua")), F.substring("role", 1, 1))
    narrow = _keyed(rows).select("conv_id", "turn", "role", "digest", "copy", "gone", initial.cast("int").alias("initial"), blank.alias("blank"), off.alias("off"))
    seen = F.row_number().over(W.partitionBy("conv_id", "gone", "digest").orderBy("turn", "copy")) > 1
    byte: Column = F.col("initial") + F.when(F.col("blank"), GO + BLANK).when(seen, GO + DUPLICATE).when(F.col("off"), CUT_OFF).otherwise(0)
    return narrow.repartition("conv_id").select("conv_id", "turn", "role", "digest", "copy", F.when(~F.col("gone"), byte).alias("byte"))


def _greedy(codes: bytes) -> int:
    """The cost of one repair without inserts: a row that doesn't fit goes if the next fits in its place, else it changes its role."""
    rows = [c & 3 for c in codes if not c & (GO | CUT_OFF)]
    cost, want = DELETE * (len(codes) - len(rows)), 2
    for i, c in enumerate(rows):
        if c != want:
            if c == 0 or i + 1 < len(rows) and rows[i + 1] == want:
                cost += DELETE
                continue
            cost += REROLE
        want = 5 - want
    return cost + DELETE * (want == 3)


class _Matrix:
    """Costs to align rows i.. to a string from place j on, up to any feasible length; head: whether the string starts with s."""

    def __init__(self, codes: bytes, head: bool, incumbent: int) -> None:
        self.codes, self.head = codes, head
        self.must = np.concatenate(([0], np.cumsum(np.frombuffer(codes, np.uint8) & GO > 0))).astype(np.int64)
        n = len(codes)
        self.slack = incumbent - DELETE * int(self.must[n])
        self.width = n - int(self.must[n]) + max(0, self.slack) // INSERT
        self.step = max(1, math.isqrt(n))
        if self.slack < 0:
            self.total = FAR
            return
        self.saved = {n: self._end()}
        for stop in range(n, 0, -self.step):
            low = max(0, stop - self.step)
            self.saved[low] = self._block(low, stop)[0]
        self.total = int(self.at(0, 0)) if self.band(0)[0] == 0 else FAR

    def band(self, i: int) -> tuple[int, int]:
        """First place and end of the places that row i can meet: each place behind is a deletion, each before an insertion."""
        free = i - int(self.must[i])
        return min(max(0, free - self.slack // DELETE), self.width), min(self.width, free + self.slack // INSERT) + 1

    def target(self, j: int) -> int:
        return 1 if self.head and j == 0 else 2 + (j + self.head) % 2

    def _end(self) -> np.ndarray:
        low, high = self.band(len(self.codes))
        j = np.arange(low, high)
        if not self.head:
            return np.where(j % 2 == 0, 0, INSERT)
        return np.where(j == 0, FAR, np.where(j < 3, INSERT * (3 - j), np.where(j % 2 == 1, 0, INSERT)))

    def _row(self, i: int, below: np.ndarray) -> np.ndarray:
        (low, high), (low_, high_) = self.band(i), self.band(i + 1)
        code = self.codes[i]
        after = np.full(high - low + 1, FAR, np.int64)
        begin, end = max(low, low_), min(high + 1, high_)
        after[begin - low : end - low] = below[begin - low_ : end - low_]
        best = after[:-1] + DELETE
        if not code & GO:
            j = np.arange(low, high)
            target = 2 + (j + self.head) % 2
            change = np.where(target == code & 3, 0, REROLE)
            if self.head and low == 0:
                change[0] = 0 if code & 3 == 1 else FAR
            best = np.minimum(best, after[1:] + change + (TRUNCATED if code & CUT_OFF else 0))
        # inserting up to any later place; s is never inserted
        first = 1 if self.head and low == 0 else 0
        j = np.arange(low + first, high)
        best[first:] = np.minimum.accumulate((best[first:] + INSERT * j)[::-1])[::-1] - INSERT * j
        return np.minimum(best, FAR)

    def _block(self, low: int, stop: int) -> list[np.ndarray]:
        rows = [self.saved[stop]]
        for i in range(stop - 1, low - 1, -1):
            rows.append(self._row(i, rows[-1]))
        return rows[::-1]

    def at(self, i: int, j: int) -> int:
        low, high = self.band(i)
        return int(self.row(i)[j - low]) if low <= j < high else FAR

    def row(self, i: int) -> np.ndarray:
        if i in self.saved:
            return self.saved[i]
        n = len(self.codes)
        stop = n - (n - i) // self.step * self.step
        low = max(0, stop - self.step)
        if getattr(self, "held", (-1, None))[0] != low:
            self.held = (low, self._block(low, stop))
        return self.held[1][i - low]

    def audit(self) -> str:
        """The least of the audits that cost total."""
        i = j = 0
        out, n, left = [], len(self.codes), self.total
        while i < n or left:
            go = self.codes[i] & GO if i < n else 0
            insertable = not (self.head and j == 0)
            stay = TRUNCATED if i < n and self.codes[i] & CUT_OFF else 0
            if i < n and self.at(i + 1, j) + DELETE == left:
                i, left = i + 1, left - DELETE
                out.append("D")
            elif insertable and self.at(i, j + 1) + INSERT == left:
                j, left = j + 1, left - INSERT
                out.append("I")
            else:
                kept = self.codes[i] & 3 == self.target(j)
                assert i < n and not go
                left -= stay + (0 if kept else REROLE)
                i, j = i + 1, j + 1
                out.append("K" if kept else "R")
        return "".join(out)


def _align(codes: bytes) -> tuple[int, str]:
    incumbent, best = min(DELETE * len(codes), _greedy(codes)), None
    for head in (False, True):
        m = _Matrix(codes, head, incumbent)
        if m.total <= incumbent:
            found = (m.total, m.audit())
            best = found if best is None else min(best, found)
            incumbent = m.total
    return best


_short = lru_cache(1 << 14)(_align)


def align(codes: bytes) -> tuple[int, str]:
    """The least cost and, of the audits at that cost, the least in ASCII order."""
    return _short(codes) if len(codes) <= 32 else _align(codes)


#: What repair() counts of a conversation without rows.
NOTHING = (0, 0, 0, 0, 0, 0, "")


def _figures(codes: np.ndarray, turns: np.ndarray) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost and audit of a conversation's bytes, and its turns without nulls."""
    if not len(codes):
        return NOTHING
    initial = codes & 3
    pairs = initial[:-1] * 4 + initial[1:]
    illegal = len(pairs) - int(np.isin(pairs, (1 * 4 + 2, 2 * 4 + 3, 3 * 4 + 2)).sum())
    gaps = int(turns[-1] - turns[0]) + 1 - (1 + int((turns[1:] != turns[:-1]).sum())) if len(turns) else 0
    n = lambda bit: int((codes & bit > 0).sum())
    return (gaps, n(BLANK), n(DUPLICATE), n(CUT_OFF), illegal, *align(codes.tobytes()))


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of conv_id, turn and byte to REPORT."""
    names = [x.split()[0] for x in REPORT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()]
    began, conv, codes, turns = False, None, [], []
    done: list[tuple] = []

    def close() -> None:
        done.append((conv, *_figures(np.concatenate(codes) if codes else np.zeros(0, np.uint8), np.concatenate(turns) if turns else np.zeros(0, np.int64))))

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        done.clear()
        return out

    for batch in batches:
        if not len(batch):
            continue
        ids, byte, turn = batch.column("conv_id").to_pylist(), batch.column("byte"), batch.column("turn")
        edges = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)]
        for start, stop in zip(edges, edges[1:], strict=False):
            if began and ids[start] != conv:
                close()
                codes, turns = [], []
            began, conv = True, ids[start]
            there = byte.slice(start, stop - start)
            codes.append(there.drop_null().to_numpy(zero_copy_only=False).astype(np.uint8))
            turns.append(turn.slice(start, stop - start).filter(there.is_valid()).drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
        if done:
            yield flush()
    if began:
        close()
        yield flush()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's report, then its rows in order, to the report with repaired_sha256."""
    report: dict | None = None
    sha, audit, at, place = hashlib.sha256(), "", 0, 0
    done: list[dict] = []

    def add(role: str, text: str) -> None:
        nonlocal place
        sha.update(f"{chr(10) * (place > first)}{role}:{text}".encode())
        place += 1

    def wanted() -> str:
        return "user" if place % 2 == 0 else "assistant"

    def inserts() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            add(wanted(), "")
            at += 1

    def close() -> None:
        if report is not None:
            inserts()
            done.append(report | {"repaired_sha256": sha.hexdigest()})

    first, schema = 0, None
    for batch in batches:
        schema = schema or pa.schema([*(batch.schema.field(n) for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")), pa.field("repaired_sha256", pa.string())])
        for row in batch.to_pylist():
            if row["audit"] is not None:
                close()
                report = {k: row[k] for k in schema.names[:-1]}
                sha, audit, at = hashlib.sha256(), row["audit"], 0
                # even places are the user's: a string with an s has an odd length and starts at -1
                first = place = -(sum(x != "D" for x in audit) % 2)
                continue
            inserts()
            edit, at = audit[at], at + 1
            if edit != "D":
                add(row["role"] if edit == "K" else wanted(), row["text"])
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
            done.clear()
    close()
    if done:
        yield pa.RecordBatch.from_pylist(done, schema)


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conversation of damage() or undamaged()."""
    ordered = faults(rows).sortWithinPartitions("conv_id", *ORDER)
    found = ordered.select("conv_id", "turn", "byte").mapInArrow(_aligned, REPORT)
    lines = _keyed(rows.filter("NOT gone")).select("conv_id", *ORDER, "text")
    both = found.select("*", F.lit(0).alias("rank")).unionByName(lines.withColumn("rank", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "rank", *ORDER)
    return dealt.drop("rank", "turn", "digest", "copy").mapInArrow(_hashed, REPORT + ", repaired_sha256 string")
