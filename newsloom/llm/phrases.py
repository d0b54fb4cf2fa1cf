"""Phrase collocations by vertical partitioning of a depth-truncated suffix tree.

Words are counted first. Their counts, summed over BUCKETS of the words' hashes, give the
vertical partition: runs of buckets are grouped so that a group's suffixes stay within
MEMORY, and a bucket with more than that is split by the second word. Then each position
whose first two words are frequent gives a suffix of up to three words; equal ones are counted where they
are read, and each group builds its part of the tree alone: it sorts its leaves, and
reads the counts of two- and three-word nodes from runs of leaf totals. Nodes under LEAST keep no
candidate, so they end there. Candidates are scored by joins with the counts of their parts.

The tree streams: a task holds one batch of sorted leaves and the two runs that are open.
Two tables are sent to all tasks, both of fixed size: the partition (BUCKETS entries)
and a bitmap of the frequent words' hashes (FILTER bits), which lets rare words end a suffix
early; a false hit only costs a leaf. Words stand in the tree as 64-bit hashes of
language and word.

Defined results: null or empty texts have no words; a null language is `und`, as is a
language of that name; repeated rows count each; a null doc_id changes nothing; empty tables
give no rows; columns of other names are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.candidates import FILTER, bitmap
from newsloom.llm.durable import cut
from newsloom.llm.textscan import LOWER, mix, pieces, signed, word_hashes, words

LEAST, TOP, COVERED = 10, 2000, 50
#: Suffixes in a group of prefixes, and the parts that hashes are summed in.
MEMORY, BUCKETS = 250_000, 1 << 16
#: Suffixes that are counted together before they leave a task.
GATHER = 600_000
_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", 10, 11, 12, 13]] = True
_APART = _PIECE.copy()
_APART[[9, 32]] = True
_U = np.uint64


def _read(batch: pa.RecordBatch) -> Iterator[tuple]:
    """For slices of documents: lower-cased bytes, words' starts and ends, hashes with the language mixed in, each word's row, and which words end a piece."""
    lang = batch.column("lang").fill_null("und")
    batch = pa.RecordBatch.from_arrays([batch.column("text"), lang], names=["text", "lang"])
    for part, data, at in pieces(batch):
        data = LOWER[data]
        starts, ends, off = words(data, at, _APART)
        if not len(starts):
            continue
        row = np.repeat(np.arange(len(part)), np.diff(off))
        codes = part.column("lang").dictionary_encode()
        salts = np.array([_salt(x) for x in codes.dictionary.to_pylist()], np.uint64)
        hashes = mix(word_hashes(data, starts, ends) ^ salts[codes.indices.to_numpy()][row])
        breaks = np.concatenate(([0], np.cumsum(_PIECE[data])))
        last = np.ones(len(starts), bool)
        last[:-1] = (breaks[starts[1:]] != breaks[ends[:-1]]) | (row[1:] != row[:-1])
        yield part, data, starts, ends, hashes, row, last


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, h, f for the distinct words of each slice."""
    for batch in batches:
        for part, data, starts, ends, hashes, row, _ in _read(batch):
            keys, first, counts = np.unique(hashes, return_index=True, return_counts=True)
            lengths = (ends - starts)[first]
            off = np.concatenate(([0], np.cumsum(lengths)))
            if off[-1] >= 1 << 31:
                raise ValueError("the distinct words of one text pass 2 GiB")
            where = np.repeat(starts[first] - off[:-1], lengths) + np.arange(off[-1])
            text = pa.StringArray.from_buffers(len(first), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data[where].tobytes()))
            yield pa.RecordBatch.from_arrays([part.column("lang").take(pa.array(row[first])), text, pa.array(signed(keys)), pa.array(counts.astype(np.int64))], names=["lang", "word", "h", "f"])


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, h, f over all words."""
    return docs.select("text", "lang").mapInArrow(_counted_words, "lang string, word string, h long, f long").groupBy("lang", "word", "h").agg(F.sum("f").alias("f"))


def partition(counts: DataFrame, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """The first group of each bucket and the parts that it is split into. counts: word_counts() of frequent words."""
    sums = counts.groupBy(F.pmod("h", F.lit(BUCKETS)).alias("bucket")).agg(F.sum("f").alias("f"))
    total = np.zeros(BUCKETS, np.int64)
    for r in sums.toLocalIterator():  # BUCKETS rows at most
        total[r.bucket] = r.f
    parts = np.maximum(1, -(-total // memory))
    first, group, filled = np.zeros(BUCKETS, np.int64), 0, 0
    for b in range(BUCKETS):
        if filled + total[b] > memory and filled:
            group, filled = group + 1, 0
        first[b], filled = group, filled + int(total[b])
        if parts[b] > 1:
            group, filled = group + int(parts[b]), 0
    return first, parts


def _leaves(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal columns of keys (three rows) added up."""
    order = np.lexsort(keys[::-1])
    keys = keys[:, order]
    new = np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(0)))
    return keys[:, new], np.add.reduceat(counts[order], np.flatnonzero(new))


def suffixes(docs: DataFrame, frequent: np.ndarray, first: np.ndarray, parts: np.ndarray) -> DataFrame:
    """group, h1, h2, h3 (0: the suffix ends after two words) and n: leaves of the tree, counted as far as one task has read."""
    sent = docs.sparkSession.sparkContext.broadcast((frequent, first, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, first, parts = sent.value
        held, size = [], 0

        def leave() -> pa.RecordBatch:
            keys, counts = _leaves(np.concatenate([k for k, _ in held], 1), np.concatenate([c for _, c in held]))
            bucket = (keys[0] % _U(BUCKETS)).astype(np.int64)
            group = first[bucket] + (keys[1] % parts[bucket].astype(np.uint64)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), *[pa.array(signed(k)) for k in keys], pa.array(counts)], names=["group", "h1", "h2", "h3", "n"])

        for batch in batches:
            for *_, hashes, _, last in _read(batch):
                at = (hashes % _U(FILTER)).astype(np.int64)
                known = (frequent[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) > 0
                go = known[:-1] & known[1:] & ~last[:-1]  # two words on
                two = np.flatnonzero(go)
                third = np.zeros(len(two), np.uint64)
                more = np.concatenate((go[1:], [False]))[two] if len(go) else np.zeros(0, bool)
                third[more] = hashes[two[more] + 2]
                if len(two):
                    held.append(_leaves(np.stack((hashes[two], hashes[two + 1], third)), np.ones(len(two), np.int64)))
                    size += held[-1][0].shape[1]
                if size > GATHER:
                    yield leave()
                    held, size = [], 0
        if held:
            yield leave()

    return docs.select("text", "lang").mapInArrow(run, "group int, h1 long, h2 long, h3 long, n long")


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted leaves to nodes h1, h2, h3 (null: of two words) and f, those of LEAST or more."""

    def runs(keys: np.ndarray, counts: np.ndarray, open_: tuple | None) -> tuple[np.ndarray, np.ndarray, tuple]:
        """The runs of equal keys that are over, and the one that is not."""
        if open_ is not None:
            keys, counts = np.concatenate((open_[0], keys), 1), np.concatenate((open_[1], counts))
        begin = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(0))))
        sums, keys = np.add.reduceat(counts, begin), keys[:, begin]
        return keys[:, :-1], sums[:-1], (keys[:, -1:], sums[-1:])

    def nodes(keys: np.ndarray, sums: np.ndarray, deep: bool) -> pa.RecordBatch:
        keep = (sums >= LEAST) & ((keys[2] != 0) if deep else True)
        third = pa.array(keys[2][keep]) if deep else pa.nulls(int(keep.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(keys[0][keep]), pa.array(keys[1][keep]), third, pa.array(sums[keep])], names=["h1", "h2", "h3", "f"])

    open_: dict[bool, tuple | None] = {True: None, False: None}
    for batch in batches:
        if len(batch):
            keys = np.stack([batch.column(c).to_numpy() for c in ("h1", "h2", "h3")])
            for deep in (True, False):
                over, sums, open_[deep] = runs(keys if deep else keys[:2], batch.column("n").to_numpy(), open_[deep])
                yield nodes(over, sums, deep)
    for deep, rest in open_.items():
        if rest is not None:
            yield nodes(*rest, deep)


def tree(leaves: DataFrame) -> DataFrame:
    """h1, h2, h3, f: the tree's nodes of two and three words that occur LEAST times or more."""
    sorted_ = leaves.repartition("group").sortWithinPartitions("h1", "h2", "h3").select("h1", "h2", "h3", "n")
    return sorted_.mapInArrow(_subtrees, "h1 long, h2 long, h3 long, f long")


def collocations(docs: DataFrame, top: int = TOP, memory: int = MEMORY) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two and three words."""
    counts = cut(word_counts(docs))
    size = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = cut(counts.filter(F.col("f") >= LEAST))
    nodes = cut(tree(suffixes(docs, bitmap(frequent, "h"), *partition(frequent, memory))))
    two, three = nodes.filter("h3 IS NULL").select("h1", "h2", F.col("f").alias("a")), nodes.filter("h3 IS NOT NULL").withColumnRenamed("f", "a")
    word = lambda k, count: frequent.select(F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}"), F.col("f").alias(count), *(["lang"] if k == 1 else []))
    pair = lambda i, j, count: two.select(F.col("h1").alias(f"h{i}"), F.col("h2").alias(f"h{j}"), F.col("a").alias(count))
    # the most frequent phrase of three words around each of two
    around = three.select(F.explode(F.array(F.struct("h1", "h2"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2")))).alias("p"), F.col("a").alias("longer"))
    around = around.groupBy("p.h1", "p.h2").agg(F.max("longer").alias("longer"))
    score = lambda l, r: F.expr(f"CAST(1000000 * CAST(a AS DECIMAL(38, 0)) * CAST(a AS DECIMAL(38, 0)) div (CAST({l} AS DECIMAL(38, 0)) * CAST({r} AS DECIMAL(38, 0))) AS BIGINT)")
    bare = two.join(around, ["h1", "h2"], "left").filter(F.coalesce(100 * F.col("longer") < COVERED * F.col("a"), F.lit(True))).drop("longer")
    pairs = bare.join(word(1, "l"), "h1").join(word(2, "r"), "h2").select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", score("l", "r").alias("score"))
    cuts = three.join(pair(1, 2, "f12"), ["h1", "h2"]).join(pair(2, 3, "f23"), ["h2", "h3"]).join(word(1, "f1"), "h1").join(word(2, "f2"), "h2").join(word(3, "f3"), "h3")
    cuts = cuts.withColumn("early", score("f1", "f23")).withColumn("late", score("f12", "f3"))
    lower = lambda early, late: F.when(F.col("early") <= F.col("late"), F.col(early)).otherwise(F.col(late))
    triples = cuts.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", lower("f1", "f12").alias("l"), lower("f23", "f3").alias("r"), lower("early", "late").alias("score"))
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = pairs.unionByName(triples).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(size, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH s AS (SELECT coalesce(lang, 'und') AS lang, unnest(list_transform(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]'), lambda x: regexp_extract_all(x, '[^\x20\x09]+'))) AS p FROM documents),
g AS (SELECT lang, unnest(p) AS w1, unnest(list_append(p[2:], NULL)) AS w2, unnest(list_concat(p[3:], [NULL, NULL])) AS w3 FROM s WHERE len(p) > 0),
t AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w1 IS NOT NULL GROUP BY ALL),
u AS (SELECT lang, w1 AS w, sum(f)::BIGINT AS f FROM t GROUP BY ALL), n AS (SELECT lang, sum(f)::BIGINT AS n FROM u GROUP BY lang),
b AS (SELECT lang, w1, w2, sum(f)::BIGINT AS a FROM t WHERE w2 IS NOT NULL GROUP BY ALL HAVING sum(f) >= 10),
c AS (SELECT lang, w1, w2, w3, f AS a FROM t WHERE w3 IS NOT NULL AND f >= 10),
o AS (SELECT lang, x, y, max(a) AS longer FROM (SELECT lang, w1 AS x, w2 AS y, a FROM c UNION ALL SELECT lang, w2, w3, a FROM c) GROUP BY ALL),
p2 AS (SELECT b.lang, w1 || ' ' || w2 AS phrase, b.a, x.f AS l, y.f AS r, (1000000::HUGEINT * b.a * b.a // (x.f::HUGEINT * y.f))::BIGINT AS score FROM b JOIN u x ON x.lang = b.lang AND x.w = w1 JOIN u y ON y.lang = b.lang AND y.w = w2
  LEFT JOIN o ON o.lang = b.lang AND o.x = w1 AND o.y = w2 WHERE longer IS NULL OR 100 * longer < 50 * b.a),
k AS (SELECT c.*, x.f AS f1, z.f AS f3, e.a AS f12, d.a AS f23, (1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * d.a))::BIGINT AS s1, (1000000::HUGEINT * c.a * c.a // (e.a::HUGEINT * z.f))::BIGINT AS s2 FROM c JOIN u x ON x.lang = c.lang AND x.w = c.w1
  JOIN u z ON z.lang = c.lang AND z.w = c.w3 JOIN b e ON e.lang = c.lang AND e.w1 = c.w1 AND e.w2 = c.w2 JOIN b d ON d.lang = c.lang AND d.w1 = c.w2 AND d.w2 = c.w3),
p3 AS (SELECT lang, w1 || ' ' || w2 || ' ' || w3 AS phrase, a, CASE WHEN s1 <= s2 THEN f1 ELSE f12 END AS l, CASE WHEN s1 <= s2 THEN f23 ELSE f3 END AS r, least(s1, s2) AS score FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM (SELECT * FROM p2 UNION ALL SELECT * FROM p3))
SELECT r.lang, rank, phrase, a, l, r, n, score FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""
