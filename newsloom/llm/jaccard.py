r"""N-gram Jaccard join by partitioning the universe of shingles.

A document is the set of its distinct n-word shingles (64-bit hashes). A size band
b (sizes from its low to its high end) has its own partition of the universe into
m segments, by a hash of the shingle. Two sets of at most `high` shingles and a
similarity of at least t differ in at most H = floor((1 - t) / (1 + t) * 2 * high)
shingles. A segment is allotted 0 (its subset must be the same) or 1 (one shingle
more or less; then the subset and all subsets with one deletion are indexed), so
that the allotments plus one add up to H + 1 + spare. By the pigeonhole principle
some segment of a linked pair differs by no more than its allotment. Segments in
which a set has nothing are skipped by it: two sets can only have lost their match
by that if both skipped more than `spare`; such sets index their empty segments too.
How many segments get 1, and the spare, come from a cost model of index rows and
chance candidates (`allot`).

A set also looks into the next band if a partner could be there. Sets that share a
key are candidates. All sets of a key are held against the key's first set, its hub.
A set has a parity bitmap, in which each shingle turns over one bit; the bits in which
two bitmaps differ are at most as many as the shingles in which the sets differ, so a
pair that differs in too many bits is not linked, and only other pairs are compared, exactly and on
whole sets. Sets of one component need no more, and two sets whose bitmaps differ from the
hub's by counts too far apart cannot be linked. Sets that share a key share its hub, so the other pairs meet at
their hubs, however many keys they share. First some members near the hub (PIVOTS) meet all others, as that joins most that are linked at all.
Those leave the join whose components still differ and whose bitmaps, of SCREEN bits and of some bits for each shingle, may be linked, each at the
smallest hub that it has in common only; they go through the same two steps. So what a crowd of sets that are alike but not linked (the variants of
one much copied text) sends on is the pairs near the threshold, though the join itself looks at each pair that
shares a hub and is not told apart by it. If these pairs are many, the nearest of each two components is compared
first, as one link makes the others needless. New links join the components there are.

A node is a distinct set, so copies cost nothing after the first in each task.

Defined results: A-Z become lower case, words are [^\x20\x09-\x0D]+; texts with fewer
than n words give their whole word sequence as one shingle; null or empty texts give
the empty set, linked with nothing; each row is a document, so rows that repeat a doc_id give
rows each; rows whose doc_id is null are linked with nothing and have a null component; an
empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import textscan as ts
from newsloom.llm.candidates import crowded, live
from newsloom.llm.durable import cut, discard, narrow
from newsloom.llm.links import components

_U = np.uint64
#: Sets of up to this many nodes are remembered by a task to leave out copies.
SEEN = 300_000
NEEDED_ROWS = 400_000
#: Of a bitmap, in powers of 2. Sets of one key differ in size by a factor of 4 at most, if percent is 50 or more.
LEAST_BITS, MOST_BITS = 1_024, 65_536
#: Bits of the bitmap that a join compares, a multiple of 64.
SCREEN = 256
#: Times that only the nearest pair of two components is compared, before all that are left are; none if those are FEW at most.
ROUNDS, FEW = 1, 20_000
#: Members of a hub, the nearest to it of each share of them, that are held against all others of it first.
PIVOTS = 4


def shingle_sets(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document, one after another, and their offsets."""
    data = ts.LOWER[data]
    starts, ends, of = ts.words(data, at)
    hashes = ts.word_hashes(data, starts, ends)
    sets = []
    all_grams = ts.grams(hashes, n)
    for i in range(len(at) - 1):
        a, b = int(of[i]), int(of[i + 1])
        if b - a >= n:
            g = np.sort(all_grams[a : b - n + 1])
            sets.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
        elif b > a:
            sets.append(ts.grams(hashes[a:b], b - a) ^ _U(b - a))
        else:
            sets.append(hashes[:0])
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), offsets


def bands(t: Fraction, largest: int = 1 << 40) -> list[tuple[int, int]]:
    """Low and high sizes. Wider bands have fewer sets that look into two, but more segments:
    about 1.4 times wide costs the fewest index rows, in whole steps of 1 / t."""
    out, low, steps = [], 1, max(1, round(0.32 / math.log(1 / t)))
    while low <= largest:
        high = max(low, math.floor(low / t**steps))
        out.append((low, high))
        low = high + 1
    return out


def allot(low: int, high: int, t: Fraction, n_docs: int) -> tuple[int, int, int]:
    """Segments with allotment 0 and 1, and the spare, of the least cost for a band."""
    differ = math.floor((1 - t) / (1 + t) * 2 * high)
    best = None
    for ones in sorted({0, (differ + 1) // 4, (differ + 1) // 2}):
        for skip in (False, True):
            spare = 0
            for _ in range(4 * skip):  # enough for all but about 1 of 10000 sets to skip no more
                blank = _blank(differ + 1 + spare - 2 * ones, ones, low)
                spare = math.ceil(blank + 3.7 * math.sqrt(blank)) if blank > 1e-4 else 0
            zeros = differ + 1 + spare - 2 * ones
            load = low / (zeros + ones)
            rows = zeros + ones * (2 + load)
            # partners by chance: an indexed segment that is blank in both, or one shingle that many texts have
            both_blank = _blank(zeros, ones, low) * (1e-8 if skip else math.exp(-load))
            chance = both_blank + 1e-5 * zeros * (load * math.exp(-load)) ** 2 + ones * (math.exp(-load) * (1 + load)) ** 2
            cost = rows + 20 * chance * n_docs
            if best is None or cost < best[0]:
                best = (cost, zeros, ones, spare)
    return best[1:]


def _blank(zeros: int, ones: int, size: int) -> float:
    """Segments with allotment 0 that a set is expected to leave blank."""
    return zeros * (1 - 1 / (zeros + ones)) ** size if zeros + ones else 0.0


def band_table(t: Fraction, n_docs: int) -> np.ndarray:
    """low, high, smallest partner of the band, zeros, ones, spare; for every band."""
    return np.array([(low, high, math.ceil(low * t), *allot(low, high, t, n_docs)) for low, high in bands(t, 1 << 26)], np.int64)


def _keys(sets: np.ndarray, off: np.ndarray, which: np.ndarray, band: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of the sets `which`, each by the partition of its band; with the set of each key."""
    low = table[band]
    zeros, ones, spare = low[:, 3], low[:, 4], low[:, 5]
    m = zeros + ones
    size = off[which + 1] - off[which]
    base = np.concatenate(([0], np.cumsum(m)))
    take = np.arange(size.sum()) + np.repeat(off[which] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
    h = sets[take]
    salt = ts.mix((band.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))
    seg = (ts.mix(h ^ np.repeat(salt, size)) % np.repeat(m, size).astype(np.uint64)).astype(np.int64)
    flat = np.repeat(base[:-1], size) + seg
    h = ts.mix(h)
    sums = np.zeros(base[-1], np.uint64)
    np.add.at(sums, flat, h)
    count = np.bincount(flat, minlength=base[-1])
    owner = np.repeat(np.arange(len(which)), m)
    number = np.arange(base[-1]) - base[:-1][owner]
    place = ts.mix(salt[owner] + number.astype(np.uint64))
    one = number < ones[owner]
    blank = (count == 0) & ~one
    skipped = np.add.reduceat(blank, base[:-1]) if len(which) else np.zeros(0)
    keep = ~blank | (skipped > spare)[owner]
    keys, owners = [ts.mix(sums ^ place)[keep]], [owner[keep]]
    lone = np.repeat(ones, size) > seg
    if lone.any():
        f = flat[lone]
        keys.append(ts.mix((sums[f] - h[lone]) ^ place[f]))
        owners.append(owner[f])
    return np.concatenate(keys), np.concatenate(owners)


def parities(sets: np.ndarray, off: np.ndarray) -> list[bytes]:
    """For each set a bitmap of some two bits for a shingle, of LEAST_BITS to MOST_BITS, a power of 2: shingles turn bits over."""
    size = np.diff(off)
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)
    base = np.concatenate(([0], np.cumsum(bits)))
    place = (ts.mix(sets ^ _U(0x5851F42D4C957F2D)) & (np.repeat(bits, size) - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(np.repeat(base[:-1], size) + place, minlength=base[-1]) & 1).astype(np.uint8)
    data = np.packbits(odd, bitorder="little").tobytes()
    return [data[a:b] for a, b in zip(base[:-1] // 8, base[1:] // 8, strict=True)]


def screens(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each set a bitmap of SCREEN bits, as rows of 64-bit words: shingles turn bits over."""
    n = len(off) - 1
    place = (ts.mix(sets ^ _U(0x2545F4914F6CDD1D)) % _U(SCREEN)).astype(np.int64)
    odd = (np.bincount(np.repeat(np.arange(n) * SCREEN, np.diff(off)) + place, minlength=n * SCREEN) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(n, SCREEN // 64)


def folded(bitmap: bytes, n: int) -> int:
    """The bitmap as an integer of n bytes: what larger ones have further up is folded on to it."""
    value, size = int.from_bytes(bitmap, "little"), len(bitmap)
    while size > n:
        size //= 2
        value = (value >> 8 * size) ^ (value & ((1 << 8 * size) - 1))
    return value


def _screen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """far: a lower bound of the shingles in which a and b differ; gap: one that is alike for all b near a in size;
    bits: the bitmap of b, as long for all such b that are not under half as large as a, else null."""
    for pdf in batches:
        far, gap, bits = [], [], []
        for a, b in zip(pdf["parity_a"], pdf["parity_b"], strict=True):
            n = min(len(a), len(b))
            far.append((folded(a, n) ^ folded(b, n)).bit_count())
            n = max(LEAST_BITS // 8, len(a) // 4)
            gap.append((folded(a, n) ^ folded(b, n)).bit_count())
            n = max(LEAST_BITS // 8, len(a) // 2)
            bits.append(np.frombuffer(folded(b, n).to_bytes(n, "little"), np.int64) if len(b) >= n else None)
        yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "n_a": pdf["n_a"], "n_b": pdf["n_b"], "far": far, "gap": gap, "bits": bits})


def _nodes(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    size = np.diff(off)
    node = np.zeros(len(size), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        node[full] = ts.mix(np.add.reduceat(ts.mix(sets), off[full]) + size[full].astype(np.uint64))
    return node


def _sketch(batches: Iterator[pa.RecordBatch], n: int, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    highs = table[:, 1]
    for batch in batches:
        for rows, data, at in ts.pieces(batch):
            sets, off = shingle_sets(data, at, n)
            size, node = np.diff(off), _nodes(sets, off)
            new = []
            for i in np.flatnonzero(size):
                x = int(node[i])
                if x not in seen:
                    new.append(i)
                    if len(seen) < SEEN:
                        seen.add(x)
            which = np.array(new, np.int64)
            band = np.searchsorted(highs, size[which])
            up = np.minimum(band + 1, len(table) - 1)
            more = (size[which] >= table[up, 2]) & (up > band)
            keys, owner = _keys(sets, off, np.concatenate((which, which[more])), np.concatenate((band, up[more])), table)
            owner = np.concatenate((which, which[more]))[owner] if len(owner) else owner
            order = np.argsort(owner, kind="stable")
            at_key = np.searchsorted(owner[order], np.arange(len(size) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(ts.signed(node)), pa.array(parities(sets, off), pa.binary()),
                    pa.FixedSizeListArray.from_arrays(pa.array(screens(sets, off).reshape(-1)), SCREEN // 64).cast(pa.list_(pa.int64())),
                    pa.ListArray.from_arrays(pa.array(at_key), pa.array(ts.signed(keys[order]))),
                ],
                names=["doc_id", "n_shingles", "node", "parity", "screen", "keys"],
            )


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The sets of the nodes named; rows that share only the doc_id of one give none."""
    for batch in batches:
        for rows, data, at in ts.pieces(batch):
            sets, off = shingle_sets(data, at, n)
            own = ts.signed(_nodes(sets, off)) == rows.column("node").to_numpy(zero_copy_only=False)
            items = [sets[off[i] : off[i + 1]].tobytes() for i in np.flatnonzero(own)]
            yield pa.RecordBatch.from_arrays([rows.column("node").filter(pa.array(own)), pa.array(items, pa.binary())], names=["node", "items"])


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        shared, whole = [], []
        last, mine = None, None
        for a, b in zip(pdf["items_a"], pdf["items_b"], strict=True):
            if a is not last:
                last, mine = a, np.frombuffer(a, np.uint64)
            other = np.frombuffer(b, np.uint64)
            if len(mine) > len(other):
                place = np.searchsorted(mine, other)
                same = int(np.count_nonzero(mine[np.minimum(place, len(mine) - 1)] == other))
            else:
                place = np.searchsorted(other, mine)
                same = int(np.count_nonzero(other[np.minimum(place, len(other) - 1)] == mine))
            shared.append(same)
            whole.append(len(mine) + len(other) - same)
        yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "shared": shared, "whole": whole})


def near_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: links at 100 * shared >= percent * union, percent from 50 to 99."""
    if not 50 <= percent < 100:
        raise ValueError("percent must be from 50 to 99")
    t = Fraction(percent, 100)
    table = band_table(t, max(docs.count(), 1))
    texts = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    kind = "doc_id long, n_shingles long, node long, parity binary, screen array<long>, keys array<long>"
    indexed = cut(texts.mapInArrow(lambda it: _sketch(it, n, table), kind))
    sketch = cut(indexed.select("doc_id", "n_shingles", "node"))
    nodes = sketch.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first_doc"))
    members = live(indexed.select(F.explode("keys").alias("key"), "node", F.lit(False).alias("probe")), sieve=True)
    pairs = cut(members.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    bitmaps = cut(indexed.select("node", "n_shingles", "parity", "screen").join(ends, "node").dropDuplicates(["node"]))
    discard(indexed)
    spent = [pairs, bitmaps]

    def screened(pairs: DataFrame) -> DataFrame:
        side = lambda x: bitmaps.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("parity").alias(f"parity_{x}"))
        out = pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(_screen, "a long, b long, n_a long, n_b long, far long, gap long, bits array<long>")
        least = F.greatest("far", F.abs(F.col("n_a") - F.col("n_b")))
        return cut(out.withColumn("maybe", (100 + percent) * least <= (100 - percent) * (F.col("n_a") + F.col("n_b"))))

    def sets_of(some: DataFrame) -> DataFrame:
        """node, items for some(node)."""
        needed = cut(some.join(nodes, "node").select("node", F.col("first_doc").alias("doc_id")))
        spent.append(needed)
        sets = texts.join(narrow(needed, NEEDED_ROWS), "doc_id").select("node", "text").mapInArrow(lambda it: _sets(it, n), "node long, items binary")
        return sets.dropDuplicates(["node"])

    def linked(pairs: DataFrame) -> DataFrame:
        """Of screened pairs, those that are linked: a, b."""
        maybe = pairs.filter("maybe").select("a", "b")
        sets = cut(sets_of(maybe.select(F.col("a").alias("node")).union(maybe.select(F.col("b").alias("node"))).distinct()))
        side = lambda x: sets.select(F.col("node").alias(x), F.col("items").alias(f"items_{x}"))
        out = maybe.join(side("a"), "a").join(side("b"), "b").select("a", "b", "items_a", "items_b").mapInPandas(_compare, "a long, b long, shared long, whole long")
        out = cut(out.filter(100 * F.col("shared") >= percent * F.col("whole")).select("a", "b"))
        discard(sets)
        return out

    def beside_hubs(stars: DataFrame, links: DataFrame) -> DataFrame:
        """hub and node with the node's size, gap to the hub, and free: not linked with it."""
        known = links.select("a", "b", F.lit(False).alias("free"))
        width = F.expr(f"n_a * {100 - percent} div {percent} + 1")
        out = stars.join(known, ["a", "b"], "left")
        return cut(out.select(F.col("a").alias("key"), F.col("b").alias("node"), F.col("n_b").alias("n"), "gap", "bits", F.coalesce("free", F.lit(True)).alias("free"), width.alias("width")))

    stars = screened(pairs)
    links = linked(stars)
    # sets that share a key share its hub, so they meet there, once for all keys of that hub
    away = beside_hubs(stars, links)
    # a hub with one other member has no other pair
    several = crowded(away, "true", 1)
    spent += [several, away]
    away = away.join(narrow(several), "key", "left_semi")
    # each member's hubs, the first that it is linked with, and what the join compares
    words = [f"word_{i}" for i in range(SCREEN // 64)]
    own = away.groupBy("node").agg(F.collect_set("key").alias("keys"), F.min(F.when(~F.col("free"), F.col("key"))).alias("linked")).join(bitmaps.select("node", *[F.col("screen")[i].alias(w) for i, w in enumerate(words)]), "node")
    reach = F.expr(f"n * {100 - percent} div {percent}")  # of a partner of this size, if it has one
    cells = F.sequence(F.expr("floor((gap - reach) / width)"), F.expr("floor((gap + reach) / width)"))
    apart = F.greatest(F.abs(F.col("gap") - F.col("gap_x")), F.abs(F.col("n") - F.col("n_x")))
    away = cut(away.join(own, "node").withColumn("cell", F.expr("gap div width")))
    given = [F.col(c).alias(f"{c}_x") for c in ("n", "gap", "component", "keys", "bits", *words)]
    differ = lambda a, b: F.bit_count(a.bitwiseXOR(b))
    few = sum((differ(F.col(w), F.col(f"{w}_x")) for w in words[1:]), differ(F.col(words[0]), F.col(f"{words[0]}_x")))
    many = F.coalesce(F.aggregate(F.zip_with("bits", "bits_x", differ), F.lit(0), lambda total, x: total + x), F.lit(0))
    bound = lambda far: (100 + percent) * far <= (100 - percent) * (F.col("n") + F.col("n_x"))
    # the long bitmaps are compared for what the others leave
    near = (F.col("component") != F.col("component_x")) & bound(few) & bound(apart) & F.when(bound(few) & bound(apart), bound(many))
    classed = lambda classes: away.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ordered = (F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b"))

    # members that are near the hub are linked with many others, so that these need not meet each other
    own = away.withColumn("component", F.coalesce("linked", "node"))
    pivots = away.groupBy("key", F.pmod("node", F.lit(PIVOTS)).alias("share")).agg(F.min(F.struct("gap", "node")).alias("p")).select("key", F.col("p.node").alias("node"))
    pivots = own.join(pivots, ["key", "node"]).select("key", F.col("node").alias("x"), F.col("free").alias("free_x"), *given)
    first = screened(pivots.join(own, "key").filter(near & (F.col("free") | F.col("free_x"))).select(*ordered).distinct())
    spent.append(first)
    links = links.union(linked(first))

    classes = components(links)
    own = classed(classes)
    free = own.filter("free").withColumn("reach", reach).select("key", F.col("node").alias("x"), *given, F.explode(cells).alias("cell"))
    # two that are both free meet once
    once = (F.col("x") < F.col("node")) | ~F.col("free")
    both = free.join(own, ["key", "cell"]).filter(once & near & (F.array_min(F.array_intersect("keys", "keys_x")) == F.col("key")))
    pairs = both.select(*ordered)
    rest = screened(pairs.distinct())
    # of two components, the nearest pair first: if it is linked, the others need no comparing
    of = lambda x: classes.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    left = rest.filter("maybe")
    rounds = 0 if left.count() <= FEW else ROUNDS
    for last in (False,) * rounds + (True,):
        side = lambda x: F.coalesce(f"of_{x}", x)
        left = left.select("a", "b", "far", "maybe").join(of("a"), "a", "left").join(of("b"), "b", "left")
        left = left.withColumn("low", F.least(side("a"), side("b"))).withColumn("high", F.greatest(side("a"), side("b"))).filter("low <> high")
        left = cut(left.select("a", "b", "far", "maybe", "low", "high"))
        spent.append(left)
        if not left.count():
            break
        first = left if last else left.groupBy("low", "high").agg(F.min(F.struct("far", "a", "b")).alias("p")).select("p.a", "p.b", F.lit(True).alias("maybe"))
        found = linked(first)
        if found.count():
            classes = components(classes.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))
    groups = classes
    discard(*spent, members, stars, away, rest)
    grouped = groups.join(nodes, "node")
    lowest = grouped.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    named = nodes.join(grouped.join(lowest, "component").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "first_doc").alias("component_id"))
    out = sketch.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    nameless = docs.filter(F.col("doc_id").isNull()).select("doc_id", "text").mapInArrow(lambda it: _sketch(it, n, table), kind)
    return out.unionByName(nameless.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
u AS (SELECT min(doc_id) AS node, len(g)::BIGINT AS n, list_sort(g) AS g FROM s GROUP BY ALL),
e AS (SELECT node, n, unnest(g) AS x FROM u),
c AS (SELECT a.node AS a, b.node AS b, a.n + b.n - count(*) AS whole, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.node < b.node AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
      GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM c UNION ALL SELECT b, a FROM c),
r(node, top) AS (SELECT node, node FROM u UNION SELECT l.b, r.top FROM r JOIN l ON l.a = r.node WHERE r.top < l.b),
m AS (SELECT node, min(top) AS top FROM r GROUP BY node)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE m.top END AS component_id FROM s JOIN u ON u.g = list_sort(s.g) JOIN m ON m.node = u.node
"""
