r"""Line dedup by an edit-distance join on segments.

Lines are split at \n and compared as UTF-8 bytes. Two lines are close if their edit
distance is at most one for each PER_EDIT bytes of the shorter, and at most EDITS. A line
of threshold e is cut into e + 1 even segments; a line close to it has one of them
unchanged, at a place that its length and the segment's number confine. Each line indexes
its segments under its length, and probes, for its own length and each one down to e less,
just the substrings that can be such a segment. Lines that share a key are verified by
banded bit-parallel edit distance.

All lines of a key are first measured against one of its indexed lines, the hub. Edit
distance is a metric, so two lines whose distances from the hub differ by more than EDITS
cannot be close; and lines of one component already need no more. Where a key keeps more
than CROWD lines that its hub does not settle (the variants of a much copied line), its
lines are cut again, finer (FINER): of m segments, all but e are unchanged in a close line,
so a key is the whole line but for e segments, with every shift of the parts between that
e edits allow. Other pairs of a key are measured with each other, if their prints may be those of
close lines. A print holds, for each length of GRAMS, the parities of the line's byte strings of that length
in PRINT bits by hash: an edit takes away at most q strings of q bytes and adds as many, so it
turns over no more than 2 * q bits of theirs.

Classes are connected components; the first line of a class (by doc_id, then line number)
stays and the others go. Lines under PER_EDIT bytes are in a class only with their copies;
those under `least` bytes always stay. op5 and the pipeline take every line that is not
empty (EVERY); the default is MIN_BYTES.

Defined results: null and empty texts have no lines; a line repeated in one document goes
but for its first; rows that repeat a doc_id must be equal and count as one document; rows
whose doc_id is null take no part; an empty table gives no rows; only doc_id and text are
read by `removals`, and `drop_lines` passes other columns on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, product
from operator import add, and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm import textscan as ts
from newsloom.llm.candidates import crowded, live
from newsloom.llm.durable import cut, discard, narrow
from newsloom.llm.links import components

EDITS = 2
PER_EDIT = 12
MIN_BYTES = 12
EVERY = 1
#: Segments of the cuts for crowded keys, one after the other.
FINER = (12,)
CROWD = 8
#: A crowded line has some hundreds of keys.
LINES_A_TASK = 256
SEEN = 500_000
#: Lengths of byte strings whose parities a print holds, and the bits for each, a multiple of 64.
GRAMS = (1, 2, 3)
PRINT = 128
_WORDS = [f"print_{i}" for i in range(len(GRAMS) * PRINT // 64)]

_U = np.uint64


def lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each line, and n + 1 offsets of the documents' lines."""
    breaks = np.flatnonzero(data == 10)
    full = np.flatnonzero(np.diff(at) > 0)
    starts = np.sort(np.concatenate((at[:-1][full], breaks + 1)))
    ends = np.sort(np.concatenate((at[1:][full], breaks)))
    return starts, ends, np.concatenate(([0], np.cumsum(np.where(np.diff(at) > 0, 1, 0) + np.diff(np.searchsorted(breaks, at)))))


def allowed(size: np.ndarray, edits: int = EDITS) -> np.ndarray:
    """The threshold of pairs whose shorter line has this size."""
    return np.minimum(size // PER_EDIT, edits)


def patterns(edits: int, parts: int, less: int) -> list[tuple[int, tuple[tuple[int, int, int], ...], tuple[tuple[int, int, int, int], ...]]]:
    """What of a line may be unchanged in one that is `less` bytes longer: for each choice of `edits` of the `parts`
    segments, its number, the stretches between them (first segment, last segment + 1, shift in the longer line), and
    the runs of chosen segments with the shifts before and after.

    The choice can be such that each run of chosen segments has an edit, so a run shifts what follows by no more
    than the edits that the other runs leave.
    """
    out = []
    for number, chosen in enumerate(combinations(range(parts), edits)):
        runs = [[c, c + 1] for c in chosen]
        for c in range(len(runs) - 1, 0, -1):
            if runs[c - 1][1] == runs[c][0]:
                runs[c - 1][1] = runs.pop(c)[1]
        most = edits - len(runs) + 1
        for steps in product(range(-most, most + 1), repeat=len(runs)):
            if sum(steps) != less or sum(map(abs, steps)) > edits:
                continue
            at, shift, kept, gaps = 0, 0, [], []
            for (a, b), step in zip(runs, steps, strict=True):
                kept.append((at, a, shift))
                gaps.append((a, b, shift, shift + step))
                at, shift = b, shift + step
            kept.append((at, parts, shift))
            out.append((number, tuple(x for x in kept if x[0] < x[1]), tuple(gaps)))
    return out


def keys(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, edits: int, parts: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Line, key, whether it is only probed, and gaps, of these lines cut in `parts` (0: one more than their threshold).

    gaps has 32 bits for what is in each of the first two runs of chosen segments, if there are several, else 0. As
    each run has an edit, lines of one key are a pair by it only if they differ in both.
    """
    length = ends - starts
    owners, found, probes, others = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)], [np.zeros(0, np.uint64)]
    for e in range(1, edits + 1):
        m = parts or e + 1
        for less in range(e + 1):
            on = np.flatnonzero((allowed(length - less, edits) == e) & (length >= less))
            if not len(on):
                continue
            target = length[on] - less
            bound = [starts[on] + target * i // m for i in range(m + 1)]
            tag = target.astype(np.uint64) * _U(1 << 20) + _U(e << 16)
            for number, kept, gaps in patterns(e, m, less):
                key = ts.mix(tag + _U(number + 1))
                for a, b, shift in kept:
                    x = np.maximum(bound[a] + shift, starts[on])
                    key = ts.mix(key ^ ts.stretches(sums, x, np.maximum(bound[b] + shift, x)))
                owners.append(on)
                found.append(key)
                probes.append(np.full(len(on), less > 0 or any(shift for *_, shift in kept)))
                halves = np.zeros(len(on), np.uint64)
                for a, b, before, after in gaps[:2] if len(gaps) > 1 else ():
                    x = np.maximum(bound[a] + before, starts[on])
                    halves = halves << _U(32) | ts.stretches(sums, x, np.maximum(bound[b] + after, x)) >> _U(32) | _U(1)
                others.append(halves)
    return np.concatenate(owners), np.concatenate(found), np.concatenate(probes), np.concatenate(others)


def _read(batches: Iterator[pa.RecordBatch], edits: int) -> Iterator[pa.RecordBatch]:
    """Each line, and at its first place in the task its keys; the first n_own are indexed."""
    seen: set[int] = set()
    for batch in batches:
        for rows, data, at in ts.pieces(batch):
            starts, ends, off = lines(data, at)
            sums = ts.prefix(data)
            node = ts.signed(ts.stretches(sums, starts, ends))
            size = ends - starts
            first = np.zeros(len(node), bool)
            for i in np.flatnonzero(size >= PER_EDIT).tolist():
                x = int(node[i])
                if x not in seen:
                    first[i] = True
                    if len(seen) < SEEN:
                        seen.add(x)
            which = np.flatnonzero(first)
            owner, key, probe, _ = keys(sums, starts[first], ends[first], edits)
            owner = which[owner]
            order = np.lexsort((probe, owner))
            key_at = np.searchsorted(owner[order], np.arange(len(node) + 1)).astype(np.int32)
            doc = np.repeat(np.arange(len(rows)), np.diff(off))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").take(pa.array(doc)), pa.array((np.arange(len(node)) - off[doc]).astype(np.int32)), pa.array(node), pa.array(size.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(key_at), pa.array(ts.signed(key[order]))), pa.array(np.bincount(owner[~probe], minlength=len(node)).astype(np.int32)),
                ],
                names=["doc_id", "line", "node", "size", "keys", "n_own"],
            )


def _finer(batches: Iterator[pa.RecordBatch], edits: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Keys of whole lines, cut in `parts`."""
    for batch in batches:
        for rows, data, at in ts.pieces(batch, "body"):
            owner, key, probe, gaps = keys(ts.prefix(data), at[:-1], at[1:], edits, parts)
            for c in range(0, len(key), 1 << 16):
                some = slice(c, c + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(ts.signed(key[some])), rows.column("node").take(pa.array(owner[some])), pa.array(probe[some]), pa.array(ts.signed(gaps[some]))], names=["key", "node", "probe", "gaps"])


def prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each line PRINT bits for each of GRAMS, as rows of 64-bit words."""
    out = np.zeros((len(starts), len(GRAMS), PRINT), np.uint8)
    grams = np.zeros(len(data), np.uint64)
    for q in range(1, max(GRAMS) + 1):
        n = max(len(data) - q + 1, 0)
        grams = grams[:n] << _U(8) | data[q - 1 : q - 1 + n]
        if q in GRAMS:
            place = (ts.mix(grams + _U(q << 32)) % _U(PRINT)).astype(np.int64)
            for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                out[i, GRAMS.index(q)] = np.bincount(place[a : max(b - q + 1, a)], minlength=PRINT) & 1
    return np.packbits(out.reshape(len(starts), -1), axis=1, bitorder="little").view(np.int64)


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted lines; of rows that repeat the doc_id before them, none."""
    last = None
    for batch in batches:
        for rows, data, at in ts.pieces(batch):
            starts, ends, off = lines(data, at)
            doc = rows.column("doc_id").to_numpy()
            fresh = np.concatenate(([doc[0] != last], doc[1:] != doc[:-1]))
            last = doc[-1]
            wanted = rows.column("wanted")
            of = np.repeat(np.arange(len(rows)), np.diff(np.asarray(wanted.offsets)))
            flat = wanted.flatten().filter(pa.array(fresh[of]))
            place = off[of[fresh[of]]] + np.asarray(flat.field("line"))
            yield pa.RecordBatch.from_arrays(
                [
                    flat.field("node"), pa.array([data[a:b].tobytes() for a, b in zip(starts[place], ends[place], strict=True)], pa.binary()),
                    *(pa.array(x) for x in prints(data, starts[place], ends[place]).T),
                ],
                names=["node", "body", *_WORDS],
            )


def trimmed(a: bytes, b: bytes, keep: int) -> tuple[bytes, bytes]:
    """Both without their common ends, but for up to `keep` bytes of them."""
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    differ = np.flatnonzero(x[:n] != y[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(x[len(a) - n :][::-1] != y[len(b) - n :][::-1])
    tail = min(int(differ[0]) if len(differ) else n, n - head)
    head = max(head - keep, 0)
    return a[head : len(a) - tail], b[head : len(b) - tail]


def distances(pairs: list[tuple[bytes, bytes]], cap: int) -> np.ndarray:
    """Edit distances up to cap (else cap + 1), for all pairs at once.

    A word holds the vertical differences of a band of 2 * cap + 1 cells around the
    diagonal, one word for each pair, and moves down one row with each column.
    """
    out = np.full(len(pairs), cap + 1)
    cut_down = [trimmed(a, b, cap) for a, b in pairs]
    near = [i for i, (a, b) in enumerate(cut_down) if abs(len(a) - len(b)) <= cap]
    tiny = [i for i in near if len(cut_down[i][0]) < cap or not cut_down[i][1]]
    for i in tiny:
        out[i] = min(_small(*cut_down[i]), cap + 1)
    small = set(tiny)
    near = sorted((i for i in near if i not in small), key=lambda i: -len(cut_down[i][1]))
    for c in range(0, len(near), 2048):
        some = near[c : c + 2048]
        width = max(len(cut_down[i][0]) for i in some)
        rows = np.full((len(some), width + 3 * cap + 2), 256, np.int16)
        columns = np.full((len(some), max(len(cut_down[i][1]) for i in some)), 257, np.int16)
        for k, i in enumerate(some):
            a, b = cut_down[i]
            rows[k, cap : cap + len(a)] = np.frombuffer(a, np.uint8)
            columns[k, : len(b)] = np.frombuffer(b, np.uint8)
        out[some] = np.minimum(_banded(rows, np.array([len(cut_down[i][0]) for i in some]), columns, np.array([len(cut_down[i][1]) for i in some]), cap), cap + 1)
    return out


def _small(a: bytes, b: bytes) -> int:
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def _banded(rows: np.ndarray, m: np.ndarray, columns: np.ndarray, n: np.ndarray, cap: int) -> np.ndarray:
    """rows holds byte i at i + cap; pairs come by falling n, and m >= cap."""
    band = 2 * cap + 1
    one, mask = _U(1), _U((1 << band) - 1)
    up = np.full(len(m), ((1 << band) - 1) & ~((1 << cap) - 1), np.uint64)  # rows above the first do not rise
    down = np.zeros(len(m), np.uint64)
    score = np.full(len(m), cap, np.int64)
    live = len(m)
    for j in range(columns.shape[1]):
        live = int(np.searchsorted(-n, -(j + 1), "right"))
        u, d, t = up[:live], down[:live], columns[:live, j]
        same = np.zeros(live, np.uint64)
        for k in range(band):
            same |= (rows[:live, j + k] == t).astype(np.uint64) << _U(k)
        level = ((((same & u) + u) ^ u) | same | d) & mask
        plus = (d | ~(level | u)) & mask
        minus = level & u
        k = m[:live] - (j + 1) + cap
        inside = k >= band - 1  # the band's last row is still a row of the table
        k = np.clip(k, 0, band - 1).astype(np.uint64)
        score[:live] += np.where(inside, 1 - ((level >> _U(band - 1)) & one).astype(np.int64), ((plus >> k) & one).astype(np.int64) - ((minus >> k) & one).astype(np.int64))
        up[:live] = (minus | ~((level >> one) | plus)) & mask
        down[:live] = (level >> one) & plus
    return score


def _flips(x: str, y: str) -> list[Column]:
    """For each of GRAMS the bits that differ between the prints in columns of these endings."""
    differ = [F.bit_count(F.col(f"{w}{x}").bitwiseXOR(F.col(f"{w}{y}"))) for w in _WORDS]
    return [reduce(add, differ[i : i + PRINT // 64]) for i in range(0, len(differ), PRINT // 64)]


def _within(edits: int, x: str, y: str) -> Column:
    """Whether the prints may be those of lines so many edits apart."""
    return reduce(and_, [n <= 2 * q * edits for q, n in zip(GRAMS, _flips(x, y), strict=True)])


def _measure(batches: Iterator[pd.DataFrame], cap: int, edits: int) -> Iterator[pd.DataFrame]:
    """Each pair's distance, above cap where bodies are null, and whether it is close; further columns are kept."""
    for pdf in batches:
        on = np.flatnonzero(pdf["body_a"].notna())
        pairs = list(zip(pdf["body_a"].iloc[on], pdf["body_b"].iloc[on], strict=True))
        far, shorter = np.full(len(pdf), cap + 1), np.zeros(len(pdf), np.int64)
        far[on] = distances(pairs, cap)
        shorter[on] = [min(len(a), len(b)) for a, b in pairs]
        kept = pdf.drop(columns=["a", "b", "body_a", "body_b"])
        yield pd.concat([pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "far": far, "close": far <= allowed(shorter, edits)}), kept], axis=1)


def _classes(texts: DataFrame, nodes: DataFrame, rows: DataFrame, edits: int, crowd: int, finer: tuple[int, ...]) -> DataFrame:
    """node, component: the components of all close lines, from enough of their links."""
    cap = 3 * edits
    bodies, spent, links, left, known = None, [], None, [], []

    def measured(pairs: DataFrame) -> DataFrame:
        """a, b, far, close and the pairs' further columns, which are longs. Only pairs whose prints may be those of lines within cap are measured."""
        side = lambda x: bodies.select(F.col("node").alias(x), F.col("body").alias(f"body_{x}"), *[F.col(w).alias(f"{w}_{x}") for w in _WORDS])
        kept = [c for c in pairs.columns if c not in ("a", "b")]
        maybe = _within(cap, "_a", "_b")
        sides = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *[F.when(maybe, F.col(c)).alias(c) for c in ("body_a", "body_b")], *kept)
        return cut(sides.mapInPandas(lambda it: _measure(it, cap, edits), ", ".join(["a long, b long, far int, close boolean", *(f"{c} long" for c in kept)])))

    for parts in (*finer, 0):
        members = live(rows)
        pairs = members.select(F.col("hub").alias("a"), F.col("node").alias("b"))
        if bodies is None:
            ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
            wanted = ends.join(nodes, "node").groupBy("first.doc_id").agg(F.collect_list(F.struct("first.line", "node")).alias("wanted"))
            bodies = cut(texts.join(wanted.hint("merge"), "doc_id").select("doc_id", "text", "wanted").mapInArrow(_bodies, "node long, body binary, " + ", ".join(f"{x} long" for x in _WORDS)))
            spent.append(bodies)
        stars = measured(pairs.distinct())
        found = stars.filter("close").select("a", "b")
        links = found if links is None else links.union(found)
        spent += [members, stars]
        members = members.withColumn("parts", F.lit(parts))
        known.append(stars.select(F.lit(parts).alias("parts"), F.col("a").alias("hub"), F.col("b").alias("node"), "far", (~F.col("close")).alias("free")))
        if not parts:
            left.append(members)
            break
        full = crowded(members.join(known[-1], ["hub", "node"]), "free", crowd)
        spent.append(full)
        few = narrow(full)
        left.append(members.join(few, "key", "left_anti"))
        again = members.join(few, "key", "left_semi")
        again = cut(again.select("node").union(again.select("hub")).distinct())
        spent.append(again)
        some = again.count()
        if not some:
            break
        dealt = bodies.select("node", "body").join(narrow(again), "node").repartition(-(-some // LINES_A_TASK), "node")
        rows = cut(dealt.mapInArrow(lambda it, parts=parts: _finer(it, edits, parts), "key long, node long, probe boolean, gaps long"))
        spent.append(rows)
    classes = components(links)
    # lines near in distance from the hub lie in one or two cells of this width
    wide = 2 * edits + 1
    # keys of all cuts meet in one join
    away = reduce(DataFrame.unionByName, left).join(reduce(DataFrame.unionByName, known), ["parts", "hub", "node"]).join(bodies.drop("body"), "node").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    away = cut(away)
    spent.append(away)
    given = [F.col(c).alias(f"{c}_x") for c in ("probe", "component", "gaps", "far", *_WORDS)]
    free = away.filter("free").select("parts", "key", F.col("node").alias("x"), *given, F.explode(F.sequence(F.expr(f"(far - {edits}) div {wide}"), F.expr(f"(far + {edits}) div {wide}"))).alias("cell"))
    differ = F.col("gaps").bitwiseXOR(F.col("gaps_x"))
    apart = (F.col("gaps") == 0) | ((differ.bitwiseAND(F.lit(0xFFFFFFFF)) != 0) & (F.shiftrightunsigned(differ, 32) != 0))
    near = F.abs(F.col("far") - F.col("far_x")) <= edits
    both = free.join(away.withColumn("cell", F.expr(f"far div {wide}")), ["parts", "key", "cell"]).filter(near & (F.col("component") != F.col("component_x")) & ~(F.col("probe") & F.col("probe_x")) & apart & _within(edits, "", "_x"))
    ends = [F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b"), F.least("component", "component_x").alias("low"), F.greatest("component", "component_x").alias("high")]
    rest = measured(both.select(*ends).distinct())
    spent.append(rest)
    # what is found now links whole components; a line without links is one itself
    joined = components(rest.filter("close").select(F.col("low").alias("a"), F.col("high").alias("b")))
    above = joined.select(F.col("node").alias("component"), F.col("component").alias("above"))
    out = classes.join(narrow(above), "component", "left").select("node", F.coalesce("above", "component").alias("component"))
    discard(*spent)
    return out.unionByName(joined).dropDuplicates(["node"])


def removals(docs: DataFrame, edits: int = EDITS, least: int = MIN_BYTES, crowd: int = CROWD, finer: tuple[int, ...] = FINER) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers from 0): for every document."""
    texts = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    read = cut(texts.mapInArrow(lambda it: _read(it, edits), "doc_id long, line int, node long, size int, keys array<long>, n_own int"))
    slim = cut(read.select("doc_id", "line", "node", "size"))
    nodes = cut(slim.filter(F.col("size") >= least).groupBy("node").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count(F.lit(1)).alias("copies")))
    rows = read.filter(F.col("size") >= least).select("node", "n_own", F.posexplode("keys").alias("k", "key")).select("key", "node", (F.col("k") >= F.col("n_own")).alias("probe"), F.lit(0).cast("long").alias("gaps"))
    classed = cut(_classes(texts, nodes, rows, edits, crowd, finer).join(nodes, "node"))
    discard(read)
    lead = classed.groupBy("component").agg(F.min("first").alias("lead"))
    leads = classed.join(lead, "component").select("node", "lead")
    repeated = nodes.join(leads, "node", "left").select("node", "copies", F.coalesce("lead", "first").alias("lead"), "first").filter("copies > 1 or lead <> first")
    # written, so that both sides of the join are plain and a line in very many documents is split
    repeated = cut(repeated.select("node", "lead"))
    discard(classed)
    gone = slim.select("doc_id", "line", "node").join(narrow(repeated), "node").filter(F.struct("doc_id", "line") != F.col("lead")).groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    counted = slim.groupBy("doc_id").agg((F.max("line") + 1).cast("long").alias("n_lines"))
    every = docs.select("doc_id").join(counted, "doc_id", "left").join(gone, "doc_id", "left")
    none = F.array().cast("array<int>")
    return every.select("doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", none).alias("removed"))


def drop_lines(docs: DataFrame, edits: int = EDITS, least: int = MIN_BYTES) -> DataFrame:
    """The columns of docs, with repeated lines taken out of text; documents that lose all lines are left out.
    An integer column n_chars follows the text where that changes."""
    found = removals(docs, edits, least).filter("n_removed > 0").dropDuplicates(["doc_id"])
    found = found.select(F.col("doc_id").alias("_of"), F.col("removed").alias("_gone"), (F.col("n_removed") == F.col("n_lines")).alias("_all"))
    d = docs.alias("d").join(found.alias("f"), F.col("d.doc_id") == F.col("f._of"), "left").filter("NOT coalesce(f._all, false)")
    kept = F.array_join(F.filter(F.split("d.text", "\n"), lambda x, i: ~F.array_contains("f._gone", i)), "\n")
    text = F.when(F.col("f._of").isNotNull(), kept).otherwise(F.col("d.text"))
    columns = {c: F.col(f"d.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.col("f._of").isNotNull(), F.length(kept).cast(kind)).otherwise(F.col("d.n_chars"))
    return d.select(*[x.alias(c) for c, x in columns.items()])
