"""First-wins dedup in a store of bounded size, oldest out first, without one task that sees all.

The store keeps `places` articles; when one more is kept, the oldest tenth leaves. So an article
meets only what is still there, and which those are depends on how many were kept before it. That
count alone says when an article leaves: the r-th kept one is there as long as at
most places + ((r - 1) div tenth) * tenth have been kept.

Arrivals are dealt into runs, one after the other, and each run is decided in a task of its own. What comes
into a run is the store that the run before leaves: at most places + 1 articles, and how far the count is from the next
eviction. A run's task sets out some articles earlier (`lead`), with an empty store, once for each such distance;
what its store is then when the run begins depends on those articles alone, in practice. So all runs are
tried at once; then, from the first run on, what the run before has left is looked up among the stores
that the run was tried with. Where it is found, all that the trial decided holds; where it is not, the run
is decided again from the right store. In the worst case each run is decided again, one after the other; the result is the same.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.lineage import checkpointed
from newsloom.operators.dedup import band_keys

BLOCK = 20_000


def positions(rows: DataFrame, order: str, block: int = BLOCK) -> DataFrame:
    """rows with place, from 0 by order, and block. No window spans more than a range of the order."""
    ranged = checkpointed(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    # one row a partition
    before = sizes.withColumn("before", F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).select("_part", F.coalesce("before", F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("_part").orderBy(order)) - 1
    placed = ranged.withColumn("_in", within).join(F.broadcast(before), "_part")
    placed = placed.withColumn("place", (F.col("before") + F.col("_in")).cast("long"))
    return placed.withColumn("block", F.floor(F.col("place") / block)).drop("_part", "_in", "before")


def tenth(places: int) -> int:
    return max(1, places // 10)


def gone(kept: int, places: int) -> int:
    """How many of the kept have left by then."""
    return 0 if kept <= places else ((kept - places - 1) // tenth(places) + 1) * tenth(places)


STORE = "place long, bands array<string>"


def marks() -> Column:
    """The first 60 bits of each band's md5. An article is held against those in the store only, band by band."""
    return F.transform("bands", lambda x: F.conv(F.substring(F.substring_index(x, ":", -1), 1, 15), 16, 10).cast("long"))


def _decide(codes: np.ndarray, able: np.ndarray, kept: int, store: list[np.ndarray], places: int) -> tuple[np.ndarray, int]:
    """Whether each article is a duplicate, and how many are kept in the end. codes: a row of numbers for each, those of store (its oldest first) and of the articles.

    An article none of whose bands is another's is kept without a look, and counted.
    """
    step = tenth(places)
    last: dict[int, int] = {}
    for rank, row in enumerate(store, kept - len(store) + 1):
        for x in row:
            last[x] = rank
    dup = np.zeros(len(able), bool)
    ahead = np.concatenate(([0], np.cumsum(able)))
    hits = 0
    # rows whose bands are all their own were given no codes
    for i in np.flatnonzero(np.fromiter((len(r) > 0 for r in codes), bool, len(codes))).tolist():
        now = kept + int(ahead[i]) - hits
        out = 0 if now <= places else ((now - places - 1) // step + 1) * step
        if any(last.get(x, 0) > out for x in codes[i]):
            dup[i] = True
            hits += bool(able[i])
        elif able[i]:
            for x in codes[i]:
                last[x] = now + 1
    return dup, kept + int(ahead[-1]) - hits


def _coded(marks: list[np.ndarray]) -> list[list[int]]:
    """For each article numbers of the bands that it has in common with others among these."""
    if not marks:
        return []
    table = np.stack(marks)
    out: list[list[int]] = [[] for _ in marks]
    base = 0
    for b in range(table.shape[1]):
        _, code, n = np.unique(table[:, b], return_inverse=True, return_counts=True)
        for i in np.flatnonzero(n[code] > 1).tolist():
            out[i].append(base + int(code[i]))
        base += len(n)
    return out


def _stand(kept: int, held: np.ndarray, places: int) -> tuple[int, str]:
    """Where the count stands and which articles are in the store, as a name; counts that evict alike from here on are one."""
    step = tenth(places)
    near = kept if kept <= places else places + 1 + (kept - places - 1) % step
    return near, hashlib.md5(np.asarray(held, np.int64).tobytes() + b"%d" % near).hexdigest()


def _held(kept: int, store: np.ndarray, place: np.ndarray, chosen: np.ndarray, places: int) -> np.ndarray:
    """Places of the articles in the store, once those chosen were kept too."""
    every = np.concatenate((store, place[chosen])).astype(np.int64)
    left = kept - gone(kept, places)
    return every[max(len(every) - left, 0) :]


def _tries(pdf: pd.DataFrame, places: int) -> pd.DataFrame:
    """A run and the articles ahead of it (lead), from each stand of the count: the store at its begin and its end."""
    pdf = pdf.sort_values("place")
    run, place, able = int(pdf["run"].iloc[0]), pdf["place"].to_numpy(np.int64), pdf["publishable"].to_numpy(bool)
    begin = int(np.count_nonzero(pdf["ahead"]))
    codes = _coded(list(pdf["marks"]))
    out = []
    # the first run has nothing ahead of it; it is decided from the given store
    for phase in range(tenth(places)) if begin else ():
        kept = 2 * places + 1 + phase
        none = np.zeros(0, np.int64)
        dup, _ = _decide(codes, able, kept, [], places)
        chosen = able & ~dup
        at = kept + int(np.count_nonzero(chosen[:begin]))
        end = kept + int(np.count_nonzero(chosen))
        # an empty store before: what is told of it is right only if all of it has left by the run's begin
        if gone(at, places) < kept:
            continue
        out.append((run, _stand(at, _held(at, none, place[:begin], chosen[:begin], places), places)[1], *_packed(end, _held(end, none, place, chosen, places), places), np.packbits(dup[begin:]).tobytes()))
    return pd.DataFrame(out, columns=TRIED_NAMES)


def _packed(kept: int, held: np.ndarray, places: int) -> tuple[int, bytes, str]:
    near, name = _stand(kept, held, places)
    return near, held.tobytes(), name


TRIED = "run long, given string, kept long, held binary, left string, dup binary"
TRIED_NAMES = [x.split()[0] for x in TRIED.split(", ")]


def _decider(kept: int, store: list[tuple[int, list[int]]], given: str, places: int):
    return lambda pdf: _again(pdf.sort_values("place"), kept, store, given, places)


def _again(pdf: pd.DataFrame, kept: int, store: list[tuple[int, list[int]]], given: str, places: int) -> pd.DataFrame:
    """A run, in its order, from the right store."""
    place, able = pdf["place"].to_numpy(np.int64), pdf["publishable"].to_numpy(bool)
    codes = _coded([np.asarray(m, np.int64) for _, m in store] + [np.asarray(m, np.int64) for m in pdf["marks"]])
    dup, end = _decide(codes[len(store) :], able, kept, codes[: len(store)], places)
    held = _held(end, np.array([p for p, _ in store], np.int64), place, able & ~dup, places)
    return pd.DataFrame([(int(pdf["run"].iloc[0]), given, *_packed(end, held, places), np.packbits(dup).tobytes())], columns=TRIED_NAMES)


def bounded_first_wins(signed: DataFrame, places: int, order: str = "arrival", block: int = BLOCK, store: DataFrame | None = None, lead: int | None = None) -> DataFrame:
    """order, is_duplicate. signed has order (unique), signature, publishable; store (STORE, places from 0) is what earlier runs have left.

    An article is a duplicate if it shares a band with one that is in the store; if not, and if it is publishable, it is kept.
    block: articles of a run; lead: those that it is tried from ahead of it.
    """
    spark, lead = signed.sparkSession, min(block, 4 * (places + tenth(places))) if lead is None else lead
    placed = positions(signed.select(order, "publishable", band_keys(F.col("signature")).alias("bands")), order, block)
    rows = checkpointed(placed.select(order, "place", F.col("block").alias("run"), "publishable", marks().alias("marks")))
    ahead = rows.filter(F.pmod("place", F.lit(block)) >= block - lead).withColumn("run", F.col("run") + 1)
    runs = rows.withColumn("ahead", F.lit(False)).unionByName(ahead.withColumn("ahead", F.lit(True)))
    last = rows.agg(F.max("run")).first()[0]
    if last is None:
        return signed.limit(0).select(order, F.lit(False).alias("is_duplicate"))
    tried = checkpointed(runs.filter(F.col("run") <= last).drop(order).groupBy("run").applyInPandas(lambda pdf: _tries(pdf, places), TRIED))
    # a few dozen bytes for each run and stand of the count
    known = {(r.run, r.given): (r.kept, r.left) for r in tried.select("run", "given", "kept", "left").toLocalIterator()}
    # the store itself, places below 0 for what earlier runs have left; only where a run is decided again
    held = [] if store is None else [(r.place, r.marks) for r in store.select("place", marks().alias("marks")).sort("place").collect()]
    kept, held = len(held), [(p - len(held), m) for p, m in held]
    held = held[gone(kept, places) :]
    given = _stand(kept, np.array([p for p, _ in held], np.int64), places)[1]
    chosen, anew, at = [], [], 0
    while at <= last:
        if (at, given) in known:
            chosen.append((at, given))
            given, at, held = known[at, given][1], at + 1, None
            continue
        if held is None:
            left = tried.filter((F.col("run") == at - 1) & (F.col("left") == given)).select("kept", "held").first()
            kept, held = left.kept, _marked(rows, store, np.frombuffer(left.held, np.int64))
        again = rows.filter(F.col("run") == at).drop(order)
        new = again.groupBy("run").applyInPandas(_decider(kept, held, given, places), TRIED).first()
        anew.append((new.run, new.dup))
        kept, given, held = new.kept, new.left, _marked(rows, store, np.frombuffer(new.held, np.int64))
        at += 1
    right = tried.join(F.broadcast(spark.createDataFrame(chosen, "run long, given string")), ["run", "given"]).select("run", "dup")
    right = right.unionByName(spark.createDataFrame([(r, bytes(d)) for r, d in anew], "run long, dup binary"))
    bits = F.col("place") - F.col("run") * block
    byte = F.conv(F.hex(F.substring("dup", (F.floor(bits / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    return rows.join(right, "run").select(order, (F.call_function("getbit", byte, (7 - F.pmod(bits, F.lit(8))).cast("int")) == 1).alias("is_duplicate"))


def _marked(rows: DataFrame, store: DataFrame | None, places: np.ndarray) -> list[tuple[int, list[int]]]:
    """Articles of a store by their places, with their marks; those of the given store have places below 0."""
    found = rows.select("place", "marks")
    if store is not None:
        found = found.unionByName(store.select((F.col("place") - store.count()).alias("place"), marks().alias("marks")))
    return [(r.place, r.marks) for r in found.filter(F.col("place").isin([int(p) for p in places])).sort("place").collect()]


def store_after(signed: DataFrame, places: int, order: str = "arrival", store: DataFrame | None = None) -> DataFrame:
    """The store (STORE) once the articles of signed have been kept, one after the other."""
    new = positions(signed.select(order, "signature"), order).select("place", band_keys(F.col("signature")).alias("bands"))
    if store is not None:
        new = store.unionByName(new.withColumn("place", F.col("place") + store.count()))
    out = gone(new.count(), places)
    return new.filter(F.col("place") >= out).withColumn("place", F.col("place") - out)
