"""Exact top-k search by inner product, in the three phases of a uniform threshold.

A vector is split into LISTS runs of components; a list holds, for each query, the
local scores of all candidates over one run, and a candidate's score is the sum of
its local scores. Candidates are kept in blocks; queries, in blocks too, visit
every block of candidates. Both are read where they lie, as a Cartesian product of their
partitions: what is visited is neither copied for each visit nor sent through the driver.

1. Each block gives, for each query and list, its DEPTH highest local entries with
   their sums. The k-th best sum found is a cutoff that the true k-th score cannot
   be below.
2. A candidate that reaches the cutoff has a local score of at least cutoff / LISTS
   in some list. The cutoffs go along with the query blocks, and only entries above
   that uniform threshold are collected.
3. Where a collected entry's missing lists, bounded by the threshold, could still
   lift it to the cutoff, its score is resolved exactly; each block returns its best
   k, and the best k of these are the answer.

Copies of a vector beyond the k + 1 smallest ids can never be among the k best (ties
go to the smaller id), so they are dropped first, before any shuffle by Spark's
window group limit. A query's row is found whether or not it is such a copy.

Defined results: a vector that is null or has a null, NaN or infinite component takes
no part, as query or candidate; vectors of unequal length are filled up with zeros;
a repeated id counts as so many candidates, none of which answers its own id; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.durable import cut

LISTS = 2
DEPTH = 40
CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 512
SCALE = 256.0


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(F.coalesce(vector, F.array().cast("array<double>")), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _bytes(m: np.ndarray) -> bytes:
    """As two bytes a component where all fit, else as eight."""
    return m.astype(np.int16 if np.abs(m).max(initial=0) < 2**15 else np.float64).tobytes()


def _array(packed: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(packed, np.int16 if len(packed) == 2 * n * width else np.float64).astype(np.float64).reshape(-1, width)


def _packed(df: DataFrame, block: Column, width: int) -> DataFrame:
    """Blocks of rows (id, v): block, ids and the floored components as packed bytes."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy(np.int64)
        m = np.floor(SCALE * _matrix(list(pdf["v"]), width))
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ids": [ids.tobytes()], "m": [_bytes(m)]})

    return df.withColumn("block", block.cast("long")).groupBy("block").applyInPandas(pack, "block long, ids binary, m binary")


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products as int64; by floating point where that is exact."""
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), np.int64)
    if np.abs(q).max() * np.abs(v).max() * q.shape[1] < 2.0**53:
        return (q @ v.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in q], object) @ np.array([[int(x) for x in row] for row in v], object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _runs(width: int, lists: int) -> list[slice]:
    edges = np.linspace(0, width, min(lists, max(width, 1)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _unpack(row, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    q_ids, ids = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.ids, np.int64)
    return q_ids, _array(row.q_m, len(q_ids), width), ids, _array(row.m, len(ids), width)


def _gather(batches: Iterator[pd.DataFrame], width: int, lists: int, depth: int, k: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for row in pdf.itertuples():
            q_ids, q, ids, m = _unpack(row, width)
            parts = [_scores(q[:, r], m[:, r]) for r in _runs(width, lists)]
            total, own = sum(parts), q_ids[:, None] == ids[None, :]
            d = min(depth, len(ids))
            found = np.concatenate([np.argpartition(np.where(own, np.iinfo(np.int64).min, p), len(ids) - d, axis=1)[:, len(ids) - d :] for p in parts], axis=1)
            found.sort(axis=1)
            new = np.ones(found.shape, bool)
            new[:, 1:] = found[:, 1:] != found[:, :-1]
            rows = np.arange(len(q_ids))[:, None]
            best = np.where(new & ~own[rows, found], total[rows, found], np.iinfo(np.int64).min)
            best = -np.sort(-best, axis=1)[:, :k]
            i, j = np.nonzero(best > np.iinfo(np.int64).min)
            yield pd.DataFrame({"query_id": q_ids[i], "score": best[i, j]})


def _resolve(batches: Iterator[pd.DataFrame], width: int, lists: int, k: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for row in pdf.itertuples():
            q_ids, q, ids, m = _unpack(row, width)
            cutoff = np.frombuffer(row.cutoff, np.int64)
            runs = _runs(width, lists)
            parts = [_scores(q[:, r], m[:, r]) for r in runs]
            threshold = cutoff / len(runs) - 1e-9 * np.abs(cutoff)
            known = [p >= threshold[:, None] for p in parts]
            seen = known[0].copy()
            for x in known[1:]:
                seen |= x
            seen &= q_ids[:, None] != ids[None, :]
            bound = sum(np.where(x, p.astype(np.float64), threshold[:, None]) for x, p in zip(known, parts, strict=True))
            i, j = np.nonzero(seen & (bound >= cutoff[:, None] - 1.0))
            score = sum(p[i, j] for p in parts)
            keep = score >= cutoff[i]
            i, score, vec = i[keep], score[keep], ids[j[keep]]
            order = np.lexsort((vec, -score, i))
            i, score, vec = i[order], score[order], vec[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            i, score, vec = i[place < k], score[place < k], vec[place < k]
            yield pd.DataFrame({"query_id": q_ids[i], "vec_id": vec, "score": score})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", lists: int = LISTS, depth: int = DEPTH) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among vectors, its own id left out."""
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    everyone, asking = pick(vectors), pick(queries).dropDuplicates(["id"])
    width = everyone.select("v").union(asking.select("v")).agg(F.max(F.size("v")).alias("w")).first()["w"] or 1
    width = max(width, 1)
    distinct = everyone.withColumn("copy", F.row_number().over(W.partitionBy("v").orderBy("id"))).filter(F.col("copy") <= k + 1).select("id", "v")
    candidates = cut(distinct)
    shards = max(1, -(-candidates.count() // CANDIDATE_BLOCK))
    groups = max(1, -(-asking.count() // QUERY_BLOCK))
    blocks = _packed(candidates, F.pmod(F.xxhash64("id"), F.lit(shards)), width)
    asked = _packed(asking, F.pmod(F.xxhash64("id"), F.lit(groups)), width).select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))
    asked = cut(asked)
    blocks = cut(blocks)
    visits = lambda a: blocks.hint("shuffle_replicate_nl").crossJoin(a)
    found = visits(asked).mapInPandas(lambda it: _gather(it, width, lists, depth, k), "query_id long, score long")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc()))
    cutoffs = found.withColumn("place", place).filter(F.col("place") <= k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("cutoff"))
    low = -(2**62)

    def attach(pdf: pd.DataFrame) -> pd.DataFrame:
        known = dict(zip(pdf["query_id"], pdf["cutoff"].fillna(low).astype("int64"), strict=True)) if len(pdf) else {}
        ids = np.frombuffer(pdf["q_ids"].iloc[0], np.int64)
        return pd.DataFrame({"q_block": [pdf["q_block"].iloc[0]], "cutoff": [np.array([known.get(i, low) for i in ids], np.int64).tobytes()]})

    listed = asking.select(F.col("id").alias("query_id"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("long").alias("q_block"))
    by_block = (
        listed.join(cutoffs, "query_id", "left").join(asked.select("q_block", "q_ids"), "q_block").groupBy("q_block").applyInPandas(attach, "q_block long, cutoff binary")
    )
    asked = cut(asked.join(by_block, "q_block"))
    best = visits(asked).mapInPandas(lambda it: _resolve(it, width, lists, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
