"""Top-k search, decontamination and mixing against plain versions."""

import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import decontaminate, mixing, topk
from tests.llm import brute

VECTORS = "vec_id long, embedding array<float>, label int, score double"


def vectors():
    r = random.Random(4)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)], 0, 0.1) for i in range(90)]
    rows += [(100 + i, rows[3][1], 1, 0.1) for i in range(12)]  # copies: ties go to the smaller id
    return rows + [(150, None, 0, 0.1), (200, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, 0.1), (250, [float("nan")] * 6, 0, 0.1), (300, [float("inf")] + [0.0] * 5, 0, 0.1), (350, [0.5, 0.25], 0, 0.1)]


@pytest.mark.parametrize("lists, depth, block", [(2, 40, 4096), (3, 1, 8)])
def test_top_k(spark, monkeypatch, lists, depth, block):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS)
    stored = {r.vec_id: r.embedding for r in df.collect()}
    fine = {i: [math.floor(256 * x) for x in v] for i, v in stored.items() if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (i for i in fine if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(fine[q], v, strict=False)), i) for i, v in fine.items() if i != q)[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    got = topk.top_k(df, df.filter("vec_id % 50 = 0"), lists=lists, depth=depth)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert not topk.top_k(df.limit(0), df.limit(0)).collect()
    assert topk.top_k(df.limit(0), df).count() == 0


def test_blocks_are_visited_where_they_lie(spark):
    """Query blocks are not multiplied by the candidates' blocks, and so never broadcast in that form."""
    df = spark.createDataFrame(vectors(), VECTORS)
    plan = topk.top_k(df, df.filter("vec_id % 50 = 0"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate explode" not in plan
    for m in (np.array([[-32768.0, 32767.0]]), np.array([[-32769.0, 1e12]]), np.zeros((0, 2))):
        assert (topk._array(topk._bytes(m), len(m), 2) == m).all()


def test_masks_lose_nothing():
    for bad in itertools.combinations(range(decontaminate.WINDOW), decontaminate.SLACK):
        assert any(not {s + o for o in m} & set(bad) for m in decontaminate.MASKS for s in range(decontaminate.WINDOW - m[-1]))


def test_decontamination(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdef", k=3))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((11, 12, 30, 30, 60))] + [(9, None), (10, ""), (11, "same, same " * 20)]
    rows = brute.corpus(3, 25)
    for k, (_, text) in enumerate(items[:5] + items[-1:]):
        for edits in range(0, 12, 2):
            w = text.split()
            for j in r.sample(range(len(w)), min(edits, len(w))):
                w[j] = "zz"
            rows.append((1000 + 20 * k + edits, "Before! " + ", ".join(w).upper() + " after", "en", "a", 1, 0.5, "k"))
    docs, bench = spark.createDataFrame(rows, brute.DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    assert got == brute.leaks(rows, items) and got
    by_shuffle = decontaminate.contaminated(docs, bench, seed_rows=0)
    assert sorted(map(tuple, by_shuffle.collect())) == got
    plan = by_shuffle._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (seed" in plan
    assert decontaminate.contaminated(docs.limit(0), bench).count() == decontaminate.contaminated(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 500, None: 90}, {"a": 0, "b": 7}, {"": 4, "É": 100, "x": 100, "y": 3, "z": 2000}, {}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(brute.targets(sizes))


def test_mixing(spark):
    rows = brute.corpus(5, 200)
    docs = spark.createDataFrame(rows, brute.DOCS)
    got = mixing.mix_sources(docs, keep=("text", "size", "source", "score")).collect()
    sizes = defaultdict(int)
    for d, t, _, s, *_ in rows:
        sizes[s] += len(brute.words(t))
    want, taken = brute.targets(sizes), defaultdict(int)
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    for r in got:
        assert r.size == len(brute.words(r.text)) and 0 <= r.taken <= 2 * r.size
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(8 * mixing.BLOCK, 0.02 * t)
    assert sorted(map(tuple, mixing.mix_sources(docs.repartition(3)).collect())) == sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got)
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix_sources(docs.withColumn("text", F.lit(None).cast("string"))).collect()} == {0}
