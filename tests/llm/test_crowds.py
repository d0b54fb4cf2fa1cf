"""Variants of one text share keys, but only the pairs that may be linked are sent on to be compared."""

import random

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter

from newsloom.llm import jaccard, linejoin
from newsloom.llm.links import components
from tests.llm import brute


def counted(monkeypatch, module, columns):
    """Row counts of what module writes with these columns first, in order."""
    seen, write = [], module.cut

    def cut(df):
        out = write(df)
        if df.columns[: len(columns)] == columns:
            seen.append(out.count())
        return out

    monkeypatch.setattr(module, "cut", cut)
    return seen


def inserted(r, words, places):
    w = words[:]
    for at in r.choices(places, k=1):
        w[at] += "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    return " ".join(w)


def test_lines_far_from_each_other_are_not_measured(spark, monkeypatch):
    r = random.Random(3)
    words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(70)]
    rows = [(k, inserted(r, words, range(30, 36))) for k in range(120)]
    rows += [(200 + k, rows[k][1].replace(words[0], words[0][1:])) for k in range(0, 120, 10)]
    measured = counted(monkeypatch, linejoin, ["a", "b", "far", "close"])
    got = {x.doc_id: x.removed for x in linejoin.removals(spark.createDataFrame(rows, "doc_id long, text string"), least=1).collect() if x.removed}
    assert got == brute.removed_lines(rows, least=1) and len(got) >= 12
    assert measured[-1] < 2 * len(rows)


def test_prints_bound_edits():
    r = random.Random(4)
    lines = []
    for _ in range(400):
        a = r.choices(b"abcd", k=r.randint(1, 60))
        b, edits = a[:], r.randint(0, 2)
        for _ in range(edits):
            at = r.randint(0, len(b))
            b[at : at + r.randint(0, 1)] = r.choices(b"abcd", k=r.randint(0, 1))
        lines += [bytes(a), bytes(b)]
    ends = np.cumsum([len(x) for x in lines])
    words = linejoin.prints(np.frombuffer(b"".join(lines), np.uint8), ends - [len(x) for x in lines], ends).view(np.uint64)
    step = linejoin.PRINT // 64
    flips = np.bitwise_count(words[::2] ^ words[1::2]).reshape(len(words) // 2, len(linejoin.GRAMS), step).sum(axis=2)
    far = np.array([brute.edit_distance(a, b) for a, b in zip(lines[::2], lines[1::2], strict=True)])
    assert (flips <= 2 * far[:, None] * np.array(linejoin.GRAMS)).all() and flips.max() > 0


def test_long_texts_that_share_passages_are_not_compared(spark, monkeypatch):
    r = random.Random(5)
    base = [f"v{r.randrange(3000)}" for _ in range(1600)]
    rows = []
    for k in range(40):
        at = r.randrange(900)
        rows.append((k, " ".join(base[:at] + [f"own{k}x{i}" for i in range(700)] + base[at + 700 :])))
    rows += [(100 + k, rows[k][1] + " end") for k in range(0, 40, 10)]
    screened = counted(monkeypatch, jaccard, ["a", "b", "n_a", "n_b", "far"])
    got = sorted(map(tuple, jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()))
    assert got == brute.near_groups(rows, 5, 80)
    assert sum(d != c for d, _, c in got) == 4
    assert sum(screened[1:]) < 2 * len(rows)


def test_members_near_the_hub_join_the_others_first(spark, monkeypatch):
    r = random.Random(6)
    base = [f"v{r.randrange(3000)}" for _ in range(150)]
    rows = []
    for k in range(150):
        w = base[:]
        for at in r.sample(range(150), r.choice([1, 2, 2, 3])):
            w[at] = f"x{k}y{at}"
        rows.append((k, " ".join(w)))
    screened = counted(monkeypatch, jaccard, ["a", "b", "n_a", "n_b", "far"])
    got = sorted(map(tuple, jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()))
    assert got == brute.near_groups(rows, 3, 90)
    assert screened[-1] < len(rows)


def writes(monkeypatch):
    """What is written from now on."""
    seen, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: (seen.append(path), write(self, path, *a, **b))[1])
    return seen


def test_links_that_are_stars_need_no_round(spark, monkeypatch):
    seen = writes(monkeypatch)
    links = [(top, top + k) for top in (10, 50, 90) for k in range(1, 9)]
    got = set(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {(x, top) for top, node in links for x in (top, node)} and len(seen) == 1
    got = set(map(tuple, components(spark.createDataFrame([*links, (18, 51)], "a long, b long")).collect()))
    assert {top for _, top in got} == {10, 90}


@pytest.mark.parametrize("few, most", [(jaccard.FEW, 28), (0, 30)])
def test_steps_that_link_nothing_are_left_out(spark, monkeypatch, few, most):
    """Each step has plans and tasks that the driver keeps."""
    monkeypatch.setattr(jaccard, "FEW", few)
    r = random.Random(7)
    base = [f"v{r.randrange(3000)}" for _ in range(150)]
    rows = []
    for k in range(120):
        w = base[:]
        for at in r.sample(range(150), r.choice([1, 2, 3, 3])):
            w[at] = f"x{k}y{at}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = writes(monkeypatch)
    got = sorted(map(tuple, jaccard.near_groups(docs, 3, 90).collect()))
    assert got == brute.near_groups(rows, 3, 90)
    assert len(seen) <= most


def test_few_links_are_written_by_few_tasks(spark, monkeypatch):
    seen = writes(monkeypatch)
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    last = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert components(spark.createDataFrame([(k, k + 1000) for k in range(300)], "a long, b long")).count() == 600
    finally:
        for k, v in last.items():
            spark.conf.set(k, v)
    assert len(seen) == 1 and len(spark.read.parquet(seen[0]).inputFiles()) <= spark.sparkContext.defaultParallelism


def test_lines_found_last_link_whole_classes(spark, monkeypatch):
    """The links of the classes so far are not gone through again."""
    r = random.Random(8)
    rows = []
    for k in range(0, 60, 3):
        words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(12)]
        rows += [(k, " ".join(words)), (k + 1, " ".join(words) + "x"), (k + 2, " ".join(["y" + words[0], *words[1:]]))]
    seen = []
    monkeypatch.setattr(linejoin, "components", lambda links: (seen.append(links.count()), components(links))[1])
    got = {x.doc_id: x.removed for x in linejoin.removals(spark.createDataFrame(rows, "doc_id long, text string"), least=1).collect() if x.removed}
    assert got == brute.removed_lines(rows, least=1) and len(got) == 40
    assert len(seen) == 2 and seen[0] >= 40 > seen[1]
