"""Benchmark items that are shorter than the window."""

import pytest

from newsloom.llm import decontaminate
from tests.llm import brute


def test_short_items(spark):
    items = [(1, "What is it?"), (2, "one two three four five six seven eight nine ten eleven"), (3, ""), (4, None), (5, "gone"), (6, " ".join(map(str, range(20))))]
    texts = ["So: WHAT, is it. What is it", "what it is", "x " + items[1][1].upper() + " y", items[1][1].replace("six", "6"), None, "", "gone", "a " + items[5][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.leaks(list(enumerate(texts)), items)
    for d, t in enumerate(texts):
        for i, q in items:
            w, q = brute.tokens(t), brute.tokens(q)
            if 0 < len(q) < 12 and any(w[k : k + len(q)] == q for k in range(len(w))):
                want.append((d, i, len(q), len(q)))
    assert sorted(map(tuple, decontaminate.leaks(docs, bench).collect())) == sorted(want)
    assert {(0, 1, 3, 3), (2, 2, 11, 11), (6, 5, 1, 1)} <= set(want)
    assert decontaminate.leaks(docs.limit(0), bench).count() == decontaminate.leaks(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("seed_rows", [0, 1 << 20])
def test_null_ids_and_repeats(spark, seed_rows):
    """The same rows however the seeds are joined."""
    item = " ".join(f"t{i}" for i in range(20))
    docs = spark.createDataFrame([(1, item, "k"), (1, item, "k"), (None, item, "k"), (2, None, "k"), (None, None, None)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(5, item), (5, item), (None, item), (6, "")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.contaminated(docs, bench, seed_rows=seed_rows).collect()] == [(1, 5, 20, 20)]
