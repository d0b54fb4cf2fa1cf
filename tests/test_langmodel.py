"""The language model counts and weighs trigrams inside tasks."""

from collections import Counter

import pyarrow as pa

from newsloom.operators import langmodel


def test_trigrams_of_slices(monkeypatch):
    monkeypatch.setattr(langmodel, "SLICE", 8)
    texts = ["abcabc", "", "xy", "é\U0001f600ü" * 4, "abc"]
    got = Counter()
    for i, _, of, codes in langmodel.trigrams(pa.array(texts)):
        got.update((i + a, b) for a, b in zip(of.tolist(), codes.tolist(), strict=True))
    want = Counter()
    for i, x in enumerate(texts):
        want.update((i, ord(x[k]) << 42 | ord(x[k + 1]) << 21 | ord(x[k + 2])) for k in range(len(x) - 2))
    assert got == want


def test_detecting_shuffles_no_trigrams(spark):
    rows = [(1, "the cat and the hat", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "42", "de"), (None, "the cat", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langmodel.LanguageModel.fit(docs.filter("doc_id < 3")).detect(docs, "doc_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan
    assert {r.doc_id: r.language for r in found.collect()} == {1: "en", 2: "de", 3: None, 4: None, None: None}
