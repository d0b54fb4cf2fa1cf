"""Exact repeats of short lines."""

import corpus_pipeline
from newsloom.llm import queries
from tests.llm import brute


def test_short_lines(spark, tmp_path):
    rows = [(1, "Les Rech.\n\na\nfirst text of its own"), (2, "a\n\nLes Rech.\nsecond text, another one"), (3, "é\né\n\nLes Rech!"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.removed for r in queries.op5_line_dedup(spark, str(tmp_path)).collect()}
    assert {d: x for d, x in found.items() if x} == brute.removed_lines(rows, least=1) == {2: [0, 2], 3: [1]}
    kept = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()}
    assert kept == dict(rows) | {2: "\nsecond text, another one", 3: "é\n\nLes Rech!"}
