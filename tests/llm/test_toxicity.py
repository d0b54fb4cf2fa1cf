"""Toxicity: held-out quality, no use of held-out labels, odd rows and columns."""

import os
import zlib

import pytest
from pyspark.sql import functions as F

from newsloom.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    # what is held out, turned over: the scores must not follow
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    got = {r.doc_id: r for r in toxicity.score(docs, turned).collect()}
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in got.items())
    truth = {r.doc_id: r.toxic for r in labels.filter("toxic IS NOT NULL").collect() if got[r.doc_id].held_out}
    bad, good = ([got[d].score for d, t in truth.items() if t == x] for x in (1, 0))
    auc = sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / (len(bad) * len(good))
    assert auc >= 0.95 and sum(x >= 0.3 for x in bad) >= 0.8 * len(bad) and sum(x >= 0.3 for x in good) <= 0.05 * len(good)


def test_odd_rows_and_columns(spark):
    rows = [(i, f"you are a stupid idiot {i}" if i % 3 == 0 else f"the weather is fine today {i}", 0.5, 1, True) for i in range(60)] + [(None, None, 0.5, 1, True), (90, "", 0.5, 1, True), (3, "you are a stupid idiot 3", 0.5, 1, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int, held_out boolean")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)] + [(0, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, labels).count() == len(rows)
    kept = toxicity.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} <= {0.5}
    assert {r.predicted for r in toxicity.score(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.score(docs.limit(0), labels).count() == 0
