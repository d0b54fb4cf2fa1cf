import os
import random
import re
from collections import Counter
from math import comb

import duckdb
import pytest
from pyspark.sql import functions as F

from newsloom.llm import quality

SF = "/root/testdata/sf0.1"


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(covered)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), n, len(w) < 50 or 100 * n > 50 * len(w))


def texts():
    random.seed(3)
    some = [None, "", " \n\t", "one", "a b", "a b c", "a b c a b c", "x x x x x", "a  b\x0bc d\ra b", "l1\nl2\n\nl1\n l1\nl2", "É# <É> &|"]
    return some + [" ".join(random.choice("ab c\nd E # f".split(" ")) for _ in range(random.randrange(300))) for _ in range(40)] + ["w%d v " % i * 3 for i in range(5)] + [" ".join(str(i % 4999) for i in range(12_000))]


def test_counts(spark):
    rows = [(i, t, "en", "k", 1) for i, t in enumerate(texts())] + [(None, "a b c", None, "k", 1), (3, "one", "en", "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, stratum int")
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((i, *plain(t), not plain(t)[-1])) for i, t, *_ in rows)
    assert quality.judge(docs.limit(0), labels.limit(0)).count() == 0


def test_hashes_that_meet_are_told_apart(spark):
    """With hashes of no bits at all every window meets every other, and the count is left to another seed."""
    frame = spark.createDataFrame([(["a", "b", "c", "d", "a", "b", "c"],), (["a"] * 7,)], "w array<string>")
    crowded = frame.select(quality._repeated(F.col("w"), F.lit(63), 0).alias("n"))
    assert [r.n for r in crowded.collect()] == [None, 7]


def test_binomial_tail(spark):
    cases = [(k, n) for n in (1, 5, 19, 20, 21, 150, 1000, 5000) for k in (0, 1, 2, 7, n // 60, n // 51) if k <= n]
    got = spark.createDataFrame(cases, "k long, n long").select(quality.binomial_tail(F.col("k"), F.col("n"), 0.02)).collect()
    for (k, n), (p,) in zip(cases, got):
        # exact: 2 % is 1 / 50
        want = sum(comb(n, j) * 49 ** (n - j) for j in range(k + 1)) / 50**n if k < n * 0.02 else 1
        assert p == pytest.approx(want, rel=1e-9), (k, n)


def test_false_rejections_are_bounded(spark):
    """Pure noise gets no cutoff that rejects more than the limit; a clear sign is found; strata without labels are left alone."""
    random.seed(11)

    def doc(symbols):
        return " ".join(f"w{random.randrange(9999)}" + ("#" if random.random() < symbols else "") for _ in range(60))

    rows, labels = [], []
    for i in range(2400):
        good = random.random() < 0.8
        clear = i % 2 == 0
        rows.append((i, doc(0.0 if good else 0.9) if clear else doc(random.random() * 0.5), "clear" if clear else "noise"))
        labels.append((i, int(good), 0))
    rows += [(9000 + i, doc(0.9), "rare") for i in range(20)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.judge(docs, marks).collect()}
    lost = lambda lang, q: [not got[i] for (i, _, l), (_, good, _) in zip(rows, labels) if l == lang and good == q]
    assert not any(lost("clear", 1)) and all(lost("clear", 0))
    assert sum(lost("noise", 1)) <= quality.LIMIT * len(lost("noise", 1))
    assert all(got[9000 + i] for i in range(20))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_agrees_with_sql(spark):
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    con = duckdb.connect()
    for n in ("documents", "labels"):
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{SF}/{n}.parquet')")
    got = quality.judge(read("documents").repartition(8), read("labels"))
    want = con.execute(quality.ORACLE_SQL)
    columns = ", ".join(c[0] for c in want.description)
    assert sorted(map(tuple, got.selectExpr(*columns.split(", ")).collect())) == sorted(want.fetchall())
    assert got.filter("NOT base_failed AND NOT kept").count() > 0
