import random
import re
from collections import Counter

import pytest

from newsloom.llm import phrases


def plain(rows, top=phrases.TOP):
    """The contract over (text, lang)."""
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            mine = f.setdefault(lang, Counter())
            for k in (1, 2, 3):
                mine.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, mine in f.items():
        able = {p: a for p, a in mine.items() if len(p) > 1 and a >= 10}
        found = []
        for p, a in able.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and p in (q[:2], q[1:]) for q, b in able.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (mine[p[:k]] * mine[p[k:]]), k, mine[p[:k]], mine[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def corpus(seed, docs):
    random.seed(seed)
    vocabulary = ["a", "The", "the", "of", "de", "en", "Éa", "x y", "hot"] + [f"w{i}" for i in range(40)]
    fixed = ["New York City", "hot dog", "in and out", "one two", "one two three"]
    rows = [(None, "en"), ("", None), (" \t", "de"), ("...;\n\r", "fr"), ("solo", "xx"), ("b\x0bc b\x0bc", "en")]
    for _ in range(docs):
        parts = [random.choice(fixed) if random.random() < 0.2 else random.choice(vocabulary) for _ in range(random.randrange(1, 200))]
        rows.append(("".join(p + random.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", ";:"]) for p in parts), random.choice(["en", "en", "de", None, "und", "en,de"])))
    return rows + [("en de " * 30, "de"), ("de en " * 30, "en"), ("go " * 5000, "en"), ("hot dog " * 300, "nl")] + rows[20:30]


@pytest.mark.parametrize("seed, docs, top, memory", [(1, 60, 2000, 250_000), (2, 150, 2000, 500), (3, 60, 7, 50)])
def test_table(spark, monkeypatch, seed, docs, top, memory):
    monkeypatch.setattr(phrases, "GATHER", 800)
    rows = corpus(seed, docs)
    frame = spark.createDataFrame([(i if i % 9 else None, *r, "w", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, word string, h1 int").repartition(3)
    got = phrases.collocations(frame, top, memory)
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, top))
    assert phrases.collocations(frame.limit(0)).count() == 0


def test_partition_keeps_to_memory(spark):
    counts = spark.createDataFrame([(i * 7919, 1 + i % 50) for i in range(3000)] + [(123_456_789, 100_000)], "h long, f long")
    first, parts = phrases.partition(counts, 1000)
    totals = Counter()
    for r in counts.collect():
        totals[r.h % phrases.BUCKETS] += r.f
    groups = Counter()
    for b, f in totals.items():
        for part in range(parts[b]):
            groups[first[b] + part] += f / parts[b]
    assert max(groups.values()) <= 1000 and len(groups) < 1000


def test_exact_beyond_64_bits(spark):
    score = "CAST(1000000 * CAST(a AS DECIMAL(38, 0)) * CAST(a AS DECIMAL(38, 0)) div (CAST(l AS DECIMAL(38, 0)) * CAST(r AS DECIMAL(38, 0))) AS BIGINT) AS s"
    cases = [(3_000_000_019, 3_000_000_021, 3_000_000_037), (7, 9_000_000_000, 11), (10**13, 10**13 + 1, 10**13 + 2), (999_999_999_989, 10**12, 10**12)]
    got = spark.createDataFrame(cases, "a long, l long, r long").selectExpr(score).collect()
    assert [r.s for r in got] == [1_000_000 * a * a // (x * y) for a, x, y in cases]
