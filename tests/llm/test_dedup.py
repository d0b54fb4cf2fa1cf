"""The deduplicating operators against plain versions."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from newsloom.llm import automata, jaccard, linejoin, runindex
from newsloom.llm.links import components
from tests.llm import brute


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def frame(spark, seed=1, n=60):
    rows = brute.corpus(seed, n)
    return rows, spark.createDataFrame(rows, brute.DOCS)


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, x) for x in range(201, 260)] + [(5, 5)]
    groups = brute.Groups({x for p in links for x in p})
    for a, b in links:
        groups.link(a, b)
    want = {(x, groups.top(x)) for p in links if p[0] != p[1] for x in p}
    assert set(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect())) == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n, percent, ones", [(3, 90, None), (5, 80, 2), (1, 60, None)])
def test_jaccard(spark, monkeypatch, n, percent, ones):
    if ones:  # so many segments are allotted one deletion
        monkeypatch.setattr(jaccard, "allot", lambda low, high, t, n_docs: ((d := math.floor((1 - t) / (1 + t) * 2 * high)) + 1 - 2 * min(ones, (d + 1) // 2), min(ones, (d + 1) // 2), 0))
    rows, docs = frame(spark, n, 90)
    w = [f"w{i}" for i in range(40)]
    rows += [(900 + k, " ".join(w[:i] + [f"x{k}"] * (k > 0) + w[i:]), "en", "a", 1, 0.5, "k") for k, i in enumerate((0, 0, 3, 20, 39, 40))]
    docs = spark.createDataFrame([*rows, rows[8], (None, "null id", "en", "a", 1, 0.5, "k")], brute.DOCS)
    got = sorted((tuple(r) for r in jaccard.near_groups(docs, n, percent).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    want = brute.near_groups(rows, n, percent)
    assert got == sorted([*want, next(x for x in want if x[0] == rows[8][0]), (None, max(3 - n, 1) if n < 3 else 1, None) if n > 1 else (None, 2, None)], key=repr)
    assert any(d != c for d, _, c in got)
    if ones:
        assert jaccard.near_groups(docs.limit(0), n, percent).count() == 0


def test_jaccard_of_a_passage_in_all_texts(spark):
    """Texts share a passage, and so keys, but few are linked; others are all near one text."""
    r = random.Random(8)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = " ".join(r.choices(vocabulary, k=14))
    texts = [f"{passage} {' '.join(r.choices(vocabulary, k=r.choice([3, 8, 20, 60])))}" for _ in range(160)]
    for t in texts[:40]:
        w = t.split()
        w[r.randrange(14, len(w))] = "changed"
        texts.append(" ".join(w))
    base = r.choices(vocabulary, k=120)
    for _ in range(100):
        w = base[:]
        for _ in range(r.randint(1, 4)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    got = rows_of(jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90), "doc_id", "n_shingles", "component_id")
    assert got == brute.near_groups(rows, 3, 90)
    assert 1 < len({c for *_, c in got}) < len(got)


def test_jaccard_through_the_sieve(spark, monkeypatch):
    from newsloom.llm import candidates

    monkeypatch.setattr(candidates, "BROADCAST_ROWS", 0)
    test_jaccard(spark, monkeypatch, 3, 90, None)


def test_index_matches():
    r = random.Random(3)
    for _ in range(30):
        strings = [bytes(r.choices(b"ab", k=r.randint(0, 40))) for _ in range(r.randint(1, 5))]
        index = runindex.RunLengthIndex(strings)
        got = index.matching_statistics()
        suffixes = [(s + i, x[i:]) for s, x in zip(index.starts, strings, strict=True) for i in range(len(x))]
        for at, x in suffixes:
            def alike(y, x=x):
                return next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
            assert got[at] == max((alike(y) for other, y in suffixes if other != at), default=0)


@pytest.mark.parametrize("length, part, hot", [(40, 8, 2000), (40, 8, 1), (400, 64, 2000)])
def test_byte_repeats(spark, monkeypatch, length, part, hot):
    monkeypatch.setattr(runindex, "SHARD_BYTES", 20_000)
    rows, _ = frame(spark, 2, 70)
    rows += [(950, "é" * 900, "en", "a", 1, 0.5, "k"), (951, "ab" * 300, "en", "a", 1, 0.5, "k")]
    docs = spark.createDataFrame([*rows, (None, rows[9][1], "en", "a", 1, 0.5, "k")], brute.DOCS)
    cuts = runindex.repeated_bytes(docs, length, part, hot)
    monkeypatch.setattr(runindex, "repeated_bytes", lambda *a: cuts)
    got = runindex.drop_repeats(docs, length, part).filter("doc_id is not null")
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.byte_repeats(rows, length)


def test_byte_repeats_of_nothing(spark):
    _, docs = frame(spark)
    assert runindex.drop_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [2000, 1])
def test_word_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(automata, "SHARD_PASSAGES", 50)
    rows, _ = frame(spark, 4, 80)
    rows += [(960, "a b " * 40, "en", "a", 1, 0.5, "k"), (961, "a b " * 30, "en", "a", 1, 0.5, "k")]
    docs = spark.createDataFrame([*rows, (None, rows[9][1], "en", "a", 1, 0.5, "k")], brute.DOCS)
    cuts = automata.repeated_windows(docs, hot=hot)
    monkeypatch.setattr(automata, "repeated_windows", lambda *a: cuts)
    got = automata.drop_repeats(docs).filter("doc_id is not null")
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute.word_repeats(rows, automata.LENGTH)
    monkeypatch.undo()
    assert automata.drop_repeats(docs.limit(0)).count() == 0


def test_automaton():
    r = random.Random(6)
    for _ in range(20):
        texts = [r.choices(range(3), k=r.randint(0, 25)) for _ in range(6)]
        a = automata.SuffixAutomaton()
        for mark, t in enumerate(texts):
            a.add(t, mark)
        for t in texts:
            want = [next(m for m, x in enumerate(texts) if any(x[j : j + 4] == t[i : i + 4] for j in range(len(x)))) for i in range(len(t) - 3)]
            assert a.first_marks(t, 4) == want


def test_distances():
    r = random.Random(7)
    pairs = []
    for _ in range(300):
        a = bytes(r.choices(b"abc", k=r.randint(0, 30)))
        b = bytearray(a)
        for _ in range(r.randint(0, 5)):
            at = r.randint(0, len(b))
            b[at : at + r.randint(0, 1)] = bytes(r.choices(b"abc", k=r.randint(0, 1)))
        pairs.append((a, bytes(b)))
    for cap in (1, 2, 6):
        assert linejoin.distances(pairs, cap).tolist() == [min(brute.edit_distance(a, b), cap + 1) for a, b in pairs]


def test_lines(spark):
    rows, _ = frame(spark, 8, 70)
    r = random.Random(9)
    base = "a line of some forty bytes, to be edited."
    for k in range(40):
        line = bytearray(base, "ascii")
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(line))
            line[at : at + r.randint(0, 1)] = r.choice([b"", b"x", b"y"])
        rows.append((2000 + k, f"start {k} of it all\n{line.decode()}\nshort\nexactly twelve", "en", "a", 1, 0.5, "k"))
    docs = spark.createDataFrame(rows, brute.DOCS)
    found = linejoin.removals(docs).collect()
    want = brute.removed_lines(rows)
    assert {x.doc_id: x.removed for x in found if x.removed} == want
    assert sorted(x.doc_id for x in found) == sorted(x[0] for x in rows)
    kept = {x.doc_id: x for x in linejoin.drop_lines(docs).collect()}
    for d, t, *_ in rows:
        gone, own = set(want.get(d, ())), (t or "").split("\n") if t else []
        if gone and len(gone) == len(own):
            assert d not in kept
            continue
        assert kept[d].text == (t if not gone else "\n".join(x for i, x in enumerate(own) if i not in gone))
        assert kept[d].n_chars == (len(kept[d].text) if gone else 1 if d >= 2000 else len(t or ""))
    assert linejoin.removals(docs.limit(0)).count() == 0


def edited(r, line, edits, letters=b"abc"):
    out = bytearray(line)
    for _ in range(edits):
        at = r.randint(0, len(out))
        out[at : at + r.randint(0, 1)] = bytes(r.choices(letters, k=r.randint(0, 1)))
    return bytes(out)


@pytest.mark.parametrize("parts", [0, 5, 9, 24])
def test_close_lines_share_a_key(parts):
    r, pairs = random.Random(parts), []
    while len(pairs) < 500:
        a = bytes(r.choices(b"abc", k=r.randint(12, 60)))
        b = edited(r, a, r.randint(0, 2))
        if brute.within(a, b, min(2, min(len(a), len(b)) // 12)):
            pairs += [a, b]
    ends = np.cumsum([len(x) for x in pairs])
    data = np.frombuffer(b"".join(pairs), np.uint8)
    owner, key, probe, gaps = linejoin.keys(linejoin.ts.prefix(data), ends - [len(x) for x in pairs], ends, 2, parts)
    found = [defaultdict(set) for _ in pairs]
    for o, k, p, g in zip(owner.tolist(), key.tolist(), probe.tolist(), gaps.tolist(), strict=True):
        found[o][k].add((p, g))

    def meet(a, b):
        return any(not (p and q) and (g == 0 or g >> 32 != h >> 32 and g % 2**32 != h % 2**32) for k in a.keys() & b.keys() for p, g in a[k] for q, h in b[k])

    assert all(pairs[i] == pairs[i + 1] or meet(found[i], found[i + 1]) for i in range(0, len(pairs), 2))


@pytest.mark.parametrize("crowd, finer", [(8, (12,)), (0, (5, 9))])
def test_variants_of_one_line(spark, crowd, finer):
    """Hundreds of variants of a line share keys, though most are not close to each other; some long lines too."""
    r = random.Random(12)
    words = ["".join(r.choices("abcde", k=r.randint(2, 6))) for _ in range(60)]
    base = r.choices(words, k=14)
    rows = []
    for k in range(260):
        w = base[:]
        for _ in range(r.randint(1, 2)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((k, f"page {k % 40:02d} of {k % 3}\n" + " ".join(w)))
    long = " ".join(r.choices(words, k=600))
    rows += [(900 + k, edited(r, long.encode(), k % 4).decode()) for k in range(9)] + [(990, "0123456789a"), (991, "0123456789b"), (992, "0123456789ab"), (993, "0123456789ac")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.removed for x in linejoin.removals(docs, least=1, crowd=crowd, finer=finer).collect() if x.removed}
    assert got == brute.removed_lines(rows, least=1)
    assert got[993] == [0] and 991 not in got
