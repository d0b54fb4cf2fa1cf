"""Terms that disclose personal data."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from newsloom.llm import disclosure, textscan
from tests.llm import brute


#: Texts of one person, in words that no other of them has.
OTHERS = [
    "the council heard Zarquon on friday (ann@mail.example)", "write: ann@mail.example or ask Zarquon", "Zarquon bought three boats", "lately ann@mail.example went unanswered while Zarquon travelled north",
    "minutes taken by Zarquon , copy sent to ann@mail.example at noon",
]


def terms_of(spark, texts, **limits):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: {texts[r.doc_id][x.start : x.end] for x in r.terms} for r in disclosure.find(docs, **limits).collect()}


def test_copies_neither_hide_a_term_nor_make_one(spark):
    mail = "Zarquon writes from ann@mail.example with hearty greetings heitein"
    copies = [f"quiet harbour words about bob@mail.example and rare lanterns {x}".strip() for x in ("", "", "tonight", "tonight")]
    plain_texts = [f"plain text with number {i} in it" for i in range(60)]
    got = terms_of(spark, [mail] * 20 + OTHERS + copies + plain_texts)
    assert [got[i] for i in range(25)] == [{"Zarquon"}] * 25
    assert not any(got[i] for i in range(25, len(got)))


def plain_base(text):
    """Base spans by the patterns as they are given."""
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        doubled = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
        if 16 <= len(digits) <= 19 and (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0:
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def test_base_spans_by_plain_patterns(spark):
    draw = random.Random(11)
    bits = ["a@b.c", "x.y+z@host.example.org", "@", ".", "+", "-", " ", "(", ")", "1", "25", "255", "256", "10.0.0.1", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111111111111111", "4111 1111-1111 1111", "+44 20 7946 0958", "+1", "日", "é", "a", "\n", "0000000000000000", "007.1.2.3"]
    texts = ["".join(draw.choices(bits, k=draw.randrange(1, 30))) for _ in range(800)] + [None, "", "7" * 3000, "a" * 3000 + "@", "1." * 2000]
    rows = [(i if i % 9 else None, t, "other") for i, t in enumerate(texts)]
    got = disclosure.report(spark.createDataFrame(rows, "doc_id long, text string, base string")).collect()
    want, kinds = [], set()
    for i, t, _ in rows:
        spans = plain_base(t or "")
        kinds |= {k for k, *_ in spans}
        n = Counter(k for k, *_ in spans)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((i if i is not None else -1, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(want)
    assert kinds == set(disclosure.KINDS)


def test_sanitised_texts(spark):
    mails = OTHERS
    rows = [*enumerate(mails), (None, mails[0]), (None, mails[0]), (7, None), (8, "é 192.0.2.7, +44 20 7946 0958")]
    rows += [(100 + i, f"plain text with number {i} in it") for i in range(60)]
    got = disclosure.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    clean = [m.replace("Zarquon", "[name]").replace("ann@mail.example", "[email]") for m in mails]
    want = [*enumerate(clean), (None, clean[0]), (None, clean[0]), (7, ""), (8, "é [ip], [phone]"), *rows[-60:]]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def word_hashes(words):
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = textscan.words(data, np.array([0, len(data)]))
    return textscan.word_hashes(data, starts, ends).tolist()


def plain(texts):
    """Terms of each document by the definition."""
    docs, sides = [], []
    for t in texts:
        spans, at, free, beside = plain_base(t or ""), 0, [], {}
        every = brute.words(t)
        low = [int(h >> 33) for h in word_hashes(every)]
        for i, w in enumerate(every):
            at = t.index(w, at)
            if all(at + len(w) <= a or at >= b for _, a, b in spans):
                free.append((w, at))
                x = (min(low[max(i - 6, 0) : i], default=-1), min(low[i + 1 : i + 7], default=-1))
                beside[w] = tuple(map(min, beside.get(w, x), x))
            at += len(w)
        docs.append(({(k, t[a:b].lower()) for k, a, b in spans}, free))
        sides.append(beside)
    n, n_term = len(texts), Counter(w for _, free in docs for w in {w for w, _ in free})
    n_entity, both = Counter(e for es, _ in docs for e in es), Counter((e, w) for es, free in docs for e in es for w in {w for w, _ in free})
    told = set()
    for (e, w), k in both.items():
        content = math.log2(n / n_entity[e])
        around = {s[w] for (es, _), s in zip(docs, sides, strict=True) if e in es and w in s}
        if min(len({x[j] for x in around}) for j in (0, 1)) <= max(1, len(around) / 2):
            continue
        if k >= 2 and k >= 0.5 * n_entity[e] and content > 0 and math.log2(n * k / (n_entity[e] * n_term[w])) >= 0.8 * content - 1e-12:
            told.add(w)
    return [sorted((a, a + len(w)) for w, a in free if w in told) for _, free in docs]


@pytest.mark.parametrize("common, bits", [(0.001, 1 << 26), (0.2, 64), (1.0, 1 << 26)])
def test_terms_of_whole_documents(spark, common, bits):
    filler = "some words é between them " * 40
    texts = [f"Zarquon {filler} ann@mail.example {filler} end +44 20 7946 0958, quux{i}" for i in range(4)]
    texts += [f"Zarquon without the entity {filler}", None, "", "ann@mail.example", "192.0.2.7 ann@mail.example,192.0.2.8 44 Zarquon"]
    texts += [f"日本 {t} bob@mail.example 日本 0958" for t in texts[:2]] + [t for *_, t in [r[:2] for r in brute.corpus(7, 50)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(x.start, x.end) for x in r.terms] for r in disclosure.find(docs, common=common, bits=bits).collect()}
    want = plain(texts)
    assert got == dict(enumerate(want))
    assert (0, 7) in want[0] and (0, 7) in want[4]
    assert disclosure.report(docs.limit(0)).count() == 0
