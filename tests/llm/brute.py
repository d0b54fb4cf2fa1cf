"""Plain versions of the operators, and a small corpus with the cases that they must bear."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import regex

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, keys string"


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Texts with exact and near copies, shared passages and lines, nulls, empty and long texts; the last columns clash with results."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(300)] + ["Ünï", "日本", "Ab"]
    make = lambda k: " ".join(r.choices(vocabulary, k=k))
    passage, line = make(90), "one line that stands in many of the texts here"
    texts: list[str | None] = [None, "", " \n\t ", "word", "two words", "two words", make(20_000)]
    while len(texts) < n:
        kind = r.randint(0, 5)
        if kind == 0 or len(texts) < 12:
            texts.append("\n".join(make(r.randint(3, 40)) for _ in range(r.randint(1, 5))))
        elif kind == 1:
            texts.append(r.choice([t for t in texts[7:] if t]))
        elif kind == 2:
            w = r.choice([t for t in texts[7:] if t]).split(" ")
            w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        elif kind == 3:
            texts.append(f"{make(5)} {passage} {make(r.randint(0, 30))}")
        elif kind == 4:
            texts.append(f"{make(9)}\n{line}\n{make(9)}\n{line[: r.randint(20, 40)]}x{line[40:]}\n\n{make(3)}\n")
        else:
            texts.append(make(12) + " " + make(3) * 2)
    return [(i * 3 + 1, t, "en", [None, "a", "a", "a", "b", "c"][i % 6], len(t or ""), 0.5, "k") for i, t in enumerate(texts)]


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


class Groups:
    def __init__(self, nodes):
        self.up = {x: x for x in nodes}

    def top(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


def near_groups(rows, n, percent):
    sets = {}
    for d, t, *_ in rows:
        w = words((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    groups = Groups(sets)
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                groups.link(a, b)
    return sorted((d, len(s), groups.top(d)) for d, s in sets.items())


def byte_repeats(rows, length):
    seen = defaultdict(int)
    raw = [(d, (t or "").encode()) for d, t, *_ in rows]
    for _, x in raw:
        for i in range(len(x) - length + 1):
            seen[x[i : i + length]] += 1
    out = []
    for d, x in raw:
        gone = [False] * len(x)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(x), sum(gone), spans, sha(bytes(b for b, g in zip(x, gone, strict=True) if not g))))
    return sorted(out)


def word_repeats(rows, length):
    first = {}
    for d, t, *_ in sorted(rows, key=lambda x: x[0]):
        w = words(t)
        for i in range(len(w) - length + 1):
            first.setdefault(tuple(w[i : i + length]), d)
    out = []
    for d, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())))
    return sorted(out)


def edit_distance(a: bytes, b: bytes) -> int:
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def within(a: bytes, b: bytes, k: int) -> bool:
    """Whether the edit distance is at most k: equal beginnings cost nothing, then one of three edits is next."""
    n = min(len(a), len(b))
    i = next((i for i in range(n) if a[i] != b[i]), n)
    a, b = a[i:], b[i:]
    if not a or not b or not k:
        return len(a) + len(b) <= k
    return within(a[1:], b[1:], k - 1) or within(a[1:], b, k - 1) or within(a, b[1:], k - 1)


def removed_lines(rows, edits=2, least=12, per_edit=12):
    where = defaultdict(list)
    for d, t, *_ in rows:
        for i, x in enumerate((t or "").encode().split(b"\n") if t else []):
            if len(x) >= least:
                where[x].append((d, i))
    groups, long = Groups(where), sorted((x for x in where if len(x) >= per_edit), key=len)
    for i, b in enumerate(long):
        for a in long[i - 1 :: -1] if i else ():  # the shorter
            if len(b) - len(a) > edits:
                break
            if within(a, b, min(edits, len(a) // per_edit)):
                groups.link(a, b)
    classes = defaultdict(list)
    for x, places in where.items():
        classes[groups.top(x)] += places
    gone = defaultdict(list)
    for places in classes.values():
        for d, i in set(places) - {min(places)}:
            gone[d].append(i)
    return {d: sorted(x) for d, x in gone.items()}


def tokens(text):
    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def leaks(rows, items, window=12, slack=2):
    out = {}
    for d, t, *_ in rows:
        w = tokens(t)
        for item, q in items:
            q = tokens(q)
            for shift in range(-len(q) + 1, len(w)) if len(q) >= window else ():
                equal = [0 <= j + shift < len(w) and w[j + shift] == x for j, x in enumerate(q)]
                if any(sum(equal[j : j + window]) >= window - slack for j in range(len(q) - window + 1)):
                    out[d, item] = max(out.get((d, item), (0, 0)), (sum(equal), len(q)))
    return sorted((*k, *v) for k, v in out.items())


def targets(sizes: dict, weights=(3, 1, 2), share=1.5, cap=2) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest, free = total - sum(cap * sizes[s] for s in full), [s for s in order if s not in full]
        level = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if level[s] >= cap * sizes[s]}
        if not over:
            return level | {s: cap * sizes[s] for s in full}
        full |= over
