"""Main text of web pages by a tree-structured graphical model over the DOM.

Each block-level element is a node with a hidden label, main text or not. A node has a
unary potential (by its tag, its names and its own text), and each parent-child pair a
pairwise potential by the child's kind. Sum-product messages go up
and down the tree once, which gives every node's exact marginal; text of nodes with a
marginal of at least 0.5 is kept. Both potentials are learned from labelled pages: pages
of made-up layouts (`labelled_layouts`) whose parts are known, and at most SAMPLE_PAGES
pages of the table that mark their article.

Scripts, styles, forms, the head, and what stands in for media (NEVER) never hold main text,
whatever the model says.

A block is a run of text between block-level tags; <br> is white space. Tags are read by
HTML's states in one pass: a quote opens a value only right after `=`. Defined results:
null or empty html, or html without text, gives the empty string; a quote that is never
closed is part of an unquoted value; from a tag that is never closed on, all is text; unclosed and stray
elements are repaired as browsers do in the simple cases; repeated rows give repeated results;
an empty table gives no rows; only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.durable import hash_bound

#: Bounds of the sample that the model is fitted on: pages, and bytes of a page.
SAMPLE_PAGES, SAMPLE_BYTES = 300, 100_000
LAYOUT_PAGES = 400

#: HTML's inline, void and raw-text elements, and those whose content is no text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn del em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot munder mover munderover mspace mstyle semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head script style noscript template iframe object svg canvas form select option button textarea input fieldset title xmp noembed noframes audio video datalist annotation".split())
#: A start tag of these closes an open <p>; of LIKE, an open element of the same group.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KINDS = {
    "nav": {"nav", "menu"}, "header": {"header"}, "footer": {"footer"}, "aside": {"aside"}, "article": {"article", "main"}, "section": {"section", "div", "body", "html", "center"},
    "heading": {"h1", "h2", "h3", "h4", "h5", "h6"}, "p": {"p", "blockquote", "pre", "figcaption"}, "list": {"ul", "ol", "dl"}, "item": {"li", "dt", "dd"},
    "table": {"table", "tbody", "thead", "tr", "td", "th"},
}
KIND_OF = {tag: kind for kind, tags in KINDS.items() for tag in tags}
KIND_LIST = [*KINDS, "other"]
KIND_AT = {k: i for i, k in enumerate(KIND_LIST)}
#: Words in class, id and role that tell a part of a page.
NAMES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip",
    "frame": "header masthead banner topbar footer foot copyright colophon logo",
    "side": "sidebar aside widget rail related recommended recommendations trending popular more",
    "notice": "cookie cookies consent notice gdpr alert modal popup overlay disclaimer paywall",
    "advert": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion promoted banner",
    "form": "form login search signup subscribe subscription newsletter contact",
    "comments": "comment comments respond reply replies discussion disqus reviews feedback",
    "share": "share sharing social tags tag meta byline author follow tools",
    "article": "article post entry story content main text body hentry prose page",
}
NAME_OF: dict[str, list[int]] = {}
for _i, _words in enumerate(NAMES.values()):
    for _w in _words.split():
        NAME_OF.setdefault(_w, []).append(_i)
#: Kinds that tell about all that is in them.
PARTS = [KIND_AT[k] for k in ("nav", "header", "footer", "aside", "article")]
N_FEATURES = 2 * len(KIND_LIST) + 2 * len(NAMES) + len(PARTS) + 7

_NAME = re.compile(r"[^\s/>]++")
_ATTRIBUTE = re.compile(r"[\s/]*+(=?[^\s/>=]*+)(?:\s*+=\s*+([^\s>]?))?")
_VALUE = re.compile(r"[^\s>]*+")
_NAMING = frozenset(("class", "id", "role"))
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

#: What ends a comment, at once or later; and raw text.
_COMMENT_END, _COMMENT_END_LATER = re.compile("-?>"), re.compile("--!?>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)", re.I | re.A) for tag in RAW}


class Tags:
    """Reads the tags of a page one after the other, each character a bounded number of times."""

    def __init__(self, html: str) -> None:
        self.html = html
        self.unclosed = {q: False for q in ("\"", "'", ">")}

    def find(self, what: str, at: int) -> int:
        """The next place of a sign; -1 if there is none, which is then known for all later places."""
        if self.unclosed[what]:
            return -1
        found = self.html.find(what, at)
        self.unclosed[what] = found < 0
        return found

    def tag(self, at: int) -> tuple[str, str, str, int] | None:
        """Of the "<" at this place: "start", "end", "" (a comment or the like) or "rest" (all that follows is text), tag, names and where it ends; None for plain text."""
        html, n = self.html, len(self.html)
        if html.startswith("<!--", at):
            end = _COMMENT_END.match(html, at + 4) or _COMMENT_END_LATER.search(html, at + 4)
            return "", "", "", end.end() if end else n
        sign = html[at + 1 : at + 2]
        closing = sign == "/"
        begin = at + 1 + closing
        letter = html[begin : begin + 1]
        if not (letter.isascii() and letter.isalpha()):
            if not closing and sign not in ("!", "?"):
                return None
            end = self.find(">", at)
            return ("", "", "", end + 1) if end >= 0 else None
        name = _NAME.match(html, begin)
        place, names = name.end(), []
        while True:
            found = _ATTRIBUTE.match(html, place)
            place = found.end()
            quote = found[2]
            if quote is not None:
                end = self.find(quote, place) if quote in ("\"", "'") else -1
                if end >= 0:
                    value, place = html[place:end], end + 1
                else:
                    value = _VALUE.match(html, place - len(quote))
                    value, place = value[0], value.end()
                if found[1].lower() in _NAMING:
                    names.append(value)
            if place >= n:
                return "rest", "", "", n
            if html[place] == ">":
                return "end" if closing else "start", name[0].lower(), " ".join(names), place + 1


class Tree:
    """Block-level elements of a page, in page order; node 0 is the page."""

    __slots__ = ("blocks", "dead", "links", "names", "parent", "tags")

    def __init__(self) -> None:
        self.tags, self.names, self.parent, self.dead = ["html"], [""], [-1], [False]
        self.blocks: list[tuple[int, str]] = []
        self.links: dict[int, int] = {}


def parse(html: str) -> Tree:
    tree = Tree()
    stack, run, at, linked = [0], [], 0, 0

    def flush() -> None:
        nonlocal run
        if run:
            text = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
            if text:
                tree.blocks.append((stack[-1], text))
            run = []

    def close(tags: set[str] | frozenset[str], stop: frozenset[str] = frozenset()) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            tag = tree.tags[stack[depth]]
            if tag in tags:
                flush()
                del stack[depth:]
                return
            if tag in stop:
                return

    def text(part: str) -> None:
        if part and not tree.dead[stack[-1]]:
            run.append(part)
            if linked:
                tree.links[stack[-1]] = tree.links.get(stack[-1], 0) + len(part)

    n, tags = len(html), Tags(html)
    while at < n:
        open_at = html.find("<", at)
        if open_at < 0:
            text(html[at:])
            break
        text(html[at:open_at])
        found = tags.tag(open_at)
        if not found:
            text("<")
            at = open_at + 1
            continue
        sort, tag, names, at = found
        if sort == "rest":
            text(html[open_at:])
        if sort == "end":
            if tag in INLINE:
                linked = max(0, linked - (tag == "a"))
            elif tag == "br":
                text(" ")
            else:
                close({tag})
        elif sort == "start":
            if tag in INLINE:
                linked += tag == "a"
                continue
            if tag == "br":
                text(" ")
                continue
            if tag in RAW:
                # in the page itself: lower-casing would move places
                end = _RAW_END[tag].search(html, at)
                at = end.start() if end else n
                flush()
                if end:
                    at = html.find(">", at) + 1 or n
                continue
            flush()
            if tag in VOID:
                continue
            if tag in CLOSES_P:
                close({"p"}, frozenset({"button", "td", "th", "article", "div", "section"}))
            if tag in LIKE:
                close(LIKE[tag], frozenset({"ul", "ol", "dl", "table", "select"}))
            linked = 0
            if tag == "html":
                continue
            tree.tags.append(tag)
            tree.names.append(names)
            tree.parent.append(stack[-1])
            tree.dead.append(tree.dead[stack[-1]] or tag in NEVER)
            stack.append(len(tree.tags) - 1)
    flush()
    return tree


def describe(tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Features of each node, and its kind."""
    n = len(tree.tags)
    kinds = np.array([KIND_AT[KIND_OF.get(t, "other")] for t in tree.tags])
    x = np.zeros((n, N_FEATURES - len(NAMES) - len(PARTS)))
    x[np.arange(n), kinds] = 1
    base = len(KIND_LIST)
    for i, names in enumerate(tree.names):
        if names:
            for part in _PART.findall(names.lower()):
                for k in NAME_OF.get(part, ()):
                    x[i, base + k] = 1
    base += len(NAMES)
    length, marks = np.zeros(n), np.zeros(n)
    for node, text in tree.blocks:
        length[node] += len(text)
        marks[node] += text.count(". ") + text.count(", ") + text.endswith((".", "!", "?"))
    linked = np.array([tree.links.get(i, 0) for i in range(n)])
    x[:, base] = np.log1p(length) / 5
    x[:, base + 1] = np.minimum(linked / np.maximum(length, 1), 1)
    x[:, base + 2] = length == 0
    x[:, base + 3] = np.minimum(marks, 10) / 10
    x[:, base + 4] = (length > 0) & (length < 25)
    x[:, base + 5] = length > 120
    x[:, base + 6] = 1
    base += 7
    parent = np.array(tree.parent[1:], np.int64)
    np.add.at(x, (parent, base + kinds[1:]), 1)
    x[:, base:] = np.log1p(x[:, base:])
    # what the elements around a node are and how they are named
    own = np.concatenate((x[:, len(KIND_LIST) : len(KIND_LIST) + len(NAMES)], x[:, PARTS]), 1)
    around = np.zeros_like(own)
    for i in range(1, n):
        p = tree.parent[i]
        around[i] = np.maximum(around[p], own[p])
    return np.concatenate((x, around), 1), kinds


class TreeModel:
    """Unary weights and, for each kind of child, the coupling of its label with its parent's.

    With labels of 0 and 1, a page's labels have the probability exp(sum of unary * features * label
    + sum of coupling * label * parent's label), normalised. Weights are learned by pseudo-likelihood:
    each label given its neighbours' is a logistic regression. As neighbours are uncertain when a page is
    read, a part of theirs is turned over in training, else the unary weights would lean on them.
    """

    def __init__(self, unary: np.ndarray, coupling: np.ndarray) -> None:
        self.unary, self.coupling = unary, coupling

    @classmethod
    def fit(cls, pages: list[tuple[Tree, list[bool]]], rounds: int = 12, ridge: float = 0.5, noise: float = 0.1) -> TreeModel:
        rows, truth, chance = [], [], np.random.default_rng(11)
        for tree, labels in pages:
            x, kinds = describe(tree)
            main = np.array(labels, float)
            seen = np.where(chance.random(len(main)) < noise, 1 - main, main)
            near = np.zeros((len(main), len(KIND_LIST)))
            for i, p in enumerate(tree.parent):
                if p >= 0 and not tree.dead[i]:
                    near[i, kinds[i]] += seen[p]
                    near[p, kinds[i]] += seen[i]
            live = ~np.array(tree.dead)
            rows.append(np.concatenate((x, near), 1)[live])
            truth.append(main[live])
        width = N_FEATURES + len(KIND_LIST)
        x, y = (np.concatenate(rows), np.concatenate(truth)) if rows else (np.zeros((0, width)), np.zeros(0))
        w = np.zeros(width)
        for _ in range(rounds if len(y) else 0):  # Newton steps
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(width)
            w = w - np.linalg.solve(curve, x.T @ (p - y) + ridge * w)
        return cls(w[:N_FEATURES], np.clip(w[N_FEATURES:], -6, 6))

    def marginals(self, tree: Tree) -> list[float]:
        """Of main text, by one upward and one downward pass of messages in log odds."""
        x, kinds = describe(tree)
        own = (x @ self.unary).tolist()
        tie = np.where(tree.dead, 0.0, self.coupling[kinds]).tolist()
        n = len(own)
        up, belief = [0.0] * n, own[:]
        for i in range(n - 1, 0, -1):  # children come after their parent
            b, t = belief[i], tie[i]
            up[i] = _log_add(0.0, t + b) - _log_add(0.0, b)
            belief[tree.parent[i]] += up[i]
        for i in range(1, n):
            rest, t = belief[tree.parent[i]] - up[i], tie[i]
            belief[i] += _log_add(0.0, t + rest) - _log_add(0.0, rest)
        return [1 / (1 + math.exp(-max(-60.0, min(60.0, b)))) for b in belief]


def _log_add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def labels_of(tree: Tree, main: set[int]) -> list[bool]:
    """Labels of all nodes from those whose own text is main text: of containers, the lowest that
    holds all main text, and those below it of which half the text is main."""
    n = len(tree.tags)
    good, total, owns = [0] * n, [0] * n, [False] * n
    for node, text in tree.blocks:
        owns[node] = True
        total[node] += len(text)
        good[node] += len(text) * (node in main)
    for i in range(n - 1, 0, -1):
        good[tree.parent[i]] += good[i]
        total[tree.parent[i]] += total[i]
    lowest = max((i for i in range(n) if good[i] == good[0]), default=0)
    inside = [False] * n
    for i in range(n):
        inside[i] = i == lowest or (tree.parent[i] >= 0 and inside[tree.parent[i]])
    return [(i in main) if owns[i] else inside[i] and total[i] > 0 and (i == lowest or 2 * good[i] >= total[i]) for i in range(n)]


def from_article(html: str) -> tuple[Tree, list[bool]] | None:
    """A page that has one <article>: its text, save in parts named otherwise, is the label."""
    tree = parse(html)
    if tree.tags.count("article") != 1:
        return None
    inside = [False] * len(tree.tags)
    for i, p in enumerate(tree.parent):
        alien = any(k < len(NAMES) - 2 for part in _PART.findall(tree.names[i].lower()) for k in NAME_OF.get(part, ()))
        inside[i] = tree.tags[i] == "article" or (p >= 0 and inside[p] and not alien and tree.tags[i] not in ("nav", "aside", "footer"))
    return tree, labels_of(tree, {i for i in range(len(inside)) if inside[i]})


def labelled_layouts(pages: int = LAYOUT_PAGES, seed: int = 7) -> list[tuple[Tree, list[bool]]]:
    """Pages of made-up layouts. Main paragraphs carry a mark that is taken off again."""
    r = random.Random(seed)
    made = []
    vocabulary = ["".join(r.choices("aeiouklmnrst", k=r.randint(1, 9))) for _ in range(500)]

    def words(n: int) -> str:
        out = r.choices(vocabulary, k=max(n, 1))
        for i in range(7, len(out), 9):
            out[i] += r.choice([",", "."])
        return " ".join(out).capitalize() + r.choice([".", ".", ""])

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(r.randint(1, 4))}</a></li>' for i in range(n))

    def paragraphs(n: int, mark: str = "", low: int = 5, high: int = 90) -> str:
        return "".join(f"<p>{mark}{'<b>' if r.random() < 0.1 else ''}{words(r.randint(low, high))}</p>" for _ in range(n))

    for _ in range(pages):
        m = "\x02"
        title = f"<h1>{m}{words(r.randint(3, 12))}</h1>"
        body = [title, paragraphs(r.randint(1, 8), m)]
        if r.random() < 0.3:
            body.append(f"<h2>{m}{words(4)}</h2>{paragraphs(r.randint(1, 3), m)}")
        if r.random() < 0.25:
            body.append("<ul>" + "".join(f"<li>{m}{words(r.randint(3, 20))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        if r.random() < 0.2:
            body.append(f"<blockquote>{m}{words(25)}</blockquote>")
        if r.random() < 0.15:
            body.append(f"<table><tr><td>{m}{words(3)}</td><td>{m}{words(4)}</td></tr></table>")
        advert = lambda: f'<{(t := r.choice(["div", "aside", "section"]))} class="{r.choice(["ad", "ads", "advert", "sponsored", "promo banner"])}">{r.choice([words(r.randint(3, 30)), paragraphs(1)])}</{t}>'
        if r.random() < 0.35:
            body.insert(r.randint(1, len(body)), advert())
        if r.random() < 0.25:
            body.append(f'<div class="{r.choice(["share", "social", "tags", "byline meta"])}">{words(r.randint(1, 5))}<ul>{links(2)}</ul></div>')
        comments = f'<{(t := r.choice(["section", "div"]))} {r.choice(["class", "id"])}="{r.choice(["comments", "comment-list", "discussion", "replies"])}"><h3>{words(2)}</h3>{"".join(f"<div class=comment>{paragraphs(r.randint(1, 2))}</div>" if r.random() < 0.5 else paragraphs(1) for _ in range(r.randint(1, 4)))}</{t}>' if r.random() < 0.45 else ""
        inside = r.random() < 0.4
        shell = r.choice(['<article>%s</article>', '<main>%s</main>', '<div class="content">%s</div>', '<div id="main-content"><div class="post">%s</div></div>', '<div class="article-body">%s</div>', '<main><article class="post">%s</article></main>', '<section class="story">%s</section>'])
        main = shell % ("".join(body) + (comments if inside else "")) + ("" if inside else comments)
        nav = r.choice([f"<nav><ul>{links(r.randint(3, 9))}</ul></nav>", f'<div class="{r.choice(["menu", "navbar", "breadcrumb"])}"><ul>{links(5)}</ul></div>', f'<ul id="nav">{links(6)}</ul>'])
        head = r.choice(["", f"<header>{r.choice([words(4), f'<h1>{words(3)}</h1>', f'<p>{words(6)}</p>'])}{nav if r.random() < 0.5 else ''}</header>", f'<div class="{r.choice(["header", "masthead", "topbar"])}">{words(4)}</div>'])
        side = r.choice(["", "", f"<aside>{r.choice([paragraphs(2), f'<h3>{words(2)}</h3><ul>{links(4)}</ul>'])}</aside>", f'<div class="{r.choice(["sidebar", "related", "widget"])}"><h3>{words(2)}</h3>{r.choice([paragraphs(1), f"<ul>{links(5)}</ul>"])}</div>'])
        foot = r.choice([f"<footer>{r.choice([words(r.randint(4, 25)), paragraphs(2)])}</footer>", f'<div class="footer">{paragraphs(1)}</div>', f'<div id="footer"><p>&copy; {words(8)}</p></div>'])
        note = r.choice(["", "", f'<div class="{r.choice(["cookie-notice", "consent", "gdpr banner", "notice"])}">{r.choice([words(r.randint(6, 40)), paragraphs(1)])}</div>', f'<div role="alert"><p>{words(12)}</p></div>'])
        form = r.choice(["", "", f'<form><label>{words(2)}</label><input></form>', f'<div class="newsletter"><p>{words(9)}</p></div>'])
        parts = [note, head, nav, advert() if r.random() < 0.7 else "", main, side, form, foot]
        if r.random() < 0.2:
            parts[4], parts[5] = parts[5], parts[4]
        page = "".join(parts)
        if r.random() < 0.4:
            page = f'<div class="{r.choice(["page", "wrapper", "container", "site"])}">{page}</div>'
        tree = parse(f"<html><body>{page}</body></html>")
        marked = {node for node, text in tree.blocks if m in text}
        tree.blocks = [(node, text.replace(m, "")) for node, text in tree.blocks]
        made.append((tree, labels_of(tree, marked)))
    return made


def main_text(html: str | None, model: TreeModel) -> str:
    if not html:
        return ""
    tree = parse(html)
    if not tree.blocks:
        return ""
    kept = model.marginals(tree)
    return "\n".join(text for node, text in tree.blocks if kept[node] >= 0.5)


def train(pages: DataFrame, sample: int = SAMPLE_PAGES, most: int = SAMPLE_BYTES) -> TreeModel:
    """From made-up layouts and at most `sample` pages of the table, of at most `most` bytes each, those of the smallest hashes of url and page_id.

    Rows are first thinned by their hashes to some eight for each that is wanted, and copies left out, so what tasks send does not grow with the table.
    """
    rank = F.xxhash64("url", "page_id")
    share = min(1.0, 8 * sample / max(pages.count(), 1))
    some = pages.filter(F.col("html").contains("<article") & (F.octet_length("html") <= most) & (rank <= F.lit(hash_bound(share))))
    rows = some.select(rank.alias("rank"), "html").dropDuplicates(["rank"]).orderBy("rank").limit(sample).collect()
    real = [x for x in (from_article(r["html"]) for r in rows) if x]
    return TreeModel.fit(labelled_layouts() + real)


def extract(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    model = model or train(pages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [main_text(h, model) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
