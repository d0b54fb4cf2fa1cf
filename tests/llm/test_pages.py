"""Main text of pages, against pages labelled by hand."""

import time

import pytest

from newsloom.llm import pagetree

PROSE = ("The river rose again during the night, and by morning the lower road was closed.", "Nobody in the village could say when it would open, or who had the key to the gate.", "A second bridge, built in 1911, still carries one lane of traffic into the town.")
#: Pages with what to keep, in order, and what must go.
PAGES = [
    (
        f'<html><head><title>T</title><style>p{{}}</style></head><body><header><a href="/">The Paper</a></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>Sport</a></ul></nav><article><h1>Water over the road</h1><p>{PROSE[0]}</p><p>{PROSE[1]}<br>{PROSE[2]}</p></article><aside><h3>Related</h3><ul><li><a href=/c>More rain to come</a></ul></aside><footer>&copy; 2024 The Paper</footer></body></html>',
        ["Water over the road", PROSE[0], f"{PROSE[1]} {PROSE[2]}"], ["The Paper", "Home", "Sport", "Related", "More rain"],
    ),
    (
        f'<body><div id="menu"><ul><li><a href=/>Start</a></li><li><a href=/x>Shop</a></li></ul></div><div class="content"><h1>Bridge</h1><p>{PROSE[2]}</p><p>{PROSE[0]}</p><div class="ad">Buy two kettles and save</div><p>{PROSE[1]}</p></div><div class="comments"><h3>Comments</h3><div class=comment><p>I walked there yesterday.</p></div></div><div class="footer"><p>Imprint</p></div></body>',
        ["Bridge", PROSE[2], PROSE[0], PROSE[1]], ["Start", "Shop", "kettles", "Comments", "yesterday", "Imprint"],
    ),
    (
        f'<body><div class="cookie-notice"><p>We use cookies to improve the site.</p></div><main><h1>Gate &amp; key</h1><p data-x=bob\'s title=it"s lang=en>{PROSE[1]}</p><p>It&#39;s <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here, as 1 < 2.</p><dialog open><p>{PROSE[0]}</p></dialog></main><form><label>Your mail</label><input><button>Send</button></form></body>',
        ["Gate & key", PROSE[1], "It's x=2 here, as 1 < 2.", PROSE[0]], ["cookies", "Your mail", "Send"],
    ),
]


@pytest.fixture(scope="module")
def model():
    return pagetree.TreeModel.fit(pagetree.labelled_layouts())


@pytest.mark.parametrize("html, kept, gone", PAGES)
def test_labelled_pages(model, html, kept, gone):
    got = pagetree.main_text(html, model)
    assert got == "\n".join(kept)
    assert not any(x in got for x in gone)


def blocks(html):
    return [text for _, text in pagetree.parse(html).blocks]


def test_quotes_and_tags():
    assert blocks("<p data-x=bob's>One two three.</p><p>Second...</p><p>It's fine</p>") == ["One two three.", "Second...", "It's fine"]
    assert blocks("<p class=\"a > b\" id='c'>x</p>") == ["x"]
    assert blocks('<p title="never closed>one</p><p>two</p>') == ["one", "two"]
    assert blocks("a < b <3 </ x> c<") == ["a < b <3 c<"]
    assert blocks("<p>whole<b unclosed") == ["whole<b unclosed"]
    assert blocks("<p =x a = 'b>c' d/>e") == ["e"]
    assert blocks("<!-- <p>x</p> -->y<!doctype html>z<!--") == ["yz"]
    assert pagetree.parse("<div class=menu id='nav bar' role=\"x\">t").names == ["", "menu nav bar x"]


def test_comments_and_raw_text():
    assert blocks("<!--><p>a</p><!---><p>b</p><!-- x --!><p>c</p><!-- - -- > --><p>d</p>") == ["a", "b", "c", "d"]
    assert blocks("İ" * 40 + "<script>var x = '</p>' < 1</SCRIPT ><p>next</p>") == ["İ" * 40, "next"]
    assert blocks("<style>a</styles>b</ſtyle>c</style\n>d<script>e") == ["d"]


@pytest.mark.parametrize("part", ["<p x='", '<p x="', "<p ", "<", "</", "<!", "<p x=y'", "<a b='c' ", "<!--"])
def test_long_nonsense_takes_linear_time(part):
    html = part * (1_000_000 // len(part))
    start = time.perf_counter()
    pagetree.parse(html)
    assert time.perf_counter() - start < 20


def test_table(spark):
    rows = [(i, f"https://a.example/{i}", html) for i, (html, *_) in enumerate(PAGES)] + [(7, "u", None), (8, None, ""), (9, "u", "<p></p>"), (None, "u", PAGES[0][0]), (9, "u", "<p></p>")]
    pages = spark.createDataFrame([(*r, "other") for r in rows], "page_id long, url string, html string, text string")
    got = pagetree.extract(pages).collect()
    want = [(p, t, len(t)) for p, _, h in rows for t in ["\n".join(next((k for x, k, _ in PAGES if x == h), []))]]
    assert sorted(map(repr, ((r.page_id, r.text, r.n_chars) for r in got))) == sorted(map(repr, want))
    assert pagetree.extract(pages.limit(0)).count() == 0
