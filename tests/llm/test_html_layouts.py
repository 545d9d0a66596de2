"""Main text of pages laid out unlike the labelled ones: token F1 over all, exact text where the layout is plain, and reading time."""

import time
from collections import Counter

import pytest

pytest.importorskip("netloom.llm")

from netloom.llm import html_extract  # noqa: E402

ONE = "The harbour board met on Tuesday to settle how the old crane should be moved before winter."
TWO = "Two members asked for a second survey, since the first had left out the quay wall and its footings."
THREE = "A decision is due in March, and the board expects the work to take eleven weeks in all."
FOUR = "Readers who live near the quay can see the plans in the library until the end of the month."

PAGES = [
    # tables as layout, upper-case tags, no semantic elements
    (f"<HTML><BODY BGCOLOR=white><TABLE><TR><TD WIDTH=120><A HREF=/>Start</A><BR><A HREF=/n>News</A><BR><A HREF=/c>Contact us</A></TD><TD><H2>Crane to move</H2><P>{ONE}<P>{TWO}<P>{THREE}</TD></TR></TABLE><CENTER><FONT SIZE=1>Copyright 1999 Quay Press</FONT></CENTER></BODY></HTML>", ["Crane to move", ONE, TWO, THREE]),
    # containers with names that the model has never seen
    (f'<body><div class="zq-top"><a href="/">Quay</a> <a href="/a">Today</a> <a href="/b">Weather</a></div><div class="xkcd42"><div class="q-wrap"><h1>Crane to move</h1><p>{ONE}</p><p>{TWO}</p><p>{THREE}</p><p>{FOUR}</p></div></div><div class="zq-end"><a href="/imp">Imprint</a> <a href="/agb">Terms</a></div></body>', ["Crane to move", ONE, TWO, THREE, FOUR]),
    # paragraphs right under body
    (f"<!doctype html><title>Crane</title><h1>Crane to move</h1><p>{ONE}</p><p>{TWO}</p><ul><li>{THREE}</li><li>{FOUR}</li></ul>", ["Crane to move", ONE, TWO, THREE, FOUR]),
    # an app shell: deep wrappers, sections, a quote
    (f'<body><div id="root"><div><div><header><div><span>Quay</span></div><nav><div><a href="/1">One</a></div><div><a href="/2">Two</a></div></nav></header><main><div><article><div><h1>Crane to move</h1></div><div><p>{ONE}</p></div><blockquote>{TWO}</blockquote><div><p>{THREE}</p></div></article></div></main><footer><div><a href="/p">Privacy</a></div><div>All rights reserved by Quay Press.</div></footer></div></div></div></body>', ["Crane to move", ONE, TWO, THREE]),
    # a blog with comments, a sidebar and a subscription box
    (f'<body><div class="page"><div class="post-body entry-content"><h2>Crane to move</h2><p>{ONE}</p><p>{TWO}</p><p>{THREE}</p></div><div id="comments"><h4>2 comments</h4><div class="comment-body"><p>I walked past it only yesterday and it looked quite fine to me.</p></div><div class="comment-body"><p>They should have done this ten years ago, as we all know.</p></div></div><div class="sidebar"><h4>About</h4><p>This blog is about the quay and all who work there.</p></div><form action="/sub"><p>Get new posts by mail every week.</p><input name="m"></form></div></body>', ["Crane to move", ONE, TWO, THREE]),
    # cookie notice and an advert between paragraphs
    (f'<body><div class="cookie-notice" role="dialog"><p>We and our partners store cookies on your device to show you adverts that fit.</p><button>Accept</button></div><main><h1>Crane to move</h1><p>{ONE}</p><div class="advert"><p>Buy two anchors and get the third one for half its price.</p></div><p>{TWO}</p><p>{THREE}</p></main></body>', ["Crane to move", ONE, TWO, THREE]),
    # definition lists, a table of data and a figure inside the article
    (f"<article><h1>Crane to move</h1><p>{ONE}</p><table><tr><th>Week</th><th>Work</th></tr><tr><td>1</td><td>Survey of the wall</td></tr></table><dl><dt>Crane</dt><dd>{TWO}</dd></dl><figure><img src=c.jpg><figcaption>The crane in 1931.</figcaption></figure><p>{THREE}</p></article>", ["Crane to move", ONE, "Week", "Work", "1", "Survey of the wall", "Crane", TWO, "The crane in 1931.", THREE]),
]


def f1(got, want):
    a, b = Counter(got.split()), Counter(want.split())
    both = (a & b).total()
    return 2 * both / max(1, a.total() + b.total())


def test_other_layouts():
    model = html_extract.trained()
    scores = [f1(t, "\n".join(w)) for t, (_, w) in zip(html_extract.extract([p for p, _ in PAGES], model), PAGES, strict=True)]
    assert min(scores) >= 0.85 and sum(scores) / len(scores) >= 0.95, scores


def test_nothing_inside_a_block_is_lost():
    model = html_extract.trained()
    page = f"<article><p>Keep <math><mi>x</mi><mo>=</mo><mn>2</mn></math> in this sentence, <svg><text>so</text></svg> that <object>all</object> of it <custom-tag>stays</custom-tag> whole.</p><p>{ONE}</p></article>"
    assert html_extract.extract([page], model) == ["Keep x=2 in this sentence, so that all of it stays whole.\n" + ONE]


@pytest.mark.parametrize("part", ['<a b="', "<a b='\"", "</x>", "</div>", "<div>", "<li>", "<td>", "<ul><li><div>", "<a ", "<!--", "<p", "<a b=\"'>", "<script>", "<p a=" + "b" * 50, "&amp", "<ul><div><li></li>"])
def test_reading_time_is_linear(part):
    html_extract.read(part * 10)

    def took(n):
        start = time.perf_counter()
        html_extract.read(part * (n // len(part)))
        return time.perf_counter() - start

    small, large = min(took(40_000) for _ in range(3)), min(took(320_000) for _ in range(2))
    assert large < 0.02 or large < 24 * small
