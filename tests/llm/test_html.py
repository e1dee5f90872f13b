"""Pages written by hand, in layouts the training pages are not made from, and pages that nest deeply."""

import time

import pytest

from opalgrid.llm import html_blocks as HB, html_extract as H

PARA = "The river rose by two metres over night, and the old bridge was closed before dawn. Nobody was hurt."
MORE = "Engineers will look at the piers on Monday. Until then, buses go by way of the northern crossing."

# (page, the text a reader would call the article)
PAGES = [
    (f"""<!doctype html><html lang=en><head><meta charset=utf-8><title>River</title><style>p{{}}</style></head><body class="home page">
    <div id="top-menu" class="navigation"><a href="/">Home</a> <a href="/w">Weather</a> <a href="/s">Sport</a></div>
    <main id="content"><h1>River closes bridge</h1><p>{PARA}</p><p>{MORE}</p></main>
    <div id="footer"><p>© 2021 Valley Courier. All rights reserved.</p></div></body></html>""", f"River closes bridge\n{PARA}\n{MORE}"),
    (f"""<html><body><header class="site-header"><a href=/>Valley Courier</a></header>
    <article itemprop="articleBody"><h1>Flood</h1><p>{PARA}</p><aside class="related"><h3>Most read</h3><ul><li><a href=1>Cats</a><li><a href=2>Dogs</a></ul></aside>
    <blockquote>{MORE}</blockquote></article><section class="comments"><h3>3 comments</h3><div class="comment"><p>I agree, thanks for this.</p></div></section></body></html>""", f"Flood\n{PARA}\n{MORE}"),
    (f"""<html><body><div class="cookie-banner">We use cookies. <button>Accept</button></div><div class="wrapper"><div class="post-body">
    <h1>Dawn</h1><div>{PARA}</div><div class="advert">Buy one, get one free!</div><ul><li>piers</li><li>deck</li><li>cables</li></ul></div>
    <form action="/subscribe"><label>Your mail</label><input name=m><button>Go</button></form></div><footer><nav><a href=1>Imprint</a><a href=2>Privacy</a></nav></footer></body></html>""", f"Dawn\n{PARA}\npiers\ndeck\ncables"),
    (f"<article><h1>No end tags<p>{PARA}<p>{MORE}", f"No end tags\n{PARA}\n{MORE}"),
    (f"<html><head><title>x</title><article><p>{PARA}</p><p>a &lt; b &amp;&amp; c&nbsp;&gt; d</p></article>", f"{PARA}\na < b && c > d"),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_pages_written_by_hand(page, want):
    blocks = HB.blocks_of(page)
    (keep,) = H.label_pages([blocks], H.trained(), H.WordBuckets())
    assert "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k) == want


DEEP = {
    "divs": "<div>x" * 100_000, "open tags": "<a" * 100_000, "spans": "<span>" * 50_000 + "<p>x</p>" * 50_000, "quotes": '<a ">' * 100_001,
    "links": "<a><p>" * 50_000, "lists": "<ul><li>x" * 50_000, "ends": "<b>" * 50_000 + "</i></p>" * 50_000, "declarations": "<!-" * 100_000, "headings": "<h1>x" * 50_000,
}


@pytest.mark.parametrize("name", DEEP)
def test_time_grows_with_the_page_alone(name):
    H.trained()
    start = time.process_time()
    blocks = HB.blocks_of(DEEP[name])
    H.label_pages([blocks], H.trained(), H.WordBuckets())
    assert time.process_time() - start < 60  # quadratic reading took minutes


def test_paths_are_those_of_the_open_elements():
    page = HB.blocks_of("<div class='a b'><p>one<p>two</div><section>three<em>four</em><h2>five")
    running = []
    for b in page:
        held = {}
        for tokens, sign in zip(page.events[: b.at], page.signs[: b.at], strict=True):
            for t in tokens:
                held[t] = held.get(t, 0) + sign
        running.append(sorted(t for t, n in held.items() if n))
        assert all(n >= 0 for n in held.values())
    div, p, section, h2 = (HB._tokens(t, a) for t, a in (("div", " class='a b'"), ("p", ""), ("section", ""), ("h2", "")))
    assert [b.text for b in page] == ["one", "two", "threefour", "five"]
    assert running == [sorted(x) for x in (div + p, div + p, section, section + h2)]
