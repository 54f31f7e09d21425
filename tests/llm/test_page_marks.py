"""Names on a page: what keeps an article whole, what still marks parts beside it, and pages of many elements."""

import re
import time
from collections import Counter

import pytest

from echoloom.llm import mincut_html

P = "Thheouble heenwh on reti ingeser erster that, and the ring of onthly thaner was erenea."


@pytest.mark.parametrize("inner", [
    '<h2 id="related-work">Related work</h2>', '<h2 id="search">Search</h2>', '<h2 id="popular-culture">Popular culture</h2>', f'<p id="notification-api">{P}</p>', f'<p class="ad">{P}</p>',
    f'<section id="comments-and-replies"><h2>Replies</h2><p>{P} More.</p></section>', f'<div class="skip-logic"><p>{P}</p></div>', f'<div class="copyright-law"><p>{P}</p></div>', f'<div class="copyright-law">{P} {P}</div>',
])
def test_an_article_stays_whole_whatever_its_parts_are_called(inner):
    want = re.sub(r"\n+", "\n", re.sub("<[^>]*>", "\n", inner)).strip()
    assert mincut_html.main_text(f"<body><nav><a>Home</a></nav><article><h1>Head</h1><p>{P}</p>{inner}<p>{P}</p></article><footer>End</footer></body>") == f"Head\n{P}\n{want}\n{P}"
    assert mincut_html.main_text(f"<article><h1>Head</h1>{inner}</article>") == f"Head\n{want}"


@pytest.mark.parametrize("part", [
    f'<div class="ad">{P}</div>', f'<div class="ad-slot">{P}</div>', f'<div id="comments"><div class="comment"><p>{P}</p></div></div>', f'<section class="comment-list"><p>{P}</p></section>', f'<div class="sidebar-right"><p>{P}</p></div>',
    '<p class="ad">Buy now</p>', f'<div class="cookie-notice">{P}</div>', f'<aside><p>{P}</p></aside>', '<ul class="share-links"><li><a>One</a><li><a>Two</a></ul>', f'<div class="promo-box-2"><p>{P}</p></div>', f'<form><p>{P}</p></form>',
])
def test_names_of_page_parts_still_mark_them(part):
    assert mincut_html.main_text(f"<body><article><h1>Head</h1><p>{P}</p>{part}<p>{P}</p></article></body>") == f"Head\n{P}\n{P}"


@pytest.mark.parametrize("html,texts", [("<div>text" * 100_000, 100_000), ("<li><table>" + "<div>x" * 20_000 + "<li></li>" * 20_000 + "</b>" * 50_000, 20_000), ("<b><p>a" * 30_000, 30_000)])
def test_deep_pages_take_time_in_proportion(html, texts):
    t = time.process_time()
    found = mincut_html.blocks(html)
    mincut_html.label(found)
    assert len(found) == texts and time.process_time() - t < 20


def test_paths_are_shared_as_far_as_elements_are():
    a, b, c = mincut_html.blocks("<div><ul><li>a<li>b</ul></div><p>c")
    assert (mincut_html._shared(a.at, b.at), mincut_html._shared(b.at, c.at), mincut_html._shared(a.at, a.at)) == (3, 1, 4)


def test_pages_without_marks(spark, sf):
    """With ids, classes and telling tags gone, at least 95 % of the blocks are labelled as the marked article has them."""
    n = right = 0
    for (html,) in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect():
        found = re.search("<article.*?</article>", html or "", re.S)
        if not found:
            continue
        article = Counter(mincut_html.main_text(found[0]).split("\n"))
        bare = re.sub(r'<(\w+)[^>]*\b(?:class|id|role)="[^"]*"[^>]*>', r"<\1>", re.sub(r"(</?)(?:article|nav|aside|footer|header|main|section)\b", r"\1div", html))
        blocks = mincut_html.blocks(bare)
        for b, kept in zip(blocks, mincut_html.label(blocks), strict=True):
            n, right = n + 1, right + (kept == (article[b.text] > 0))
            article[b.text] -= article[b.text] > 0
    assert n > 100 and right / n >= 0.95
