"""Marginals against the enumeration of all labellings, held-out pages, and markup as browsers read it."""

import html
import itertools
import math
import random
import re
import time

import numpy as np
import oracle
import pytest

from agrispark.llm import html_extract

PRIOR = html_extract.prior_model()


def leaves(page):
    return [t for t in html_extract.Tree(page).text if t is not None]


def test_marginals_are_those_of_all_labellings():
    rng = random.Random(6)

    def page(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["<p>Some words here.</p>", "<p class=ad>x</p>", "<h2>Head</h2>", "text "])
        tag = rng.choice(["div", "section", "nav", "article", "ul"])
        return f"<{tag}>" + "".join(page(depth - 1) for _ in range(rng.randrange(1, 3))) + f"</{tag}>"

    seen = 0
    for _ in range(80):
        tree = html_extract.Tree(page(3))
        n = len(tree.parent)
        if not 3 <= n <= 12:
            continue
        seen += 1
        weights, edge = PRIOR[0] / 4, (rng.uniform(0.01, 0.3), rng.uniform(0.4, 0.9))
        score = np.array(tree.features()) @ weights
        total, one = 0.0, [0.0] * n
        for y in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(s for s, v in zip(score, y, strict=True) if v))
            for i in range(1, n):
                p = edge[y[tree.parent[i]]]
                w *= p if y[i] else 1 - p
            total += w
            for i in range(n):
                one[i] += w * y[i]
        assert np.allclose(tree.marginals(weights, edge), [x / total for x in one], atol=1e-9)
    assert seen > 20


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p>Prices 5 < 6 here and more words follow.", ["Prices 5 < 6 here and more words follow."]),
        ("<article><p title=it's>First one.</p><p>Second 'one'.</p><p>Third.</p>", ["First one.", "Second 'one'.", "Third."]),
        ("<p title=\"a>b\" x='>'>In.</p><p data-x=\"never closed>Next.</p>", ["In.", "Next."]),
        ("<p>a<3 <= b <é> c</p><p>d</ >e</p><!-->f<!-- g --><p>h<!-- i", ["a<3 <= b <é> c", "de", "f", "h"]),
        ("<p>x<script>'<p>no</p>'</SCRIPT >y<svg/>z<button>b</button>w<select>never closed</p>", ["xyzwnever closed"]),
        ("<p>one &lt;two&gt; &amp;amp; &#233;</p>\n<p> three\n four</p><p", ["one <two> &amp; é", "three four"]),
    ],
)
def test_markup_as_browsers_read_it(page, want):
    assert leaves(page) == want


@pytest.mark.parametrize("page", ["<p a='" * 100_000, "<button>" * 100_000, "<div>" * 50_000 + "</section>" * 50_000, "<" * 1_000_000, "<p>" + "word " * 600_000, "<!" * 300_000, "<a b=\"'" * 50_000])
def test_very_long_pages(page):
    began = time.perf_counter()
    html_extract.extract_text(page, *PRIOR)
    assert time.perf_counter() - began < 20


def test_held_out_pages(spark):
    read = lambda t: spark.read.parquet(f"{oracle.DATA}/sf0.01/{t}.parquet")
    pages = read("pages")
    model = html_extract.train(html_extract.labelled_pages(pages.where("page_id % 2 = 0"), read("documents")), sample_pages=100)
    assert any(abs(a - b) > 0.05 for a, b in zip(model[0], PRIOR[0], strict=True)) and model[1] != PRIOR[1]
    right = total = 0
    for r in pages.where("page_id % 2 = 1").collect():
        article = r.html.partition("<article>")[2].partition("</article>")[0]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", article))
        total += 1
        right += html_extract.extract_text(r.html, *model) == "\n\n".join(b for b in blocks if b)
    assert total > 50 and right >= 0.99 * total


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div id=header>Site</div><div id=content><h1>Title here</h1><p>First paragraph of text.</p></div><div id=sidebar><p>Side.</p></div>", "Title here\n\nFirst paragraph of text."),
        ("<article class='post tag-x'><h1>T</h1><p>Main text.</p><div class=comments><h3>Comments</h3><p>Nice article, I agree.</p><p>So do I, and more.</p></div><p>End.</p></article>", "T\n\nMain text.\n\nEnd."),
        ("<div class='page-with-ads'><article><p>Main text.</p><article class=comment><p>My comment is that I like it.</p></article></article></div>", "Main text."),
        ("<body class=has-sidebar><div class='with-sidebar'><div class=post><p>Main text number one is here, long.</p><p>More.</p></div></div><div class=sidebar><p>Side.</p></div>", "Main text number one is here, long.\n\nMore."),
    ],
)
def test_kinds_of_pages_not_trained_on(spark, page, want):
    read = lambda t: spark.read.parquet(f"{oracle.DATA}/sf0.01/{t}.parquet")
    model = html_extract.train(html_extract.labelled_pages(read("pages"), read("documents")))
    assert html_extract.extract_text(page, *model) == want


@pytest.mark.parametrize("trained", [False, True])
def test_blocks_of_an_article_keep_their_text_whatever_part_they_are_named_after(spark, trained):
    model = PRIOR
    if trained:
        pages, docs = (spark.read.parquet(f"{oracle.DATA}/sf0.01/{t}.parquet") for t in ("pages", "documents"))
        model = html_extract.train(html_extract.labelled_pages(pages, docs))
    long = "This paragraph goes on for a while, so that it reads like the text of an article and nothing else. "
    page = (
        "<body><header class='site-header'>Home page of all</header><nav>Home About</nav><article><h1 class='article-header'>The first heading</h1>"
        f"<div class='entry-header'><h2>By the author of it</h2></div><p>{long}</p><h2 class='section-header'>A second heading</h2><p class='form'>{long}forms</p>"
        f"<p class='entry-footer'>{long}end</p><p class='advert'>Buy now {long}</p><p class='cookie-notice'>We use cookies. {long}</p><div class='comment-form'>{long}said</div>"
        f"<div class='post-footer'>Tags: a, b</div></article><aside>Other pages</aside><div class='page-footer'><p>All rights reserved.</p></div></body>"
    )
    got = html_extract.extract_text(page, *model).split("\n\n")
    assert got == [x.strip() for x in ("The first heading", "By the author of it", long, "A second heading", long + "forms", long + "end")]
