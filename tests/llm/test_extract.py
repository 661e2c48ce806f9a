import html
import re

import numpy as np
import pytest

from gridscale.llm import extract as X
from gridscale.llm.pagemaker import made_pages
from gridscale.llm.queries import op12_pages


@pytest.fixture(scope="module")
def model():
    return X.fit()


def texts(page):
    return [b.text for b in X.blocks(page)]


def test_blocks():
    assert texts("<p>a<b>b</b>c<br>d&nbsp;e<p>f &amp; g &am&lt") == ["abc d e", "f & g &am<"]
    assert texts("a < b </ x>c<!-- <p>no</p> -->d<!-->e<script>if (a < b) '</p>'</script>f<style>p{}</style><title>t</title>g") == ["a < b cde", "f", "g"]
    assert texts("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>x<td>y<td>z</table>") == ["1", "2", "3", "4", "x", "y", "z"]
    assert texts("<a title='x > y' href=\"q>r\">k</a> <!doctype html> <textarea>form</textarea><P CLASS=X>Up<SCRIPT>x</SCRIPT >per") == ["k", "Up", "per"]
    assert texts("") == texts("<") == [] or texts("<") == ["<"]
    assert texts("<script>never closed <p>x") == [] and texts("x<!-- never closed <p>y") == ["x"] and texts("x<p class='never closed") == ["x"]
    found = X.blocks('<body><div id="main-content" class="PostBody wide"><p>x <a href=y>link</a></p></div><p style="display: none">z')
    assert found[0].path == ("body", "div main content post body wide", "p") and found[0].linked == 4
    assert found[1].path == ("body", "p hidden")


def test_hard_pages_take_linear_time():
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert texts(deep) == ["x"] and len(X.blocks(deep)[0].path) == X.OUTER + X.INNER
    assert texts("<a b='" * 30_000) == [] and len(texts("<p>x" * 30_000)) == 30_000
    assert texts("<!--" * 30_000) == [] and len(texts("< " * 30_000)) == 1


def test_gradient_by_finite_differences():
    small = X.fit(40, 1)
    made = [X.labelled(p) for p in made_pages(5, 3)]
    x, y = X.inputs([b for b, _ in made], X.Hashes()), np.concatenate([y for _, y in made])
    m = X.Labeller(small.path_row, small.word_row, *[a.astype(float) for a in small.arrays])
    _, grads = X.gradient(m, x, y)
    for a, g in zip(m.arrays, grads, strict=True):
        for k in np.argsort(-np.abs(g).ravel())[:4]:
            old, step = a.ravel()[k], 1e-2
            a.ravel()[k] = old + step
            up, _ = X.gradient(m, x, y)
            a.ravel()[k] = old - step
            down, _ = X.gradient(m, x, y)
            a.ravel()[k] = old
            assert (up - down) / 2 / step == pytest.approx(g.ravel()[k], rel=1e-2, abs=1e-6)


def test_held_out_made_pages(model):
    test = [X.labelled(p) for p in made_pages(300, seed=99)]
    got = model.label([b for b, _ in test], X.Hashes())
    wrong = sum(int(((p >= 0.5) != (y > 0.5)).sum()) for p, (_, y) in zip(got, test, strict=True))
    assert wrong / sum(len(y) for _, y in test) < 0.005
    alone = model.label([test[7][0]], X.Hashes())[0]  # neighbours in a batch make no difference
    assert np.allclose(alone, got[7], atol=1e-5)


def article(page):
    """What stands in the one article of a page of the tables, by regular expressions."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    want = sorted((r.page_id, r.url, t := article(r.html), len(t)) for r in spark.read.parquet(f"{sf}/pages.parquet").collect())
    assert sorted(map(tuple, op12_pages(spark, sf).collect())) == want


OTHER = {
    "names only": (
        '<div id="masthead">My site</div><div class="navbar"><a href=/>Home</a> <a href=/b>Blog</a></div><div class="entry-content"><h2>On birds</h2><p>Birds sing in the morning, and some of them at night.</p><div>They also fly.</div></div>'
        '<div class="sidebar"><h3>Recent posts</h3><ul><li><a href=1>On cats</a></li><li><a href=2>On dogs</a></li></ul></div><div id="footer">Copyright 2020. All rights reserved.</div>',
        "On birds Birds sing in the morning, and some of them at night. They also fly.",
    ),
    "comments": (
        "<header><h1>Paper</h1></header><nav><ul><li><a>News</a></li><li><a>Sport</a></li></ul></nav><main><h1>A long day in town</h1><p>The mayor spoke for three hours, and nobody left the hall.</p><p>Then it rained.</p></main>"
        '<section class="comments"><h3>2 comments</h3><div class="comment"><p><b>Ann</b> says</p><p>I was there too, and it was a very good speech.</p></div></section><footer>&copy; Paper</footer>',
        "A long day in town The mayor spoke for three hours, and nobody left the hall. Then it rained.",
    ),
    "notice and form": (
        '<div class="cookie-banner"><p>We use cookies to make your visit of this website better.</p><button>Accept</button></div><article><h1>Bread</h1><p>Take flour, water and salt. Wait a day.</p><blockquote>Bread is life.</blockquote></article>'
        '<form class="newsletter"><label>Subscribe to the newsletter</label><input name=q><button>Go</button></form><aside class="related"><h4>Related</h4><a href=x>Cake for all</a></aside>',
        "Bread Take flour, water and salt. Wait a day. Bread is life.",
    ),
}


@pytest.mark.parametrize("kind", OTHER)
def test_other_layouts(model, kind):
    page, want = OTHER[kind]
    assert X.main_texts([page, f"<html><body>{page}</body></html>"], model, X.Hashes()) == [want, want]


def test_edge_rows(spark, model):
    long = "<article><h1>Title of it</h1>" + "<p>One more line of a very long text.</p>" * 20_000 + "</article>"
    rows = [(1, None, None, 5), (1, None, None, 5), (None, "u", "", 5), (2, "u", "<p", 5), (3, None, long, 5), (4, "u", "<nav><a>Home</a></nav>", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in X.extract(pages, model).collect()}
    assert got[1, None] == got[None, "u"] == got[2, "u"] == got[4, "u"] == ("", 0)
    assert got[3, None][0] == "Title of it" + " One more line of a very long text." * 20_000 and got[3, None][1] == len(got[3, None][0])
    assert X.extract(pages, model).count() == 6 and X.extract(pages.where("false"), model).count() == 0
