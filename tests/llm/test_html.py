import itertools
import re
from html import unescape

import numpy as np
import pytest
from helpers import clashing

from callquality.llm import html as H
from callquality.llm.layouts import fit_on_pages, labelled_by_markup, relaid_pages
from callquality.llm.queries import op12_html
from callquality.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def htmls(spark):
    return [r["html"] for r in table(spark, SF, "pages").orderBy("page_id").collect()]


@pytest.fixture(scope="module")
def model(htmls):
    return fit_on_pages(htmls)


def test_marginals_are_exact():
    rnd = np.random.default_rng(1)
    parent, depth = np.array([-1, 0, 0, 1, 1, 3, -1, 6]), np.array([0, 1, 1, 2, 2, 3, 0, 1])
    score, edge = rnd.normal(size=8), rnd.normal(size=(8, 2, 2))
    p, pair, total = H.marginals(score, edge, parent, depth)
    weights = {}
    for y in itertools.product((0, 1), repeat=8):
        weights[y] = np.exp(sum(score[k] * y[k] + (edge[k, y[parent[k]], y[k]] if parent[k] >= 0 else 0) for k in range(8)))
    z = sum(weights.values())
    assert np.isclose(total, np.log(z))
    for k in range(8):
        assert np.isclose(p[k], sum(w for y, w in weights.items() if y[k]) / z)
        if parent[k] >= 0:
            assert np.allclose(pair[k], [[sum(w for y, w in weights.items() if (y[parent[k]], y[k]) == (a, b)) / z for b in (0, 1)] for a in (0, 1)])


def test_blocks_of_broken_markup():
    cases = {
        "<p>a<p>b &amp; c<b>d</b>e<br>f": ["a", "b & cde f"],
        "<ul><li>x<li>y<ul><li>z</ul></ul>t": ["x", "y", "z", "t"],
        "<script>var t='</p>';</script><style>p</style><!-- c --><div>  u\n v&nbsp;w </div></div></p>x": ["u v w", "x"],
        "<table><tr><td>1<td>2<tr><td>3</table>": ["1", "2", "3"],
        "a < b <p class='x>y'>c</p> 1 <2 <a href=\"": ["a < b", "c", "1 <2"],
        "<p>unclosed <b>bold <p>next</article>end": ["unclosed bold", "next", "end"],
        "<textarea>no</textarea><button>no</button><svg><text>no</text></svg>yes<!-- open": ["yes"],
        "<button>kept as it never ends": ["kept as it never ends"],
        "": [], "   ": [],
    }
    for html, blocks in cases.items():
        assert [t for t in H.parse_pages([html]).text if t] == blocks, html
    pages = H.parse_pages([None, "<div>" * 3000 + "deep", "x"])
    assert [t for t in pages.text if t] == ["deep", "x"] and len(H.features(pages)) == len(pages.page)


def test_held_out_layouts(htmls, model):
    pages = H.parse_pages(relaid_pages(htmls[100:], 300, seed=99))
    leaf, y = np.array([bool(t) for t in pages.text]), np.array(pages.label) > 0
    p = H.content_marginals(pages, model)
    assert ((p >= 0.5) == y)[leaf].mean() > 0.985


def test_written_page(model):
    body = "The committee met on Tuesday and agreed, after a long debate, that the bridge would be rebuilt in stone. Work starts in spring."
    html = f"""<html><head><title>T</title></head><body><div class="cookie-notice"><p>We use cookies to make this site better for you, and to see how it is used. By going on you agree to that.</p></div>
    <div id="top"><ul class="main-nav"><li><a href=/a>Home</a><li><a href=/b>News</a></ul></div>
    <div class="layout"><div class="story"><h1>Bridge to be rebuilt</h1><p>{body}</p><p>Short one.</p><div class="ad-slot">Buy shoes now, they are cheap.</div><p>{body} <a href=x>More on it</a>.</p></div>
    <div class="sidebar"><h3>Most read</h3><ul><li><a href=1>One thing</a><li><a href=2>Another thing</a></ul></div></div>
    <section id="comments"><h2>2 comments</h2><div class="comment"><b>Ann</b><p>I think that stone is a fine choice for a bridge, as it lasts longer than steel, and looks better too.</p></div></section>
    <form class="newsletter"><p>Get our letter every week.</p><input></form><div class="footer">&copy; 2020 The Paper</div></body></html>"""
    assert H.main_texts([html], model) == [["Bridge to be rebuilt", body, "Short one.", f"{body} More on it."]]


def test_fit_states_its_cases():
    model = H.fit_tree_model(H.parse_pages([]))
    assert not model.node.any() and not model.edge.any()
    assert H.main_texts(["<p>x", None, ""], fit_on_pages([]))[1:] == [[], []]
    assert labelled_by_markup("<Main id=x><nav>") == '<main data-fit="1" id=x><nav data-fit="0">'


def test_extract_keeps_columns(spark, model):
    rows = [(1, "u", "<article><p>" + "long " * 40_000 + "</p></article>"), (2, None, None), (2, None, ""), (None, "u", "<nav>x</nav>")]
    got = H.extract_main_text(clashing(spark.createDataFrame(rows, "page_id long, url string, html string")), model, block_bytes=1000).collect()
    assert [r["main"] for r in got][1:3] == [[], []] and got[0]["main"] == [("long " * 40_000).strip()] and got[0]["kept"] == "x"
    assert H.extract_main_text(spark.createDataFrame([], "html string"), model).count() == 0


def test_op12_query(spark, htmls):
    def by_hand(html):
        text = re.sub(r"</?(?:p|h1|br)>", "\n", re.search(r"<article>(.*?)</article>", html, re.S)[1])
        return " ".join(unescape(re.sub(r"<[^>]*>", "", text)).split())

    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in op12_html(spark, SF).collect()}
    want = {r["page_id"]: by_hand(r["html"]) for r in table(spark, SF, "pages").collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}
