import html
import re

import pytest
from pyspark.sql import functions as F

from mrkit.llm import html_content


@pytest.fixture(scope="module")
def model():
    return html_content.train(None)


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("<article><h1>T &amp; t</h1><p>One\n two&nbsp;three &lt;b&gt; &#233;.<p>Next <b>bold<br>line.</article>", "T & t\nOne two three <b> é.\nNext bold line."),
        ("<body><nav><a href=x>Menu</a></nav><main><p>The text is here, all of it.</p><aside><p>Not this, please.</p></aside></main><footer>© me</footer>", "The text is here, all of it."),
        ("<div id=content><h1>Title</h1><p>Some words of text, as usual.</p></div><div class='sidebar'><p>Links and such, here.</p></div><div id=comments><p>I like it very much.</p></div>", "Title\nSome words of text, as usual."),
        ("<article><p>a<script>var t='</p>';</script> b.<!-- <p>no</p> --> c.</p><form><p>Your name, please.</p></form></article>", "a b. c."),
        ("<article><p>unclosed &am and < 5 > 3.", "unclosed &am and < 5 > 3."),
    ],
)
def test_pages(model, page, text):
    assert model.extract(page) == text


def test_marginals_equal_enumeration(model):
    """Sum-product on a small tree against the sum over all assignments."""
    from itertools import product
    from math import exp

    nodes = html_content.parse("<div class=menu><p>Some text, here.</p></div><article><h1>T</h1></article>")
    own = [exp(sum(model.features.get(f, 0.0) for f in html_content.features(n))) for n in nodes]
    totals = [[0.0, 0.0] for _ in nodes]
    for states in product((0, 1), repeat=len(nodes)):
        state = dict(zip(map(id, nodes), states))
        weight = 1e-6 if states[0] else 1.0
        for n, s, o in zip(nodes, states, own):
            weight *= o if s else 1.0
            if n.parent is not None:
                weight *= model.edge(n)[state[id(n.parent)]][s]
        for k, s in enumerate(states):
            totals[k][s] += weight
    found = model.marginals(nodes)
    for n, (a, b) in zip(nodes, totals):
        assert found[id(n)] == pytest.approx(b / (a + b), rel=1e-9)


def test_whole_table(table):
    pages = table("pages").withColumn("text", F.lit("clash"))
    found = {r.page_id: (r.url, r.text, r.n_chars) for r in html_content.main_text(pages).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        text = "\n".join(b for b in blocks if b)
        assert found[r.page_id] == (r.url, text, len(text))


def test_awkward_rows(spark):
    long = "<article>" + "<p>Words of text.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x"), (3, "u", long), (3, "u", long), (4, "u", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = html_content.main_text(pages).collect()
    assert len(found) == 6 and [r.text for r in found[:2]] == ["", ""] and found[3].n_chars == 20_000 * 15 - 1
    assert html_content.main_text(pages.where("page_id < 0")).collect() == []


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>t</title><article><p>text</p></article>", "text"),
        ("<html><head><meta charset=x><style>p{}</style><link href=y><article><p>text</p></article>", "text"),
        ("<head><title>t</title></head><body><article><p>text</p></article>", "text"),
        ("<article><p>One <select><option>a<option>b</p><p>Two.</p></article>", "One\nTwo."),
        ("<article><div><svg><g><path d=x></div><p>Two.</p></article>", "Two."),
        ("<article><svg><title>t</title><g><text>no</text><p>Two.</p></article>", "Two."),
        ("<article><div><svg><foreignObject><div>no</div>no</foreignObject>no</svg><p>Yes.</p></div></article>", "Yes."),
        ("<article><p>One <svg><foreignObject><p>no</p></foreignObject></svg> two.</p></article>", "One two."),
        ("<article><div><datalist><option>no</div><p>Two.</p></article>", "Two."),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> be.</p></article>", "Let x=2 be."),
        ("<article><p>See <object data=x><param name=y>the film</object> here.</p><object><p>Two.</article>", "See the film here.\nTwo."),
        ("<article><p>a <svg/> b <svg><svg/></svg> c</p></article>", "a b c"),
        ("<article><p>a <select><option>no<option>no</select> b</p></article>", "a b"),
    ],
)
def test_hidden_elements_end(model, page, text):
    assert model.extract(page) == text


def test_the_bound_counts_pages_that_mark_their_article(spark):
    marked = [(i, f"<ARTICLE class=a{chr(97 + i)}><p>Some words {i}, as usual.</ARTICLE>") for i in range(4)]
    rows = [(i, "<div><p>No mark.</div>") for i in range(100, 300)] + marked + marked[:1] * 200
    found = html_content.train(spark.createDataFrame(rows, "page_id long, html string"), 4)
    labelled = [html_content.labelled(page) for page in html_content.LABELLED]
    expected = html_content.Model(labelled, [html_content.self_labelled(page) for _, page in marked])
    assert found.features == expected.features and found.edges == expected.edges
