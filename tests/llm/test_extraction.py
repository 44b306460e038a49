from __future__ import annotations

import html
import re

import numpy as np
import pytest

from foliolens.llm import extraction
from foliolens.llm.common import table
from foliolens.llm.extraction import BlockLabeller, blocks_of, extract, fit_labeller, laid_out, main_texts


@pytest.fixture(scope="module")
def pages(spark):
    return [r["html"] for r in table(spark, "/root/testdata/sf0.01", "pages").select("html").orderBy("page_id").collect()]


@pytest.fixture(scope="module")
def net(pages):
    return fit_labeller(pages[:100])


def test_parsing():
    page = (
        "<!doctype html><head><title>t</title><style>p{}</style></head><body><p>one<p>two <b>bold<br>line<div>three"
        "</div><ul><li>a<li>b &amp; c</ul><script>var x='</p>';</script><!-- no <p>no</p> --><p hidden>never</p>"
        "<p class='x' title='a > b'>four&nbsp;&#233;<select><option>no</select></p><td>five<p>six</p"
    )
    assert [b.text for b in blocks_of(page)] == ["one", "two bold line", "three", "a", "b & c", "four é", "five", "six"]
    assert blocks_of(None) == blocks_of("") == blocks_of("<p> &nbsp; </p>") == []
    assert [b.text for b in blocks_of("<p>cut &am")] == ["cut &am"] and [b.text for b in blocks_of("<p>cut</artic")] == ["cut"]
    (b,) = blocks_of('<div class="cookieNotice top" id=x-1><a href="/">go</a> on</div>')
    assert {"t:div", "c:cookie", "c:notice", "c:top", "c:x", "c:1"} <= set(b.path) and 0 < b.linked < 1


def test_hidden_inline_elements_end_at_their_own_tag():
    texts = lambda page: [b.text for b in blocks_of(page)]
    assert texts('<p><i class="icon" aria-hidden="true"></i> Text</p>') == ["Text"]
    assert texts("<body><span hidden>no</span><p>one</p>two</body>") == ["one", "two"]
    assert texts("<p>a <span hidden>no <span>no</span> no</span>b</p>") == ["a b"]
    assert texts("<p>a <a href=x aria-hidden=true>#</a>b <b style='color:red; display : none'>no</b>c") == ["a b c"]
    assert texts("<div><i hidden>no<p>no</i>b</p>c</div>") == ["b", "c"]
    assert texts("<div><span hidden>no<p>no</p></span>b<em hidden>no</div>c") == ["b", "c"]
    (b,) = blocks_of("<div class=top><i hidden>x</i>text</div>")
    assert b.path == ["t:div", "c:top"] and b.linked == 0


def test_only_attributes_hide():
    for seen in ('title="the hidden cost"', 'data-x="a hidden gem"', "title='display:none'", "aria-hidden=false", "class=hidden-x data-hidden", "style='x-display:none'"):
        assert [b.text for b in blocks_of(f"<p {seen}>text <i {seen}>too</i></p>")] == ["text too"], seen
    for gone in ("hidden", 'hidden=""', "HIDDEN='until-found'", "aria-hidden = 'TRUE'", 'style="display:none!important"', "title='x' hidden"):
        assert [b.text for b in blocks_of(f"<p {gone}>no</p><p>text<i {gone}>no</i></p>")] == ["text"], gone


def test_given_pages(pages, net):
    """The article's blocks of the given layout, cut out by plain patterns."""
    for page, found in zip(pages, main_texts(pages, net), strict=True):
        article = re.sub(r"<[^>]*\Z", "", re.search(r"<article>(.*?)(</article|\Z)", page, re.S)[1])
        parts = [re.sub(r"<[^>]*>", "", p.replace("<br>", " ")) for p in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert found == want


def test_made_pages_that_training_did_not_see(pages, net):
    rng = np.random.default_rng(1234)
    texts = [b.text for p in pages[100:200] for b in blocks_of(p)]
    right = total = 0
    for _ in range(150):
        blocks, labels = laid_out(texts, rng)
        right += int((net.label([extraction.features(blocks)])[0] == np.array(labels, bool)).sum())
        total += len(labels)
    assert right / total > 0.97


def test_surroundings(net):
    page = """<html><body><header><h1>Site</h1></header><nav><ul><li><a>Home</a><li><a>News</a></ul></nav>
      <div class="cookie-banner">We use cookies</div><main><article><h1>Title here</h1><p>First para &amp; text.</p>
      <div class="advert">Buy now</div><p>Second   para<br>line</p><section class="comments"><h2>Comments</h2>
      <p>nice article</p></section></article></main><aside class="sidebar"><p>Other things</p></aside>
      <form><label>Name</label></form><footer>(c)</footer></body></html>"""
    assert main_texts([page, None, ""], net) == ["Title here\nFirst para & text.\nSecond para line", "", ""]


def test_gradients():
    rng = np.random.default_rng(5)
    net = BlockLabeller.fresh(6, 3)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, live = rng.normal(size=(2, 4, 6)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    y = rng.integers(0, 2, (2, 4)).astype(float)

    def loss():
        z = net.logits(x, live)
        return float(((np.logaddexp(0, z) - y * z) * live).sum() / live.sum())

    grads = net.gradients(x, live, y)
    for name, w in net.weights.items():
        at = tuple(int(rng.integers(s)) for s in w.shape)
        old = w[at]
        w[at] = old + 1e-3
        up = loss()
        w[at] = old - 1e-3
        down = loss()
        w[at] = old
        assert grads[name][at] == pytest.approx((up - down) / 2e-3, abs=2e-4), name


def test_length_does_not_change_labels(net, pages):
    """A page's labels are the same alone and among longer ones."""
    rows = [extraction.features(blocks_of(p)) for p in pages[:30]]
    together = net.label(rows)
    for row, own in zip(rows, together, strict=True):
        assert (net.label([row])[0] == own).all()


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(extraction, "MADE", 40)
    rows = [(1, "u", "<article><p>x y z.</p></article>"), (2, None, None), (None, "u", ""), (1, "u", "<article><p>x y z.</p></article>")]
    df = spark.createDataFrame([(*r, "taken") for r in rows], "page_id long, url string, html string, main_text string")
    found = extract(df)
    assert found.columns == [*df.columns, "_main_text"] and found.count() == 4
    assert extract(df.filter("false")).count() == 0
    assert main_texts(["<article><p>a</p><nav>b</nav></article>"], None) == ["a"]
