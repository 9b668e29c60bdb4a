import re

import numpy as np
import pytest

from stockwarden.llm import extraction as X


@pytest.fixture(scope="module")
def field():
    return X.default_field()


def test_viterbi_is_the_best_of_all_label_sequences():
    rng = np.random.default_rng(1)
    for n in range(1, 8):
        f = X.Field(rng.standard_normal((4, 2)), rng.standard_normal((2, 2)), rng.standard_normal(2))
        x = rng.standard_normal((n, 4))
        e = x @ f.emit
        value = lambda y: f.start[y[0]] + sum(e[k, y[k]] for k in range(n)) + sum(f.move[a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: B023, E731
        every = [[m >> k & 1 for k in range(n)] for m in range(2**n)]
        assert f.decode(x).tolist() == max(every, key=value)


def test_training_follows_the_exact_gradient():
    rng = np.random.default_rng(2)
    pages = [(rng.standard_normal((n, 3)), rng.integers(0, 2, n)) for n in (1, 4, 6)]
    fitted = X.train(pages, rounds=4000, rate=0.2)

    def loss(flat):
        emit, move, start = flat[:6].reshape(3, 2), flat[6:10].reshape(2, 2), flat[10:]
        total = 0.0
        for x, y in pages:
            e = x @ emit
            value = lambda z: start[z[0]] + sum(e[k, z[k]] for k in range(len(z))) + sum(move[a, b] for a, b in zip(z, z[1:], strict=False))  # noqa: B023, E731
            every = np.array([value([m >> k & 1 for k in range(len(y))]) for m in range(2 ** len(y))])
            total += np.log(np.exp(every).sum()) - value(y.tolist())
        return total / len(pages) + 0.01 * (flat**2).sum()

    at = np.concatenate((fitted.emit.ravel(), fitted.move.ravel(), fitted.start))
    slopes = [(loss(at + 1e-5 * step) - loss(at - 1e-5 * step)) / 2e-5 for step in np.eye(12)]
    assert np.abs(slopes).max() < 0.01


def test_held_out_layouts(field):
    wrong = total = 0
    for page in X.labelled_pages(120, seed=77):
        blocks = X.blocks_of(page)
        labels = np.array([int("~" in b.text) for b in blocks])
        for b in blocks:
            b.text = b.text.replace("~", "") or "."
        wrong += int((field.decode(X.features(blocks)) != labels).sum())
        total += len(labels)
    assert wrong / total < 0.02, (wrong, total)


def test_given_pages(spark, field):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in X.extract(table, field).collect()}
    assert len(got) == table.count()
    for r in table.collect():
        inside = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", r.html, re.S)[1]
        assert got[r.page_id].text == "\n".join(b.text for b in X.blocks_of(inside)), r.page_id
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_blocks():
    text = lambda page: [b.text for b in X.blocks_of(page)]
    assert text("<p>a&amp;b&nbsp; c<br>d<p>e<b>f</b>g") == ["a&b c d", "efg"]
    assert text("<script>x<p></script><style>y</style><!-- <p>z</p> --><p title='a>b'>1 < 2 &lt;p&gt;") == ["1 < 2 <p>"]
    assert text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert text("<div hidden>no</div><div style='display:none'>no</div><div>yes</div>") == ["yes"]
    assert text("<p>a</b></div>b<td>c") == ["a", "b", "c"] and text("<p") == ["<p"] and text("") == [] and text(None) == []
    assert text("<!-- never ends <p>x") == []
    assert len(X.blocks_of("<div>" * 3000 + "deep")) == 1


def test_elements_without_an_end_lose_no_text():
    text = lambda page: [b.text for b in X.blocks_of(page)]
    for tag in ("<button-group>", "<video-player>", "<title-bar>", "<svg viewBox='0 0 1 1'/>", "<math/>", "<button>", "<object data=x>", "<video src=x>", "<svg>"):
        assert text(f"<p>a {tag} b</p><p>c</p>") == ["a b", "c"], tag
    assert text("<p>a</p><button><p>b</p><button>no</button><p>c</p>") == ["a", "b", "c"]
    assert text("<p>a <button class='x'>no</button> b <svg><svg><p>no</svg>no</svg>c</p>") == ["a b c"]
    assert text("<p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p>") == ["let x=1 be"]
    assert text("<p>a</p><script>b <p>c</p>") == ["a"] and text("<p>a<template><p>no</p></template>b</p>") == ["ab"]


def test_odd_rows(spark, field):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<article><p>Some text that is here, and more of it. It goes on.</p></article>", "x"), (3, "u", "<nav><a href=x>menu</a></nav>", "x"), (3, "u", "<nav><a href=x>menu</a></nav>", "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in X.extract(table, field).collect()))
    body = "Some text that is here, and more of it. It goes on."
    assert got == [(0, body, len(body)), (1, "", 0), (2, "", 0), (3, "", 0), (3, "", 0)]
    assert X.extract(table.limit(0), field).count() == 0
