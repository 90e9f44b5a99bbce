import html
import re

import pytest

from symgraph.llm import extract as E
from symgraph.llm.html_blocks import leaf_blocks
from symgraph.llm.labelled_pages import labelled_pages


@pytest.fixture(scope="module")
def field():
    return E.train()


def test_blocks_decode_references_and_close_paragraphs():
    blocks = leaf_blocks("<body><p>a&amp;b <b>c<br>d<p>e&nbsp; f<ul><li>x<li>y</ul><script>var t='</p>'</script><!-- no --><svg>z</svg>tail")
    assert [b.text for b in blocks] == ["a&b c d", "e f", "x", "y", "tail"]
    assert "p" not in blocks[2].tags and blocks[2].last == ("body", "ul", "li") and leaf_blocks(None) == [] and leaf_blocks("<<<>&#xZZ;")


def test_held_out_labelled_pages(field):
    wrong = total = 0
    for page in labelled_pages(200, 1234):
        blocks = leaf_blocks(page)
        got = field.decode(blocks)
        wrong += sum(g != (b.mark == "main") for b, g in zip(blocks, got))
        total += len(blocks)
    assert wrong / total < 0.02


def test_viterbi_equals_the_best_of_all_sequences(field):
    from itertools import product

    for page in labelled_pages(15, 77):
        blocks = leaf_blocks(page)[:9]
        local = [[sum(field.weights.get(n, (0, 0))[s] for n in names) for s in (0, 1)] for names in E.features(blocks)]

        def value(seq):
            return sum(local[i][s] for i, s in enumerate(seq)) + sum(field.steps[a][b] for a, b in zip(seq, seq[1:]))

        best = max(map(value, product((0, 1), repeat=len(blocks))))
        assert value([int(x) for x in field.decode(blocks)]) == pytest.approx(best)


@pytest.mark.parametrize("page", [
    "<html><body><div><h1>Some title here</h1><p>First paragraph has words in it.</p><p>Second para also has words in it.</p></div></body></html>",
    "<body><h1>Title</h1><div>First paragraph has words in it.</div><div>Second one is here too, with more.</div><div>Short end.</div></body>",
    "<body><div><div><a href=/>Home</a> <a href=/b>Blog</a></div></div><div><div><h2>Title of it</h2><p>First paragraph has words in it.</p><p>Last words.</p></div></div></body>",
    "<body><table><tr><td><p>First paragraph has words in it.</p><p>Second para also has words, and <a href=/x>one link</a> in it.</p></td></tr></table></body>",
])
def test_layouts_without_names_keep_every_paragraph(field, page):
    blocks = leaf_blocks(page)
    want = " ".join(b.text for b in blocks if "Home" not in b.text)
    assert E.main_text(page, field) == want


@pytest.mark.parametrize("page", [
    "<body><header><h1>Site</h1></header><main><h1>A title</h1><p>First paragraph has words in it.</p><p>Second one too, with more of them.</p></main></body>",
    "<body><header><h1>Site</h1><p>Words under it</p></header><article><h2>A title</h2><p>First paragraph has words in it.</p><p>Second one too, with more of them.</p></article><footer>Copyright 2020 someone</footer></body>",
    "<body><table><tr><td><a href=/>Home</a> <a href=/a>A</a></td></tr><tr><td><h1>A title</h1><p>First paragraph has words in it.</p><p>Second one too, with more of them.</p></td></tr><tr><td>Copyright 2020 someone</td></tr></table></body>",
    "<body><table><tr><td><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul></td><td><h1>A title</h1><p>First paragraph has words in it.</p><p>Second one too, with more of them.</p></td></tr></table></body>",
])
def test_site_headers_and_cells_beside_the_article_go(field, page):
    text = E.main_text(page, field)
    assert text.endswith("A title First paragraph has words in it. Second one too, with more of them.") and len(text) < 81


def test_a_header_inside_an_article_stays(field):
    page = "<body><nav><a href=/>Home</a></nav><article><header><h1>A title of it</h1></header><p>First paragraph has words in it.</p><p>Second one too, with more of them.</p></article></body>"
    assert E.main_text(page, field) == "A title of it First paragraph has words in it. Second one too, with more of them."


def test_deep_and_unclosed_markup_costs_no_more_than_its_length():
    import time

    def seconds(n):
        began = time.perf_counter()
        blocks = leaf_blocks("<span class='a b'><div>word " * n + "<b>" * n + "<h1>x</h1></i>" * n)
        assert len(blocks) == 2 * n
        return time.perf_counter() - began

    seconds(500)
    assert seconds(8000) < 40 * max(seconds(800), 0.01)


def test_given_pages_give_their_articles(spark, field):
    rows = E.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), field=field).collect()
    for r in rows:
        inner = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", inner)).split())


def test_odd_pages(spark, field):
    long = "<article><h1>T</h1>" + "<p>word word word.</p>" * 20000 + "</article>"
    rows = [(1, None, "x"), (2, "", "x"), (3, "<nav><a href=/>Home</a></nav>", "x"), (4, long, "x"), (4, long, "x"), (5, "<article><p>open <div", "x")]
    got = E.extract(spark.createDataFrame(rows, "page_id long, html string, text string"), field=field).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == 6 and text[1] == text[2] == text[3] == "" and text[4].count("word") == 60000 and text[5].startswith("open")
    assert E.extract(spark.createDataFrame([], "page_id long, html string"), field=field).count() == 0
