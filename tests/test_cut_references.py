import pytest

from symgraph.operators import html
from symgraph.plans import catalog


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cut")
    page = "<html><body><h1>{}</h1><p>a &amp; b &amp;lt; &lt;c&gt;</p></body></html>"
    titles = ["Nuts &amp; bolts&amp", "This &am", "That &", "A &quot;word&quot", "&ampersand; here"]
    spark.createDataFrame([(i, f"u{i}", page.format(t)) for i, t in enumerate(titles)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def test_sections_of_pages_whose_titles_are_cut_in_a_reference(spark, pages):
    got = {r.doc: (r.title, r.section_id) for r in catalog.QUERIES["page_sections"](spark, pages).collect()}
    assert got == {0: ("Nuts & bolts&amp", "nuts-boltsamp"), 1: ("This &am", "this-am"), 2: ("That &", "that"), 3: ('A "word&quot', "a-wordquot"), 4: ("&ampersand; here", "ampersand-here")}


def test_pages_whose_titles_are_cut_in_a_reference(spark, pages):
    got = {r.page_id: r.markdown for r in catalog.QUERIES["html_to_markdown"](spark, pages).collect()}
    titles = ["Nuts & bolts&amp", "This &am", "That &", 'A "word&quot', "&ampersand; here"]
    assert got == {i: f"# {t}\n\n\na & b &lt; <c>" for i, t in enumerate(titles)}


def test_references_are_read_as_browsers_do_by_default():
    page = "<p>a &amp; b&amp &copy; &copy &#65; &#66 &am</p>"
    assert html.to_markdown(page) == "a & b& © © A B &am"
    assert html.to_markdown(page, open_references=False) == "a & b&amp © &copy A &#66 &am"
