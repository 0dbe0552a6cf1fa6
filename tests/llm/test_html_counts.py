"""A slot of a host's template counts all of its texts."""

from flowbook.llm import html_extract
from flowbook.llm.queries import table


def test_many_constant_texts_of_a_slot(spark):
    table(spark, "/root/testdata/sf0.001", "pages")  # workers find the package
    fixed = "".join(f"<p>Constant text {k}.</p>" for k in range(40))
    rows = [(i, "http://h.x/1", f"<div><p>Own text {i}.</p>{fixed}</div>") for i in range(300)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == 300 and all(r.main_text == f"Own text {r.page_id}." for r in out)


def test_the_share_is_exact(spark):
    """A text on 80 of 100 pages is constant, one on 79 is not."""
    table(spark, "/root/testdata/sf0.001", "pages")
    rows = [(i, "http://h.x/1", f"<div><p>Own text {i}.</p>{'<p>Eighty.</p>' if i < 80 else ''}{'<p>Less.</p>' if i < 79 else ''}</div>") for i in range(100)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.main_text == f"Own text {r.page_id}." + ("\nLess." if r.page_id < 79 else "") for r in out)
