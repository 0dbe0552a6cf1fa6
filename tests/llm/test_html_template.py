"""The host's template judges what stands in articles too, by exact counts."""

from flowbook.llm import html_extract
from flowbook.llm.queries import table


def texts(spark, rows):
    table(spark, "/root/testdata/sf0.001", "pages")  # workers find the package
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.main_text for r in html_extract.extract(df).collect()}


def test_template_text_in_an_article_goes(spark):
    page = ("<article><h1>Head {0}</h1><p>Body of number {0}.</p><p>Written by our own desk.</p>"
            "<ul><li><a href=/a>Top {0}</a></li><li><a href=/b>More {0}</a></li></ul></article>")
    out = texts(spark, [(i, "http://h.x/1", page.format(i)) for i in range(20)])
    assert out == {i: f"Head {i}\nBody of number {i}." for i in range(20)}


def test_an_article_repeated_as_a_whole_stays(spark):
    whole = "Head\nFirst words.\nSecond words."
    page = "<div class=top><p>Visit {}</p></div><main><h1>{}</h1><p>First words.</p><p>Second words.</p></main>"
    out = texts(spark, [(i, "http://h.x/1", page.format(i, "Head")) for i in range(20)] + [(i, "http://k.x/1", page.format(i, f"Head {i}")) for i in range(20, 40)])
    assert {out[i] for i in range(20)} == {whole}
    assert all(out[i] == whole.replace("Head", f"Head {i}") for i in range(20, 40))


def test_a_few_pages_are_no_template(spark):
    page = "<article><h1>Head</h1><p>Same words.</p><ul><li><a href=/a>A source</a></li></ul><p>Body {}</p></article>"
    out = texts(spark, [(i, "http://h.x/1", page.format(i)) for i in range(4)])
    assert out[2] == "Head\nSame words.\nA source\nBody 2"
