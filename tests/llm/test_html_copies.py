"""An open page between identical copies is compared with the nearest other page."""

from cellweave.llm import html


def test_copies_are_passed_over(spark):
    page = lambda k, story: (k, f"http://a.com/x/{k:04d}", f"<div>Home</div><div><p>story {story}</p></div><div>Rights</div>")
    rows = [page(1, 1)] + [page(k, 2) for k in range(2, 7)] + [page(7, 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.text) for r in html.main_texts(pages).collect())
    assert got == [(1, "story 1"), *((k, "story 2") for k in range(2, 7)), (7, "story 3")]
