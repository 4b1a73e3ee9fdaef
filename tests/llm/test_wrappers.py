"""Main texts: trees of any depth, marked articles and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanveil.llm.wrappers import extract_main_texts, main_text, parse, shape_of


def test_depth_has_no_limit():
    deep = "<div>" * 200 + "<aside><p>advert</p></aside>" + "</div>" * 200
    assert main_text(f"<div><article><p>a</p>{deep}<p>tail</p></article></div>", []) == "a\n\ntail"
    assert main_text("<div>" * 20000 + "deep" + "</div>" * 20000, []) == "deep"


def test_varying_text_decides_over_marked_articles():
    site = (
        "<body><div><p>Welcome to our site, read by everyone</p></div>"
        "<div><h2>{0}</h2><p>The story of {0}, told at length and in full</p></div>"
        "<div><article><p>Teaser {0}</p></article><article><p>Box {0}</p></article></div></body>"
    )
    reference = shape_of(parse(site.format("old things")), [])
    want = "new days\n\nThe story of new days, told at length and in full"
    assert main_text(site.format("new days"), [reference]) == want
    # An article of template text only.
    page = "<body><article><p>All rights reserved</p></article><div><p>{}</p></div></body>"
    reference = shape_of(parse(page.format("an older text of some length")), [])
    assert main_text(page.format("something new that is longer"), [reference]) == "something new that is longer"


def test_pages_without_marks_give_the_same_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plain = pages.withColumn("html", F.regexp_replace("html", "(</?)article>", "$1div>"))
    one, two = (sorted((r.page_id, r.text) for r in extract_main_texts(p).collect()) for p in (pages, plain))
    assert one == two


def test_every_template_of_a_host_is_learned(spark):
    boxes = "<div><p>{1} rights are reserved here</p></div>"
    rare = "<body><section><div><p>Rare {0}</p></div><p>Tail of the rare template</p></section>" + boxes + "</body>"
    usual = "<body><div><h2>{0}</h2><p>Usual {0}</p></div>" + boxes + "</body>"
    rows = [usual.format(f"text {k}", "Usual") for k in range(60)] + [rare.format(f"text {k}", "Rare") for k in range(4)]
    # Short, and mostly template.
    rows += ["<body><div><p>x{}</p></div><div><p>{}</p></div></body>".format(k, "All of this is boilerplate " * 20) for k in range(4)]
    frame = [(k, f"http://h.net/{k}", page) for k, page in enumerate(rows)]
    got = {r.page_id: r.text for r in extract_main_texts(spark.createDataFrame(frame, "page_id long, url string, html string")).collect()}
    assert got[0] == "text 0\n\nUsual text 0"
    assert got[61] == "Rare text 1"
    assert got[65] == "x1"


def test_notices_inside_articles_are_template(spark):
    page = (
        "<body><nav><a href='/'>Home</a></nav><article><h1>{0}</h1><p>Subscribe now and get ten percent off</p><p>The story of {0},"
        " told at length and in full</p><p>Read more on our front page</p></article></body>"
    )
    rows = [(k, f"http://h.net/{k}", page.format(f"subject {k}")) for k in range(40)]
    # Near copies of one article, which are not notices to one another.
    copies = "<body><article><p>{0}</p><p>One long text that all of these pages hold, whatever their number may be</p></article></body>"
    rows += [(100 + k, f"http://copies.net/{k}", copies.format(k)) for k in range(20)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_main_texts(frame).collect()}
    assert all(got[k] == f"subject {k}\n\nThe story of subject {k}, told at length and in full" for k in range(40))
    assert all(got[100 + k].endswith("whatever their number may be") for k in range(20))


def test_marked_boxes_beside_the_text(spark):
    page = "<body><div><h2>{0}</h2><p>The story of {0}, told at length and in full</p></div><div><article><p>Teaser {0}</p></article></div></body>"
    rows = [(k, f"http://h.net/{k}", page.format(f"subject {k}")) for k in range(12)] * 2
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.page_id, r.text) for r in extract_main_texts(frame).collect()]
    assert sorted(got) == sorted([(k, f"subject {k}\n\nThe story of subject {k}, told at length and in full") for k in range(12)] * 2)
