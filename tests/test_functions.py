"""Golden cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import classify, html, jsonld, normalize, urls


def values(spark, rows, build, n=1):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ", ".join(f"c{i} string" for i in range(n)))
    return [r[0] for r in df.select(build(*[F.col(f"c{i}") for i in range(n)]).alias("v")).collect()]


@pytest.mark.parametrize(
    "url, country",
    [
        ("https://mill.example.nz/wheel", "nz"), ("HTTPS://MILL.EXAMPLE.PT", "pt"), ("https://mill.example.se:8443/x", "se"), ("https://joe:pw@mill.example.dk/", "dk"), ("https://mill.example.fi./grain", "fi"),
        ("https://xn--mhle-0ra.example.at/", "at"), ("https://mill.example.uk/de-fr/x", "gb"), ("https://mill.example.org/pt-BR", "br"), ("https://mill.example.org/EN_uk/x", "gb"), ("https://mill.example.org//sv-se//x", "se"),
        ("https://mill.example.org/x/en-us/", None), ("https://mill.example.org/en-eng", None), ("https://mill.example.org/en-zz", None), ("https://millhost/en-nz/x", "nz"), ("ftp://mill.example.ie/a", "ie"), ("mill.example.nz", None), (None, None),
    ],
)
def test_country(spark, url, country):
    assert values(spark, [url], urls.country) == [country]


def test_slugs(spark):
    assert values(spark, ["https://www.example.com", "https://example.com:8080", "https://www.my_site.com"], urls.job_slug) == ["example-com", "example-com", "my-site-com"]
    assert values(spark, ["https://www.Nike.com/path", "https:\\/\\/www.armani.com\\/"], urls.command_slug) == ["nike-com", "armani-com"]
    assert values(spark, ["My Shop.com"], urls.name_slug) == ["my-shop-com"]


def test_url_shapes(spark):
    assert values(spark, ["https://a.com//x///y?q=//z"], urls.collapse_slashes) == ["https://a.com/x/y?q=//z"]
    assert values(spark, ["https://A.com/x.html/", "https://a.com/x?y=1"], urls.canonical) == ["a.com/x", "a.com/x"]
    assert values(spark, [("//c.com/x", "https://a.com/b"), ("x", "https://a.com/b/c"), ("x", "https://a.com"), (None, "https://a.com")], urls.absolutise, 2) == ["https://c.com/x", "https://a.com/b/x", "https://a.com/x", ""]
    assert values(spark, ["https://a.com/p/12/x", "https://a.com/p/x12", "https://a.com/p"], urls.sku) == ["12", "12", ""]
    assert values(spark, ["a b*~"], urls.percent_encode) == ["a%20b%2A~"]


def test_text(spark):
    assert values(spark, ["average rating value is 5.0 of 5."], html.rating) == [5.0]
    assert values(spark, ["<p> a </p><p></p><p class='x'>b\n c</p>"], html.paragraphs) == ["a\nb c"]
    assert values(spark, ["12 views, 1,000"], html.digits) == ["121000"]
    assert values(spark, ["---\nname: x y \n---"], lambda c: html.frontmatter(c, "name")) == ["x y"]
    assert values(spark, ["Home .nav { color: red }"], html.label) == ["Home"]
    assert values(spark, ["x" * 301], lambda c: F.length(html.shorten(c))) == [303]


def test_normalise(spark):
    assert values(spark, ["58.95", "1234.5", "€3", "ask", None], normalize.price_text) == ["$58.95", "$1,234.50", "€3", "$ask", ""]
    assert values(spark, ["CALVIN KLEIN", "none"], normalize.brand) == ["Calvin Klein", ""]
    assert values(spark, ["products", "class", "jobs", None], normalize.singular_label) == ["products", "cla", "job", "items"]
    assert values(spark, ["12.5", "9"], lambda c: normalize.original_price(c, F.lit("10"))) == ["12.5", ""]
    assert values(spark, ["https://schema.org/PreOrder", "BackStock", ""], normalize.availability_map) == ["In Stock", "Back Stock", ""]


def test_classify(spark):
    assert values(spark, [("403", "x"), ("200", "plain"), ("200", "Captcha!")], lambda s, t: classify.banned(s.cast("int"), t), 2) == [True, False, True]
    assert values(spark, ["<p>Just a Moment", "fine"], classify.blocked) == [True, False]


def test_jsonld_shapes(spark):
    def of(build, *texts):
        return values(spark, list(texts), lambda c: build(F.try_parse_json(c)))

    assert of(jsonld.has_price, '{"offers": {"price": 0}}', '{"offers": [{"price": ""}, {"price": "3"}]}', '{"offers": []}', "{}") == [False, True, False, False]
    assert of(lambda v: jsonld.named(v, "author"), '{"author": "A"}', '{"author": {"name": "B"}}', '{"author": [{"name": "C"}]}', '{"author": null}') == ["A", "B", "C", ""]
    assert of(jsonld.pictures, '{"image": "a"}', '{"image": [{"url": "b"}, "c", null]}', "{}") == [["a"], ["b", "c"], []]
    assert of(jsonld.salary, '{"baseSalary": {"value": {"minValue": 1, "maxValue": 2, "unitText": "HOUR"}}}', "{}") == ["$1 - $2 HOUR", ""]
    assert values(spark, ["x"], lambda c: jsonld.longest_tag(F.array(F.lit("cat:a"), F.lit("cat:bbb"), F.lit("cat:ccc"), F.lit("zzzzzzzz")))) == ["cat:bbb"]


def test_wrapped_blocks_stay_in_their_page(spark):
    """First of a role in page order, its own object where a key holds no object, no row without objects; nothing is sorted or shuffled."""
    def page(*scripts):
        return "".join(f'<script type="application/ld+json">{s}</script>' for s in scripts)

    htmls = [
        page("{bad", '[7, {"review": {"a": 1}}, {"@type": "Product", "n": 1}]', '{"@type": "Product", "n": 2}', '{"@type": "AggregateRating", "n": 3}'),
        page('{"aggregateRating": 5}'), page('{"@type": "Other"}'), "", None,
    ]
    pages = spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")
    found = jsonld.wrapped_blocks(pages)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    got = found.select("page_id", *[F.to_json(c) for c in ("product", "rating", "review")]).collect()
    assert sorted(map(tuple, got)) == [(0, '{"@type":"Product","n":1}', '{"@type":"AggregateRating","n":3}', '{"a":1}'), (2, None, None, None)]
