"""The element scanner, selectors and listing operators on markup that regular expressions can't read."""

import duckdb
import pytest
from pyspark.sql import functions as F

import compare
from quarrymill import registry
from quarrymill.operators import listings
from quarrymill.sources.elements import first_text, matches, meta_tags, parse_selector, pick, plain_text, scan, selected


def _tags(html):
    return [(e.tag, e.parent, e.leave, e.depth) for e in scan(html).elements]


def test_scan_closes_what_html_closes():
    assert _tags("<ul><li>a<li>b<ul><li>c</ul></ul>") == [("ul", None, 4, 0), ("li", 0, 1, 1), ("li", 0, 4, 1), ("ul", 2, 4, 2), ("li", 3, 4, 3)]
    assert _tags("<p>a<div>b</div>") == [("p", None, 0, 0), ("div", None, 1, 0)]
    assert _tags("<div><br/><img src=x>t</b></div></div><p>") == [("div", None, 2, 0), ("br", 0, 1, 1), ("img", 0, 2, 1), ("p", None, 3, 0)]
    assert _tags("<table><tr><td>1<td>2<tr><td>3</table>") == [("table", None, 5, 0), ("tr", 0, 3, 1), ("td", 1, 2, 2), ("td", 1, 3, 2), ("tr", 0, 5, 1), ("td", 4, 5, 2)]
    page = scan("<a HREF=/x title='a > b' title=2 hidden>one &amp; <b>two</b></a><script>if (a < b) '</p>'</script>")
    assert page.elements[0].attrs == {"href": "/x", "title": "a > b", "hidden": ""}
    assert "".join(page.pieces[page.elements[0].first : page.elements[0].last]) == "one & two"
    assert page.elements[2].tag == "script" and page.pieces[-1] == "if (a < b) '</p>'"
    assert scan(None).elements == [] and scan("a < b <").elements == []
    deep = scan("<div>" * 3000 + "x")
    assert deep.elements[0].leave == 2999 and deep.elements[-1].depth == 2999


@pytest.mark.parametrize(
    "css, picked",
    [
        ("li", [2, 4]), ("#m", [0]), (".big", [1]), ("ul.big.wide", [1]), ("[data-x]", [2, 4]), ("[data-x=b]", [4]), ('[data-x="A" i]', [2]), ("[class*='id']", [1]), ("[class^=bi]", [1]),
        ("[class$=wide]", [1]), ("[class~=wide]", [1]), ("div a", [3]), ("div > a", []), ("ul > li > a", [3]), ("div > ul a, b", [3, 5]), ("* > b", [5]), ("div li [href]", [3]), ("p", []),
    ],
)
def test_selectors(css, picked):
    page = scan('<div id=m><ul class="big wide"><li data-x=a><a href=u>t</a><li data-x="b">v<b>w</b></ul></div>')
    chains = parse_selector(css)
    assert [e.node for e in page.elements if any(matches(c, e, page.elements) for c in chains)] == picked


def test_no_selector():
    with pytest.raises(ValueError, match="no selector"):
        parse_selector("a:hover")


def _page(spark, *htmls):
    return spark.createDataFrame([(i, "https://a.example/dir/page", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def test_rows_of_elements(spark):
    pages = _page(spark, "<h1> A <i>b</i></h1><h1>c</h1><title>T</title>", None, "", "<title>only</title><h1> </h1>")
    rows = pick(pages, ["h1", "i"], ["page_id"]).orderBy("page_id", "node").collect()
    assert [(r.page_id, r.node, r.leave, r.tag, r.pieces, r.picked) for r in rows] == [(0, 0, 1, "h1", [" A ", "b"], [0]), (0, 1, 1, "i", ["b"], [1]), (0, 2, 2, "h1", ["c"], [0]), (3, 1, 1, "h1", [" "], [0])]
    assert {tuple(r) for r in first_text(pages, ["h1", "title"]).collect()} == {(0, "A b", 0), (3, "only", 1)}
    assert {(r.page_id, r.selector, r.n, tuple(r.texts)) for r in selected(pages, ["h1"], shown=1, limit=2).collect()} == {(0, 0, 2, ("A ",)), (3, 0, 1, ("",))}
    assert [r.t for r in pages.orderBy("page_id").select(plain_text(F.col("html")).alias("t")).collect()] == ["A b c T", "", "", "only"]
    metas = _page(spark, "<meta content=1 name=a><meta property='b' content='x > y'><meta name=a content=2><meta name=c content=''><meta name='' property=d content=e>")
    assert meta_tags(metas).head().meta == {"a": "2", "b": "x > y", "d": "e"}
    assert pick(pages.limit(0), ["h1"]).collect() == []


def test_cards_prefer_the_link_inside(spark):
    card = "<div class=product-tile data-sku=c{0} data-price=5><span><a data-sku=l{0} aria-label='L {0}' href=?p={0}>x</a></span><a href=/second>y</a></div>"
    own = "<a class=item-card href=/own/{0} data-productid={0}>Own {0}</a>"
    html = "".join(card.format(i) for i in range(3)) + "<div class=product-tile>no link</div>" + "".join(own.format(i) for i in range(3)) + "<b class=plp-card><a href=/few>few</a></b>"
    rows = listings.cards(_page(spark, html)).orderBy("selector", "pos").collect()
    by = {}
    for r in rows:
        by.setdefault(r.selector, []).append((r.href, r.text, r.data))
    assert set(by) == {2, 3, 6, 7, 19}
    assert by[7] == [(f"https://a.example/dir/page?p={i}", f"L {i}", {"sku": f"l{i}", "price": "5"}) for i in range(3)]
    assert by[6] == [(f"https://a.example/own/{i}", f"Own {i}", {"productid": str(i)}) for i in range(3)]
    assert by[3][1] == ("https://a.example/dir/page?p=0", "L 0", {"sku": "l0", "price": "5"}) or len(by[3]) >= 3


def test_product_links_go_on_until_there_are_enough(spark):
    two = "".join(f"<div class=product-card><a href=/c{i}>c</a></div>" for i in range(2))
    three = "".join(f"<div class=product-tile><a href=/t{i}>t</a></div>" for i in range(3))
    paths = "".join(f"<a href=/p/{i}>p</a>" for i in range(40)) + "<a href=/item/a1>i</a>"
    got = listings.product_links(_page(spark, two + paths, two + three + paths, paths.replace("/p/", "/x/").replace("/item/", "/sku-9"))).orderBy("page_id", "place").collect()
    by = [[r.href.removeprefix("https://a.example") for r in got if r.page_id == i] for i in range(3)]
    assert by[0] == [f"/p/{i}" for i in range(40)]  # two cards are too few; thirty addresses end the stage before the next kind
    assert by[1] == ["/t0", "/t1", "/t2"]
    assert by[2] == ["/sku-9a1"]


def test_grid_of_the_nearest_class(spark):
    grid = "<div class='g x'><p><i><b><a href=/product/{0}>t</a></b></i></p></div>"
    html = "".join(grid.format(i) for i in range(3)) + "".join(f"<ul class=far><li><i><b><u><a href=/product/z{i}>z</a></u></b></i></li></ul>" for i in range(2)) + "<nav class=n><a href=/home>h</a></nav>"
    got = listings.grid_links(_page(spark, html, "<a href=/product/1>1</a>")).orderBy("pos").collect()
    assert [(r.page_id, r.parent, r.href) for r in got] == [(0, "g", f"https://a.example/product/{i}") for i in range(3)]


@pytest.mark.parametrize("name", ["page_first_selected", "page_parsed_text", "page_selected_texts"])
def test_queries_decode_the_references_of_their_sql(spark, tmp_path, name):
    """Titles and headings that are cut in a reference, end in a bare ``&`` or hold others than ``&amp;``; a script's ``&`` is no reference."""
    page = '<html><head><title> {t} | x{t}</title><script>var t="</p>";a && b</script></head><body><article><h1>{t}</h1><p>{t}</p></article></body></html>'
    cut = ["a &amp;&amp", "b &", "c &am", "d &quot;e&quot", "&amp;lt; f", "&copy; &copyg"]
    rows = [(3 * i + k, "https://a.example/x", page.replace("{t}", t)) for i, t in enumerate(cut) for k in range(2)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert compare.spark_rows(registry.QUERIES[name](spark, str(tmp_path))) == compare.sql_rows(con, registry.SQL[name])
