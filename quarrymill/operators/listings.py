"""Links and cards from real markup: navigation containers, product cards, grids, and the cascade of strategies over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import jsonld as J
from quarrymill.functions import urls as U
from quarrymill.operators.links import first_of_each, largest_grid, strategy_cascade
from quarrymill.shared import kept
from quarrymill.sources.elements import has, joined_text, pick, text_content

# Selectors of navigation containers, of product cards and of product addresses, patterns of the latter, and
# the attributes that cards are read for. The order of cards and addresses is the order in which they are tried.
NAVIGATION = "nav, [role=navigation], .menu, .navbar, .header-nav, .main-nav, .category-nav, .categories, header ul, .mega-menu, .dropdown-menu, .mega-nav, .utility-bar"
CARDS = (
    '[data-cy="product-grid-item"]', "[data-product-id]", "[data-productid]", "[data-sku]", ".product-card", ".product-item", ".item-card", ".product-tile",
    ".product-card--product", ".c-product-tile", "[ref=productTile]", "[data-tileid]", ".tile--product", "[data-testid=product-tile]", ".grid-item--product",
    ".plp-card", ".ae-plp-card", ".c-grid-item", '[class*="product-card"]', '[class*="product-tile"]', '[class*="product_tile"]', '[class*="plp-product"]',
    '[class*="grid-product"]', '[data-testid*="product" i]', '[data-testid*="tile" i]', '[data-testid*="card" i]', '[data-testid*="grid" i]',
)
ADDRESSES = ("/p/", "/product/", "/item/", "/pd/", "/dp/", "/sp-", "-c.aspx", "-c.html")
ADDRESS_PATTERNS = (r"/[+-]p\w*\d{4,}", r"/[+-]p\d{4,}", r"/pid[-_]\d", r"/sku[-_]\d", r"/product[-_/]\w")
ATTRIBUTES = ("data-sku", "data-productid", "data-product-id", "data-brand", "data-price", "data-productname")
LEAST_CARDS, MOST_CARDS, ENOUGH_ADDRESSES = 3, 200, 30


def _attr(element: str, name: str) -> Column:
    return F.nullif(F.col(element)[F.lit(name)], F.lit(""))


def container_links(pages: DataFrame, limit: int = 50) -> DataFrame:
    """``(page_id, href, text, place)``: links inside any navigation container, first occurrences, at most ``limit`` a page.

    Containers come in document order and links in theirs inside; a link in several counts where it is met first.
    """
    rows = kept(pick(pages, [NAVIGATION, "a[href]"]), "elements")
    boxes = rows.filter(has(0)).select("page_id", F.col("node").alias("box"), F.col("leave").alias("box_leave"))
    anchors = rows.filter(has(1)).select("page_id", "url", "node", F.col("attrs")["href"].alias("raw"), joined_text(F.col("pieces")).alias("text"))
    inside = anchors.join(boxes, "page_id").filter("node > box AND node <= box_leave")
    links = inside.select("page_id", "box", "node", U.absolutise(F.col("raw"), F.col("url")).alias("href"), "text")
    good = links.filter((F.col("href") != "") & F.length("text").between(2, 79) & ~F.col("href").rlike("^(?:#|javascript:|mailto:|tel:)"))
    return first_of_each(good, ["page_id"], "href", ["box", "node"]).filter(F.col("place") <= limit).select("page_id", "href", "text", F.col("place").cast("long").alias("place"))


def cards(pages: DataFrame) -> DataFrame:
    """``(page_id, selector, pos, href, text, data)``: product cards of the selectors that pick three or more, with the link inside and its data.

    The link is the first anchor inside the card, or the card itself; values are the link's or else the card's, a sku also
    that of the first element inside the card that has one.
    """
    rows = kept(pick(pages, [*CARDS, "a[href]", "[data-sku]"]), "elements")
    own = F.filter("picked", lambda s: s < len(CARDS))
    boxes = rows.filter(F.size(own) > 0).select("page_id", "url", F.col("node").alias("card"), "leave", F.col("tag").alias("card_tag"), F.col("attrs").alias("card_attrs"), joined_text(F.col("pieces")).alias("card_text"), own.alias("selectors"))
    inner = rows.filter(has(len(CARDS)) | has(len(CARDS) + 1)).select("page_id", "node", has(len(CARDS)).alias("is_link"), F.col("attrs").alias("inner_attrs"), joined_text(F.col("pieces")).alias("link_text"))
    met = boxes.select("page_id", "card", "leave").join(inner, "page_id").filter("node >= card AND node <= leave")
    inside = F.col("node") > F.col("card")
    link = F.struct(F.col("inner_attrs").alias("attrs"), "link_text")
    per = met.groupBy("page_id", "card").agg(
        F.min_by(F.when(F.col("is_link"), link), F.when(F.col("is_link"), F.struct(~inside, "node"))).alias("link"),
        F.min_by(F.col("inner_attrs")["data-sku"], F.when(inside & F.col("inner_attrs")["data-sku"].isNotNull(), F.col("node"))).alias("inner_sku"),
    )
    full = boxes.join(per, ["page_id", "card"]).filter("link IS NOT NULL").withColumn("link_attrs", F.col("link.attrs"))
    values = [(n.removeprefix("data-").replace("-", "_"), F.coalesce(_attr("link_attrs", n), _attr("card_attrs", n))) for n in ATTRIBUTES]
    values[0] = ("sku", F.coalesce(values[0][1], F.col("inner_sku")))
    data = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n, _ in values]), F.array(*[v for _, v in values])), lambda _, v: v.isNotNull())
    text = F.coalesce(*[_attr("link_attrs", n) for n in ("data-productname", "title", "aria-label")], F.nullif(F.substring("card_text", 1, 120), F.lit("")), F.substring("link.link_text", 1, 120))
    said = full.select("page_id", F.explode("selectors").alias("selector"), F.col("card").alias("pos"), U.absolutise(F.col("link_attrs")["href"], F.col("url")).alias("href"), text.alias("text"), data.alias("data"))
    # Selectors count all their cards, also those without a link.
    many = boxes.select("page_id", F.explode("selectors").alias("selector")).groupBy("page_id", "selector").count().filter(F.col("count") >= LEAST_CARDS).drop("count")
    return said.join(many, ["page_id", "selector"])


def listed_products(pages: DataFrame) -> DataFrame:
    """``(page_id, pos, href, text)``: the entries of JSON-LD lists, other blocks' only where the address looks like a product's."""
    scripts = pick(pages, ['script[type="application/ld+json"]']).withColumn("v", F.try_parse_json(text_content(F.col("pieces"))))
    each = scripts.filter(J.is_object(F.col("v"))).select("page_id", "url", "node", J.text(F.col("v"), '$["@type"]').alias("type"), F.posexplode(J.elements(F.col("v"), "$.itemListElement")).alias("at", "item"))
    raw = J.text(F.col("item"), "$.url")
    href = F.when(raw.startswith("/"), U.absolutise(raw, F.col("url"))).otherwise(raw)
    links = each.select("page_id", "type", (F.col("node").cast("long") * 1_000_000 + F.col("at")).alias("pos"), href.alias("href"), F.substring(F.coalesce(J.text(F.col("item"), "$.name"), F.lit("")), 1, 100).alias("text"))
    return links.filter((F.col("href") != "") & (F.coalesce(F.col("type") == "ItemList", F.lit(False)) | U.is_product_url(F.col("href")))).drop("type")


def product_links(pages: DataFrame) -> DataFrame:
    """``(page_id, place, href, text, data)``: products of listing pages by lists, then cards, then addresses, then patterns.

    A stage is entered only while a page has fewer than three links; cards go on to the next selector until there are
    three, addresses until there are thirty.
    """
    anchors = pick(pages, ["a[href]"]).select("page_id", "url", F.col("node").alias("pos"), F.col("attrs")["href"].alias("raw"), F.substring(joined_text(F.col("pieces")), 1, 100).alias("text"))
    anchors = anchors.withColumn("href", U.absolutise(F.col("raw"), F.col("url")))
    none = F.lit(None).cast("map<string,string>").alias("data")
    which = F.array_compact(F.array(*[F.when(F.contains(F.col("raw"), F.lit(a)), i) for i, a in enumerate(ADDRESSES)]))
    addressed = anchors.filter(U.is_product_url(F.col("href"))).select("page_id", F.explode(which).alias("i"), "pos", "href", "text")
    patterned = anchors.filter((F.col("raw") != "") & F.col("raw").rlike("|".join(ADDRESS_PATTERNS)))
    first_address, last = len(CARDS) + 1, len(CARDS) + len(ADDRESSES) + 1

    def staged(rows: DataFrame, stage: int, strategy: Column, enough: int, data: Column) -> DataFrame:
        return rows.select("page_id", F.lit(stage).alias("stage"), strategy.cast("int").alias("strategy"), F.lit(enough).alias("enough"), F.col("pos").cast("long").alias("pos"), "href", "text", data)

    # A selector's cards are looked at up to a fixed number, as the reported list is.
    held = first_of_each(cards(pages), ["page_id", "selector"], "pos", ["pos"]).filter(F.col("place") <= MOST_CARDS)
    found = staged(listed_products(pages), 0, F.lit(0), 3, none)
    found = found.unionByName(staged(held, 1, F.col("selector") + 1, 3, F.col("data")))
    found = found.unionByName(staged(addressed, 2, F.col("i") + first_address, ENOUGH_ADDRESSES, none))
    found = found.unionByName(staged(patterned, 3, F.lit(last), ENOUGH_ADDRESSES, none))
    return strategy_cascade(found.filter("href <> ''")).select("page_id", F.col("place").cast("long").alias("place"), "href", "text", "data")


def grid_links(pages: DataFrame, levels: int = 4) -> DataFrame:
    """``(page_id, parent, href, text, pos)``: product-like links of a page's largest group under one class, if it has three.

    A link's group is the first class of the nearest element above it that has one, up to ``levels`` above; links without are one group.
    """
    rows = kept(pick(pages, ["a[href]", "[class]"]), "elements")
    links = rows.filter(has(0)).select("page_id", "url", "node", "depth", F.col("attrs")["href"].alias("raw"), joined_text(F.col("pieces")).alias("text"))
    links = links.withColumn("href", U.absolutise(F.col("raw"), F.col("url"))).filter((F.col("href") != "") & ~F.col("raw").rlike("^(?:#|javascript:)") & U.is_product_url(F.col("href")))
    classed = rows.filter(has(1)).select("page_id", F.col("node").alias("up"), F.col("leave").alias("up_leave"), F.col("depth").alias("up_depth"), F.get(F.split(F.trim(F.col("attrs")["class"]), r"\s+"), F.lit(0)).alias("cls")).filter("cls <> ''")
    above = links.select("page_id", "node", "depth").join(classed, "page_id").filter(f"node > up AND node <= up_leave AND depth - up_depth <= {levels}")
    nearest = above.groupBy("page_id", "node").agg(F.max_by("cls", "up").alias("parent"))
    grouped = links.join(nearest, ["page_id", "node"], "left").select("page_id", F.coalesce("parent", F.lit("no-class")).alias("parent"), "href", "text", F.col("node").alias("pos"))
    return largest_grid(grouped)


# What marks a product as on sale.
ON_SALE = ".main-details .price .sale, .main-details .price.on-sale, .main-details .dont-pay"


def on_sale(pages: DataFrame) -> DataFrame:
    """``(page_id, on_sale)`` of every page."""
    marked = pick(pages, [ON_SALE], ["page_id"]).select("page_id").distinct().withColumn("on_sale", F.lit(True))
    return pages.select("page_id").join(marked, "page_id", "left").select("page_id", F.coalesce("on_sale", F.lit(False)).alias("on_sale"))


def merged_explorations(browser: DataFrame, probe: DataFrame, browser_real: DataFrame, probe_real: DataFrame) -> DataFrame:
    """``browser`` and ``probe`` (site, kind, href) to one exploration a site: categories of the browser's, products of the browser's if they are real, else the probe's if those are.

    ``*_real`` (site, has_real_links) say whose products are real; where neither's are, the browser's stay.
    """
    real = browser_real.withColumnRenamed("has_real_links", "b").join(probe_real.withColumnRenamed("has_real_links", "p"), "site", "full")
    use_probe = real.filter(~F.coalesce("b", F.lit(False)) & F.coalesce("p", F.lit(False))).select("site")
    own = browser.join(use_probe.withColumn("_swap", F.lit(True)), "site", "left").filter((F.col("kind") == "category") | F.col("_swap").isNull()).drop("_swap")
    return own.unionByName(probe.filter("kind = 'product'").join(use_probe, "site", "left_semi"))
