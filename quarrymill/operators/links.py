"""Link discovery: anchors of navigation, first occurrences, pattern modes, category choice, paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import urls as U
from quarrymill.functions.html import squeeze

ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]*)[^>]*>(.*?)</a>"""
#: What tells paging, for both engines' regular expressions.
PAGER = r"""(?is)class\s*=\s*["'][^"']*\b(?:pagination|page-numbers|pager)\b[^"']*["'][^>]*>(.*?)</(?:ul|ol|nav|div)>"""
LOAD_MORE_PART = r"""(?is)id\s*=\s*["']load-more[^"']*["'][^>]*>(.*?)</(?:div|section|p)>"""
LINK_START = r"(?i)<a\s[^>]*href"
NEXT_LINK = r"""(?i)<a\s[^>]*(?:rel\s*=\s*["']?next\b|class\s*=\s*["'][^"']*\bnext-page\b)"""
NEXT_IN_PAGER = r"""(?i)class\s*=\s*["'](?:[^"']*\s)?next[\s"']"""
LOAD_MORE_BUTTON = r"""(?i)<(?:button|a)\s[^>]*class\s*=\s*["'][^"']*load-more|class\s*=\s*["'](?:[^"']*\s)?show-more[\s"']"""
#: Path endings that tell a site's kind of pages, in the order in which ties are settled.
ENDINGS = (r"-c\.aspx$", r"-ch\d+\.aspx$", r"-c\.html$", r"\.aspx$", r"\.html$", r"\.htm$")
CATEGORY_PATH = r"(?i)(-ch-|/c(?:ategory)?/|/collections/|/shop/|/browse/|-ch[0-9]+)"


def first_of_each(df: DataFrame, group: Sequence[str], key: str, order: Sequence[str], numbered: bool = True) -> DataFrame:
    """The first row of each key within ``group``, by ``order``; ``place`` numbers what is left within the group."""
    # A grouped minimum merges before the shuffle, where a window would sort every row of a frequent key.
    first = df.groupBy(*group, key).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("first"))
    once = first.select("first.*")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))) if numbered else once


def navigation_links(pages: DataFrame, limit: int = 50) -> DataFrame:
    """``(page_id, href, text, place)``: links of navigation elements, first occurrences, at most ``limit`` a page."""
    nav = F.regexp_extract_all("html", F.lit("(?is)<nav[^>]*>(.*?)</nav>"), F.lit(1))
    each = pages.select("page_id", "url", F.explode(nav).alias("nav"))
    hrefs, texts = (F.regexp_extract_all("nav", F.lit(ANCHOR), F.lit(i)) for i in (1, 2))
    anchors = each.select("page_id", "url", F.posexplode(F.arrays_zip(hrefs.alias("href"), texts.alias("text"))).alias("pos", "a"))
    links = anchors.select("page_id", "pos", U.absolutise(F.col("a.href"), F.col("url")).alias("href"), squeeze(F.regexp_replace("a.text", "<[^>]+>", "")).alias("text"))
    good = links.filter((F.col("href") != "") & (F.length("text") > 1) & (F.length("text") < 80) & ~F.col("href").rlike("^(?:#|javascript:|mailto:|tel:)"))
    return first_of_each(good, ["page_id"], "href", ["pos"]).filter(F.col("place") <= limit).select("page_id", "href", "text", F.col("place").cast("long").alias("place"))


def all_links(pages: DataFrame, scanned: int = 300, limit: int = 50) -> DataFrame:
    """Same-host anchors of whole pages that may be categories: the fallback for pages without navigation.

    The first ``scanned`` anchors of a page are looked at and the first ``limit`` links kept, as the reported list is.
    """
    hrefs, texts = (F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(i)) for i in (1, 2))
    anchors = pages.select("page_id", "url", F.posexplode(F.slice(F.arrays_zip(hrefs.alias("href"), texts.alias("text")), 1, scanned)).alias("pos", "a"))
    said = anchors.filter(~F.col("a.href").rlike("^(?:#|javascript:|mailto:|tel:)"))
    links = said.select("page_id", "url", "pos", U.absolutise(F.col("a.href"), F.col("url")).alias("href"), squeeze(F.regexp_replace("a.text", "<[^>]+>", "")).alias("text"))
    worded = links.filter(F.length("text").between(2, 60))
    same = worded.filter((U.host(F.col("href")) == U.host(F.col("url"))) & ~U.is_off_category(F.col("href"), F.col("text")))
    return first_of_each(same, ["page_id"], "href", ["pos"]).filter(F.col("place") <= limit).select("page_id", "href", "text", F.col("place").cast("long").alias("place"))


def links_with_fallback(pages: DataFrame) -> DataFrame:
    """Navigation links, and for pages without any their same-host links."""
    nav = navigation_links(pages)
    rest = pages.join(nav.select("page_id").distinct(), "page_id", "left_anti")
    return nav.unionByName(all_links(rest))


def merge_new(links: DataFrame, more: DataFrame) -> DataFrame:
    """``links`` and those of ``more`` whose page and href are not there yet."""
    return links.unionByName(more.join(links.select("page_id", "href"), ["page_id", "href"], "left_anti"))


def url_pattern_mode(links: DataFrame, site: str) -> DataFrame:
    """Per site the ending that most paths have (first seen on ties) and the number of distinct paths."""
    last = F.regexp_extract(F.regexp_replace("path", "/+$", ""), "([^/]*)$", 1)
    hits = F.array_compact(F.array(*[F.when(last.rlike("(?i)" + p), F.struct(F.lit(i).alias("ord"), F.lit(p).alias("pattern"))) for i, p in enumerate(ENDINGS)]))
    counted = links.select(site, "pos", F.inline(hits)).groupBy(site, "ord", "pattern").agg(F.count("*").alias("n"), F.min("pos").alias("at"))
    best = counted.groupBy(site).agg(F.min_by("pattern", F.struct(-F.col("n"), "at", "ord")).alias("pattern"))
    paths = links.groupBy(site).agg(F.count_distinct("path").alias("paths"))
    return paths.join(best, site, "left").select(site, F.coalesce("pattern", F.lit("")).alias("pattern"), "paths")


def category_choice(links: DataFrame, criteria: Column) -> DataFrame:
    """Per page the link to follow: one that holds a word of the criteria, a category path, one segment, the first."""
    words = F.filter(F.split(F.lower(criteria), " "), lambda w: w != "")
    holds = F.exists(words, lambda w: F.contains(F.lower(F.col("text")), w) | F.contains(F.lower(F.col("href")), w))
    rank = F.when(holds, 0).when(U.path(F.col("href")).rlike(CATEGORY_PATH), 1).when(U.is_single_segment(F.col("href")), 2).otherwise(3)
    good = links.filter(~U.is_off_category(F.col("href"), F.col("text")))
    return good.groupBy("page_id").agg(F.min_by("href", F.struct(rank, "place")).alias("href"))


def has_real_links(links: DataFrame, categories: DataFrame, least: int = 3) -> DataFrame:
    """Per page whether enough product links are left without promotions and category links."""
    real = links.filter(U.is_real_product_link(F.col("href"), F.col("text"))).join(categories.select("page_id", "href"), ["page_id", "href"], "left_anti")
    return real.groupBy("page_id").agg((F.count("*") >= least).alias("has_real_links"))


def largest_grid(cards: DataFrame, least: int = 3) -> DataFrame:
    """``cards`` (page_id, parent, href, pos): the cards of each page's most frequent parent, if there are enough."""
    counted = cards.groupBy("page_id", "parent").agg(F.count("*").alias("n"), F.min("pos").alias("at")).filter(F.col("n") >= least)
    best = counted.groupBy("page_id").agg(F.min_by("parent", F.struct(-F.col("n"), "at")).alias("parent"))
    return cards.join(best, ["page_id", "parent"], "left_semi")


def strategy_cascade(found: DataFrame, least: int = 3, limit: int = 200) -> DataFrame:
    """``found`` (page_id, strategy, href, pos): links up to the first strategy with which a page has enough.

    Where there is a ``stage``, whose strategies are numbered one after the other, a stage is entered only while a page has
    fewer than ``least`` links, and its strategies go on until there are as many as their ``enough`` says.
    """
    if "stage" not in found.columns:
        found = found.withColumns({"stage": F.col("strategy"), "enough": F.lit(least)})
    unique = first_of_each(found, ["page_id"], "href", ["strategy", "pos"], numbered=False)
    per = unique.groupBy("page_id", "stage", "strategy", "enough").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("page_id").orderBy("strategy").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at_entry = F.min("_before").over(Window.partitionBy("page_id", "stage"))
    used = per.withColumn("_before", before).withColumn("_entry", at_entry).filter((F.col("_entry") < least) & (F.col("_before") < F.col("enough"))).select("page_id", "strategy")
    placed = unique.join(used, ["page_id", "strategy"]).withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("strategy", "pos")))
    return placed.filter(F.col("place") <= limit)


def pages_until_nothing_new(listing: DataFrame) -> DataFrame:
    """``listing`` (site, page_no, href) of a paged list: rows before the first page that adds no link, first seen only."""
    first = listing.groupBy("site", "href").agg(F.min("page_no").alias("page_no"))
    fresh = first.groupBy("site", "page_no").agg(F.count("*").alias("fresh"))
    shown = listing.select("site", "page_no").distinct().join(fresh, ["site", "page_no"], "left")
    stop = shown.filter("fresh IS NULL").groupBy("site").agg(F.min("page_no").alias("stop"))
    return first.join(stop, "site", "left").filter("stop IS NULL OR page_no < stop").drop("stop")


def accumulated(listing: DataFrame, totals: DataFrame, most_empty: int = 3) -> tuple[DataFrame, DataFrame]:
    """``listing`` (site, round, href, scrolled) and ``totals`` (site, total; null: unknown) to links and an account.

    Rounds add what was not seen before. A site stops after the first round that reaches its total, that brings nothing
    new without having been scrolled to, or that is the last of ``most_empty`` scrolled rounds in a row without news. Links are ``(site, href, round)``
    of the rounds up to there; the account has ``(site, rounds, links, stopped)`` with the rule that decided. A round
    without any link is a row with a null href.
    """
    first = listing.filter("href IS NOT NULL").groupBy("site", "href").agg(F.min("round").alias("round"))
    added = first.groupBy("site", "round").agg(F.count("*").alias("added"))
    rounds = listing.groupBy("site", "round").agg(F.max("scrolled").alias("scrolled")).join(added, ["site", "round"], "left").join(totals, "site", "left")
    order = Window.partitionBy("site").orderBy("round")
    news = F.coalesce("added", F.lit(0))
    # Rounds without news that follow each other are an island: as many rounds with news lie before them.
    marked = rounds.withColumn("so_far", F.sum(news).over(order)).withColumn("island", F.sum(F.when(news > 0, 1).otherwise(0)).over(order)).withColumn("added", news)
    streak = F.sum(F.when(F.col("added") == 0, 1).otherwise(0)).over(Window.partitionBy("site", "island").orderBy("round"))
    rule = (
        F.when(F.col("total") <= F.col("so_far"), "total")
        .when((F.col("added") == 0) & ~F.col("scrolled"), "nothing_new")
        .when((F.col("added") == 0) & (F.col("streak") >= most_empty), "empty_rounds")
    )
    told = marked.withColumn("streak", streak).withColumn("rule", rule)
    stops = told.filter("rule IS NOT NULL").groupBy("site").agg(F.min("round").alias("stop"), F.min_by("rule", "round").alias("stopped"))
    held = told.join(stops, "site", "left").filter("stop IS NULL OR round <= stop")
    account = held.groupBy("site").agg(F.count("*").alias("rounds"), F.sum("added").alias("links"), F.coalesce(F.any_value("stopped", True), F.lit("end")).alias("stopped"))
    return first.join(stops, "site", "left").filter("stop IS NULL OR round <= stop").select("site", "href", "round"), account


def pagination_kind(html: Column) -> Column:
    """How a list goes on: a next link, inside a load-more part or not, then page numbers, then a load-more button.

    Parts are told by class or id and end at the first closing tag of their kind, as no element tree is built.
    """
    pager = F.regexp_extract(html, PAGER, 1)
    more = F.regexp_extract(html, LOAD_MORE_PART, 1)
    return (
        F.when(more.rlike(LINK_START), "load_more")
        .when(html.rlike(NEXT_LINK) | pager.rlike(NEXT_IN_PAGER), "next_button")
        .when(pager.rlike(LINK_START), "page_numbers")
        .when(html.rlike(LOAD_MORE_BUTTON), "load_more")
        .otherwise("none")
    )


def discovery_method(fatal_locale: Column, searched: Column, criteria: Column, categories: Column, real_links: Column, pattern: Column) -> Column:
    """How a site's products are found: the first rule that holds."""
    many, real = categories >= 3, real_links > 0
    rules = (
        ("failed", fatal_locale & ~real),
        ("search", searched & (criteria != "") & real),
        ("category", many & real),
        ("url_pattern", pattern != ""),
        ("failed", ~(many | real | searched)),
        ("category", many),
    )
    return F.coalesce(*[F.when(holds, name) for name, holds in rules], F.lit("unknown"))


def inferred_paging(kind: Column, total: Column, found: Column) -> Column:
    """Paging of a list: what was seen, 'unknown' where a stated total is above what was found, else empty."""
    return F.coalesce(F.nullif(kind, F.lit("none")), F.when(F.coalesce(total, F.lit(0)) > found, "unknown"), F.lit(""))


def keyword_collections(queries: DataFrame, keywords: DataFrame) -> DataFrame:
    """``queries`` (query_id, query) by ``keywords`` (ord, keyword, collection): collections of contained keywords, each once, in order.

    The keyword table is configuration of a few rows; it is broadcast for the theta join.
    """
    hits = queries.join(F.broadcast(keywords), F.contains(F.lower("query"), F.col("keyword")))
    return first_of_each(hits, ["query_id"], "collection", ["ord"]).select("query_id", "collection", F.col("place").cast("long").alias("place"))
