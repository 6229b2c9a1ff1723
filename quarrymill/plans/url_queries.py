"""Queries over URLs. The test pages have few kinds of URLs, so variants are made of them by the same SQL in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import urls as U
from quarrymill.functions.html import title
from quarrymill.operators import links as L
from quarrymill.operators.links import category_choice, first_of_each, url_pattern_mode

from .catalog import query, table

#: Plain SQL for both engines: one of nine kinds of URL for each page.
VARIANT = """CASE page_id % 9
 WHEN 0 THEN url
 WHEN 1 THEN 'https://www.Shop' || page_id || '.co.uk/en-us//products///item-' || page_id || '.html?x=1#top'
 WHEN 2 THEN 'https://www.my_site' || page_id || '.com:8080/en-us/a/b' || (page_id + 100000)
 WHEN 3 THEN 'http://store.example.com/fr_CA/product/blue-shirt-' || (page_id * 37 + 1000) || '/'
 WHEN 4 THEN 'https://example' || page_id || '.com.au/men/sale/'
 WHEN 5 THEN 'https://shop.example.jp/search?q=abc&page=' || page_id
 WHEN 6 THEN 'https:' || chr(92) || '/' || chr(92) || '/www.brand' || page_id || '.com' || chr(92) || '/'
 WHEN 7 THEN 'https://brand.example.org/collections/new-in/p/' || page_id || '?Search=red+shoes'
 ELSE 'https://example.com/en-uk/' || page_id || '//x' END"""
HOST = "lower(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1))"
PATH = "regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
SRC = f"(SELECT page_id, {VARIANT} AS u FROM pages)"


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("page_id", f"{VARIANT} AS u")


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


@query(f"""
SELECT page_id, u AS url, CASE WHEN label = 'uk' THEN 'gb' WHEN label IN ({_list(U.COUNTRIES)}) THEN label
  WHEN seg = 'uk' THEN 'gb' WHEN seg IN ({_list(U.COUNTRIES)}) THEN seg END AS country
FROM (SELECT page_id, u, regexp_extract({HOST}, '\\.([^.]+)\\.*$', 1) AS label, lower(regexp_extract({PATH}, '^/+[a-zA-Z]{{2}}[-_]([a-zA-Z]{{2}})(?:/|$)', 1)) AS seg FROM {SRC})
""")
def url_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir).select("page_id", F.col("u").alias("url"), U.country(F.col("u")).alias("country"))


@query(f"""
SELECT page_id, trim(regexp_replace(split_part(replace(lower(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), 'www.', ''), ':', 1), '[^a-z0-9]', '-', 'g'), '-') AS slug FROM {SRC}
""")
def url_slug_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir).select("page_id", U.job_slug(F.col("u")).alias("slug"))


@query(f"""
SELECT page_id, trim(regexp_replace(regexp_replace({HOST}, '^www\\.', ''), '[^a-z0-9]+', '-', 'g'), '-') AS slug
FROM (SELECT page_id, trim(replace(u, chr(92), '')) AS u FROM {SRC})
""")
def url_slug_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir).select("page_id", U.command_slug(F.col("u")).alias("slug"))


@query(f"""
SELECT page_id, {HOST} || regexp_replace(regexp_replace({PATH}, '/+$', ''), '\\.html$', '') AS canonical,
  CASE WHEN regexp_matches(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN
    regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || regexp_replace({PATH}, '/{{2,}}', '/', 'g') || regexp_extract(u, '^[^?#]*(.*)$', 1) ELSE u END AS collapsed,
  split_part(u, '?', 1) AS bare, regexp_replace({PATH}, '[0-9]+', '{{id}}', 'g') AS template
FROM {SRC}
""")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("u")
    return variants(spark, sf_dir).select("page_id", U.canonical(u).alias("canonical"), U.collapse_slashes(u).alias("collapsed"), U.without_query(u).alias("bare"), U.path_template(u).alias("template"))


_SEGMENTS = "list_filter(list_transform(string_split(trim(p, '/'), '/'), lambda s: trim(s, '-')), lambda s: s <> '')"


@query(f"""
SELECT page_id, p NOT IN ('', '/', '/search')
  AND NOT (len({_SEGMENTS}) > 0 AND len(list_filter({_SEGMENTS}, lambda s: regexp_matches(s, '^(?:{"|".join(U.SHOP_SECTIONS)})'))) = len({_SEGMENTS}))
  AND (regexp_matches(p, '{"|".join(f"(?:{x})" for x in U.PRODUCT_PATHS)}') OR (length(p) > 20 AND regexp_matches(p, '[0-9]'))) AS is_product,
  len(string_split(trim(p, '/'), '/')) = 1 AND p NOT IN ('', '/') AS single_segment
FROM (SELECT page_id, lower({PATH}) AS p FROM {SRC})
""")
def url_product_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir).select("page_id", U.is_product_url(F.col("u")).alias("is_product"), U.is_single_segment(F.col("u")).alias("single_segment"))


@query(f"""
SELECT page_id, coalesce(list_filter(parts, lambda s: regexp_matches(s, '^[0-9]+$'))[1], regexp_extract(list_filter(parts, lambda s: regexp_matches(s, '[0-9]+$'))[1], '([0-9]+)$', 1), '') AS sku,
  CASE WHEN key = '' THEN '' ELSE split_part(u, '?', 1) || '?' || key || '={{criteria}}' END AS search_template
FROM (SELECT page_id, u, list_reverse(string_split(trim({PATH}, '/'), '/')) AS parts,
  regexp_extract('&' || regexp_extract(u, '^[^?#]*\\?([^#]*)', 1), '(?i)&(search|q|searchterm|keyword|query)=', 1) AS key FROM {SRC})
""")
def url_sku_and_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir).select("page_id", U.sku(F.col("u")).alias("sku"), U.search_template(F.col("u")).alias("search_template"))


_TERMS = "CASE page_id % 3 WHEN 0 THEN 'red shoes, blue*hat' WHEN 1 THEN 'a~b' ELSE ' x-ray ,, y ' END"
_Q = "replace(replace(replace(url_encode(t), '+', '%20'), '%7E', '~'), '*', '%2A')"


@query(f"""
WITH s AS (SELECT page_id, {VARIANT} AS u, {_TERMS} AS terms FROM pages),
t AS (SELECT page_id, regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS o, regexp_replace({PATH}, '/+$', '') AS p, trim(unnest(string_split(terms, ','))) AS t, generate_subscripts(string_split(terms, ','), 1) AS tp FROM s),
q AS (SELECT *, {_Q} AS q, trim(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM t WHERE t <> ''),
c AS (SELECT page_id, tp, [o || p || '/search?q=' || q, o || p || '/search?search=' || q, o || p || '/search?searchterm=' || q, o || p || '/search?searchTerm=' || q,
  o || '/search?q=' || q, o || '/search?search=' || q, o || '/search?searchterm=' || q, o || '/search?searchTerm=' || q,
  o || p || '/search.aspx?search=' || q, o || p || '/search.asp?search=' || q, o || p || '/search/?q=' || q, o || p || '/search/' || q, o || p || '/search/' || slug, o || '/search/' || q] AS cs FROM q),
e AS (SELECT page_id, tp, unnest(cs) AS url, generate_subscripts(cs, 1) AS cp FROM c),
d AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY tp, cp) AS rn FROM e)
SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY tp, cp) AS place FROM d WHERE rn = 1
""")
def url_search_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = table(spark, sf_dir, "pages").selectExpr("page_id", f"{VARIANT} AS u", f"{_TERMS} AS terms")
    terms = src.select("page_id", "u", F.posexplode(F.split("terms", ",")).alias("tp", "t")).withColumn("t", F.trim("t")).filter("t <> ''")
    each = terms.select("page_id", "tp", F.posexplode(U.search_candidates(F.col("t"), F.col("u"))).alias("cp", "url"))
    return first_of_each(each, ["page_id"], "url", ["tp", "cp"]).select("page_id", "url", F.col("place").cast("long").alias("place"))


_LANG = "CASE page_id % 4 WHEN 0 THEN 'EN-US' WHEN 1 THEN 'en' WHEN 2 THEN 'fr' ELSE '' END"


@query(f"""
SELECT page_id, CASE WHEN expected = '' OR lang = '' OR lang = expected OR starts_with(lang, expected || '-') OR lang = split_part(expected, '-', 1) THEN ''
  ELSE 'expected ' || expected || ' but page is ' || lang END AS note
FROM (SELECT page_id, CASE WHEN contains(b, '-') THEN split_part(b, '/', 1) ELSE '' END AS expected, lower(l) AS lang
  FROM (SELECT page_id, trim({PATH}, '/') AS b, {_LANG} AS l FROM {SRC}))
""")
def page_locale_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = table(spark, sf_dir, "pages").selectExpr("page_id", f"{VARIANT} AS u", f"{_LANG} AS l")
    return src.select("page_id", U.locale_note(F.col("u"), F.col("l")).alias("note"))


_REF = """CASE page_id % 12 WHEN 0 THEN '' WHEN 1 THEN 'https://a.example.com/x/../y' WHEN 2 THEN '//cdn.example.com/y.js' WHEN 3 THEN '/rooted/./z/../w?x=../v' WHEN 4 THEN 'beside?k=v' WHEN 5 THEN '../up/./z/'
  WHEN 6 THEN '?q=1' WHEN 7 THEN '#part' WHEN 8 THEN '../../../../top' WHEN 9 THEN 'httpdocs/x/..' WHEN 10 THEN 'mailto:a@b.example' ELSE '.' END"""


@query(f"""
SELECT page_id, CASE page_id % 12 WHEN 0 THEN '' WHEN 1 THEN r WHEN 2 THEN 'https:' || r WHEN 3 THEN o || '/rooted/w?x=../v' WHEN 4 THEN o || folder || r WHEN 5 THEN o || regexp_replace(folder, '[^/]+/$', '') || 'up/z/'
  WHEN 6 THEN o || p || r WHEN 7 THEN regexp_replace(url, '#.*$', '') || r WHEN 8 THEN o || '/top' WHEN 9 THEN o || folder || 'httpdocs/' WHEN 10 THEN r ELSE o || folder END AS absolute
FROM (SELECT *, CASE WHEN p = '' THEN '/' ELSE regexp_replace(p, '[^/]*$', '') END AS folder FROM (
  SELECT page_id, url, {_REF} AS r, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS o, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p FROM pages))
""")
def url_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("page_id", "url", f"{_REF} AS r").select("page_id", U.absolutise(F.col("r"), F.col("url")).alias("absolute"))


@query(f"""
SELECT a.page_id AS page_id, count(*) AS same_pages FROM (SELECT page_id, {HOST} || regexp_replace(regexp_replace({PATH}, '/+$', ''), '\\.html$', '') AS k FROM {SRC}) a
JOIN (SELECT {HOST.replace("(u,", "(url,")} || regexp_replace(regexp_replace({PATH.replace("(u,", "(url,")}, '/+$', ''), '\\.html$', '') AS k FROM pages) b USING (k) GROUP BY a.page_id
""")
def url_equivalence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = variants(spark, sf_dir).select("page_id", U.canonical(F.col("u")).alias("k"))
    b = table(spark, sf_dir, "pages").select(U.canonical(F.col("url")).alias("k"))
    return a.join(b, "k").groupBy("page_id").agg(F.count("*").alias("same_pages"))


LINK_SQL = """
nav AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<nav[^>]*>(.*?)</nav>', 1)) AS n FROM pages),
anchors AS (SELECT page_id, url, unnest(regexp_extract_all(n, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']?([^"''\\s>]*)[^>]*>.*?</a>', 1)) AS href0, unnest(regexp_extract_all(n, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']?[^"''\\s>]*[^>]*>(.*?)</a>', 1)) AS text0,
  generate_subscripts(regexp_extract_all(n, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']?([^"''\\s>]*)[^>]*>.*?</a>', 1), 1) AS pos FROM nav),
links AS (SELECT page_id, pos, trim(regexp_replace(regexp_replace(text0, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS text,
  CASE WHEN href0 = '' THEN '' WHEN starts_with(href0, 'http') THEN href0 WHEN starts_with(href0, '//') THEN 'https:' || href0
    ELSE regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href0 END AS href FROM anchors),
good AS (SELECT * FROM links WHERE href <> '' AND length(text) > 1 AND length(text) < 80),
firsts AS (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY pos) AS rn FROM good),
placed AS (SELECT page_id, href, text, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS place FROM firsts WHERE rn = 1)
"""


def nav_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrymill.operators.links import navigation_links

    return navigation_links(table(spark, sf_dir, "pages"))


@query(f"WITH {LINK_SQL} SELECT page_id, href, text, place FROM placed WHERE place <= 50")
def page_links_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nav_links(spark, sf_dir)


@query(f"WITH {LINK_SQL}, f AS (SELECT href, page_id, place, row_number() OVER (PARTITION BY href ORDER BY page_id, place) AS rn FROM placed WHERE place <= 50) SELECT href, page_id, place FROM f WHERE rn = 1")
def page_links_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Across pages: each link where it is seen first."""
    return first_of_each(nav_links(spark, sf_dir), [], "href", ["page_id", "place"], numbered=False).select("href", "page_id", "place")


@query(f"""
WITH {LINK_SQL}, seen AS (SELECT href, min(page_id) AS first_page FROM placed WHERE place <= 50 GROUP BY href)
SELECT first_page AS page_id, count(*) AS new_links FROM seen GROUP BY first_page
""")
def link_new_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read in page order, how many links each page adds to those before."""
    return nav_links(spark, sf_dir).groupBy("href").agg(F.min("page_id").alias("page_id")).groupBy("page_id").agg(F.count("*").alias("new_links"))


_LAST = "regexp_extract(regexp_replace(p, '/+$', ''), '([^/]*)$', 1)"
_SUFFIX = "CASE page_id % 5 WHEN 0 THEN '/a/item-' || page_id || '-c.aspx' WHEN 1 THEN '/b/' || page_id || '.html' WHEN 2 THEN '/b/x' || page_id || '.htm' WHEN 3 THEN '/c/list-ch' || page_id || '.aspx' ELSE '/d/' || page_id END"


@query(f"""
WITH l AS (SELECT page_id % 7 AS site, page_id AS pos, {_SUFFIX} AS p FROM pages),
pats(ord, pattern) AS (VALUES (0, '-c\\.aspx$'), (1, '-ch\\d+\\.aspx$'), (2, '-c\\.html$'), (3, '\\.aspx$'), (4, '\\.html$'), (5, '\\.htm$')),
hits AS (SELECT site, ord, pattern, count(*) AS n, min(pos) AS first_at FROM l JOIN pats ON regexp_matches({_LAST}, '(?i)' || pattern) GROUP BY ALL),
best AS (SELECT site, arg_min(pattern, (-n, first_at, ord)) AS pattern FROM hits GROUP BY site),
n AS (SELECT site, count(DISTINCT p) AS paths FROM l GROUP BY site)
SELECT site, coalesce(pattern, '') AS pattern, paths FROM n LEFT JOIN best USING (site)
""")
def link_url_pattern_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").selectExpr("page_id % 7 AS site", "page_id AS pos", f"{_SUFFIX} AS path")
    return url_pattern_mode(links, "site")


@query(f"""
WITH {LINK_SQL}, g AS (SELECT page_id, href, text, place, regexp_extract(href, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p FROM placed
  WHERE place <= 50 AND NOT regexp_matches(lower(href), '{"|".join(w.replace(".", chr(92) + ".") for w in U.OFF_CATEGORY)}') AND NOT regexp_matches(lower(text), '{"|".join(w.replace(".", chr(92) + ".") for w in U.OFF_CATEGORY)}'))
SELECT page_id, arg_min(href, (CASE WHEN contains(lower(text), 'the') OR contains(lower(href), 'the') THEN 0 WHEN regexp_matches(p, '(?i)(-ch-|/c(?:ategory)?/|/collections/|/shop/|/browse/|-ch[0-9]+)') THEN 1
  WHEN p NOT IN ('', '/') AND len(string_split(trim(p, '/'), '/')) = 1 THEN 2 ELSE 3 END, place)) AS href FROM g GROUP BY page_id
""")
def link_category_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_choice(nav_links(spark, sf_dir), F.lit("the"))


@query(f"""
WITH {LINK_SQL}, host AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS h FROM pages)
SELECT h AS host, count(*) AS links, count(*) FILTER (WHERE NOT regexp_matches(lower(href), '{"|".join(w.replace(".", chr(92) + ".") for w in U.OFF_PRODUCT)}') AND NOT regexp_matches(lower(text), '{"|".join(w.replace(".", chr(92) + ".") for w in U.OFF_PRODUCT)}')
  AND NOT regexp_matches(lower(href), '{"|".join(U.PROMOTIONS)}')) AS real_links FROM placed JOIN host USING (page_id) WHERE place <= 50 GROUP BY h
""")
def link_real_per_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("host"))
    links = nav_links(spark, sf_dir).join(hosts, "page_id")
    return links.groupBy("host").agg(F.count("*").alias("links"), F.count_if(U.is_real_product_link(F.col("href"), F.col("text"))).alias("real_links"))


_LABEL = "CASE page_id % 3 WHEN 0 THEN 'New & Used ' || page_id WHEN 1 THEN '!!' ELSE repeat('Long label ', 6) || page_id END"


@query(f"""
WITH s AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS o, {_LABEL} AS label FROM pages),
g AS (SELECT page_id, o, label, trim(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM s WHERE length(label) <= 50)
SELECT page_id, label, o || unnest(['/' || slug, '/category/' || slug, '/collections/' || slug]) AS href FROM g WHERE slug <> ''
""")
def link_category_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = table(spark, sf_dir, "pages").selectExpr("page_id", "url", f"{_LABEL} AS label")
    slug = U.slugify(F.col("label"))
    origin = F.regexp_extract("url", f"({U.SCHEME}[^/?#]*)", 1)
    good = src.filter((F.length("label") <= 50) & (slug != ""))
    return good.select("page_id", "label", F.explode(F.transform(F.array(F.lit("/"), F.lit("/category/"), F.lit("/collections/")), lambda p: F.concat(origin, p, slug))).alias("href"))


_PAGED = """CASE page_id % 8 WHEN 0 THEN '<div id="load-more-component"><a href="/p2">More</a></div>' WHEN 1 THEN '<a class="x" rel="next" href="/p2">2</a>' WHEN 2 THEN '<ul class="pagination"><li class="next"><a href="/p2">&gt;</a></li></ul>'
 WHEN 3 THEN '<div class="pager"><a href="/p2">2</a></div>' WHEN 4 THEN '<button class="btn Load-More">More</button>' WHEN 5 THEN '<p>next</p>' WHEN 6 THEN '<div class="show-more">x</div>' ELSE html END"""


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(f"""
SELECT page_id, CASE WHEN regexp_matches(regexp_extract(h, '{_quoted(L.LOAD_MORE_PART)}', 1), '{L.LINK_START}') THEN 'load_more'
  WHEN regexp_matches(h, '{_quoted(L.NEXT_LINK)}') OR regexp_matches(regexp_extract(h, '{_quoted(L.PAGER)}', 1), '{_quoted(L.NEXT_IN_PAGER)}') THEN 'next_button'
  WHEN regexp_matches(regexp_extract(h, '{_quoted(L.PAGER)}', 1), '{L.LINK_START}') THEN 'page_numbers' WHEN regexp_matches(h, '{_quoted(L.LOAD_MORE_BUTTON)}') THEN 'load_more' ELSE 'none' END AS pagination
FROM (SELECT page_id, {_PAGED} AS h FROM pages)
""")
def link_pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("page_id", f"{_PAGED} AS h").select("page_id", L.pagination_kind(F.col("h")).alias("pagination"))


@query(f"""
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{_quoted(L.ANCHOR)}', 1)[1:300]) AS raw, unnest(regexp_extract_all(html, '{_quoted(L.ANCHOR)}', 2)[1:300]) AS text0, unnest(range(least(300, len(regexp_extract_all(html, '{_quoted(L.ANCHOR)}'))))) AS pos FROM pages),
l AS (SELECT page_id, pos, url, raw, trim(regexp_replace(regexp_replace(text0, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS text,
  CASE WHEN raw = '' THEN '' WHEN starts_with(raw, 'http') THEN raw WHEN starts_with(raw, '//') THEN 'https:' || raw WHEN starts_with(raw, '/') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || raw
    ELSE regexp_replace(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*)', 1), '[^/]*$', '') || raw END AS href FROM a),
g AS (SELECT * FROM l WHERE NOT regexp_matches(raw, '^(#|javascript:|mailto:|tel:)') AND length(text) BETWEEN 2 AND 60
  AND lower(regexp_extract(href, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) = lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1))
  AND NOT regexp_matches(lower(href), '{"|".join(w.replace(".", chr(92) + ".") for w in U.OFF_CATEGORY)}') AND NOT regexp_matches(lower(text), '{"|".join(w.replace(".", chr(92) + ".") for w in U.OFF_CATEGORY)}')),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY pos) AS rn FROM g),
p AS (SELECT page_id, href, text, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS place FROM f WHERE rn = 1)
SELECT * FROM p WHERE place <= 50
""")
def page_links_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.all_links(table(spark, sf_dir, "pages"))


@query("SELECT page_id, length(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^\\s+|\\s+$', '', 'g')) AS n FROM pages")
def page_title_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.length(title(F.col("html"), 1 << 30)).cast("long").alias("n"))
