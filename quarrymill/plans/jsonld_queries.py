"""Queries over JSON-LD and records. The test pages have none, so blocks are made from ``part`` by the same SQL in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import jsonld as J
from quarrymill.functions import normalize as N
from quarrymill.operators import records as R

from .catalog import query, table

_PRICE = "CAST(round(p_retailprice, 0) AS BIGINT)"
#: Plain SQL for both engines: a product block with four shapes of offers, types and brands.
PRODUCT = f"""concat('{{"@type": ', CASE p_partkey % 3 WHEN 0 THEN '"Product"' WHEN 1 THEN '["Thing", "Product"]' ELSE '"WebPage"' END,
 ', "name": "', p_name, '", "sku": "S', p_partkey, '", "brand": ', CASE p_partkey % 4 WHEN 0 THEN concat('{{"name": "', lower(p_brand), '"}}') WHEN 1 THEN concat('"', p_brand, '"') WHEN 2 THEN '"none"' ELSE concat('["', p_brand, '"]') END,
 ', "offers": ', CASE p_partkey % 5 WHEN 0 THEN concat('{{"price": "', {_PRICE}, '", "priceCurrency": "EUR", "availability": "https://schema.org/InStock"}}')
   WHEN 1 THEN concat('[{{"price": "', {_PRICE}, '", "highPrice": "', {_PRICE} + 10, '", "availability": "OutOfStock"}}]') WHEN 2 THEN '[]' WHEN 3 THEN '{{"price": ""}}' ELSE concat('{{"price": ', {_PRICE}, ', "highPrice": "5"}}') END, '}}')"""
PAGE = f"""concat('<html><script type="application/ld+json">', {PRODUCT}, '</script><script type="application/ld+json">{{bad</script><script type="application/ld+json">[{{"@type": "BreadcrumbList", "itemListElement": [{{"name": "Home"}}, {{"item": {{"name": "', p_brand, '"}}}}, {{"item": "', p_type, '"}}]}}, 7, {{"@type": "Product", "name": "second"}}]</script></html>')"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS page_id", f"{PAGE} AS html")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS page_id", f"{PRODUCT} AS j").select("page_id", F.try_parse_json("j").alias("block"))


_BLOCKS = f"""
src AS (SELECT p_partkey AS page_id, p_name, p_brand, p_type, {PRODUCT} AS j FROM part)
"""


@query("""
SELECT p_partkey AS page_id, pos AS script_pos, item AS item_pos, t AS types FROM (
  SELECT p_partkey, 0 AS pos, 0 AS item, CASE p_partkey % 3 WHEN 0 THEN 'Product' WHEN 1 THEN 'Thing,Product' ELSE 'WebPage' END AS t FROM part
  UNION ALL SELECT p_partkey, 2, 0, 'BreadcrumbList' FROM part UNION ALL SELECT p_partkey, 2, 2, 'Product' FROM part)
""")
def jsonld_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.blocks(pages(spark, sf_dir)).select("page_id", "script_pos", "item_pos", F.array_join(J.types(F.col("block")), ",").alias("types"))


@query("SELECT p_partkey AS page_id, CASE WHEN p_partkey % 3 = 2 THEN 'second' ELSE p_name END AS name FROM part")
def jsonld_product_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = J.first_of_type(J.blocks(pages(spark, sf_dir)), ["Product", "ProductGroup"])
    return first.select("page_id", J.either(F.col("block"), "$.name").alias("name"))


@query(f"""
WITH {_BLOCKS}
SELECT page_id, coalesce(CASE json_type(j, '$.offers') WHEN 'OBJECT' THEN coalesce(json_extract_string(j, '$.offers.price'), '') NOT IN ('', '0')
  WHEN 'ARRAY' THEN coalesce(json_extract_string(j, '$.offers[0].price'), '') NOT IN ('', '0') END, false) AS has_price FROM src
""")
def jsonld_has_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).select("page_id", J.has_price(F.col("block")).alias("has_price"))


@query("SELECT p_partkey AS page_id, p_brand || ' > ' || p_type AS breadcrumb FROM part")
def jsonld_breadcrumb(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = J.first_of_type(J.blocks(pages(spark, sf_dir)), ["BreadcrumbList"])
    return first.select("page_id", J.breadcrumb(F.col("block")).alias("breadcrumb"))


_LIST = """concat('{"@type": "ItemList", "itemListElement": [{"item": {"url": "/p/', p_partkey, '", "name": "', p_name, '", "offers": {"price": "', CAST(round(p_retailprice * 100, 0) AS BIGINT), '", "priceCurrency": "USD"}}}, {"url": "https://x.example.com/p/', p_partkey % 10, '", "name": "flat"}, {"item": {"url": "/p/', p_partkey, '"}}, {"name": "nowhere"}]}')"""


@query("""
SELECT p_partkey AS page_id, '/p/' || p_partkey AS href, p_name AS text, '$' || format('{:,.2f}', CAST(round(p_retailprice * 100, 0) AS BIGINT) / 100.0) AS price, 0 AS pos FROM part
UNION ALL SELECT p_partkey, 'https://x.example.com/p/' || (p_partkey % 10), 'flat', '', 1 FROM part
""")
def jsonld_itemlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing prices are in minor units; links count once, in order."""
    v = table(spark, sf_dir, "part").selectExpr("p_partkey AS page_id", f"{_LIST} AS j").select("page_id", F.try_parse_json("j").alias("v"))
    each = v.select("page_id", F.posexplode(J.elements(F.col("v"), "$.itemListElement")).alias("pos", "e"))
    item = F.when(F.coalesce(J.text(F.col("e"), "$.item.url"), F.lit("")) != "", F.try_variant_get("e", "$.item", "variant")).otherwise(F.col("e"))
    each = each.withColumn("p", item)
    price = F.format_number(J.text(F.col("p"), "$.offers.price").try_cast("double") / 100, 2)
    links = each.select("page_id", J.either(F.col("p"), "$.url").alias("href"), J.either(F.col("p"), "$.name").alias("text"), F.coalesce(F.concat(F.lit("$"), price), F.lit("")).alias("price"), "pos").filter("href <> ''")
    from quarrymill.operators.links import first_of_each

    return first_of_each(links, ["page_id"], "href", ["pos"], numbered=False)


@query(f"""
WITH {_BLOCKS}, o AS (SELECT *, CASE json_type(j, '$.offers') WHEN 'OBJECT' THEN json_extract(j, '$.offers') ELSE json_extract(j, '$.offers[0]') END AS o,
  coalesce(nullif(CASE WHEN json_type(j, '$.brand') = 'VARCHAR' THEN json_extract_string(j, '$.brand') END, ''), json_extract_string(j, '$.brand.name'), json_extract_string(j, '$.brand[0]'), '') AS b FROM src),
q AS (SELECT *, coalesce(json_extract_string(o, '$.price'), '') AS price, json_extract_string(o, '$.highPrice') AS high FROM o)
SELECT page_id, p_name AS title, price, CASE WHEN try_cast(high AS DOUBLE) > coalesce(try_cast(price AS DOUBLE), 0) THEN high ELSE '' END AS original_price,
  coalesce(json_extract_string(o, '$.priceCurrency'), 'USD') AS currency, CASE WHEN contains(coalesce(json_extract_string(o, '$.availability'), ''), 'InStock') THEN 'In Stock' ELSE 'Out of Stock' END AS availability,
  CASE WHEN lower(b) IN ('', 'none', 'null') THEN '' ELSE upper(b[1]) || lower(b[2:]) END AS brand, 'S' || page_id AS sku FROM q
""")
def record_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).select("page_id", *[c.alias(k) for k, c in R.product(F.col("block")).items()])


_SHOP = f"""concat('{{"title": "', p_name, '", "handle": "h-', p_partkey, '", "variants": ', CASE p_partkey % 3 WHEN 0 THEN '[]' WHEN 1 THEN concat('[{{"price": "', {_PRICE}, '.50", "compare_at_price": "', {_PRICE} + 5, '.00", "available": true}}]')
 ELSE concat('[{{"price": "', {_PRICE}, '.00", "compare_at_price": "', {_PRICE}, '.00", "available": false}}, {{"price": "1"}}]') END, '}}')"""


@query(f"""
SELECT p_partkey AS page_id, p_name AS title, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '$' || {_PRICE} || '.50' ELSE '$' || {_PRICE} || '.00' END AS price, CASE p_partkey % 3 WHEN 1 THEN 'In Stock' ELSE 'Out of Stock' END AS availability,
  CASE p_partkey % 3 WHEN 1 THEN '$' || ({_PRICE} + 5) || '.00' ELSE '' END AS original_price, 'https://shop.example.com/products/h-' || p_partkey AS url FROM part
""")
def record_product_shopify(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "part").selectExpr("p_partkey AS page_id", f"{_SHOP} AS j").select("page_id", F.try_parse_json("j").alias("v"))
    return v.select("page_id", *[c.alias(k) for k, c in R.shop_product(F.col("v"), "https://shop.example.com").items()])


_ARTICLE = """concat('{"@type": "Article", "', CASE p_partkey % 2 WHEN 0 THEN 'headline' ELSE 'name' END, '": "', p_name, '", "author": ', CASE p_partkey % 4 WHEN 0 THEN concat('{"name": "', p_brand, '"}') WHEN 1 THEN concat('"', p_brand, '"') WHEN 2 THEN concat('[{"name": "', p_brand, '"}]') ELSE 'null' END,
 ', "datePublished": "2024-01-0', p_partkey % 9 + 1, '", "articleBody": "Body ', p_partkey, '", "image": ', CASE p_partkey % 3 WHEN 0 THEN '"a.png"' WHEN 1 THEN '["a.png", {"url": "b.png"}]' ELSE '[]' END, ', "keywords": ', CASE p_partkey % 2 WHEN 0 THEN '" x , y,, "' ELSE '["x", "z"]' END, ', "articleSection": "', p_type, '"}')"""


@query("""
SELECT p_partkey AS page_id, p_name AS title, CASE p_partkey % 4 WHEN 3 THEN '' ELSE p_brand END AS author, '2024-01-0' || (p_partkey % 9 + 1) AS publish_date, 'Body ' || p_partkey AS content,
  CASE p_partkey % 3 WHEN 0 THEN 'a.png' WHEN 1 THEN 'a.png b.png' ELSE '' END AS images, CASE p_partkey % 2 WHEN 0 THEN 'x|y' ELSE 'x|z' END AS tags, p_type AS category FROM part
""")
def record_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "part").selectExpr("p_partkey AS page_id", f"{_ARTICLE} AS j").select("page_id", F.try_parse_json("j").alias("v"))
    return v.select("page_id", *[c.alias(k) for k, c in R.article(F.col("v")).items()])


_JOB = """concat('{"@type": "JobPosting", "title": "', p_name, '", "hiringOrganization": ', CASE p_partkey % 2 WHEN 0 THEN concat('{"name": "', p_brand, '"}') ELSE concat('"', p_brand, '"') END, ', "jobLocation": {"address": {"addressLocality": "NYC", "addressRegion": "', CASE p_partkey % 2 WHEN 0 THEN '' ELSE 'NY' END, '"}}',
 ', "baseSalary": {"value": {"minValue": ', p_size, CASE p_partkey % 2 WHEN 0 THEN ', "maxValue": 99' ELSE '' END, ', "unitText": "HOUR"}}, "description": "D", "qualifications": ', CASE p_partkey % 2 WHEN 0 THEN '["a", "b"]' ELSE '"c"' END, ', "employmentType": ', CASE p_partkey % 3 WHEN 0 THEN '"FULL_TIME"' ELSE '["PART_TIME", "TEMP"]' END, '}')"""


@query("""
SELECT p_partkey AS page_id, p_name AS title, p_brand AS company, CASE p_partkey % 2 WHEN 0 THEN 'NYC' ELSE 'NYC, NY' END AS location, '$' || p_size || CASE p_partkey % 2 WHEN 0 THEN ' - $99' ELSE '' END || ' HOUR' AS salary,
  'D' AS description, CASE p_partkey % 2 WHEN 0 THEN 'a' || chr(10) || 'b' ELSE 'c' END AS requirements, CASE p_partkey % 3 WHEN 0 THEN 'FULL_TIME' ELSE 'PART_TIME, TEMP' END AS job_type FROM part
""")
def record_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "part").selectExpr("p_partkey AS page_id", f"{_JOB} AS j").select("page_id", F.try_parse_json("j").alias("v"))
    return v.select("page_id", *[c.alias(k) for k, c in R.job(F.col("v")).items()])


@query("""
SELECT conv_id, 'Thread ' || conv_id AS title, 'user' || conv_id % 5 AS author, count(*) AS posts, greatest(0, count(*) - 1) AS replies, '2024-01-' || lpad(CAST(max(turn) + 1 AS VARCHAR), 2, '0') AS last_activity
FROM conversations GROUP BY conv_id
""")
def record_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("post", F.struct(F.concat(F.lit("2024-01-"), F.lpad((F.col("turn") + 1).cast("string"), 2, "0")).alias("dateCreated")))
    grouped = c.groupBy("conv_id").agg(F.collect_list("post").alias("comment"))
    whole = F.to_json(F.struct(F.concat(F.lit("Thread "), "conv_id").alias("headline"), F.struct(F.concat(F.lit("user"), F.col("conv_id") % 5).alias("name")).alias("author"), "comment"))
    v = grouped.select("conv_id", F.try_parse_json(whole).alias("v"))
    return v.select("conv_id", *[x.alias(k) for k, x in R.thread(F.col("v")).items()])


@query(f"""
SELECT p_name AS title, CAST({_PRICE} AS VARCHAR) AS price, 'https://x.example.com/' || p_partkey AS url, CAST(200 AS BIGINT) AS status_code, '' AS remarks FROM part WHERE p_partkey % 10 NOT IN (3, 4)
UNION ALL SELECT '', '', 'https://x.example.com/' || p_partkey, 0, 'Error: timeout after ' || p_size FROM part WHERE p_partkey % 10 = 3
UNION ALL SELECT '', '', 'https://x.example.com/' || p_partkey, 0, 'No title found' FROM part WHERE p_partkey % 10 = 4
""")
def record_error_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("url", F.concat(F.lit("https://x.example.com/"), "p_partkey"))
    failed = p.filter("p_partkey % 10 = 3").select(*[c.alias(k) for k, c in R.error_record(F.col("url"), F.concat(F.lit("timeout after "), "p_size")).items()])
    titled = F.when(F.expr("p_partkey % 10 = 4"), "").otherwise(F.col("p_name"))
    price = F.when(F.expr("p_partkey % 10 = 4"), "").otherwise(F.expr(f"CAST({_PRICE} AS STRING)"))
    fine = p.filter("p_partkey % 10 <> 3").select(titled.alias("title"), price.alias("price"), "url", F.lit(200).cast("long").alias("status_code"), F.lit("").alias("remarks"))
    return R.require_title(fine).unionByName(failed)


_RAW_PRICE = "CASE p_partkey % 6 WHEN 0 THEN CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR(20)) WHEN 1 THEN '' WHEN 2 THEN '€12' WHEN 3 THEN 'call us' WHEN 4 THEN ' 1234.5 ' ELSE '£' || p_size END"


@query(f"""
SELECT p_partkey, CASE WHEN t = '' THEN '' WHEN regexp_matches(t, '^[$€£]') THEN t ELSE '$' || coalesce(format('{{:,.2f}}', try_cast(t AS DOUBLE)), t) END AS price,
  CASE WHEN t = '' THEN '' WHEN regexp_matches(t, '^[$€£]') THEN t ELSE '$' || coalesce(format('{{:.2f}}', try_cast(t AS DOUBLE)), t) END AS plain,
  CASE WHEN t = '' THEN '' WHEN contains(t, '$') THEN 'USD' WHEN contains(t, '€') THEN 'EUR' WHEN contains(t, '£') THEN 'GBP' ELSE 'USD' END AS currency
FROM (SELECT p_partkey, trim({_RAW_PRICE}) AS t FROM part)
""")
def norm_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_RAW_PRICE} AS raw")
    return p.select("p_partkey", N.price_text(F.col("raw")).alias("price"), N.price_text(F.col("raw"), thousands=False).alias("plain"), N.currency_of(F.col("raw")).alias("currency"))


@query(f"SELECT p_partkey, CAST(try_cast(regexp_replace({_RAW_PRICE}, '[^0-9.]', '', 'g') AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM part")
def norm_price_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_RAW_PRICE} AS raw").select("p_partkey", N.price_amount(F.col("raw")).cast("double").alias("amount"))


_CUR = "CASE p_partkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'CHF' WHEN 3 THEN 'CNY' ELSE 'XXX' END"


@query(f"""
SELECT p_partkey, CASE WHEN t = '' THEN '' WHEN regexp_matches(t, '^[$€£¥]') THEN t ELSE CASE c WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' WHEN 'CHF' THEN 'CHF ' WHEN 'CNY' THEN '¥' ELSE '' END || t END AS price
FROM (SELECT p_partkey, trim({_RAW_PRICE}) AS t, {_CUR} AS c FROM part)
""")
def norm_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_RAW_PRICE} AS raw", f"{_CUR} AS c")
    return p.select("p_partkey", N.price_with_symbol(F.col("raw"), F.col("c")).alias("price"))


_STATE = "CASE p_partkey % 9 WHEN 0 THEN 'https://schema.org/InStock' WHEN 1 THEN 'OutOfStock' WHEN 2 THEN 'http://schema.org/PreOrder' WHEN 3 THEN 'LimitedAvailability' WHEN 4 THEN 'SoldOut' WHEN 5 THEN '' WHEN 6 THEN 'https://schema.org/BackStock' WHEN 7 THEN 'Discontinued' ELSE 'weird' END"


@query(f"SELECT p_partkey, CASE WHEN contains({_STATE}, 'InStock') THEN 'In Stock' ELSE 'Out of Stock' END AS availability FROM part")
def norm_availability_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_STATE} AS s").select("p_partkey", N.availability_basic(F.col("s")).alias("availability"))


@query(f"""
SELECT p_partkey, coalesce(map {{'InStock': 'In Stock', 'InStoreOnly': 'In Stock', 'LimitedAvailability': 'In Stock', 'OnlineOnly': 'In Stock', 'OutOfStock': 'Out of Stock', 'Discontinued': 'Out of Stock', 'PreOrder': 'In Stock'}}[t], replace(t, 'Stock', ' Stock')) AS mapped,
  CASE WHEN contains(l, 'instock') THEN 'In Stock' WHEN contains(l, 'outofstock') OR contains(l, 'soldout') THEN 'Out of Stock' WHEN contains(l, 'preorder') THEN 'Pre-order' WHEN contains(l, 'limitedavailability') THEN 'Limited Stock' ELSE s END AS four
FROM (SELECT p_partkey, s, lower(s) AS l, regexp_extract(s, '([^/]*)$', 1) AS t FROM (SELECT p_partkey, {_STATE} AS s FROM part))
""")
def norm_availability_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_STATE} AS s").select("p_partkey", N.availability_map(F.col("s")).alias("mapped"), N.availability_four(F.col("s")).alias("four"))


_SAID = "CASE p_partkey % 6 WHEN 0 THEN 'Add to bag' WHEN 1 THEN 'Currently unavailable' WHEN 2 THEN 'SOLD OUT' WHEN 3 THEN 'It is in stock now' WHEN 4 THEN 'out of stock' ELSE 'details' END"


@query(f"""
SELECT p_partkey, CASE WHEN regexp_matches(l, '\\bin stock\\b') THEN 'In Stock' WHEN regexp_matches(l, '\\bout of stock\\b') THEN 'Out of Stock' ELSE '' END AS by_text,
  CASE WHEN regexp_matches(l, 'out of|sold out|unavailable') THEN 'Out of Stock' WHEN regexp_matches(l, 'add to|shop now|buy now|available') THEN 'In Stock' WHEN p <> '' THEN 'In Stock' ELSE 'Out of Stock' END AS by_action
FROM (SELECT p_partkey, lower({_SAID}) AS l, {_RAW_PRICE} AS p FROM part)
""")
def norm_availability_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_SAID} AS s", f"{_RAW_PRICE} AS p")
    return p.select("p_partkey", N.availability_text(F.col("s")).alias("by_text"), N.availability_action(F.col("s"), F.col("p")).alias("by_action"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS brand FROM part
""")
def norm_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.expr("p_partkey % 7 = 0"), "NULL").otherwise(F.upper("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", N.brand(raw).alias("brand"))


_DUAL = f"CASE p_partkey % 4 WHEN 0 THEN 'Was £' || ({_PRICE} + 5) || '.00 now £' || {_PRICE} || '.00' WHEN 1 THEN '£1,' || lpad(CAST(p_size AS VARCHAR(10)), 3, '0') || '.99' WHEN 2 THEN ' on request ' ELSE '' END"


@query(f"""
SELECT p_partkey, CASE WHEN len(a) > 0 THEN a[-1] ELSE trim(t) END AS price, CASE WHEN len(a) > 1 THEN a[1] ELSE '' END AS original
FROM (SELECT p_partkey, t, regexp_extract_all(t, '£[0-9,]+\\.[0-9]{{2}}') AS a FROM (SELECT p_partkey, {_DUAL} AS t FROM part))
""")
def norm_dual_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, original = N.dual_price(F.col("t"))
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_DUAL} AS t").select("p_partkey", price.alias("price"), original.alias("original"))
