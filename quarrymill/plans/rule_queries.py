"""Queries over small rules: answers, states, labels, texts, prices. Inputs are made of ``part`` and ``documents`` by the same SQL in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import classify as C
from quarrymill.functions import html as H
from quarrymill.functions import jsonld as J
from quarrymill.functions import normalize as N
from quarrymill.functions import urls as U
from quarrymill.operators import gates as G
from quarrymill.operators import links as L
from quarrymill.operators import records as R

from .catalog import query, table

K = "p_partkey"


def parts(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(K, *[f"{sql} AS {name}" for name, sql in columns.items()])


#: Answers made of what an event says: JSON objects with and without an answer, plain text, and none.
_ANSWER = """CASE event_type WHEN 'click' THEN props WHEN 'view' THEN concat('{"choice": "', CASE WHEN value > 20 THEN 'Abort' ELSE 'Go' END, '"}')
 WHEN 'signup' THEN CASE WHEN value > 30 THEN 'Cancel' WHEN value > 20 THEN 'stop' WHEN value > 10 THEN 'cancel' ELSE 'fine' END
 WHEN 'purchase' THEN concat('{"decision": "', CASE WHEN value > 15 THEN 'reject' ELSE 'approve' END, '", "choice": "No"}') WHEN 'error' THEN CASE WHEN value > 25 THEN '{"response": "go on"}' END END"""


@query(f"""
SELECT event_id, said, said IN ('Cancel', 'Abort', 'No', 'stop', 'Stop', 'reject') AS cancels, said NOT IN ('Cancel', 'Abort', 'No', 'stop', 'Stop') AS approves FROM (
  SELECT event_id, CASE WHEN p IS NULL THEN 'Cancel' WHEN starts_with(p, '{{') THEN coalesce(json_extract_string(CASE WHEN starts_with(p, '{{') THEN p END, '$.decision'),
    json_extract_string(CASE WHEN starts_with(p, '{{') THEN p END, '$.choice'), json_extract_string(CASE WHEN starts_with(p, '{{') THEN p END, '$.response'), '') ELSE p END AS said FROM (SELECT event_id, {_ANSWER} AS p FROM events))
""")
def gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "events").selectExpr("event_id", f"{_ANSWER} AS p").select("event_id", G.decision(F.col("p")).alias("said"))
    return said.select("event_id", "said", G.is_cancel(F.col("said")).alias("cancels"), G.is_approve(F.col("said")).alias("approves"))


#: Orders as jobs: the state by priority, the error by amount, the run by status, the reason for asking by month.
_STATE = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'captcha_blocked' WHEN '2' THEN 'akamai_blocked' WHEN '3' THEN 'blocked' WHEN '4' THEN 'running' END"
_ERROR = "CASE WHEN o_totalprice < 50000 THEN 'boom' WHEN o_totalprice < 100000 THEN '' END"
_RUN = "CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'DONE' END"
_REASON = "CASE month(o_orderdate) WHEN 1 THEN 'retry_failed' WHEN 2 THEN 'low_coverage' WHEN 3 THEN 'skill_approval' WHEN 4 THEN 'other' WHEN 5 THEN 'choose_mechanism' END"


@query(f"""
SELECT o_orderkey, CASE WHEN s IN ('captcha_blocked', 'akamai_blocked') THEN s WHEN coalesce(e, '') <> '' OR coalesce(x, '') = 'FAILED' THEN 'failed' ELSE 'completed' END AS status,
  CASE r WHEN 'retry_failed' THEN 're_scrape' WHEN 'low_coverage' THEN 'field_coverage' WHEN 'skill_approval' THEN 'skill_update' WHEN 'choose_mechanism' THEN 'mechanism' ELSE 'execution' END AS approval
FROM (SELECT o_orderkey, {_STATE} AS s, {_ERROR} AS e, {_RUN} AS x, {_REASON} AS r FROM orders)
""")
def gate_final_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_STATE} AS s", f"{_ERROR} AS e", f"{_RUN} AS x", f"{_REASON} AS r")
    return o.select("o_orderkey", G.final_status(F.col("s"), F.col("e"), F.col("x")).alias("status"), G.approval_type(F.col("r")).alias("approval"))


#: Events as checks of a service: their age by minute, the call budget by value, the mode by type, the criteria by value.
_AGE = "CASE WHEN event_type <> 'error' THEN minute(ts) * 10 END"
_BUDGET = "CAST(floor(value) AS INT)"
_EVENT_MODE = "CASE WHEN event_type IN ('click', 'view') THEN 'url_list' ELSE 'navigation' END"
_CRITERIA = "CASE WHEN value > 20 THEN props END"


@query(f"""
SELECT event_id, CASE WHEN age IS NULL THEN 'unknown' WHEN value <= 5 THEN 'down' WHEN age < 300 THEN 'up' ELSE 'degraded' END AS health,
  CASE WHEN budget < 50 AND hour(ts) >= 5 THEN least(budget + 10, 50) ELSE budget END::BIGINT AS budget, CASE WHEN criteria IS NOT NULL AND mode = 'url_list' THEN 'search_term' ELSE mode END AS mode,
  CASE WHEN day(ts) % 5 < 4 THEN 'browser' ELSE 'http' END AS method, (value <= 3 AND event_type = 'view') OR event_type = 'signup' AS needs_browser
FROM (SELECT *, {_AGE} AS age, {_BUDGET} AS budget, {_EVENT_MODE} AS mode, {_CRITERIA} AS criteria FROM events)
""")
def gate_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("*", f"{_AGE} AS age", f"{_BUDGET} AS budget", f"{_EVENT_MODE} AS mode", f"{_CRITERIA} AS criteria")
    method = F.get(F.array(*map(F.lit, C.BROWSER_METHODS), F.lit("httpx")), F.expr("CAST(day(ts) % 5 AS INT)"))
    return e.select(
        "event_id",
        G.service_health(F.col("age"), F.expr("value > 5")).alias("health"),
        G.extended_budget(F.col("budget"), F.expr("hour(ts)")).cast("long").alias("budget"),
        G.input_mode(F.col("mode"), F.col("criteria")).alias("mode"),
        C.method_class(method).alias("method"),
        C.needs_browser(F.expr("value > 3"), F.expr("event_type <> 'view'"), F.when(F.expr("event_type = 'signup'"), "react").otherwise("")).alias("needs_browser"),
    )


_KEY = f"CASE {K} % 6 WHEN 0 THEN 'products' WHEN 1 THEN 'articles' WHEN 2 THEN 'class' WHEN 3 THEN 'pages' WHEN 4 THEN '' END"


@query(f"""
SELECT {K}, CASE WHEN k = 'products' THEN k WHEN k IS NULL THEN 'items' ELSE rtrim(k, 's') END AS label, regexp_replace(lower(p_brand), '[^a-z0-9-]', '-', 'g') AS slug, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS kind,
  CASE WHEN length(p_name) > 20 THEN substr(p_name, 1, 20) || '...' ELSE p_name END AS short, regexp_replace(p_brand || p_size, '[^0-9]', '', 'g') AS digits, try_cast(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS first_number
FROM (SELECT *, {_KEY} AS k FROM part)
""")
def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").selectExpr("*", f"{_KEY} AS k")
    c = F.col
    return p.select(
        K,
        N.singular_label(c("k")).alias("label"),
        U.name_slug(c("p_brand")).alias("slug"),
        N.capitalise(F.lower("p_type")).alias("kind"),
        H.shorten(c("p_name"), 20).alias("short"),
        H.digits(F.concat("p_brand", "p_size")).alias("digits"),
        H.first_integer(c("p_brand")).alias("first_number"),
    )


_MARKDOWN = f"concat('---', chr(10), 'name:  ', p_name, ' ', chr(10), 'kind: x', chr(10), '---')"
_PARAGRAPHS = f"concat('<p>', p_name, '</p><p> </p><P class=a><b>', p_type, '</b> end</p>')"
_STYLE = f"CASE {K} % 3 WHEN 0 THEN 'Style: AB-' || {K} WHEN 1 THEN 'style no # x' || {K} ELSE 'plain' END"
_RATED = f"CASE {K} % 2 WHEN 0 THEN 'Average rating value is 4.' || ({K} % 10) || ' of 5.' ELSE 'unrated' END"


@query(f"""
SELECT {K}, p_name AS name, p_name || chr(10) || p_type || ' end' AS paragraphs, CASE {K} % 3 WHEN 0 THEN 'AB-' || {K} WHEN 1 THEN 'x' || {K} ELSE '' END AS style, CASE {K} % 2 WHEN 0 THEN ('4.' || ({K} % 10))::DOUBLE END AS rating FROM part
""")
def text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir, m=_MARKDOWN, h=_PARAGRAPHS, s=_STYLE, r=_RATED)
    return p.select(K, H.frontmatter(F.col("m"), "name").alias("name"), H.paragraphs(F.col("h")).alias("paragraphs"), H.style_id(F.col("s")).alias("style"), H.rating(F.col("r")).alias("rating"))


_PRICE = f"CASE {K} % 3 WHEN 0 THEN '' WHEN 1 THEN '$5.00' END"
_ORIGINAL = f"CASE {K} % 2 WHEN 0 THEN '$9.00' ELSE '' END"
_AMOUNT = f"CASE {K} % 4 WHEN 0 THEN '1,234' WHEN 1 THEN 'ask' ELSE '' || {K} END"
_CENTS = f"CASE {K} % 3 WHEN 0 THEN '.99' WHEN 1 THEN '5' ELSE '' END"


#: Thousands apart by commas.
_WHOLE = "regexp_replace(reverse(regexp_replace(reverse(CAST(floor(p_retailprice * 7) AS BIGINT)::VARCHAR), '([0-9]{3})', '\\1,', 'g')), '^,', '')"


@query(f"""
SELECT {K}, CASE WHEN p = '' AND o <> '' THEN o ELSE p END AS price, CASE WHEN p = '' AND o <> '' THEN '' ELSE o END AS original,
  CASE p_type WHEN 'PROMO' THEN '' ELSE '$' || {_WHOLE} || '.' || CASE WHEN p_size >= 10 THEN p_size::VARCHAR WHEN p_size > 5 THEN '0' || p_size ELSE '00' END END AS assembled, CASE WHEN p_size > 25 THEN 'In Stock' ELSE 'Out of Stock' END AS availability
FROM (SELECT *, CASE WHEN p_size % 3 = 0 THEN '' ELSE '$' || p_size || '.00' END AS p, CASE WHEN p_brand > 'Brand#2' THEN '$' || (p_size + 9) || '.00' ELSE '' END AS o FROM part)
""")
def norm_price_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices from sizes and brands, whole amounts with and without thousands and cents from retail prices and sizes."""
    e = F.expr
    price, original = N.promoted_price(e("CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('$', p_size, '.00') END"), e("CASE WHEN p_brand > 'Brand#2' THEN concat('$', p_size + 9, '.00') ELSE '' END"))
    whole = e("CASE p_type WHEN 'PROMO' THEN 'ask' ELSE CAST(CAST(floor(p_retailprice * 7) AS BIGINT) AS STRING) END")
    cents = e("CASE WHEN p_size > 5 THEN concat('.', p_size) ELSE '' END")
    return table(spark, sf_dir, "part").select(K, price.alias("price"), original.alias("original"), N.amount_with_cents(whole, cents).alias("assembled"), N.availability_flag(e("p_size > 25")).alias("availability"))


@query(f"""
SELECT {K}, array_to_string(CASE {K} % 2 WHEN 0 THEN ['https://a/1.jpg', 'https://a/' || {K} || '.jpg'] ELSE ['https://a/1.jpg'] END, ' ') AS images, 'cat:' || p_type AS tag,
  array_to_string(list_filter(['a=' || CASE {K} % 2 WHEN 0 THEN p_brand ELSE 'direct' END, 'b=mapped', 'c=direct'], lambda x: true), ',') AS merged FROM part
""")
def norm_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    own = F.when(F.expr(f"{K} % 2 = 0"), F.concat(F.lit("https://a/"), F.col(K).cast("string"), F.lit(".jpg"))).otherwise("https://a/Logo.png")
    urls = F.array(F.lit("https://a/1.jpg"), F.lit("data:x"), own, F.lit("https://a/1.jpg"), F.lit(""))
    tags = F.array(F.lit("cat:a"), F.concat(F.lit("cat:"), F.col("p_type")), F.lit("a tag that is longer than all of the others, by far"))
    direct = F.create_map(F.lit("a"), F.lit("direct"), F.lit("c"), F.lit("direct"))
    existing = F.create_map(F.lit("a"), F.when(F.expr(f"{K} % 2 = 0"), F.col("p_brand")).otherwise(""))
    mapped = F.create_map(F.lit("a"), F.lit("mapped"), F.lit("b"), F.lit("mapped"), F.lit("d"), F.lit(""))
    merged = F.array_sort(F.transform(F.map_entries(R.merge_fields(direct, existing, mapped)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return p.select(K, F.array_join(N.images(urls), " ").alias("images"), J.longest_tag(tags).alias("tag"), F.array_join(merged, ",").alias("merged"))


#: Customers as sites: locale trouble by balance, a search by segment, its words by nation, links by nation and balance.
_SITE = """c_acctbal < 0 AS fatal, c_mktsegment IN ('BUILDING', 'AUTOMOBILE') AS searched, CASE WHEN c_nationkey > 10 THEN c_name ELSE '' END AS criteria, c_nationkey % 7 AS categories,
  CAST(floor(c_acctbal / 3000) AS INT) AS real_links, CASE WHEN c_mktsegment = 'MACHINERY' THEN '.html' ELSE '' END AS pattern, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'next_button' ELSE 'none' END AS kind, c_nationkey * 2 AS total"""


@query(f"""
SELECT c_custkey, CASE WHEN fatal AND NOT real_links > 0 THEN 'failed' WHEN searched AND criteria <> '' AND real_links > 0 THEN 'search' WHEN categories >= 3 AND real_links > 0 THEN 'category' WHEN pattern <> '' THEN 'url_pattern'
    WHEN categories < 3 AND real_links <= 0 AND NOT searched THEN 'failed' WHEN categories >= 3 THEN 'category' ELSE 'unknown' END AS method,
  CASE WHEN kind <> 'none' THEN kind WHEN total > 20 THEN 'unknown' ELSE '' END AS paging FROM (SELECT *, {_SITE.replace("//", "/")} FROM customer)
""")
def link_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    sites = table(spark, sf_dir, "customer").selectExpr("c_custkey", *[x.strip() for x in _columns(_SITE)])
    method = L.discovery_method(c("fatal"), c("searched"), c("criteria"), c("categories"), c("real_links"), c("pattern"))
    return sites.select("c_custkey", method.alias("method"), L.inferred_paging(c("kind"), c("total"), F.lit(20)).alias("paging"))


def _columns(sql: str) -> list[str]:
    """A list of SQL columns, taken apart at the commas outside of brackets."""
    out, depth = [""], 0
    for x in sql:
        depth += (x == "(") - (x == ")")
        out = [*out, ""] if x == "," and not depth else [*out[:-1], out[-1] + x]
    return out


#: Parts as samples: a title by size, a price by type, a status by brand, remarks by type and size.
_SAMPLE = {"title": "CASE WHEN p_size > 10 THEN p_name END", "price": "CASE WHEN p_type <> 'PROMO' THEN CAST(p_size AS STRING) ELSE '' END", "status_code": "CASE WHEN p_brand = 'Brand#1' THEN 404 ELSE 200 END", "remarks": "CASE WHEN p_type = 'ECONOMY' AND p_size > 40 THEN 'Soft 404: gone' END"}


@query(f"""
SELECT {K}, title IS NOT NULL AND price <> '' AND status_code <> 404 AND remarks IS NULL AS valid, p_size > {3 * (len(G.DEFAULT_CORE) - 1)} AS core FROM (SELECT *, {", ".join(f"{v} AS {k}" for k, v in _SAMPLE.items())} FROM part)
""")
def gate_valid_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's sample beside one that is dead; its core fields are there from a size on that grows from field to field."""
    e = F.expr
    own = F.struct(*[e(v).alias(k) for k, v in _SAMPLE.items()])
    dead = F.struct(F.col("p_name").alias("title"), F.lit("1").alias("price"), F.lit(410).alias("status_code"), F.lit(None).cast("string").alias("remarks"))
    fields = F.array_compact(F.array(F.lit("brand"), *[F.when(F.col("p_size") > 3 * i, name) for i, name in enumerate(G.DEFAULT_CORE)]))
    return table(spark, sf_dir, "part").select(K, G.valid_output(F.array(dead, own)).alias("valid"), G.core_present(fields).alias("core"))
