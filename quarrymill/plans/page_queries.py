"""Queries over raw pages and documents: page facts, meta tags, cleaning, classification, content search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import classify as C
from quarrymill.functions import html as H
from quarrymill.operators import gates as G

from .catalog import query, table

#: Plain SQL for both engines: some pages get a block phrase, a shell mark or hardly any text, which none of the test pages has.
HTML = """CASE page_id % 10 WHEN 3 THEN replace(html, '<article>', '<article><p>Just a moment...</p>') WHEN 4 THEN replace(html, '<body>', '<body ng-app="x">')
 WHEN 5 THEN concat('<html><body><div id="root"></div><script>', repeat('x', 11000), '</script></body></html>') ELSE html END"""
_TITLE = "substr(regexp_replace(regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1), '^\\s+|\\s+$', '', 'g'), 1, 200)"
_INNER = "regexp_extract(h, '(?is)<body[^>]*>(.*?)</body>', 1)"


def _squeeze(sql: str) -> str:
    return f"regexp_replace(regexp_replace({sql}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


_BODY = f"substr({_squeeze(f'''regexp_replace(CASE WHEN {_INNER} = '' THEN h ELSE {_INNER} END, '<[^>]+>', ' ', 'g')''')}, 1, 1500)"
_SHELL = " ".join(f"WHEN contains(substr(h, 1, 50000), '{m}') THEN '{n}'" for m, n in C.SHELL_MARKS)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("page_id", "url", f"{HTML} AS h")


@query(f"""
SELECT page_id, title, length(body) AS body_length, blocked, framework, length(h) > 2000 AND NOT blocked AS meaningful FROM (
  SELECT page_id, h, {_TITLE} AS title, body, regexp_matches(lower(substr(h, 1, 5000)), '{"|".join(C.BLOCK_PHRASES)}') AS blocked,
    CASE {_SHELL} WHEN length(body) < 200 AND length(h) > 10000 THEN 'unknown-large-shell' ELSE '' END AS framework
  FROM (SELECT page_id, h, {_BODY} AS body FROM (SELECT page_id, {HTML} AS h FROM pages)))
""")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("h")
    facts = pages(spark, sf_dir).withColumn("body", H.body_text(h)).withColumn("blocked", C.blocked(h))
    return facts.select("page_id", H.title(h).alias("title"), F.length("body").cast("long").alias("body_length"), "blocked", C.shell_framework(h, F.col("body")).alias("framework"), C.meaningful(h, F.col("blocked")).alias("meaningful"))


@query(f"SELECT page_id, {_TITLE} AS title, split_part({_TITLE}, ' | ', 1) AS head FROM (SELECT page_id, {HTML} AS h FROM pages)")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = H.title(F.col("h"))
    return pages(spark, sf_dir).select("page_id", t.alias("title"), H.title_head(t).alias("head"))


_META = """concat('<meta name="Author" content="a', page_id, '"><meta property="og:title" content="', repeat('t', 250), '"><meta name="author" content="b"><meta content="x" name="later">', html)"""


@query("SELECT page_id, 'b' AS author, repeat('t', 200) AS og_title, CAST(2 AS BIGINT) AS tags, CAST(1 AS BIGINT) AS og FROM pages")
def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of a name wins; only tags with the name before the content count."""
    p = table(spark, sf_dir, "pages").selectExpr("page_id", f"{_META} AS h").select("page_id", H.meta_map(F.col("h")).alias("m"), H.og_tags(F.col("h")).alias("og"))
    return p.select("page_id", F.col("m")["author"].alias("author"), F.col("og")["og:title"].alias("og_title"), F.size("m").cast("long").alias("tags"), F.size("og").cast("long").alias("og"))


@query(f"""SELECT page_id, md5({_squeeze("regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&[a-zA-Z]+;|&#[0-9]+;', ' ', 'g')")}) AS text FROM pages""")
def text_clean_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(H.clean_named(F.col("html"))).alias("text"))


@query(f"""SELECT page_id, md5({_squeeze("replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&')")}) AS text FROM pages""")
def text_clean_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(H.clean_xml_entities(F.col("html"))).alias("text"))


def _without(sql: str, *tags: str) -> str:
    for t in tags:
        sql = f"regexp_replace({sql}, '(?is)<{t}(?:\\s[^>]*)?>.*?</{t}\\s*>', ' ', 'g')"
    return f"regexp_replace({sql}, '<[^>]+>', ' ', 'g')"


@query(f"SELECT page_id, md5({_squeeze(_without('html', 'script', 'style', 'nav', 'header', 'footer', 'noscript'))}) AS text FROM pages")
def text_main_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(H.main_text_fallback(F.col("html"))).alias("text"))


@query(f"""SELECT page_id, CASE WHEN length(t) > 500 THEN substr(t, 1, 500) || '...' ELSE t END AS description FROM (SELECT page_id, {_squeeze(_without('html', 'script', 'style'))} AS t FROM pages)""")
def text_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.description(F.col("html")).alias("description"))


@query("""
SELECT page_id, len(regexp_extract_all(html, '(?i)<h1[\\s>]')) AS h1, len(regexp_extract_all(html, '(?i)<nav[\\s>]')) AS nav, len(regexp_extract_all(html, '(?i)<article[\\s>]')) AS article,
  len(regexp_extract_all(html, '(?i)<img\\s')) AS image, len(regexp_extract_all(html, '(?i)class\\s*=\\s*["''][^"'']*\\bad\\b')) AS ad FROM pages
""")
def page_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = H.selector_counts(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", *[counts[k].cast("long").alias(k) for k in ("h1", "nav", "article", "image", "ad")])


_MARKS = "CASE page_id % 6 WHEN 0 THEN 'Page Not Found' WHEN 1 THEN 'Sorry, no longer available' ELSE 'Fine' END"
_FINAL = "CASE page_id % 4 WHEN 0 THEN '/home' WHEN 1 THEN '/a/' || page_id || '/more' ELSE '/a/' || page_id || '/' END"


@query(f"""
SELECT page_id, CASE WHEN m IS NOT NULL THEN 'text: ' || m WHEN a <> '' AND b <> '' AND NOT starts_with(b, a) THEN 'moved: ' || a || ' to ' || b ELSE '' END AS reason FROM (
  SELECT page_id, list_filter(['page not found', 'product not found', 'no longer available', 'discontinued', 'item unavailable', '404'], lambda x: contains(lower({_MARKS}) || chr(10) || 'h', x))[1] AS m,
    '/a/' || page_id AS a, regexp_replace({_FINAL}, '/+$', '') AS b FROM pages)
""")
def soft404_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").selectExpr("page_id", f"{_MARKS} AS t", "'/a/' || page_id AS a", f"{_FINAL} AS b")
    return p.select("page_id", C.soft_404_reason(F.col("t"), F.lit("h"), F.col("a"), F.col("b")).alias("reason"))


_STATUS = "CASE page_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 200 WHEN 2 THEN 301 WHEN 3 THEN 503 ELSE NULL END"
_REMARK = "CASE page_id % 7 WHEN 0 THEN 'Soft 404: gone' WHEN 1 THEN 'Captcha shown' ELSE NULL END"


@query(f"""
SELECT page_id, coalesce({_STATUS}, 200) IN (301, 302, 303, 307, 308, 404, 410, 451) OR regexp_matches(lower(coalesce({_REMARK}, '')), 'soft 404|product not found|no longer available|discontinued|not a product page') AS dead,
  coalesce({_STATUS}, 200) IN (403, 429, 503) OR regexp_matches(lower(coalesce({_REMARK}, '')), 'captcha|access denied') AS banned FROM pages
""")
def dead_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").selectExpr("page_id", f"{_STATUS} AS s", f"{_REMARK} AS r")
    return p.select("page_id", C.dead_product(F.col("s"), F.col("r")).alias("dead"), C.banned(F.coalesce("s", F.lit(200)), F.col("r")).alias("banned"))


@query("""
SELECT doc_id, line, substr(text, 1, 200) AS excerpt FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
WHERE regexp_matches(text, '(?i)licen[sc]ed? under|token\\s*=')
""")
def doc_regex_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line_text"))
    return lines.filter(F.col("line_text").rlike(r"(?i)licen[sc]ed? under|token\s*=")).select("doc_id", (F.col("at") + 1).cast("long").alias("line"), F.substring("line_text", 1, 200).alias("excerpt"))


_PRESENT = [("title", "p_partkey % 2 < 2"), ("price", "p_partkey % 3 < 2"), ("availability", "p_partkey % 4 < 3"), ("original_price", "p_partkey % 5 = 0"), ("currency", "p_partkey % 6 < 5"), ("url", "p_partkey % 7 < 6"), ("src_url", "p_partkey % 8 < 7")]
_COVERED = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for _, c in _PRESENT)
_LACKS = "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} THEN NULL ELSE '{n}' END" for n, c in _PRESENT) + "], lambda x: x IS NOT NULL)), ',')"


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = F.array_compact(F.array(*[F.when(F.expr(c), n) for n, c in _PRESENT], F.lit("brand")))
    return table(spark, sf_dir, "part").select("p_partkey", present.alias("fields"))


@query(f"SELECT p_partkey, round(n / 7.0::DOUBLE, 6) AS ratio, CASE WHEN n / 7.0::DOUBLE >= 0.8 THEN 'code_writer' ELSE 'low_coverage' END AS gate FROM (SELECT p_partkey, {_COVERED} AS n FROM part)")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = G.coverage(F.col("fields"))
    return _fields(spark, sf_dir).select("p_partkey", F.round(ratio, 6).alias("ratio"), G.coverage_gate(ratio).alias("gate"))


@query(f"SELECT p_partkey, {_LACKS} AS missing FROM part")
def coverage_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).select("p_partkey", F.array_join(G.missing(F.col("fields")), ",").alias("missing"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN CASE WHEN p_size % 3 + 1 >= 2 THEN 'scraper_analyzer' ELSE 'low_confidence' END WHEN p_partkey % 4 > 1 THEN 'choose_mechanism'
  WHEN coalesce(CASE WHEN p_partkey % 13 > 0 THEN (p_partkey % 100) / 100.0::DOUBLE END, 0) < 0.7 THEN 'low_confidence' ELSE 'product_analyzer' END AS gate FROM part
""")
def gate_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    confidence = F.when(F.expr("p_partkey % 13 > 0"), F.expr("p_partkey % 100") / 100.0)
    return table(spark, sf_dir, "part").select("p_partkey", G.analysis_gate(F.expr("p_partkey % 11 <> 0"), F.expr("p_size % 3"), F.expr("p_partkey % 4"), confidence).alias("gate"))


@query("""
SELECT d.doc_id, CASE WHEN NOT report THEN CASE WHEN r = 99 THEN 'cleanup' WHEN r < 2 THEN 'scraper_analyzer' ELSE 'cleanup' END WHEN quality = 1 AND c >= 0.85 AND NOT severe THEN 'field_confirmation' WHEN r = 99 THEN 'cleanup'
  WHEN r < 2 THEN 'scraper_analyzer' WHEN c >= 0.5 AND n_chars > 1000 THEN 'field_confirmation' ELSE 'human_approval' END AS route
FROM (SELECT doc_id, n_chars, quality, quality IS NOT NULL AS report, CASE doc_id % 5 WHEN 4 THEN 99 ELSE doc_id % 5 END AS r, (doc_id % 101) / 100.0::DOUBLE AS c, coalesce(toxic, 0) = 1 AS severe FROM documents LEFT JOIN labels USING (doc_id)) d
""")
def gate_test_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    retries = F.expr("CASE doc_id % 5 WHEN 4 THEN 99 ELSE doc_id % 5 END")
    verdict = F.when(F.col("quality") == 1, "PASS").otherwise("FAIL")
    return d.select("doc_id", G.test_route(F.col("quality").isNotNull(), retries, verdict, F.expr("doc_id % 101") / 100.0, F.coalesce("toxic", F.lit(0)) == 1, F.col("n_chars") > 1000).alias("route"))


@query("""
SELECT p_partkey, round(least(greatest(0.1, least(1.0, raw - CASE WHEN p_partkey % 3 = 0 THEN 0.15::DOUBLE ELSE 0 END - CASE WHEN p_partkey % 4 > 0 AND p_partkey % 5 = 0 THEN 0.20::DOUBLE ELSE 0 END - CASE WHEN p_partkey % 2 = 0 THEN 0.05::DOUBLE ELSE 0 END)), raw), 6) AS confidence
FROM (SELECT p_partkey, coalesce(CASE WHEN p_partkey % 9 > 0 THEN (p_partkey % 100) / 100.0::DOUBLE END, 1.0) AS raw FROM part)
""")
def confidence_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.expr("p_partkey % 9 > 0"), F.expr("p_partkey % 100") / 100.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(G.adjusted_confidence(raw, F.expr("p_partkey % 3"), F.expr("p_partkey % 4"), F.expr("p_partkey % 5"), F.expr("p_partkey % 2 = 1")), 6).alias("confidence"))
