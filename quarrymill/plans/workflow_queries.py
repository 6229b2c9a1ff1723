"""Queries over threads, paging, human decisions, watchdog tables, issues, run documents and address lists.

``conversations`` stand for threads, ``customer`` for jobs, ``orders`` for steps and approvals, ``events`` for logs, answers
and listing rounds, ``lineitem`` for issues, ``part`` for items of a run and ``pages`` for addresses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import jsonld as J
from quarrymill.functions import urls as U
from quarrymill.operators import decisions as D
from quarrymill.operators import history as O
from quarrymill.operators import links as L
from quarrymill.operators import records as R
from quarrymill.operators import threads as T
from quarrymill.shared import fresh_path
from quarrymill.sources import documents as W
from quarrymill.sources import files as S

from .catalog import query, table

#: A post answers the one at half its turn; in every fifth conversation two posts answer each other, in every fourth one answers none that is there.
_PARENT = "CASE WHEN conv_id % 5 = 0 AND turn = 3 THEN 4 WHEN conv_id % 5 = 0 AND turn = 4 THEN 3 WHEN conv_id % 4 = 1 AND turn = 2 THEN 99 WHEN turn > 0 THEN (turn - 1) // 2 END"
_POSTS = f"""
posts AS (SELECT conv_id AS thread, turn AS post, {_PARENT} AS parent, role FROM conversations
), top AS (
  SELECT *, CASE WHEN parent IS NULL THEN '' ELSE 'orphan' END AS problem FROM posts p WHERE parent IS NULL OR NOT EXISTS (SELECT 1 FROM posts q WHERE q.thread = p.thread AND q.post = p.parent)
), down AS (
  SELECT thread, post, 0::BIGINT AS depth, lpad(post::VARCHAR, 10, '0') AS path, role, problem FROM top
  UNION ALL SELECT p.thread, p.post, d.depth + 1, d.path || lpad(p.post::VARCHAR, 10, '0'), p.role, '' FROM posts p JOIN down d ON p.thread = d.thread AND p.parent = d.post
)"""


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id AS thread", "turn AS post", f"{_PARENT.replace('//', 'DIV')} AS parent", "role")


@query(f"WITH RECURSIVE {_POSTS} SELECT p.thread, p.post, depth, path, coalesce(problem, 'cycle') AS problem FROM posts p LEFT JOIN down d ON p.thread = d.thread AND p.post = d.post")
def thread_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.placed_posts(_posts(spark, sf_dir)).select("thread", "post", "depth", "path", "problem")


@query(f"""
WITH RECURSIVE {_POSTS}, n AS (SELECT *, coalesce(lead(depth) OVER (PARTITION BY thread ORDER BY path), -1) AS after FROM down
), part AS (SELECT thread, path, depth, '{{"post":' || post || ',"role":"' || role || '","replies":[' || CASE WHEN after > depth THEN '' ELSE repeat(']}}', (depth - after + CASE WHEN after < 0 THEN 0 ELSE 1 END)::INTEGER) END || CASE WHEN after >= 0 AND after <= depth THEN ',' ELSE '' END AS text FROM n)
SELECT thread, count(*) AS posts, greatest(count(*) - 1, 0) AS replies, max(depth) AS deepest, md5('[' || string_agg(text, '' ORDER BY path) || ']') AS tree FROM part GROUP BY thread
""")
def thread_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = T.nested_threads(T.placed_posts(_posts(spark, sf_dir)), F.struct("post", "role"))
    return trees.select("thread", "posts", "replies", "deepest", F.md5("tree").alias("tree"))


_TOTAL = "CASE user_id % 3 WHEN 0 THEN 10 + user_id % 20 END"


@query(f"""
WITH listing AS (SELECT DISTINCT user_id AS site, CAST(date_trunc('day', ts) AS DATE) AS round, props AS href, day(ts) % 3 > 0 AS scrolled, {_TOTAL} AS total FROM events
), firsts AS (SELECT site, href, min(round) AS round FROM listing GROUP BY site, href
), r AS (SELECT l.site, l.round, any_value(scrolled) AS scrolled, any_value(total) AS total, (SELECT count(*) FROM firsts f WHERE f.site = l.site AND f.round = l.round) AS added FROM listing l GROUP BY l.site, l.round
), s AS (SELECT *, sum(added) OVER w AS so_far, row_number() OVER w AS k, max(CASE WHEN added > 0 THEN round END) OVER w AS last_news FROM r WINDOW w AS (PARTITION BY site ORDER BY round)
), t AS (SELECT *, count(*) FILTER (added = 0) OVER (PARTITION BY site, last_news ORDER BY round) AS streak FROM s
), u AS (SELECT *, CASE WHEN total <= so_far THEN 'total' WHEN added = 0 AND NOT scrolled THEN 'nothing_new' WHEN added = 0 AND streak >= 3 THEN 'empty_rounds' END AS rule FROM t
), stop AS (SELECT site, min(round) AS stop, arg_min(rule, round) AS stopped FROM u WHERE rule IS NOT NULL GROUP BY site)
SELECT u.site, count(*) AS rounds, sum(added)::BIGINT AS links, coalesce(any_value(stopped), 'end') AS stopped FROM u LEFT JOIN stop USING (site) WHERE stop IS NULL OR round <= stop GROUP BY u.site
""")
def paging_accumulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's days are rounds of a list, what happened on them its links."""
    e = table(spark, sf_dir, "events")
    listing = e.select(F.col("user_id").alias("site"), F.to_date("ts").alias("round"), F.col("props").alias("href"), (F.dayofmonth("ts") % 3 > 0).alias("scrolled"))
    totals = e.selectExpr("user_id AS site", f"{_TOTAL} AS total").distinct()
    return L.accumulated(listing, totals)[1]


_REASONS = ("testing_exhausted", "low_confidence", "budget_exhausted_site", "budget_exhausted_product", "budget_exhausted_navigation", "missing_artifact_site", "missing_artifact_product", "missing_artifact_navigation", "playwright_unavailable", "re_scrape", "choose_mechanism", "pre_execution", "unheard_of")
_LABELS = ("Redo the analysis", "Continue without", "Retry with higher budget", "Provide feedback for final retry", "Use probe_html")
_SAID = "CASE event_type WHEN 'click' THEN 'approve' WHEN 'view' THEN 'look' WHEN 'signup' THEN 'Continue' WHEN 'purchase' THEN 'reject' ELSE 'retry' END"
_REASON = " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_REASONS))
_LABEL = " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_LABELS))
_ANSWERS = f"""user_id AS job, event_id AS seq, CASE CAST(floor(value * 100) AS BIGINT) % {len(_REASONS)} {_REASON} END AS reason, {_SAID} AS decision,
  CASE CAST(floor(value * 10) AS BIGINT) % 6 {_LABEL} END AS label, CASE WHEN value > 20 THEN props END AS feedback"""


@query(f"""
WITH a AS (SELECT {_ANSWERS} FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY job, reason ORDER BY seq) - 1 AS resumes,
  lower(CASE WHEN reason <> 'testing_exhausted' AND lower(decision) IN ('approve', 'continue') THEN 'Continue anyway' ELSE coalesce(label, decision) END) AS l FROM a)
SELECT job, seq, resumes, CASE WHEN resumes >= 5 THEN 'cleanup' WHEN decision = 'reject' THEN '__end__'
  WHEN reason = 'testing_exhausted' THEN CASE WHEN l = 'provide feedback for final retry' AND coalesce(feedback, '') <> '' THEN 'scraper_analyzer' ELSE 'field_confirmation' END
  WHEN reason = 'low_confidence' THEN CASE WHEN contains(l, 'continue') THEN 'product_analyzer' ELSE 'setup_workspace' END
  WHEN starts_with(reason, 'budget') THEN CASE WHEN contains(l, 'retry') OR contains(l, 'higher budget') THEN CASE WHEN contains(reason, 'site') THEN 'site_analyzer' WHEN contains(reason, 'navigation') THEN 'navigation_explore' ELSE 'product_analyzer' END
    WHEN contains(l, 'continue') THEN CASE WHEN contains(reason, 'product') THEN 'normalize_fields' ELSE 'scraper_analyzer' END ELSE '__end__' END
  WHEN starts_with(reason, 'missing') THEN CASE WHEN contains(l, 'redo') THEN CASE WHEN contains(reason, 'site') THEN 'site_analyzer' WHEN contains(reason, 'navigation') THEN 'navigation_explore' ELSE 'product_analyzer' END
    WHEN contains(l, 'continue') THEN CASE WHEN contains(reason, 'site') THEN 'update_tracker_analysis' ELSE 'scraper_analyzer' END ELSE '__end__' END
  WHEN reason = 'playwright_unavailable' THEN CASE WHEN contains(l, 'retry') OR contains(l, 'playwright') THEN 'navigation_explore' WHEN contains(l, 'probe_html') OR contains(l, 'continue') THEN 'navigation_synthesize' ELSE '__end__' END
  WHEN reason = 're_scrape' THEN 'setup_workspace' WHEN reason = 'choose_mechanism' THEN 'code_writer' WHEN reason = 'pre_execution' THEN 'run_execution' ELSE 'cleanup' END AS target
FROM n
""")
def decision_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "events").selectExpr(*_exprs(_ANSWERS))
    return D.replayed(answers, D.rule_table(spark), "job", "seq").select("job", "seq", "resumes", "target")


def _exprs(columns: str) -> list[str]:
    """A list of SQL columns taken apart at the commas between them."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


_MODE = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'navigation' WHEN '2' THEN 'list_page' WHEN '3' THEN 'search_term' ELSE 'url_list' END"
_BITS = {"site": "o_totalprice > 100000", "product": "o_custkey % 3 > 0", "code": "o_orderstatus <> 'P'", "navigated": "o_totalprice > 250000", "analysed": "month(o_orderdate) > 6"}


@query(f"""
SELECT o_orderkey, CASE WHEN mode <> 'url_list' AND NOT navigated THEN 'site_analyzer' WHEN mode = 'navigation' OR NOT site THEN 'site_analyzer' WHEN NOT product THEN 'validate_analysis' WHEN code THEN 'code_tester' WHEN analysed THEN 'code_writer' ELSE 'scraper_analyzer' END AS target
FROM (SELECT o_orderkey, {_MODE} AS mode, {", ".join(f"{v} AS {k}" for k, v in _BITS.items())} FROM orders)
""")
def decision_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_MODE} AS mode", *[f"{v} AS {k}" for k, v in _BITS.items()])
    site, product, code = D.skip_flags(c("mode"), c("site"), c("product"), c("code"))
    return o.select("o_orderkey", D.resume_target(c("mode"), c("navigated"), site, product, code, c("analysed")).alias("target"))


_JOB_STATUS = "CASE c_mktsegment WHEN 'BUILDING' THEN 'running' WHEN 'AUTOMOBILE' THEN 'waiting_approval' WHEN 'MACHINERY' THEN 'running' ELSE 'completed' END"
_STEP_STATUS = "CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'pending' ELSE 'completed' END"
_NOW = "2024-01-20 12:00:00"
_STUCK = f"""
jobs AS (SELECT c_custkey AS job, {_JOB_STATUS} AS status, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(floor(c_acctbal) AS BIGINT)) AS started_at FROM customer
), last AS (SELECT user_id AS job, max(ts) AS t FROM events WHERE ts < TIMESTAMP '{_NOW}' GROUP BY user_id
), stuck AS (
  SELECT job, CAST(floor((epoch(TIMESTAMP '{_NOW}') - floor(epoch(coalesce(t, started_at)))) / 60) AS BIGINT) AS idle FROM jobs LEFT JOIN last USING (job)
  WHERE status = 'running' AND coalesce(t, started_at) < TIMESTAMP '{_NOW}' - INTERVAL 15 MINUTE)"""


def _watched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    none, text = F.lit(None).cast("timestamp"), F.lit(None).cast("string")
    started = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(floor(c_acctbal) AS INT))")
    jobs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job"), F.expr(_JOB_STATUS).alias("status"), started.cast("timestamp").alias("started_at"), none.alias("completed_at"), text.alias("error_message"))
    steps = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("step"), F.expr(_STEP_STATUS).alias("status"), none.alias("completed_at"))
    logs = table(spark, sf_dir, "events").filter(F.col("ts") < F.lit(_NOW).cast("timestamp")).select(F.col("user_id").alias("job"), "ts")
    # Running it again on what it has made changes nothing.
    jobs, steps, _ = O.fail_stuck(jobs, steps, logs, _NOW)
    return O.fail_stuck(jobs, steps, logs, _NOW)


@query(f"""
WITH {_STUCK} SELECT job, CASE WHEN idle IS NULL THEN status ELSE 'failed' END AS status, CASE WHEN idle IS NOT NULL THEN 'Worker process crashed (no activity for ' || idle || ' min). Likely OOM killed.' END AS error_message, idle IS NOT NULL AS ended FROM jobs LEFT JOIN stuck USING (job)
""")
def watchdog_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _watched(spark, sf_dir)[0].select("job", "status", "error_message", F.col("completed_at").isNotNull().alias("ended"))


@query(f"WITH {_STUCK} SELECT o_custkey AS job, o_orderkey AS step, CASE WHEN idle IS NOT NULL AND o_orderstatus IN ('O', 'P') THEN 'failed' ELSE {_STEP_STATUS} END AS status, idle IS NOT NULL AND o_orderstatus IN ('O', 'P') AS ended FROM orders LEFT JOIN stuck ON job = o_custkey")
def watchdog_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _watched(spark, sf_dir)[1].select("job", "step", "status", F.col("completed_at").isNotNull().alias("ended"))


_APPROVAL = "CASE o_orderstatus WHEN 'F' THEN 'rejected' ELSE 'pending' END"


@query(f"""
SELECT o_orderkey AS approval, CASE WHEN due THEN 'approved' ELSE {_APPROVAL} END AS status, CASE WHEN due THEN 'auto-approved' END AS human_response FROM (
  SELECT *, {_APPROVAL} = 'pending' AND coalesce(c_mktsegment = 'AUTOMOBILE' AND c_acctbal > 0, false) AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 10 MINUTE AS due FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
""")
def approvals_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, none = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    approvals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("approval"), F.col("o_custkey").alias("job"), F.expr(_APPROVAL).alias("status"), F.col("o_orderdate").alias("created_at"), text.alias("human_response"), none.alias("resolved_at"))
    jobs = table(spark, sf_dir, "customer").selectExpr("c_custkey AS job", f"{_JOB_STATUS} AS status", "c_acctbal > 0 AS auto_queued")
    once, _ = O.auto_approve(approvals, jobs, "1998-01-01 00:00:00")
    return O.auto_approve(once, jobs, "1998-01-01 00:00:00")[0].select("approval", "status", "human_response")


_SEVERITY = "CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'medium' ELSE 'low' END"


@query(f"""
WITH i AS (SELECT l_suppkey AS job, {_SEVERITY} AS severity, l_orderkey || '-' || l_linenumber AS description, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem)
SELECT job, severity, count(*) AS n, string_agg(description, ' ' ORDER BY k) FILTER (k <= CASE severity WHEN 'high' THEN 5 ELSE 3 END) AS first FROM i WHERE severity <> 'low' GROUP BY job, severity
""")
def issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS job", f"{_SEVERITY} AS severity", "concat(l_orderkey, '-', l_linenumber) AS description", "l_orderkey", "l_linenumber", "l_partkey")
    return O.issue_summary(issues, "job", ["l_orderkey", "l_linenumber", "l_partkey"]).withColumn("first", F.array_join("first", " "))


_TOOL = """CASE page_id % 3 WHEN 0 THEN concat('ran { not json } then {"a": "} \\\\" {", "n": ', page_id, ', "in": {"b": [1, {}]}} and { more }') WHEN 1 THEN concat('### Result', chr(10), '"{\\\\"n\\\\": ', page_id, '}"', chr(10), '### Ran code', chr(10), '{"n": -1}') ELSE concat('### Result', chr(10), '{"n": ', page_id, '}') END"""


@query("SELECT page_id, page_id AS n, CASE page_id % 3 WHEN 0 THEN '} \" {' END AS a FROM pages")
def embedded_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects among braces that are none, in quotes under a heading, and plain under one."""
    found = table(spark, sf_dir, "pages").select("page_id", S.embedded_json(F.expr(_TOOL)).alias("v"))
    return found.select("page_id", F.try_variant_get("v", "$.n", "bigint").alias("n"), F.try_variant_get("v", "$.a", "string").alias("a"))


_CASES = """CASE p_partkey % 4 WHEN 0 THEN concat('{"Name": "', p_name, '", "Offers": {"Price": "', p_size, '"}}') WHEN 1 THEN concat('{"name": "', p_name, '", "offers": {"price": "', p_size, '"}}')
  WHEN 2 THEN concat('{"Name": "", "name": "', p_name, '", "Offers": {"price": "', p_size, '"}}') ELSE concat('{"NAME": "', p_name, '", "offers": {"Price": "', p_size, '"}}') END"""


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN '' ELSE p_name END AS name, p_size::VARCHAR AS price FROM part")
def jsonld_any_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.try_parse_json(F.expr(_CASES))
    return table(spark, sf_dir, "part").select("p_partkey", J.any_case(v, "name").alias("name"), J.any_case(v, "offers", "price").alias("price"))


@query("""
SELECT 'https://shop.example/' || p_brand AS site, '2024-02-0' || r || '_080000' AS run, count(p_partkey) FILTER (r = 2 OR p_size > 25) AS items, coalesce(sum(CASE WHEN r = 2 OR p_size > 25 THEN p_partkey END), 0)::BIGINT AS ids
FROM part, (SELECT unnest([1, 2]) AS r) GROUP BY ALL HAVING count(p_partkey) FILTER (r = 2 OR p_size > 25) > 0
""")
def run_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' documents, a file per brand and run, written and read again."""
    path = fresh_path(spark, "runs")
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("https://shop.example/"), "p_brand").alias("site"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_retailprice").cast("string").alias("price"))
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    W.write_run_documents(p.join(sizes, "id").filter("p_size > 25").drop("p_size"), path, "2024-02-01_080000")
    W.write_run_documents(p, path, "2024-02-02_080000")
    read = S.read_run_outputs(spark, f"{path}/*/output_*.json")
    return read.groupBy(F.col("site_url").alias("site"), "run").agg(F.count("*").alias("items"), F.sum("id").alias("ids"))


@query("SELECT url, row_number() OVER (PARTITION BY regexp_extract(lower(url), '^[a-z]+://(?:www\\.)?([^/:?#]*)', 1) ORDER BY page_id) - 1 AS pos FROM pages")
def url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses by site, written beside the sites' runs and read again."""
    path = fresh_path(spark, "lists")
    site = F.regexp_extract(F.lower("url"), r"^[a-z]+://(?:www\.)?([^/:?#]*)", 1)
    W.sync_lists(table(spark, sf_dir, "pages").select(site.alias("site"), "url", F.col("page_id").alias("pos")), path)
    return S.read_url_lists(spark, f"{path}/*/urls.json").select("url", F.col("pos").cast("long").alias("pos"))


@query("SELECT page_id, CASE page_id % 3 WHEN 2 THEN 0 ELSE 1 END AS accepted, CASE page_id % 3 WHEN 2 THEN '' ELSE url END AS first FROM pages")
def pasted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE page_id % 3 WHEN 0 THEN to_json(array(url, ' ')) WHEN 1 THEN concat('[\"', url, '\"]') ELSE concat('[\"', url, '\", \"ftp:x\"]') END")
    good, bad = S.parse_pasted_urls(table(spark, sf_dir, "pages").select("page_id", raw.alias("raw")))
    kept_rows = good.select("page_id", F.size("urls").alias("accepted"), F.col("urls")[0].alias("first"))
    return kept_rows.union(bad.select("page_id", F.lit(0), F.lit("")))


@query("SELECT p_partkey, p_name || '\\d' AS title, p_size::VARCHAR AS price FROM part")
def artifact_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON with stray backslashes, mended, as an API's product."""
    raw = F.concat(F.lit('{"name": "'), "p_name", F.lit('\\d", "price": '), F.col("p_size").cast("string"), F.lit("}"))
    p = table(spark, sf_dir, "part").select("p_partkey", S.parse_artifact(raw).alias("v"))
    fields = R.api_product(F.col("v"))
    return p.select("p_partkey", fields["title"].alias("title"), fields["price"].alias("price"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS id, CASE p_partkey % 2 WHEN 0 THEN 'price missing; ' ELSE '' END || 'availability defaulted' AS remarks FROM part")
def numbered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.expr("p_partkey % 2 = 0"), "").otherwise("1")
    p = table(spark, sf_dir, "part").select("p_partkey", F.struct("p_retailprice", "p_partkey").alias("by"), R.warned(price, F.lit("USD"), F.lit("")).alias("remarks"))
    return R.number_rows(p, "by").select("p_partkey", "id", "remarks")


_COLLECTIONS = [(0, "ring", "rings"), (1, "widget", "widgets"), (2, "red", "colours"), (3, "small", "sizes"), (4, "blue", "colours")]


@query(f"""
WITH k(ord, keyword, collection) AS (VALUES {", ".join(map(str, _COLLECTIONS))}), hits AS (SELECT p_partkey, collection, min(ord) AS ord FROM part, k WHERE contains(lower(p_name), keyword) GROUP BY p_partkey, collection)
SELECT p_partkey AS query_id, collection, row_number() OVER (PARTITION BY p_partkey ORDER BY ord) AS place FROM hits
""")
def link_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"))
    return L.keyword_collections(asked, spark.createDataFrame(_COLLECTIONS, "ord int, keyword string, collection string"))


@query("""
WITH l AS (SELECT user_id AS site, day(ts) AS page_no, props AS href FROM events), f AS (SELECT site, href, min(page_no) AS page_no FROM l GROUP BY ALL
), s AS (SELECT site, min(page_no) AS stop FROM (SELECT DISTINCT site, page_no FROM l) ANTI JOIN f USING (site, page_no) GROUP BY site)
SELECT site, page_no, href FROM f LEFT JOIN s USING (site) WHERE stop IS NULL OR page_no < stop
""")
def link_pages_until_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = table(spark, sf_dir, "events").select(F.col("user_id").alias("site"), F.dayofmonth("ts").cast("long").alias("page_no"), F.col("props").alias("href"))
    return L.pages_until_nothing_new(listing).select("site", "page_no", "href")
