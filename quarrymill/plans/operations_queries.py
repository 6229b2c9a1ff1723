"""Queries over jobs, sites, steps, approvals and caches. ``orders`` stand for jobs, ``customer`` for sites, ``events``
for steps, probes and tool calls; every time rule takes a literal point in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill import schemas as S
from quarrymill.operators import history as O

from .catalog import query, table

STATUS = "CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE CASE o_orderkey % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'waiting_approval' END END"
AS_OF = "2001-07-30 00:00:00"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS job", "o_custkey AS site", f"{STATUS} AS status", "o_orderdate AS created_at", "o_orderpriority AS priority", "o_totalprice AS amount")


JOBS = f"(SELECT o_orderkey AS job, o_custkey AS site, {STATUS} AS status, o_orderdate AS created_at, o_orderpriority AS priority, o_totalprice AS amount FROM orders)"


@query(f"""
SELECT (SELECT count(*) FROM customer) AS sites, count(*) AS jobs, count(*) FILTER (WHERE status IN ('running', 'pending', 'waiting_approval')) AS active, count(*) FILTER (WHERE status = 'waiting_approval') AS pending_approvals,
  count(*) FILTER (WHERE created_at >= TIMESTAMP '{AS_OF}') AS today_jobs, count(*) FILTER (WHERE created_at >= TIMESTAMP '{AS_OF}' AND status = 'completed') AS today_completed,
  count(*) FILTER (WHERE created_at >= TIMESTAMP '{AS_OF}' AND status = 'failed') AS today_failed FROM {JOBS}
""")
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass per table."""
    today = F.col("created_at") >= F.lit(AS_OF).cast("timestamp")
    counts = jobs(spark, sf_dir).agg(
        F.count("*").alias("jobs"),
        F.count_if(F.col("status").isin("running", "pending", "waiting_approval")).alias("active"),
        F.count_if(F.col("status") == "waiting_approval").alias("pending_approvals"),
        F.count_if(today).alias("today_jobs"),
        F.count_if(today & (F.col("status") == "completed")).alias("today_completed"),
        F.count_if(today & (F.col("status") == "failed")).alias("today_failed"),
    )
    return counts.join(F.broadcast(table(spark, sf_dir, "customer").agg(F.count("*").alias("sites"))))


@query(f"SELECT status, count(*) AS n FROM {JOBS} GROUP BY status")
def jobs_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT job, status, site FROM {JOBS} ORDER BY created_at DESC, job DESC LIMIT 10")
def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).orderBy(F.desc("created_at"), F.desc("job")).limit(10).select("job", "status", "site")


@query(f"SELECT job, status, lower(c_name) AS site_name, CAST(n_name AS VARCHAR) AS country FROM {JOBS} JOIN customer ON site = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE status IN ('running', 'pending')")
def jobs_sites_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = jobs(spark, sf_dir).filter(F.col("status").isin("running", "pending"))
    sites = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site"), F.lower("c_name").alias("site_name"), "c_nationkey")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
    return active.join(sites, "site").join(nations, "c_nationkey", "left").select("job", "status", "site_name", "country")


@query(f"SELECT c_custkey AS site, count(job) AS jobs, count(job) FILTER (WHERE status = 'failed') AS failed, coalesce(max(created_at), TIMESTAMP '1970-01-01 00:00:00') AS last_job FROM customer LEFT JOIN {JOBS} ON lower('S' || site) = lower('s' || c_custkey) GROUP BY c_custkey")
def site_job_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites by their jobs, joined without regard to case."""
    sites = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site"), F.lower(F.concat(F.lit("s"), "c_custkey")).alias("k"))
    own = jobs(spark, sf_dir).select("job", "status", "created_at", F.lower(F.concat(F.lit("S"), "site")).alias("k"))
    last = F.coalesce(F.max("created_at"), F.lit("1970-01-01 00:00:00").cast("timestamp"))
    return sites.join(own, "k", "left").groupBy("site").agg(F.count("job").alias("jobs"), F.count_if(F.col("status") == "failed").alias("failed"), last.alias("last_job"))


@query(f"""
SELECT job, site, CAST(floor((epoch(TIMESTAMP '{AS_OF}') - epoch(created_at)) / 60) AS BIGINT) AS waited FROM {JOBS} JOIN customer ON site = c_custkey
WHERE status = 'waiting_approval' AND c_acctbal > 0 AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 10 MINUTE
""")
def stale_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("site"))
    as_of = F.lit(AS_OF).cast("timestamp")
    stale = jobs(spark, sf_dir).filter((F.col("status") == "waiting_approval") & (F.col("created_at") < as_of - F.expr("INTERVAL 10 MINUTES")))
    return stale.join(sites, "site").select("job", "site", F.floor((F.unix_timestamp(as_of) - F.unix_timestamp("created_at")) / 60).alias("waited"))


_IDLE_AS_OF = "2024-01-29 12:00:00"


@query(f"""
WITH jobs AS (SELECT c_custkey AS job, TIMESTAMP '2024-01-01 00:00:00' AS started_at FROM customer WHERE c_custkey % 3 = 0), logs AS (SELECT user_id AS job, max(ts) AS last_log FROM events WHERE ts < TIMESTAMP '{_IDLE_AS_OF}' GROUP BY user_id)
SELECT job, CAST(floor((epoch(TIMESTAMP '{_IDLE_AS_OF}') - floor(epoch(coalesce(last_log, started_at)))) / 60) AS BIGINT) AS idle_minutes FROM jobs LEFT JOIN logs USING (job) WHERE coalesce(last_log, started_at) < TIMESTAMP '{_IDLE_AS_OF}' - INTERVAL 15 MINUTE
""")
def stuck_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    running = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("job"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("started_at"))
    logs = table(spark, sf_dir, "events").filter(F.col("ts") < F.lit(_IDLE_AS_OF).cast("timestamp")).select(F.col("user_id").alias("job"), "ts")
    return O.stuck_jobs(running, logs, _IDLE_AS_OF).select("job", "idle_minutes")


@query("""
SELECT CASE WHEN n > 0 THEN 'skipped' WHEN site IS NULL THEN 'idle' ELSE 'queued' END AS action, CASE WHEN n = 0 THEN site END AS site FROM
 (SELECT arg_min(c_custkey, (CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1 END, c_acctbal, c_custkey)) AS site FROM customer WHERE c_custkey % 4 < 2 AND c_custkey % 5 > 0), (SELECT count(*) AS n FROM orders WHERE o_orderdate > TIMESTAMP '2100-01-01 00:00:00')
""")
def schedule_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = "CASE c_custkey % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'failed' ELSE 'complete' END"
    sites = table(spark, sf_dir, "customer").selectExpr("c_custkey AS site", f"{status} AS status", "c_custkey % 5 AS n_urls", "c_acctbal AS created_at", "c_acctbal AS updated_at")
    return O.schedule(sites, table(spark, sf_dir, "orders").filter("o_orderdate > TIMESTAMP '2100-01-01 00:00:00'"))


@query("SELECT user_id AS job, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_per_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "job").withColumn("at", F.col("ts"))
    return O.latest(e, ["job"], ["ts", "event_id"], ["at", "event_type"]).withColumnRenamed("at", "ts")


@query("""
WITH calls AS (SELECT event_id, user_id, floor(value)::BIGINT AS k FROM events WHERE event_type = 'click'), results AS (SELECT user_id, floor(value)::BIGINT AS k, arg_max(event_type || event_id, event_id) AS result FROM events WHERE event_type IN ('view', 'error') GROUP BY ALL)
SELECT event_id, coalesce(result, '') AS result FROM calls LEFT JOIN results USING (user_id, k)
""")
def tool_call_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("call", F.concat_ws(":", F.col("user_id").cast("string"), F.floor("value").cast("string")))
    results = e.filter(F.col("event_type").isin("view", "error")).withColumn("result", F.concat("event_type", "event_id"))
    return O.pair_calls(e.filter("event_type = 'click'"), results, "call", "event_id").select("event_id", F.coalesce("result", F.lit("")).alias("result"))


_RANK = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'error' THEN 4 ELSE 5 END"
_PROBES = f"(SELECT user_id AS domain, event_type AS method, {_RANK} AS rank, max(value) > 90 AS success, event_type = 'error' AND min(value) < 1 AS wall FROM events GROUP BY user_id, event_type)"


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("domain"), F.col("event_type").alias("method")).agg(F.max("value").alias("high"), F.min("value").alias("low"))
    return e.selectExpr("domain", "method", f"{_RANK.replace('event_type', 'method')} AS rank", "high > 90 AS success", "method = 'error' AND low < 1 AS wall")


@query(f"""
WITH p AS {_PROBES}, e AS (SELECT domain, arg_min(CASE WHEN success THEN method ELSE '' END, rank) AS method, arg_min(NOT success, rank) AS walled FROM p WHERE success OR wall GROUP BY domain)
SELECT domain, count(*) AS attempts, coalesce(any_value(e.method), '') AS method, coalesce(any_value(walled), false) AS walled FROM p LEFT JOIN e USING (domain) GROUP BY domain
""")
def probe_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.first_success(_probes(spark, sf_dir), "domain")


@query(f"""
WITH p AS (SELECT *, method IN ('signup', 'purchase') AS heavy FROM {_PROBES} WHERE success), a AS (SELECT domain, min(rank) AS r, arg_min(method, rank) AS m, arg_min(heavy, rank) AS h FROM p GROUP BY domain)
SELECT a.domain AS domain, any_value(m) AS first_method, coalesce(arg_min(p.method, p.rank), '') AS second_method FROM a LEFT JOIN p ON p.domain = a.domain AND p.heavy <> h AND p.rank > r GROUP BY a.domain
""")
def probe_two_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.first_success_by_class(_probes(spark, sf_dir), "domain", F.col("method").isin("signup", "purchase"))


@query("""
WITH c AS (SELECT user_id AS domain, min(ts) AS cached_at, max(ts) AS last_used_at, arg_max(event_type, (ts, event_id)) AS method FROM events GROUP BY user_id)
SELECT domain, method, cached_at + INTERVAL 96 HOUR >= TIMESTAMP '2024-01-05 12:00:00' AS usable FROM c
""")
def probe_cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache time is that of the first insert: later writes don't renew it."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("domain"), F.col("event_type").alias("method"), F.col("ts").alias("cached_at"), F.struct("ts", "event_id").alias("last_used_at"))
    cache = O.upsert(e.filter("pmod(last_used_at.event_id, 2) = 0"), e.filter("pmod(last_used_at.event_id, 2) = 1"), ["domain"], "last_used_at", insert_only=["cached_at"])
    fresh = O.unexpired(cache, "2024-01-05 12:00:00", 96).select("domain", F.lit(True).alias("usable"))
    return cache.join(fresh, "domain", "left").select("domain", "method", F.coalesce("usable", F.lit(False)).alias("usable"))


@query("SELECT user_id AS job, CAST(floor(value / 20) AS BIGINT) AS phase, min(ts) FILTER (WHERE event_type = 'view') AS started_at, min(ts) FILTER (WHERE event_type IN ('purchase', 'error')) AS completed_at FROM events GROUP BY ALL")
def step_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.floor(F.col("value") / 20).alias("phase"), "ts", F.col("event_type").alias("status"))
    return O.step_timeline(e, ["job", "phase"], "view", ["purchase", "error"])


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.changes(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


_T, _SC, _RM = "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END", "CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 200 END", "CASE WHEN p_partkey % 11 = 0 THEN 'Error: x' WHEN p_partkey % 3 = 0 THEN 'note' ELSE '' END"


@query(f"""
SELECT p_brand AS brand, count(*) AS n, count(*) FILTER (WHERE t <> '' AND s > 0) AS title_and_status, count(*) FILTER (WHERE t <> '' AND r = '') AS title_no_remarks, count(*) FILTER (WHERE t <> '' AND NOT starts_with(r, 'Error')) AS title_no_error, count(*) FILTER (WHERE t <> '') AS title_only
FROM (SELECT p_brand, {_T} AS t, {_SC} AS s, {_RM} AS r FROM part) GROUP BY p_brand
""")
def success_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four definitions of a successful record, counted in one pass."""
    p = table(spark, sf_dir, "part").selectExpr("p_brand AS brand", f"{_T} AS t", f"{_SC} AS s", f"{_RM} AS r")
    titled = F.col("t") != ""
    return p.groupBy("brand").agg(
        F.count("*").alias("n"),
        F.count_if(titled & (F.col("s") > 0)).alias("title_and_status"),
        F.count_if(titled & (F.col("r") == "")).alias("title_no_remarks"),
        F.count_if(titled & ~F.col("r").startswith("Error")).alias("title_no_error"),
        F.count_if(titled).alias("title_only"),
    )


@query("""
WITH fixture AS (SELECT 'https://c' || (s_suppkey * 20) || '.example.com' AS url FROM supplier), existing AS (SELECT 'https://c' || c_custkey || '.example.com' AS url FROM customer WHERE c_custkey % 2 = 0)
SELECT url, CASE WHEN url IN (SELECT url FROM existing) THEN 'skipped' ELSE 'created' END AS outcome FROM fixture
""")
def site_import_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixture = table(spark, sf_dir, "supplier").selectExpr("'https://c' || (s_suppkey * 20) || '.example.com' AS url")
    existing = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").selectExpr("'https://c' || c_custkey || '.example.com' AS url")
    created = O.import_new(existing, fixture, "url").withColumn("outcome", F.lit("created"))
    skipped = fixture.join(existing, "url", "left_semi").withColumn("outcome", F.lit("skipped"))
    return created.unionByName(skipped)


_TYPES = ", ".join(f"('{k}', '{c}', '{m}')" for k, (c, m) in S.PAGE_TYPES.items())
_ASKED = "list_element(['product_list', 'job_navigation', 'unknown_type', 'serp'], CAST(o_orderkey % 4 + 1 AS BIGINT))"


@query(f"""
WITH m(page_type, content_type, input_mode) AS (VALUES {_TYPES})
SELECT page_type, coalesce(content_type, page_type) AS content_type, coalesce(input_mode, 'url_list') AS input_mode, n FROM (SELECT {_ASKED} AS page_type, count(*) AS n FROM orders GROUP BY 1) LEFT JOIN m USING (page_type)
""")
def content_type_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.element_at(F.array(*map(F.lit, ("product_list", "job_navigation", "unknown_type", "serp"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    counted = table(spark, sf_dir, "orders").groupBy(asked.alias("page_type")).agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(S.page_types(spark)), "page_type", "left").select("page_type", F.coalesce("content_type", "page_type").alias("content_type"), F.coalesce("input_mode", F.lit("url_list")).alias("input_mode"), "n")


@query("SELECT 'product' AS content_type, CAST(10 AS BIGINT) AS fields, CAST(2 AS BIGINT) AS required UNION ALL SELECT 'article', 7, 1 UNION ALL SELECT 'job_posting', 8, 1 UNION ALL SELECT 'forum_thread', 6, 1 UNION ALL SELECT 'serp', 4, 3 UNION ALL SELECT 'page_content', 4, 1")
def content_type_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fields(spark).groupBy("content_type").agg(F.count("*").alias("fields"), F.count_if("required").alias("required"))


@query("""
SELECT o_orderkey AS job, max(l_linenumber)::BIGINT AS steps, string_agg(l_linestatus, '' ORDER BY l_linenumber, l_linestatus) AS statuses FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P' GROUP BY o_orderkey
""")
def job_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with their steps nested in order."""
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.struct("l_linenumber", "l_linestatus").alias("step"))
    own = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("job"))
    nested = own.join(steps, "job").groupBy("job").agg(F.array_sort(F.collect_list("step")).alias("steps"))
    return nested.select("job", F.array_max("steps")["l_linenumber"].cast("long").alias("steps"), F.array_join(F.transform("steps", lambda s: s["l_linestatus"]), "").alias("statuses"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return O.delete_cascade(table(spark, sf_dir, "lineitem"), gone, "l_orderkey").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


@query("SELECT c_custkey AS site, CASE WHEN c_custkey % 3 = 0 THEN 'new' || c_custkey ELSE lower(c_mktsegment) END AS platform FROM customer")
def output_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site"), F.lower("c_mktsegment").alias("platform"))
    new = old.select("site", F.when(F.expr("site % 3 = 0"), F.concat(F.lit("new"), "site")).otherwise("").alias("platform"))
    return O.merge_output(old, new, "site", ["platform"])
