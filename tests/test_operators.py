"""Links, records, history, gates, sources and plans."""

import json

from pyspark.sql import functions as F

from quarrymill import schemas
from quarrymill.operators import gates, history, links, records
from quarrymill.sources import files
from quarrymill.streaming import feeds


def test_link_operators(spark):
    found = spark.createDataFrame([(1, 0, "a", 0), (1, 0, "b", 1), (1, 1, "c", 0), (1, 1, "a", 1), (1, 2, "d", 0), (2, 0, "x", 0)], "page_id int, strategy int, href string, pos int")
    got = links.strategy_cascade(found).orderBy("page_id", "place").select("page_id", "href").collect()
    assert [tuple(r) for r in got] == [(1, "a"), (1, "b"), (1, "c"), (2, "x")]
    listing = spark.createDataFrame([("s", 1, "a"), ("s", 1, "b"), ("s", 2, "b"), ("s", 3, "c")], "site string, page_no int, href string")
    assert sorted(r.href for r in links.pages_until_nothing_new(listing).collect()) == ["a", "b"]
    cards = spark.createDataFrame([(1, "g", str(i), i) for i in range(3)] + [(1, "h", "z", 9)], "page_id int, parent string, href string, pos int")
    assert links.largest_grid(cards).count() == 3
    words = spark.createDataFrame([(0, "ring", "rings"), (1, "gold", "gold"), (2, "old", "gold")], "ord int, keyword string, collection string")
    asked = spark.createDataFrame([(1, "Gold ring")], "query_id int, query string")
    assert [r.collection for r in links.keyword_collections(asked, words).orderBy("place").collect()] == ["rings", "gold"]
    page = spark.createDataFrame([(1, "https://a.com/x", '<a href="/shoes">Shoes</a><a href="https://b.com/">B</a><a href="/cart">Cart</a>')], "page_id int, url string, html string")
    assert [r.href for r in links.links_with_fallback(page).collect()] == ["https://a.com/shoes"]


def test_record_helpers(spark):
    rows = spark.createDataFrame([("b",), ("a",)], "url string")
    assert [tuple(r) for r in records.number_rows(rows, "url").collect()] == [("a", 1), ("b", 2)]
    m = spark.range(1).select(records.merge_fields(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"), F.lit("c"), F.lit("")), F.create_map(F.lit("a"), F.lit("9"), F.lit("d"), F.lit("4"))).alias("m"))
    assert m.head().m == {"a": "1", "b": "3", "d": "4"}


def test_history(spark):
    cache = spark.createDataFrame([("d", "http", "2024-01-01 00:00:00", 1)], "domain string, method string, cached_at string, used int").withColumn("cached_at", F.to_timestamp("cached_at"))
    newer = cache.withColumn("method", F.lit("browser")).withColumn("cached_at", F.col("cached_at") + F.expr("INTERVAL 5 HOURS")).withColumn("used", F.lit(2))
    merged = history.upsert(cache, newer, ["domain"], "used", insert_only=["cached_at"])
    assert merged.head().method == "browser"
    assert history.unexpired(merged, "2024-01-01 05:00:00").count() == 0
    assert history.unexpired(merged, "2024-01-01 04:00:00").count() == 1


def test_gates(spark):
    t = spark.range(1)
    assert t.select(gates.service_health(F.lit(None).cast("int"), F.lit(True)), gates.service_health(F.lit(10), F.lit(True)), gates.service_health(F.lit(900), F.lit(True))).head()[:] == ("unknown", "up", "degraded")
    assert t.select(gates.extended_budget(F.lit(45), F.lit(6)), gates.extended_budget(F.lit(45), F.lit(2))).head()[:] == (50, 45)
    assert t.select(gates.decision(F.lit('{"decision": "Approve"}')), gates.decision(F.lit("stop")), gates.input_mode(F.lit("url_list"), F.lit("x"))).head()[:] == ("Approve", "stop", "search_term")
    said = spark.createDataFrame([(x,) for x in ("Cancel", '{"choice": "Abort"}', '{"decision": "reject"}', '{"response": "go on"}', "{}", "whatever", "cancel", None)], "p string").select(gates.decision(F.col("p")).alias("d"))
    assert [r[:] for r in said.select(gates.is_cancel(F.col("d")), gates.is_approve(F.col("d"))).collect()] == [(True, False), (True, False), (True, True), (False, True), (False, True), (False, True), (False, True), (True, False)]
    ends = [("captcha_blocked", "boom", "FAILED"), ("akamai_blocked", None, None), ("blocked", None, "DONE"), ("running", "boom", None), ("running", "", "FAILED"), (None, None, None)]
    got = spark.createDataFrame(ends, "s string, e string, x string").select(gates.final_status(F.col("s"), F.col("e"), F.col("x")))
    assert [r[0] for r in got.collect()] == ["captcha_blocked", "akamai_blocked", "completed", "failed", "failed", "completed"]


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"urls": ["https://a.com", " ", "https://b.com"]}, indent=1))
    lists = files.read_url_lists(spark, str(tmp_path / "in"))
    assert [r.url for r in lists.orderBy("pos").collect()] == ["https://a.com", "https://b.com"]
    (tmp_path / "runs").mkdir()
    for name, n in (("output_2024-01-01_000000.json", 1), ("output_2024-01-02_000000.json", 2)):
        (tmp_path / "runs" / name).write_text(json.dumps({"site": {"url": "s"}, "products": [{"title": str(i)} for i in range(n)]}))
    assert files.read_run_outputs(spark, str(tmp_path / "runs")).count() == 3
    assert files.read_run_outputs(spark, str(tmp_path / "runs"), latest=True).count() == 2
    assert sorted(r["items"] for r in files.count_items(spark, str(tmp_path / "runs")).collect()) == [1, 2]
    good, bad = files.parse_pasted_urls(spark.createDataFrame([('["https://a.com", ""]',), ("nope",), ('["x"]',)], "raw string"))
    assert (good.count(), bad.count()) == (1, 2)
    repaired = spark.createDataFrame([('{"a": "b\\c"}',), ('{"a": 1}',), ("x",)], "raw string").select(F.to_json(files.parse_artifact(F.col("raw"))).alias("v"))
    assert [r.v for r in repaired.collect()] == ['{"a":"b\\\\c"}', '{"a":1}', None]
    said = spark.createDataFrame([('text\n### Result\n{"a": 1}\n### More',), ('note {"b": {"c": 2}} end',)], "raw string")
    assert [r.v for r in said.select(F.to_json(files.embedded_json(F.col("raw"))).alias("v")).collect()] == ['{"a":1}', '{"b":{"c":2}}']
    assert files.search_text(spark, str(tmp_path / "in"), "b\\.com").count() == 1
    pages = spark.createDataFrame([("s", 1, [("a",), ("b",)]), ("s", 2, [("b",)]), ("s", 3, [("c",)])], "site string, page_no int, items array<struct<url:string>>")
    assert sorted(r.url for r in files.fold_api_pages(pages, "site", "page_no", "items", "url", 2).collect()) == ["a", "b"]


def test_schemas(spark):
    assert {"title string", "price string"} <= set(schemas.record_schema("product").split(", "))
    for name in schemas.FIELDS:
        spark.createDataFrame([], schemas.record_schema(name))
    assert schemas.content_types(spark).count() == 6


def test_choices_and_field_lines(spark):
    assert [tuple(r)[1:] for r in schemas.choices(spark).orderBy("ord").limit(4).collect()] == [("product", "Shopping: Product"), ("product_list", "Shopping: Product List"), ("product_navigation", "Shopping: Product Navigation"), ("article", "Articles: Article")]
    assert schemas.choices(spark).count() == 11 == len(schemas.PAGE_TYPES)
    lines = {r.content_type: r.lines.split("\n") for r in schemas.field_lines(spark).collect()}
    assert lines["serp"][0] == "- rank: number (required)" and len(lines["product"]) == 10


def test_links_merge_and_real_links(spark):
    page = spark.createDataFrame([(1, "https://a.com/p/1", "One"), (1, "https://a.com/p/2", "Two"), (1, "https://a.com/p/3", "Three"), (1, "https://a.com/sale", "Sale"), (2, "https://a.com/p/1", "One")], "page_id int, href string, text string")
    assert {(r.page_id, r.has_real_links) for r in links.has_real_links(page, page.limit(0)).collect()} == {(1, True), (2, False)}
    more = spark.createDataFrame([(1, "https://a.com/p/1", "again"), (2, "https://a.com/p/9", "new")], "page_id int, href string, text string")
    assert links.merge_new(page, more).count() == 6


def test_file_lists_and_runs(spark, tmp_path):
    urls = spark.createDataFrame([("s", 1, "https://a"), ("s", 0, "https://b"), ("t", 0, "https://c")], "site string, pos int, url string")
    files.write_url_list(urls, f"file://{tmp_path}/lists", "site", "pos")
    assert sorted((r.pos, r.url) for r in files.read_url_lists(spark, f"file://{tmp_path}/lists").collect()) == [(0, "https://b"), (0, "https://c"), (1, "https://a")]
    for name in ("output_2024-01-01_000000.json", "output_2024-01-02_000000.json", "other.json"):
        (tmp_path / "runs").mkdir(exist_ok=True)
        (tmp_path / "runs" / name).write_text("{}")
    listed = files.list_files(spark, f"file://{tmp_path}/runs", "*.json")
    assert [r.file for r in listed.collect()] == ["output_2024-01-02_000000.json", "output_2024-01-01_000000.json", "other.json"]
    assert sorted(r.file for r in files.runs_since(listed, F.lit("2024-01-02 00:01:00").cast("timestamp")).collect()) == ["other.json", "output_2024-01-02_000000.json"]


def test_no_python_in_column_queries(spark, sf_dir):
    from quarrymill.registry import QUERIES

    for name in ("page_facts", "url_country", "jsonld_blocks", "record_product", "page_links_nav", "agent_summary"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
    plan = QUERIES["recent_jobs"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint" in plan


def test_drained_rows_lie_in_the_shared_folder(spark, sf_dir):
    events = feeds.read_stream(spark, f"{sf_dir}/events.parquet")
    shared = spark.conf.get("spark.checkpoint.dir")
    for got in (feeds.drain(events.select("event_id"), "append"), feeds.drain(events.groupBy("event_type").count(), "complete")):
        assert got.inputFiles() and all(f.replace("///", "/").startswith(shared.replace("///", "/")) for f in got.inputFiles())
