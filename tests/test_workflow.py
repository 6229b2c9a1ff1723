"""Threads, decisions, paging, watchdog tables, run documents and JSON in free text, on small golden cases."""

import json

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import jsonld as J
from quarrymill.operators import decisions, history, links, threads
from quarrymill.sources import documents, files


def _threads(spark, rows):
    return threads.placed_posts(spark.createDataFrame(rows, "thread string, post long, parent long, text string"))


def test_threads_of_any_depth(spark):
    deep = [("deep", i, i - 1 if i else None, f"t{i}") for i in range(70)]
    wide = [("wide", 0, None, 'say "hi"'), ("wide", 3, 0, "c"), ("wide", 1, 0, "a"), ("wide", 2, 1, "b"), ("wide", 9, None, "z")]
    odd = [("odd", 1, 2, "x"), ("odd", 2, 1, "y"), ("odd", 3, 2, "under a cycle"), ("odd", 4, 4, "own"), ("odd", 5, 77, "orphan"), ("odd", 6, 5, "below")]
    placed = _threads(spark, deep + wide + odd).cache()
    got = {(r.thread, r.post): (r.depth, r.problem) for r in placed.collect()}
    assert all(got["deep", i] == (i, "") for i in range(70))
    assert {k[1]: v for k, v in got.items() if k[0] == "odd"} == {1: (None, "cycle"), 2: (None, "cycle"), 3: (None, "cycle"), 4: (None, "cycle"), 5: (0, "orphan"), 6: (1, "")}
    trees = {r.thread: r for r in threads.nested_threads(placed, F.struct("post", "text")).collect()}
    assert json.loads(trees["wide"].tree) == [
        {"post": 0, "text": 'say "hi"', "replies": [{"post": 1, "text": "a", "replies": [{"post": 2, "text": "b", "replies": []}]}, {"post": 3, "text": "c", "replies": []}]},
        {"post": 9, "text": "z", "replies": []},
    ]
    assert (trees["deep"].posts, trees["deep"].replies, trees["deep"].deepest) == (70, 69, 69)
    level = json.loads(trees["deep"].tree)
    for i in range(70):
        assert level[0]["post"] == i
        level = level[0]["replies"]
    assert json.loads(trees["odd"].tree) == [{"post": 5, "text": "orphan", "replies": [{"post": 6, "text": "below", "replies": []}]}]
    bare = threads.nested_threads(placed.filter("thread = 'odd'"), F.struct(F.lit(None).cast("string").alias("none"))).head()
    assert json.loads(bare.tree) == [{"replies": [{"replies": []}]}]
    assert _threads(spark, []).collect() == []


def test_decisions(spark):
    rules = decisions.rule_table(spark)
    cases = [
        ("testing_exhausted", "approve", "Provide feedback for final retry", "do", "scraper_analyzer"), ("testing_exhausted", "approve", "Provide feedback for final retry", "", "field_confirmation"),
        ("testing_exhausted", "approve", "Something", "do", "field_confirmation"), ("low_confidence", "approve", "whatever", None, "product_analyzer"), ("low_confidence", "no", "Start again", None, "setup_workspace"),
        ("budget_exhausted_product", "go", "Retry with higher budget", None, "product_analyzer"), ("budget_exhausted_product", "ok", "Retry", None, "normalize_fields"), ("missing_artifact_site", "x", "Redo it", None, "site_analyzer"),
        ("missing_artifact_site", "x", None, None, "__end__"), ("playwright_unavailable", "x", "Use probe_html", None, "navigation_synthesize"), ("re_scrape", "reject", "x", None, "__end__"), ("pre_execution", "", "", None, "run_execution"),
        ("unheard", "x", "y", None, "cleanup"), (None, None, None, None, "cleanup"),
    ]
    answers = spark.createDataFrame(cases, "reason string, decision string, label string, feedback string, want string")
    got = decisions.routes(answers, rules, F.lit(0)).collect()
    assert len(got) == len(cases) and [(tuple(r[:4]), r.target) for r in got if r.want != r.target] == []
    again = spark.createDataFrame([(1, i, "re_scrape" if i % 2 else "review", "x", None, None) for i in range(14)], "job int, at int, reason string, decision string, label string, feedback string")
    told = {r.at: (r.resumes, r.target) for r in decisions.replayed(again, rules, "job", "at").collect()}
    assert told[9] == (4, "setup_workspace") and told[11] == (5, "cleanup") and told[8] == (4, "run_execution") and told[10] == (5, "cleanup")
    own = decisions.rule_table(spark, [("a", "*", None, "mine"), ("*", "*", None, "other")])
    assert {r.target for r in decisions.routes(answers.withColumn("reason", F.lit("a")).filter("decision = 'go'"), own, F.lit(0)).collect()} == {"mine"}


@pytest.mark.parametrize(
    "rounds, total, want",
    [
        ([["a", "b"], ["c"], ["d"]], 3, (2, 3, "total")), ([["a"], ["a"], ["b"]], None, (2, 1, "nothing_new")), ([["a"], None, None, ["b"], None, None, None, ["c"]], None, (7, 2, "empty_rounds")),
        ([["a"], None, ["b"]], 9, (3, 2, "end")), ([["a", "a"]], 1, (1, 1, "total")),
    ],
)
def test_accumulated_paging(spark, rounds, total, want):
    """A round that is None was scrolled to and brought nothing."""
    rows = [("s", i, h, r is None) for i, r in enumerate(rounds) for h in (r or [None])]
    listing = spark.createDataFrame(rows, "site string, round int, href string, scrolled boolean")
    found, account = links.accumulated(listing, spark.createDataFrame([("s", total)], "site string, total int"))
    assert [(r.rounds, r.links, r.stopped) for r in account.collect()] == [want]
    assert found.count() == want[1]


def test_watchdog_changes_tables_once(spark):
    jobs = spark.createDataFrame([(1, "running", "2024-01-01 00:00:00"), (2, "running", "2024-01-01 00:00:00"), (3, "waiting_approval", "2024-01-01 00:00:00")], "job int, status string, at string")
    jobs = jobs.select("job", "status", F.to_timestamp("at").alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"), F.lit(None).cast("string").alias("error_message"))
    steps = spark.createDataFrame([(1, "running"), (1, "completed"), (1, "pending"), (2, "running")], "job int, status string").withColumn("completed_at", F.lit(None).cast("timestamp"))
    logs = spark.createDataFrame([(2, "2024-01-01 09:50:00"), (1, "2024-01-01 09:00:00")], "job int, ts string").withColumn("ts", F.to_timestamp("ts"))
    once = history.fail_stuck(jobs, steps, logs, "2024-01-01 10:00:00")
    assert sorted((r.job, r.status, r.error_message) for r in once[0].collect()) == [(1, "failed", "Worker process crashed (no activity for 60 min). Likely OOM killed."), (2, "running", None), (3, "waiting_approval", None)]
    assert sorted((r.job, r.status, r.completed_at is not None) for r in once[1].collect()) == [(1, "completed", False), (1, "failed", True), (1, "failed", True), (2, "running", False)]
    assert [tuple(r) for r in once[2].collect()] == [(1, "failed")]
    twice = history.fail_stuck(once[0], once[1], logs, "2024-01-01 11:00:00")
    assert {r.job for r in twice[2].collect()} == {2} and twice[0].filter("job = 1").head() == once[0].filter("job = 1").head()
    assert sorted(twice[1].filter("job = 1").collect()) == sorted(once[1].filter("job = 1").collect())


def test_approvals(spark):
    rows = [(10, 1, "pending", "2024-01-01 09:00:00"), (11, 2, "pending", "2024-01-01 09:00:00"), (12, 1, "pending", "2024-01-01 09:55:00"), (13, 1, "rejected", "2024-01-01 08:00:00")]
    approvals = spark.createDataFrame(rows, "approval int, job int, status string, at string").select("approval", "job", "status", F.to_timestamp("at").alias("created_at"), F.lit(None).cast("string").alias("human_response"), F.lit(None).cast("timestamp").alias("resolved_at"))
    jobs = spark.createDataFrame([(1, "waiting_approval", True), (2, "waiting_approval", False)], "job int, status string, auto_queued boolean")
    given, resumed = history.auto_approve(approvals, jobs, "2024-01-01 10:00:00")
    assert sorted((r.approval, r.status) for r in given.collect()) == [(10, "approved"), (11, "pending"), (12, "pending"), (13, "rejected")]
    assert [r.job for r in resumed.collect()] == [1]
    assert history.auto_approve(given, jobs, "2024-01-01 10:00:00")[1].collect() == []


def test_issues_are_cut_before_the_shuffle(spark):
    issues = spark.createDataFrame([(1, "high", f"d{i}", i) for i in range(9)] + [(1, "medium", f"m{i}", i) for i in range(4)] + [(1, "low", "x", 0), (2, "high", "only", 0)], "job int, severity string, description string, at int")
    got = history.issue_summary(issues, "job", ["at"])
    assert {(r.job, r.severity): (r.n, r.first) for r in got.collect()} == {(1, "high"): (9, [f"d{i}" for i in range(5)]), (1, "medium"): (4, ["m0", "m1", "m2"]), (2, "high"): (1, ["only"])}
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_merge_reduces_new_rows_first(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (1, ""), (1, None), (2, "")], "k int, v string")
    assert sorted(tuple(r) for r in history.merge_output(old, new, "k", ["v"]).collect()) == [(1, "x"), (2, "b")]


def test_run_documents_are_whole(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([("https://www.a.com/x", 2, 'say "b"', None), ("https://www.a.com/x", 1, "a", "1"), ("https://b.com", 1, "c", "2"), ("https://b-com", 1, "d", "3")], "site string, id long, title string, price string")
    meta = spark.createDataFrame([("https://empty.com", ("x",))], "site string, metadata struct<note:string>")
    made = documents.write_run_documents(rows, path, "2024-01-01_000000", metadata=meta)
    assert [m.split("/")[0].rsplit("-", 1)[0] if m.startswith("b-com-") else m.split("/")[0] for m in made] == ["a-com-x", "b-com", "b-com", "empty-com"]
    read = json.loads((tmp_path / "out" / "a-com-x" / "output_2024-01-01_000000.json").read_text())
    assert read == {"site": {"url": "https://www.a.com/x"}, "metadata": {}, "products": [{"id": 1, "title": "a", "price": "1"}, {"id": 2, "title": 'say "b"', "price": None}]}
    assert json.loads((tmp_path / "out" / "empty-com" / "output_2024-01-01_000000.json").read_text())["products"] == []
    assert documents.finished_runs(spark, path) == ["2024-01-01_000000"]
    assert files.read_run_outputs(spark, f"{path}/*/output_*.json").count() == 4
    documents.write_run_documents(rows.limit(1), path, "2024-01-01_000000")
    assert documents.finished_runs(spark, path) == ["2024-01-01_000000"]


def test_a_failed_task_leaves_no_document(spark, tmp_path):
    @F.udf("string")
    def broken(title):
        raise ValueError("on purpose")

    rows = spark.createDataFrame([("https://a.com", 1, "a")], "site string, id long, title string").withColumn("title", broken("title"))
    with pytest.raises(Exception, match="on purpose"):
        documents.write_run_documents(rows, f"file://{tmp_path}/out", "2024-01-01_000000")
    assert not list((tmp_path / "out").rglob("*.json")) if (tmp_path / "out").exists() else True
    assert documents.finished_runs(spark, f"file://{tmp_path}/out") == []


def test_lists_beside_runs(spark, tmp_path):
    rows = spark.createDataFrame([("a.com", "https://a.com/2", 2), ("a.com", 'https://a.com/1?q="x"', 1)], "site string, url string, pos int")
    assert documents.sync_lists(rows, f"file://{tmp_path}") == ["a-com/urls.json"]
    assert json.loads((tmp_path / "a-com" / "urls.json").read_text()) == {"urls": ['https://a.com/1?q="x"', "https://a.com/2"]}
    documents.sync_lists(rows.filter("pos = 2"), f"file://{tmp_path}")
    assert [r.url for r in files.read_url_lists(spark, f"file://{tmp_path}/*/urls.json").collect()] == ["https://a.com/2"]


def test_json_in_free_text(spark):
    said = [
        ('see {this} and {"a": "} { \\" }", "b": {"c": []}} then {"a": 2}', '{"a":"} { \\" }","b":{"c":[]}}'), ('### Result\n"{\\"n\\": 1}"\n### Ran', '{"n":1}'), ("### Result\nnot json\n{\"z\": 1}", '{"z":1}'),
        ("### Result\n```json\n{\"a\": [1, 2]}\n```", '{"a":[1,2]}'), ("nothing { here", None), (None, None), ("", None), ("{" * 3000, None),
    ]
    got = spark.createDataFrame(said, "raw string, want string").select("raw", "want", F.to_json(files.embedded_json(F.col("raw"))).alias("got")).collect()
    assert [(r.raw, r.got) for r in got if r.got != r.want] == []
    v = spark.createDataFrame([('{"Offers": {"price": ""}, "offers": {"Price": 7}}',), ('{"offers": 3}',)], "j string").select(J.any_case(F.parse_json("j"), "offers", "price").alias("p"))
    assert [r.p for r in v.collect()] == ["7", ""]
