"""Operations history: logs, steps, jobs, caches. Joins, sequence numbers, budgets, timeouts and rebuilt tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sequence(logs: DataFrame, job: str, order: Sequence[str]) -> DataFrame:
    """``seq`` from 0 on within a job."""
    return logs.withColumn("seq", (F.row_number().over(Window.partitionBy(job).orderBy(*order)) - 1).cast("long"))


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key the row that comes last, with a mergeable aggregate instead of a sort of all rows."""
    return df.groupBy(*key).agg(F.max(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in columns])).alias("m")).select(*key, *[F.col(f"m._{c}").alias(c) for c in columns])


def log_page(logs: DataFrame, after: int, size: int) -> DataFrame:
    """One page of every job's feed: the rows after ``after``, at most ``size``."""
    return logs.filter(F.col("seq") > after).filter(F.col("seq") <= after + size)


def suffix_in_budget(messages: DataFrame, conv: str, order: str, role: str, text: str, budget: int) -> DataFrame:
    """The newest messages that fit beside the system ones, up to the first that doesn't; system messages always stay."""
    size = F.length(text)
    system = F.sum(F.when(F.col(role) == "system", size).otherwise(0)).over(Window.partitionBy(conv))
    newest = Window.partitionBy(conv).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = F.sum(F.when(F.col(role) == "system", 0).otherwise(size)).over(newest)
    return messages.withColumn("_system", system).withColumn("_used", used).filter((F.col(role) == "system") | (F.col("_used") <= budget - F.col("_system"))).drop("_system", "_used")


def prefix_in_budget(messages: DataFrame, conv: str, order: str, text: str, budget: int, least: int = 100) -> DataFrame:
    """Messages in order until the budget ends; the one that crosses it is cut if more than ``least`` is left."""
    before = Window.partitionBy(conv).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget) - F.coalesce(F.sum(F.length(text)).over(before), F.lit(0))
    kept = messages.withColumn("_left", left).filter((F.length(text) <= F.col("_left")) | (F.col("_left") > least))
    cut = F.when(F.length(text) <= F.col("_left"), F.col(text)).otherwise(F.concat(F.substring(text, F.lit(1), F.col("_left").cast("int")), F.lit("\n[...truncated]")))
    return kept.withColumn(text, cut).drop("_left")


def pair_calls(calls: DataFrame, results: DataFrame, key: str, order: str) -> DataFrame:
    """Every call with its last result, or without one."""
    last = results.groupBy(key).agg(F.max_by("result", order).alias("result"))
    return calls.join(last, key, "left")


def first_success(attempts: DataFrame, domain: str) -> DataFrame:
    """``attempts`` (domain, method, rank, success, wall): the method of the first success, unless a wall comes before."""
    end = attempts.filter("success OR wall").groupBy(domain).agg(F.min(F.struct("rank", (~F.col("success")).alias("walled"), "method")).alias("m"))
    tried = attempts.groupBy(domain).agg(F.count("*").alias("attempts"))
    return tried.join(end, domain, "left").select(domain, "attempts", F.when(~F.col("m.walled"), F.col("m.method")).otherwise("").alias("method"), F.coalesce("m.walled", F.lit(False)).alias("walled"))


def first_success_by_class(attempts: DataFrame, domain: str, kind: Column) -> DataFrame:
    """The first method that worked, and the first of the other class that worked after it."""
    good = attempts.filter("success").withColumn("_kind", kind)
    first = good.groupBy(domain).agg(F.min(F.struct("rank", "method", "_kind")).alias("a"))
    later = good.join(first, domain).filter((F.col("_kind") != F.col("a._kind")) & (F.col("rank") > F.col("a.rank")))
    second = later.groupBy(domain).agg(F.min(F.struct("rank", "method")).alias("b"))
    return first.join(second, domain, "left").select(domain, F.col("a.method").alias("first_method"), F.coalesce("b.method", F.lit("")).alias("second_method"))


def stuck_jobs(jobs: DataFrame, logs: DataFrame, as_of: str, idle_minutes: int = 15) -> DataFrame:
    """Running ``jobs`` (job, started_at) whose last log, or start without logs, is too long ago."""
    last = logs.groupBy("job").agg(F.max("ts").alias("last_log"))
    seen = jobs.join(last, "job", "left").withColumn("last_activity", F.coalesce("last_log", "started_at"))
    idle = F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last_activity")) / 60)
    return seen.withColumn("idle_minutes", idle).filter(F.col("last_activity") < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {idle_minutes} MINUTES"))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], order: str, insert_only: Sequence[str] = ()) -> DataFrame:
    """A rebuilt table: per key the newest row; ``insert_only`` columns keep the value of the first row."""
    rows = old.unionByName(new)
    others = [c for c in rows.columns if c not in key]
    picked = [(F.min_by if c in insert_only else F.max_by)(c, order).alias(c) for c in others if c != order]
    return rows.groupBy(*key).agg(*picked, F.max(order).alias(order)).select(*rows.columns)


def unexpired(cache: DataFrame, as_of: str, hours: int = 4) -> DataFrame:
    return cache.filter(F.col("cached_at") + F.expr(f"INTERVAL {hours} HOURS") >= F.lit(as_of).cast("timestamp"))


def step_timeline(events: DataFrame, key: Sequence[str], running: str, done: Sequence[str]) -> DataFrame:
    """When a phase first ran and when it first ended."""
    return events.groupBy(*key).agg(
        F.min(F.when(F.col("status") == running, F.col("ts"))).alias("started_at"), F.min(F.when(F.col("status").isin(*done), F.col("ts"))).alias("completed_at")
    )


def changes(events: DataFrame, key: str, order: Sequence[str], state: str) -> DataFrame:
    """Only the rows whose state differs from the one before."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.col(state))).drop("_before")


def schedule(sites: DataFrame, active: DataFrame) -> DataFrame:
    """Nothing while a job is active; else the oldest new site, else the failed site that was updated longest ago."""
    ready = sites.filter("status IN ('new', 'failed') AND n_urls > 0")
    order = F.struct(F.when(F.col("status") == "new", 0).otherwise(1), F.when(F.col("status") == "new", F.col("created_at")).otherwise(F.col("updated_at")), "site")
    pick = ready.agg(F.min_by("site", order).alias("site"))
    busy = active.agg(F.count("*").alias("n"))
    return pick.join(F.broadcast(busy)).select(F.when(F.col("n") > 0, "skipped").when(F.col("site").isNull(), "idle").otherwise("queued").alias("action"), F.when(F.col("n") == 0, F.col("site")).alias("site"))


def import_new(existing: DataFrame, fixture: DataFrame, key: str) -> DataFrame:
    return fixture.join(existing.select(key).distinct(), key, "left_anti")


def delete_cascade(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def merge_output(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """New values where they are not empty, the old ones otherwise. Of several new rows of a key each column takes the largest value."""
    n = new.groupBy(key).agg(*[F.max(F.nullif(c, F.lit(""))).alias(f"_{c}") for c in columns])
    return old.join(n, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def fail_stuck(jobs: DataFrame, steps: DataFrame, logs: DataFrame, as_of: str, idle_minutes: int = 15) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(jobs, steps, messages)`` after the watchdog: running jobs that were silent for too long fail, and with them their open steps.

    ``jobs`` (job, status, started_at, completed_at, error_message) and ``steps`` (job, status, completed_at) are rebuilt as
    a whole, so that a second run finds nothing to do; ``messages`` (job, status) are what is to be told of it.
    """
    stuck = stuck_jobs(jobs.filter("status = 'running'").select("job", "started_at"), logs, as_of, idle_minutes).select("job", F.col("idle_minutes").alias("_idle"))
    now, failed = F.lit(as_of).cast("timestamp"), F.col("_idle").isNotNull()
    said = F.format_string("Worker process crashed (no activity for %d min). Likely OOM killed.", "_idle")
    marked = jobs.join(stuck, "job", "left")
    new_jobs = marked.withColumns({"status": F.when(failed, "failed").otherwise(F.col("status")), "completed_at": F.when(failed, now).otherwise(F.col("completed_at")), "error_message": F.when(failed, said).otherwise(F.col("error_message"))})
    open_step = failed & F.col("status").isin("running", "pending")
    new_steps = steps.join(stuck, "job", "left").withColumns({"completed_at": F.when(open_step, now).otherwise(F.col("completed_at")), "status": F.when(open_step, "failed").otherwise(F.col("status"))})
    return new_jobs.select(*jobs.columns), new_steps.select(*steps.columns), stuck.select("job", F.lit("failed").alias("status"))


def auto_approve(approvals: DataFrame, jobs: DataFrame, as_of: str, minutes: int = 10) -> tuple[DataFrame, DataFrame]:
    """``(approvals, resumed)``: approvals that waited too long for jobs that were queued by the machine are given; ``resumed`` are their jobs.

    ``approvals`` (approval, job, status, created_at, human_response, resolved_at) is rebuilt as a whole.
    """
    waiting = jobs.filter("status = 'waiting_approval' AND auto_queued").select("job", F.lit(True).alias("_waits"))
    now = F.lit(as_of).cast("timestamp")
    due = F.coalesce("_waits", F.lit(False)) & (F.col("status") == "pending") & (F.col("created_at") < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    marked = approvals.join(waiting, "job", "left").withColumn("_due", F.coalesce(due, F.lit(False)))
    given = {"status": F.when(F.col("_due"), "approved").otherwise(F.col("status")), "human_response": F.when(F.col("_due"), "auto-approved").otherwise(F.col("human_response")), "resolved_at": F.when(F.col("_due"), now).otherwise(F.col("resolved_at"))}
    return marked.withColumns(given).select(*approvals.columns), marked.filter("_due").select("job").distinct()


def issue_summary(issues: DataFrame, job: str, order: Sequence[str], shown: dict[str, int] | None = None) -> DataFrame:
    """``(job, severity, n, first)``: issues of each severity and the first few, five high and three medium ones.

    Counts merge before the shuffle; the first few are cut by rank before it as well, so that no severity of a job is sorted as a whole.
    """
    shown = shown or {"high": 5, "medium": 3}
    own = issues.filter(F.col("severity").isin(*shown))
    counts = own.groupBy(job, "severity").agg(F.count("*").alias("n"))
    limit = F.coalesce(*[F.when(F.col("severity") == s, k) for s, k in shown.items()])
    place = F.row_number().over(Window.partitionBy(job, "severity").orderBy(*order))
    top = own.withColumn("_place", place).filter(F.col("_place") <= max(shown.values())).filter(F.col("_place") <= limit)
    first = top.groupBy(job, "severity").agg(F.array_sort(F.collect_list(F.struct("_place", "description"))).alias("f"))
    return counts.join(first, [job, "severity"]).select(job, "severity", "n", F.transform("f", lambda x: x["description"]).alias("first"))


def duration_seconds(started: Column, completed: Column) -> Column:
    """Seconds between two times; 0 if one of them isn't there."""
    return F.coalesce((F.unix_micros(completed) - F.unix_micros(started)) / 1_000_000, F.lit(0.0))


def faceted(rows: DataFrame, facets: dict[str, object], term: str = "", searched: Sequence[str] = ()) -> DataFrame:
    """Rows with all of the facets' values and, if there is a term, that hold it in one of the searched columns in any case."""
    for column, value in facets.items():
        rows = rows.filter(F.col(column) == value)
    if term:
        hits = [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(term.lower())) for c in searched]
        rows = rows.filter(F.greatest(*hits) if len(hits) > 1 else hits[0])
    return rows


def progress(rows: DataFrame, job: str, order: Sequence[str], every: int = 25) -> DataFrame:
    """``(job, done, total, percent)``: a mark after every so many of a job's rows and after its last."""
    place = F.row_number().over(Window.partitionBy(job).orderBy(*order))
    totals = rows.groupBy(job).agg(F.count("*").alias("total"))
    marks = rows.select(job, place.cast("long").alias("done")).join(totals, job).filter((F.col("done") % every == 0) | (F.col("done") == F.col("total")))
    return marks.select(job, "done", "total", F.floor(100 * F.col("done") / F.col("total")).alias("percent"))


def fresh(saved_at: Column, as_of: str, hours: int = 4) -> Column:
    """Whether what was saved then is no older than so many hours."""
    return F.coalesce(F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS") <= saved_at, F.lit(False))
