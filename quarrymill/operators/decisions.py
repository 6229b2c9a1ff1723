"""Where a job goes after a human's answer: a table of rules, most specific first, replayed over each job's history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ANY = "*"
MOST_RESUMES = 5
# Answers that end a job, answers that mean going on, the label that asks for a last try, and the table itself:
# reason, word in the label, whether feedback was given (null: whatever), target. The first rule that holds counts.
CANCELS = ("Cancel", "Abort", "reject", "Cancel entire job")
APPROVES = ("approve", "yes", "ok", "continue", "continue anyway", "proceed")
LAST_TRY, GO_ON, END, DEFAULT = "provide feedback for final retry", "Continue anyway", "__end__", "cleanup"
RULES: tuple[tuple[str, str, bool | None, str], ...] = (
    ("testing_exhausted", LAST_TRY, True, "scraper_analyzer"),
    ("testing_exhausted", ANY, None, "field_confirmation"),
    ("low_confidence", "continue", None, "product_analyzer"),
    ("low_confidence", ANY, None, "setup_workspace"),
    ("budget_exhausted_site", "retry", None, "site_analyzer"),
    ("budget_exhausted_site", "higher budget", None, "site_analyzer"),
    ("budget_exhausted_site", "continue", None, "scraper_analyzer"),
    ("budget_exhausted_site", ANY, None, END),
    ("budget_exhausted_product", "retry", None, "product_analyzer"),
    ("budget_exhausted_product", "higher budget", None, "product_analyzer"),
    ("budget_exhausted_product", "continue", None, "normalize_fields"),
    ("budget_exhausted_product", ANY, None, END),
    ("budget_exhausted_navigation", "retry", None, "navigation_explore"),
    ("budget_exhausted_navigation", "higher budget", None, "navigation_explore"),
    ("budget_exhausted_navigation", "continue", None, "scraper_analyzer"),
    ("budget_exhausted_navigation", ANY, None, END),
    ("missing_artifact_site", "redo", None, "site_analyzer"),
    ("missing_artifact_site", "continue", None, "update_tracker_analysis"),
    ("missing_artifact_site", ANY, None, END),
    ("missing_artifact_product", "redo", None, "product_analyzer"),
    ("missing_artifact_product", "continue", None, "scraper_analyzer"),
    ("missing_artifact_product", ANY, None, END),
    ("missing_artifact_navigation", "redo", None, "navigation_explore"),
    ("missing_artifact_navigation", "continue", None, "scraper_analyzer"),
    ("missing_artifact_navigation", ANY, None, END),
    ("playwright_unavailable", "retry", None, "navigation_explore"),
    ("playwright_unavailable", "playwright", None, "navigation_explore"),
    ("playwright_unavailable", "probe_html", None, "navigation_synthesize"),
    ("playwright_unavailable", "continue", None, "navigation_synthesize"),
    ("playwright_unavailable", ANY, None, END),
    ("re_scrape", ANY, None, "setup_workspace"),
    ("retry_failed", ANY, None, "setup_workspace"),
    ("choose_mechanism", ANY, None, "code_writer"),
    ("low_coverage", ANY, None, "code_writer"),
    ("validation_failed", ANY, None, "field_confirmation"),
    ("reanalyze_exhausted", ANY, None, "run_execution"),
    ("pre_execution", ANY, None, "run_execution"),
    ("skill_approval", ANY, None, "skill_learner"),
    ("field_confirmation", ANY, None, "run_execution"),
    ("review", ANY, None, "run_execution"),
    (ANY, ANY, None, DEFAULT),
)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, bool | None, str]] = RULES) -> DataFrame:
    """The rules as rows, with their place as ``priority``."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "priority int, rule_reason string, word string, fed boolean, target string")


def routes(answers: DataFrame, rules: DataFrame, resumes: Column) -> DataFrame:
    """``answers`` (reason, decision, label, feedback, ...) with ``target``.

    ``resumes`` says how often the job has gone on before; from ``MOST_RESUMES`` on it is cleaned up, whatever the answer. A
    null label is the decision. The rules are joined by reason, each answer's own and the one for any, so that the table
    may grow; what the label must hold is looked at after that.
    """
    said = F.coalesce("decision", F.lit(""))
    label = F.coalesce("label", said)
    last_try = F.coalesce(F.col("reason") == "testing_exhausted", F.lit(False))
    meant = F.when(F.lower(said).isin(*APPROVES) & ~last_try, GO_ON).otherwise(label)
    whole = answers.withColumns({"_id": F.monotonically_increasing_id(), "_label": F.lower(meant), "_capped": resumes >= MOST_RESUMES, "_ended": said.isin(*CANCELS)})
    fed = F.coalesce("feedback", F.lit("")) != ""
    # A label asks for a last try only as a whole; other words may stand anywhere in it.
    holds = (F.col("word") == ANY) | F.when(F.col("word") == LAST_TRY, F.col("_label") == F.col("word")).otherwise(F.contains("_label", "word"))
    asked = whole.withColumn("rule_reason", F.explode(F.array_distinct(F.array(F.coalesce("reason", F.lit("")), F.lit(ANY)))))
    met = asked.join(rules, "rule_reason").filter(holds & (F.col("fed").isNull() | (F.col("fed") == fed)))
    best = met.groupBy("_id").agg(F.min_by("target", "priority").alias("_target"), F.any_value(F.struct(*answers.columns)).alias("_row"), F.any_value("_capped").alias("_capped"), F.any_value("_ended").alias("_ended"))
    target = F.when(F.col("_capped"), DEFAULT).when(F.col("_ended"), END).otherwise(F.col("_target"))
    return best.select("_row.*", target.alias("target"))


def replayed(history: DataFrame, rules: DataFrame, job: str, order: str) -> DataFrame:
    """``history`` of answers with ``resumes``, how many of the job's for that reason came before, and ``target``."""
    before = F.row_number().over(Window.partitionBy(job, "reason").orderBy(order)) - 1
    return routes(history.withColumn("resumes", before.cast("long")), rules, F.col("resumes"))


def resume_target(mode: Column, navigated: Column, skip_site: Column, skip_product: Column, skip_code: Column, analysed: Column) -> Column:
    """Where a resumed job enters: modes that discover addresses need that first, all others what isn't there yet."""
    discovers = mode.isin("navigation", "list_page", "search_term") & ~navigated
    return (
        F.when(discovers | ~skip_site, "site_analyzer")
        .when(~skip_product, "validate_analysis")
        .when(skip_code, "code_tester")
        .when(analysed, "code_writer")
        .otherwise("scraper_analyzer")
    )


def skip_flags(mode: Column, has_site: Column, has_product: Column, has_code: Column) -> tuple[Column, Column, Column]:
    """What a run that was in progress needn't do again: each thing that is there with all before it; nothing for navigation."""
    site = has_site & (mode != "navigation")
    product = site & has_product
    return site, product, product & has_code
