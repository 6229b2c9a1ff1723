"""Quality gates and routing: pure decisions on columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrymill.functions.classify import dead_product

#: The default core of a record; it is used for every content type unless ``core`` says otherwise.
DEFAULT_CORE = ("title", "price", "availability", "original_price", "currency", "url", "src_url")
MIN_COVERAGE, MIN_CONFIDENCE, PASS_CONFIDENCE, PARTIAL_CONFIDENCE = 0.80, 0.7, 0.85, 0.5
MAX_RETRIES, FINAL_ATTEMPT = 2, 99


def coverage(fields: Column, core: Sequence[str] = DEFAULT_CORE) -> Column:
    return F.size(F.array_intersect(fields, F.array(*map(F.lit, core)))) / F.lit(float(len(core))) if core else F.lit(1.0)


def missing(fields: Column, core: Sequence[str] = DEFAULT_CORE) -> Column:
    return F.array_sort(F.array_except(F.array(*map(F.lit, core)), fields))


def coverage_gate(ratio: Column, least: float = MIN_COVERAGE) -> Column:
    return F.when(ratio >= least, "code_writer").otherwise("low_coverage")


def analysis_gate(found: Column, retries: Column, mechanisms: Column, confidence: Column) -> Column:
    return (
        F.when(~found, F.when(retries + 1 >= MAX_RETRIES, "scraper_analyzer").otherwise("low_confidence"))
        .when(mechanisms > 1, "choose_mechanism")
        .when(F.coalesce(confidence, F.lit(0.0)) < MIN_CONFIDENCE, "low_confidence")
        .otherwise("product_analyzer")
    )


def test_route(report: Column, retries: Column, verdict: Column, confidence: Column, severe: Column, valid_output: Column) -> Column:
    """Where a test report leads; a missing report, the final attempt and used-up retries come in this order."""
    final, again = retries == FINAL_ATTEMPT, retries < MAX_RETRIES
    return (
        F.when(~report, F.when(final, "cleanup").when(again, "scraper_analyzer").otherwise("cleanup"))
        .when((verdict == "PASS") & (confidence >= PASS_CONFIDENCE) & ~severe, "field_confirmation")
        .when(final, "cleanup")
        .when(again, "scraper_analyzer")
        .when((confidence >= PARTIAL_CONFIDENCE) & valid_output, "field_confirmation")
        .otherwise("human_approval")
    )


def adjusted_confidence(raw: Column, product_links: Column, selectors: Column, verified: Column, has_jsonld: Column) -> Column:
    lost = (
        F.when(product_links == 0, 0.15).otherwise(0.0)
        + F.when((selectors > 0) & (verified == 0), 0.20).otherwise(0.0)
        + F.when(~has_jsonld, 0.05).otherwise(0.0)
    )
    kept = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.coalesce(raw, F.lit(1.0)) - lost))
    return F.least(kept, F.coalesce(raw, F.lit(1.0)))


# States in which a job ends before its run, and answers that cancel.
BLOCKED_STATES = ("captcha_blocked", "akamai_blocked")
CANCEL_LABELS = ("Cancel", "Abort", "No", "stop", "Stop")
# Kinds of approval by the reason for asking; others are asked for the execution.
APPROVAL_TYPES = {
    "re_scrape": "re_scrape", "retry_failed": "re_scrape", "low_confidence": "confidence", "choose_mechanism": "mechanism", "low_coverage": "field_coverage",
    "validation_failed": "validation", "field_confirmation": "field_confirm", "pre_execution": "execution", "reanalyze_exhausted": "validation", "skill_approval": "skill_update",
}


def final_status(state: Column, error: Column, execution: Column) -> Column:
    """Blocked jobs stay blocked; an error or a failed run fails; everything else is completed."""
    failed = (F.coalesce(error, F.lit("")) != "") | (F.coalesce(execution, F.lit("")) == "FAILED")
    return F.when(state.isin(*BLOCKED_STATES), state).when(failed, "failed").otherwise("completed")


def approval_type(reason: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in APPROVAL_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.coalesce(reason, F.lit(""))), F.lit("execution"))


def valid_output(samples: Column) -> Column:
    """``samples`` (title, price, status_code, remarks): whether a live one has a title and a price."""
    return F.coalesce(F.exists(samples, lambda p: ~dead_product(p["status_code"], p["remarks"]) & (F.coalesce(p["title"], F.lit("")) != "") & (F.coalesce(p["price"], F.lit("")) != "")), F.lit(False))


def core_present(fields: Column, core: Sequence[str] = DEFAULT_CORE) -> Column:
    return (F.size(fields) > 0) & (F.size(F.array_except(F.array(*map(F.lit, core)), fields)) == 0)


def service_health(age_seconds: Column, ok: Column, fresh: int = 300) -> Column:
    return F.when(age_seconds.isNull(), "unknown").when(~ok, "down").when(age_seconds < fresh, "up").otherwise("degraded")


def extended_budget(limit: Column, calls: Column, step: int = 10, most: int = 50, least_calls: int = 5) -> Column:
    return F.when((limit < most) & (calls >= least_calls), F.least(limit + step, F.lit(most))).otherwise(limit)


def input_mode(mode: Column, criteria: Column) -> Column:
    return F.when((F.coalesce(criteria, F.lit("")) != "") & (mode == "url_list"), "search_term").otherwise(mode)


def decision(payload: Column) -> Column:
    """What a human answered: a JSON object's decision, choice or response (empty without any), or the text itself; no answer cancels."""
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(payload)), F.lit("")).startswith("OBJECT")
    said = F.coalesce(*[F.get_json_object(payload, f"$.{k}") for k in ("decision", "choice", "response")], F.lit(""))
    return F.when(payload.isNull(), "Cancel").when(is_object, said).otherwise(payload)


def is_cancel(said: Column) -> Column:
    return said.isin(*CANCEL_LABELS, "reject")


def is_approve(said: Column) -> Column:
    """Whatever is no cancel label approves."""
    return ~said.isin(*CANCEL_LABELS)
