"""States of tasks, attempts, files and calls: groups, precedence, accounting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The group of every final task state; any other state is pending.
TASK_GROUPS = {
    "success": "COMPLETED VERIFIED PARSED REGISTERED REUSED CACHED TRANSLATED PRESERVED_MANUAL ALREADY_PRESENT PREPARED RESTORED".split(),
    "failed": (
        "FAILED EXHAUSTED NOT_FOUND ACCESS_DENIED ERROR RUNNER_ERROR INVALID_DOI BROWSER_UNAVAILABLE UNSAFE_URL MISMATCH INVALID_PDF RETRIEVED_UNVERIFIED ENTITLEMENT_REQUIRED ACCESS_BLOCKED"
        " TOO_LARGE REDIRECT_ERROR REQUEST_ERROR NETWORK_ERROR RATE_LIMITED SERVICE_ERROR AMBIGUOUS ROLLED_BACK ROLLBACK_REQUIRED"
    ).split(),
    "interaction": ["INTERACTION_REQUIRED", "AUTH_REQUIRED"],
    "partial": ["PARTIAL"],
    "skipped": ["SKIP", "SKIPPED", "CANCELLED"],
}
# Provider errors and the status each leaves; others leave ERROR.
PROVIDER_ERRORS = {"configuration": "CONFIGURATION_ERROR", "not_found": "NOT_FOUND", "request": "REQUEST_ERROR", "network": "NETWORK_ERROR", "rate_limit": "RATE_LIMITED", "service": "SERVICE_ERROR", "parse": "PARSE_ERROR"}
# Kinds of jobs that may have run up a bill when they stop.
BILLED_JOBS = ["translation", "research", "planning", "input_normalization"]


def task_group(status: Column) -> Column:
    out = F.when(F.lit(False), "")
    for group, states in TASK_GROUPS.items():
        out = out.when(status.isin(states), group)
    return out.otherwise("pending")


def provider_status(error: Column) -> Column:
    """Status a provider's error leaves; null without an error."""
    known = F.create_map(*[F.lit(x) for pair in PROVIDER_ERRORS.items() for x in pair])
    return F.when(error.isNotNull(), F.coalesce(known[error], F.lit("ERROR")))


def retrieved_status(identity: Column, role: Column) -> Column:
    """Status of a retrieved file from the identity of its paper and its role."""
    return F.when(role == "SUPPLEMENT", "SUPPLEMENT").when((identity == "MATCH") & (role == "ARTICLE"), "VERIFIED").when(identity == "MISMATCH", "MISMATCH").otherwise("RETRIEVED_UNVERIFIED")


def access_outcome(statuses: Column, kept_unverified: Column, api: Column) -> Column:
    """Final status of a paper from the set of its attempts' statuses, whether an unverified file was kept, and the status of a publisher's interface (null: not asked)."""
    has = lambda s: F.array_contains(statuses, s)
    only = lambda *xs: (F.size(statuses) > 0) & (F.size(F.array_except(statuses, F.array(*map(F.lit, xs)))) == 0)
    pending = reduce(lambda a, b: a | b, [has(s) for s in ("INTERACTION_REQUIRED", "ENTITLEMENT_REQUIRED", "ACCESS_DENIED")])
    out = F.when(has("AMBIGUOUS"), "AMBIGUOUS").when(has("RETRIEVED_UNVERIFIED") | (kept_unverified & ~pending), "RETRIEVED_UNVERIFIED")
    for s in ("INTERACTION_REQUIRED", "ENTITLEMENT_REQUIRED", "ACCESS_DENIED", "AUTH_REQUIRED"):
        out = out.when(has(s), s)
    out = out.when(api.isin("AUTH_REQUIRED", "ENTITLEMENT_REQUIRED", "ACCESS_DENIED"), api)
    return out.when(only("UNSAFE_URL"), "UNSAFE_URL").when(only("ERROR", "NAVIGATION_ERROR", "BROWSER_UNAVAILABLE"), "ERROR").otherwise("EXHAUSTED")


def accounted_cost(estimated: Column, reserved: Column) -> Column:
    """Known cost, else the reservation; an amount below zero or not finite is an error."""
    c = F.coalesce(estimated, reserved)
    bad = F.isnan(c) | (c < 0) | (F.abs(c) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("a cost of the ledger is no amount"))).otherwise(c)


def revision_mode(coverage_supported: Column, all_supported: Column, open_points: Column) -> Column:
    """Whether a review asks for a whole new extraction, for single corrections, or for nothing."""
    return F.when(~coverage_supported, "full_coverage").when(~all_supported | (open_points > 0), "targeted").otherwise("unchanged")


def after_restart(status: Column, kind: Column, uncertain: Column, titles: Column) -> Column:
    """A job found unfinished at a start is interrupted; its bill is uncertain where it was, where its kind calls models, or where titles were to be translated."""
    ended = status.isin("COMPLETED", "PARTIAL", "FAILED", "CANCELLED", "INTERRUPTED")
    unsure = F.coalesce(uncertain, F.lit(False)) | kind.isin(BILLED_JOBS) | F.coalesce(titles, F.lit(False))
    return F.struct(F.when(ended, status).otherwise("INTERRUPTED").alias("status"), F.when(ended, F.coalesce(uncertain, F.lit(False))).otherwise(unsure).alias("billing_uncertain"))


def audit_status(checks: list[Column], pages: Column, first_text_read: Column) -> Column:
    """FAILED unless every check holds and the file has a page; WARNING where only its text could not be read."""
    held = reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in checks])
    return F.when(~held | (F.coalesce(pages, F.lit(0)) == 0), "FAILED").when(~F.coalesce(first_text_read, F.lit(False)), "WARNING").otherwise("PASSED")


def translation_state(manual: Column, confirmed: Column, title: Column, cached: Column) -> Column:
    """What storing a translated title does: titles set or confirmed by hand stay."""
    mine = title.isNotNull() & (title != "") & (F.coalesce(confirmed, F.lit(False)) | F.coalesce(manual, F.lit(False)))
    return F.when(mine, "PRESERVED_MANUAL").when(cached, "CACHED").otherwise("TRANSLATED")
