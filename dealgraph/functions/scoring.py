"""Validation, confidence and insight scores as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and bounds that results depend on.
STAGE_BASE = {"po_in_progress": 0.8, "quote": 0.55, "rfq": 0.4, "integration": 0.8, "research": 0.2}
PRIORITY_SHIFT = {"high": 0.1, "low": -0.05}


def by_value(column: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def meaningful(x: Column) -> Column:
    """M01 for texts: there, and not blank."""
    return x.isNotNull() & (F.trim(x.cast("string")) != "")


def completeness(fields: Sequence[Column]) -> Column:
    """The share of filled fields to the fourth power."""
    return F.pow(sum((meaningful(f).cast("int") for f in fields), F.lit(0)) / len(fields), F.lit(4.0))


def recency(days: Column) -> Column:
    """1 within a day, to 0.5 at 30 days, to 0 at 180; 0.5 if unknown."""
    return (F.when(days.isNull(), 0.5).when(days <= 1, 1.0).when(days <= 30, 1 - (days - 1) / 29 * 0.5)
            .when(days <= 180, 0.5 - (days - 30) / 150 * 0.5).otherwise(0.0))


def validation_score(status: Column, final: Column, ai: Column) -> Column:
    """1 if passed, 0 if failed, else the first known non-zero confidence, else 0.25."""
    known = F.coalesce(F.nullif(final, F.lit(0.0)), F.nullif(ai, F.lit(0.0)), F.lit(0.25))
    return F.when(status == "passed", 1.0).when(status == "failed", 0.0).otherwise(known)


def entity_quality(complete: Column, ai: Column, valid: Column, recent: Column) -> Column:
    """The weighted quality by which a master record is chosen; an unknown confidence (not one of 0) counts as 0.4."""
    return 0.4 * complete + 0.3 * F.coalesce(ai, F.lit(0.4)) + 0.2 * valid + 0.1 * recent


def validate_deal(name: Column, customer: Column, value: Column, confidence: Column) -> Column:
    """(errors, confidence, valid). Each passed critical rule adds 0.05."""
    rules = [("name_required", ~meaningful(name), "critical", 0.5), ("name_length", ~F.length(F.coalesce(name, F.lit(""))).between(5, 200), "warning", 0.1),
             ("customer_required", ~meaningful(customer), "critical", 0.5), ("value_positive", ~F.coalesce(value > 0, F.lit(False)), "error", 0.3),
             ("value_range", ~F.coalesce(value.between(100, 10_000_000), F.lit(False)), "warning", 0.1)]
    failed = F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad, _, _ in rules]))
    change, critical = F.lit(0.0), F.lit(False)
    for _, bad, severity, cost in rules:
        change = change + F.when(bad, -cost).otherwise(0.05 if severity == "critical" else 0.0)
        if severity == "critical":
            critical = critical | bad
    return F.struct(failed.alias("failed"), clamp(confidence + change, 0.0, 1.0).alias("confidence"), (~critical).alias("valid"))


def date_issues(close: Column, registered: Column, as_of: Column) -> Column:
    """long past or far closing dates, registrations in the future or after closing."""
    return F.array_compact(F.array(F.when(F.datediff(close, as_of) < -180, F.lit("close_long_past")), F.when(F.datediff(close, as_of) > 730, F.lit("close_far")),
                                   F.when(registered > as_of, F.lit("registered_in_future")), F.when(registered > close, F.lit("registered_after_close"))))


def customer_issues(name: Column) -> Column:
    """(issues, valid, adjustment) of a customer's name: 'rule:severity' of each rule that it breaks, whether none is worse than a warning, and what it takes off a confidence."""
    blank = F.coalesce(F.trim(name), F.lit("")) == ""
    shouted = (name == F.upper(name)) & (F.length(name) > 5)
    person = name.rlike(r"(?i)^(?:Mr|Mrs|Ms|Dr|Prof)\.?\s+[A-Z]") | name.rlike(r"^[A-Z][a-z]+ [A-Z][a-z]+$")
    found = F.array_compact(F.array(
        F.when(person, F.lit("name_not_person:warning")), F.when(shouted | (~shouted & (name == F.lower(name))), F.lit("name_capitalization:warning")), F.when(name.rlike("@|https?://"), F.lit("name_no_email_url:error")),
        F.when(F.length(name) < 2, F.lit("name_length:error")).when(F.length(name) > 100, F.lit("name_length:warning"))))
    issues = F.when(blank, F.array(F.lit("name_required:critical"))).otherwise(found)
    bad = F.exists(issues, lambda x: ~x.endswith(":warning"))
    return F.struct(issues.alias("issues"), (~bad).alias("valid"), F.when(blank, -0.5).when(bad, -0.3).when(F.size(issues) > 0, -0.05).otherwise(0.0).alias("adjustment"))


def calibrate(confidence: Column, kind: Column, name: Column, customer: Column, value: Column, currency: Column, close: Column, email: Column, phone: Column) -> Column:
    """what a deal, vendor or contact lacks scales its confidence down; a deal's currency and its closing date (a date, or null) scale it up, to at most 0.99 each."""
    def gone(x: Column) -> Column:
        return F.coalesce(x.cast("string"), F.lit("")) == ""

    deal = kind == "deal"
    out = confidence * F.when(kind.isin("deal", "vendor", "contact") & gone(name), 0.8).otherwise(1.0) * F.when(deal & gone(customer), 0.8).otherwise(1.0) * F.when(deal & (F.coalesce(value, F.lit(0.0)) == 0), 0.95).otherwise(1.0)
    out = out * F.when((kind == "contact") & gone(email) & gone(phone), 0.9).otherwise(1.0)
    out = F.when(deal & ~gone(currency), F.least(F.lit(0.99), out * 1.05)).otherwise(out)
    return clamp(F.when(deal & close.isNotNull(), F.least(F.lit(0.99), out * 1.05)).otherwise(out), 0.0, 1.0)


def mail_confidence(tier1: Column, tier2: Column, tier3: Column, filled: Column, corroboration: Column) -> Column:
    """keyword tiers, filled fields of five and corroboration, at most 1."""
    def share(x: Column, full: int) -> Column:
        return F.least(F.lit(1.0), x / full)

    return F.least(F.lit(1.0), 0.30 * share(tier1, 3) + 0.15 * share(tier2, 5) + 0.05 * share(tier3, 10) + 0.30 * filled / 5 + F.least(F.lit(0.20), corroboration))


def win_probability(stage: Column, priority: Column, has_cost_notes: Column, has_steps: Column) -> Column:
    """by stage, shifted by priority, cost notes and missing next steps; 0.05 to 0.95."""
    p = by_value(stage, STAGE_BASE, 0.2) + by_value(priority, PRIORITY_SHIFT, 0.0) + F.when(has_cost_notes, 0.05).otherwise(0.0) - F.when(has_steps, 0.0).otherwise(0.05)
    return F.round(clamp(p, 0.05, 0.95), 2)


def momentum(has_steps: Column, actors: Column, days_quiet: Column) -> Column:
    """next steps, more than two actors, and how long nothing has happened."""
    m = 0.5 + F.when(has_steps, 0.2).otherwise(0.0) + F.when(actors > 2, 0.1).otherwise(0.0) + F.when(days_quiet <= 7, 0.1).when(days_quiet > 21, -0.1).otherwise(0.0)
    return F.round(clamp(m, 0.0, 1.0), 2)


def risk_flags(win: Column, moving: Column, has_steps: Column, complete: Column) -> Column:
    """F27."""
    return F.array_compact(F.array(F.when(win < 0.3, F.lit("low_win_probability")), F.when(moving < 0.4, F.lit("stalled")), F.when(~has_steps, F.lit("missing_next_steps")), F.when(~complete, F.lit("incomplete_metadata"))))


def insight_notes(stage: Column, priority: Column, flags: Column) -> Column:
    """what to mind about a high-priority RFQ and a stalled deal."""
    return F.array_compact(F.array(F.when((priority == "high") & (stage == "rfq"), F.lit("High-priority RFQ: ensure follow-up on pricing.")),
                                   F.when(F.array_contains(flags, "stalled"), F.lit("No recent activity detected; consider re-engaging stakeholders."))))


def composite_quality(missing: Column, conflicts: Column, days: Column) -> Column:
    """(completeness, consistency, freshness, overall, severity) of a cluster's record."""
    complete, consistent = clamp(100 - 12.5 * missing, 0.0, 100.0), clamp(100 - 15.0 * conflicts, 0.0, 100.0)
    fresh = F.when(days.isNull() | (days >= 45), 40.0).when(days >= 30, 65.0).otherwise(100.0)
    overall = F.round(0.4 * complete + 0.3 * consistent + 0.3 * fresh)
    return F.struct(complete.alias("completeness"), consistent.alias("consistency"), fresh.alias("freshness"), overall.alias("overall"),
                    F.when(overall < 60, "high").when(overall < 80, "medium").otherwise("low").alias("severity"))
