"""Fields of deal sections (E25): ordered patterns per field, compiled to one expression each.

A field takes the first of its patterns that matches; what the pattern's group holds is then processed, and the field's boost added
to the section's confidence if a value comes out. All is built-in functions over the section's text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields with their patterns in order, how a match is processed, and what a value adds to the confidence.
_LINE, _SIGN = r"([^\n]+)", r"[\s]*[:#-]\s*"
_MONEY = _SIGN + r"\$?([\d,]+(?:\.\d{2})?)\s*([kKmM])?"
_STATE = _SIGN + r"(\w+(?:[\s-]\w+)?)"
_LINES = _SIGN + r"([^\n]+(?:\n(?![A-Z][a-z]*[\s]*[:#-])[^\n]+)*)"
FIELDS = (
    ("deal_name", "text", 0.2, tuple(rf"(?i){w}(?:\s+Name)?{_SIGN}{_LINE}" for w in ("Deal", "Opportunity", "Account", "Project"))),
    ("customer_name", "text", 0.15, (*(rf"(?i){w}(?:\s+Name)?{_SIGN}{_LINE}" for w in ("Customer", "Client", "Company")), rf"(?i)Account{_SIGN}{_LINE}", rf"(?i)End[\s-]*User{_SIGN}{_LINE}")),
    ("deal_value", "money", 0.2, (*(rf"(?i)(?:Deal\s+)?{w}{_MONEY}" for w in ("Value", "Amount", "Size")), rf"(?i)Price{_MONEY}", r"\$\s*([\d,]+(?:\.\d{2})?)\s*([kKmM])?(?:\s|\z)", r"(?i)(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)\s*(?:USD|dollars?)")),
    ("status", "status", 0.15, tuple(rf"(?i){w}{_STATE}" for w in ("Status", "Stage", "Phase", "State"))),
    ("owner", "text", 0.1, (rf"(?i)Owner{_SIGN}{_LINE}", rf"(?i)(?:Sales\s+)?Rep(?:resentative)?{_SIGN}{_LINE}", rf"(?i)Assigned[\s]+(?:to)?{_SIGN}{_LINE}", rf"(?i)(?:Account\s+)?Manager{_SIGN}{_LINE}")),
    ("close_date", "date", 0.1, (rf"(?i)(?:Expected\s+)?Close[\s]*(?:Date)?{_SIGN}{_LINE}", rf"(?i)(?:Expected\s+)?Closing{_SIGN}{_LINE}", rf"(?i)Target[\s]+Date{_SIGN}{_LINE}", rf"(?i)Due[\s]+Date{_SIGN}{_LINE}", rf"(?i)Timeline{_SIGN}{_LINE}")),
    ("probability", "percent", 0.1, (*(rf"(?i){w}{_SIGN}(\d+)\s*%?" for w in ("Probability", r"(?:Win\s+)?Likelihood", "Confidence")), r"(?i)(\d+)\s*%\s+(?:probability|likely|chance)")),
    ("decision_maker", "text", 0.1, (rf"(?i)Decision[\s-]*Maker{_SIGN}{_LINE}", rf"(?i)(?:Key\s+)?Contact{_SIGN}{_LINE}", rf"(?i)(?:Primary\s+)?Stakeholder{_SIGN}{_LINE}", rf"(?i)Champion{_SIGN}{_LINE}")),
    ("description", "lines", 0.05, tuple(rf"(?i){w}{_LINES}" for w in ("Description", "Notes?", "Details?", "Summary"))),
)
STATUSES = {"new": "registered", "open": "registered", "active": "approved", "qualified": "qualified", "discovery": "discovery", "proposal": "proposal", "negotiation": "negotiation", "negotiating": "negotiation",
            "closed won": "closed-won", "closed-won": "closed-won", "won": "closed-won", "closed lost": "closed-lost", "closed-lost": "closed-lost", "lost": "closed-lost", "pending": "pending", "approved": "approved", "rejected": "rejected"}


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _first(text: Column, patterns: Sequence[str], group: int) -> Column:
    """The group of the first pattern whose first group holds something."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        one = F.regexp_extract(text, p, 1)
        # a pattern may have no second group
        value = one if group == 1 else (F.regexp_extract(text, p, 2) if "([kKmM])" in p else F.lit(""))
        out = F.when(one != "", value).otherwise(out)
    return out


def money(value: Column, unit: Column) -> Column:
    number = F.regexp_extract(F.replace(value, F.lit(","), F.lit("")), r"^(\d+\.?\d*)", 1).try_cast("double")
    return number * F.when(F.lower(unit) == "k", 1e3).when(F.lower(unit) == "m", 1e6).otherwise(1.0)


def close_date(value: Column) -> Column:
    """A date as any reader takes it, or the 30th of a quarter's last month."""
    x = _trimmed(value)
    forms = [F.when(x.rlike(p), F.try_to_timestamp(x, F.lit(f)).cast("date")) for p, f in ((r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"), (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"))]
    quarter = F.regexp_extract(x, r"(?i)Q([1-4])\s+(\d{4})", 1).try_cast("int")
    return F.coalesce(*forms, F.when(quarter.isNotNull(), F.make_date(F.regexp_extract(x, r"(?i)Q([1-4])\s+(\d{4})", 2).try_cast("int"), quarter * 3, F.lit(30))))


def _processed(kind: str, text: Column, patterns: Sequence[str]) -> Column:
    value = _first(text, patterns, 1)
    if kind == "money":
        return money(value, _first(text, patterns, 2))
    if kind == "status":
        mapped = F.create_map(*[F.lit(x) for pair in STATUSES.items() for x in pair])
        return F.coalesce(F.try_element_at(mapped, F.lower(_trimmed(value))), F.nullif(_trimmed(value), F.lit("")))
    if kind == "date":
        return close_date(value)
    if kind == "percent":
        return F.least(F.lit(100), F.coalesce(value.try_cast("int"), F.when(value.isNotNull(), F.lit(100))))
    plain = _trimmed(value)
    return F.nullif(F.regexp_replace(plain, r"\n\s+", " ") if kind == "lines" else plain, F.lit(""))


def compiled(text: Column, fields: Sequence[tuple] = FIELDS) -> dict[str, Column]:
    """A column for each of the fields (name, kind, boost, patterns); null where none of its patterns gives a value."""
    return {name: _processed(kind, text, patterns) for name, kind, _, patterns in fields}


def inferred_name(text: Column) -> Column:
    """A name for a deal that has none: its first line, a company in it, or a line of capitalised words."""
    line = _trimmed(F.regexp_extract(text, r"(?m)^[^\S\n]*(\S[^\n]*)", 1))
    clean = _trimmed(F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"^[\d.)\-•]\s*", ""), r"(?i)^Deal[\s:#-]*", ""), r"(?i)^Opportunity[\s:#-]*", ""))
    company = F.regexp_extract(text, r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Inc|Corp|LLC|Ltd|Co)\.?)", 1)
    capitals = F.regexp_extract(text, r"(?m)^([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,4})\s*$", 1)
    return F.when((F.length(line) < 100) & line.rlike("[a-zA-Z]{3,}") & (F.length(clean) > 2), clean).when(company != "", company).when((capitals != "") & (F.length(capitals) < 60), capitals)


def extract(sections: DataFrame, fields: Sequence[tuple] = FIELDS) -> DataFrame:
    """Sections (text_id, start, part, confidence) with a column per field, the name inferred where none is given ('Unknown Deal' if that fails too), n_fields, the number of values found, and
    the confidence raised by the boosts of the fields found, to at most 1."""
    columns = compiled(F.col("part"), fields)
    x = sections.select("text_id", "start", "part", F.col("confidence").alias("_c"), *[c.alias(n) for n, c in columns.items()])
    boost, found = F.lit(0.0), F.lit(0)
    for name, _, value, _ in fields:
        there = F.col(name).isNotNull()
        boost, found = boost + F.when(there, value).otherwise(0.0), found + there.cast("int")
    inferred = inferred_name(F.col("part"))
    x = x.withColumn("n_fields", found + (F.col("deal_name").isNull() & inferred.isNotNull()).cast("int")).withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("_c") + boost), 6))
    return x.withColumn("deal_name", F.coalesce("deal_name", inferred, F.lit("Unknown Deal"))).drop("_c", "part")
