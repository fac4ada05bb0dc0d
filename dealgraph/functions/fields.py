"""Coercions and checks of single fields as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that name a commodity, the first in this order wins.
COMMODITIES = [
    "cable", "cables", "cabling", "fiber", "fibre", "ftth", "fttx", "transformer", "transformers", "switch", "switches", "switching",
    "router", "routers", "routing", "copper", "power", "electrical", "battery", "batteries", "solar", "photovoltaic", "pv", "inverter", "inverters",
    "ups", "backup power", "generator", "generators", "network", "networking", "sd-wan", "firewall", "server", "servers", "storage", "san", "nas",
    "compute", "datacenter", "data center", "wireless", "wi-fi", "wifi", "5g", "antenna", "antennas", "tower", "towers", "conduit", "panel", "panels",
    "equipment", "hardware", "software", "platform", "license", "licenses", "licensing", "security", "surveillance", "camera", "cameras",
    "sensing", "scada", "automation", "hvac", "cooling",
]
# The states that a deal may have.
STATUSES = ["prospecting", "qualified", "proposal", "negotiation", "closed_won", "closed_lost", "registered", "pending", "new"]
# The words that are dropped from a stated amount.
AMOUNT_NOISE = [r"[$€£¥]", ",", r"(?i)per\s*(year|month|quarter|annum)", "(?i)annually", r"(?i)approx\.?", "(?i)estimated?", "~|approximately"]


def commodity(*texts: Column) -> Column:
    """The first commodity word that the joined texts contain, capitalised; null if none."""
    low = F.lower(F.concat_ws(" ", *texts))
    first = F.filter(F.array(*[F.lit(w) for w in COMMODITIES]), lambda w: F.contains(low, w))
    word = F.get(first, F.lit(0))
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 100))


def amount_currency(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("€")), "EUR").when(F.contains(text, F.lit("£")), "GBP").when(F.contains(text, F.lit("¥")), "JPY").otherwise("USD")


def amount_upside(text: Column) -> Column:
    """A stated amount with K, M or B, rounded; the higher end of a range. Null where none is above 0."""
    plain = text
    for noise in AMOUNT_NOISE:
        plain = F.regexp_replace(plain, noise, "")
    plain = F.trim(plain)
    number, sign = r"([\d.]+)\s*([KMBkmb])?", r"\s*[-–—to]+\s*"

    def part(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(plain, pattern, group), F.lit(""))

    def times(suffix: Column) -> Column:
        s = F.upper(suffix)
        return F.when(s == "K", 1e3).when(s == "M", 1e6).when(s == "B", 1e9).otherwise(1.0)

    span = number + sign + number
    low = part(span, 1).try_cast("double") * times(F.coalesce(part(span, 2), part(span, 4)))
    high = part(span, 3).try_cast("double") * times(F.coalesce(part(span, 4), part(span, 2)))
    one = part(number, 1).try_cast("double") * times(part(number, 2))
    top = F.greatest(low, high)
    value = F.when(top > 0, top).when(one > 0, one)
    return F.floor(value + 0.5).cast("long")


def spreadsheet_date(text: Column) -> Column:
    """A cell's date: a serial number of days since 1899-12-30, an ISO date, or day, month's name and year."""
    t = F.trim(text)
    return (F.when(F.rlike(t, F.lit(r"^\d+(\.\d+)?$")), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(t.try_cast("double")).cast("int")))
            .when(F.rlike(t, F.lit(r"^\d{4}-\d{2}-\d{2}")), F.substring(t, 1, 10).try_cast("date"))
            .otherwise(F.to_date(F.try_to_timestamp(F.when(F.rlike(t, F.lit(r"^\d{1,2}\s+[A-Za-z]{3}\s+\d{4}$")), t), F.lit("d MMM yyyy")))))


def csv_status(text: Column) -> Column:
    low = F.lower(text)
    return (F.when(F.contains(low, F.lit("won")), "closed-won").when(F.contains(low, F.lit("lost")), "closed-lost").when(F.contains(low, F.lit("approved")), "approved")
            .when(F.contains(low, F.lit("rejected")), "rejected").otherwise("registered"))


def csv_amount(text: Column) -> Column:
    """The number at the start of a text without signs of currency and thousands; 0 if there is none."""
    plain = F.regexp_replace(text, "[,$]", "")
    return F.coalesce(F.regexp_extract(plain, r"^\s*([-+]?[0-9]*\.?[0-9]+)", 1).try_cast("double"), F.lit(0.0))


def status_adjustment(status: Column) -> Column:
    """What a status adds to a confidence: .05 if it is a known one, else -.05."""
    known = F.lower(F.trim(status)).isin(*STATUSES)
    return F.when(F.coalesce(known, F.lit(False)), 0.05).otherwise(-0.05)


def key_part(text: Column) -> Column:
    """A part of a correlation key: lower case, without signs, blanks as underscores; empty if there is none."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(F.trim(F.lower(text)), r"[^\w\s]", ""), r"\s+", "_"), F.lit(""))


def deal_key(customer: Column, vendor: Column, value: Column) -> Column:
    """Customer:vendor:thousands; parts that are empty or 0 are left out."""
    thousands = F.floor(F.coalesce(value, F.lit(0.0)) / 1000 + 0.5)
    return F.concat_ws(":", F.nullif(key_part(customer), F.lit("")), F.nullif(key_part(vendor), F.lit("")), F.nullif(thousands, F.lit(0)).cast("string"))


def contact_key(email: Column, name: Column) -> Column:
    """Email:x, lower case and trimmed, or else name:y."""
    e = F.lower(F.trim(email))
    return F.when(F.coalesce(e, F.lit("")) != "", F.concat(F.lit("email:"), e)).otherwise(F.concat(F.lit("name:"), key_part(name)))


#: A rule: (name, kind, field, argument, severity, what it takes off a confidence). Arguments by kind: required, the least
#: length; range, (least, most) or None; format, a regex; one_of, the values.
Rule = tuple


def rule_failures(rules: list[Rule]) -> Column:
    """Array of (rule, severity, impact) of the rules that a row fails; a null field fails required rules only."""
    out = []
    for name, kind, field, arg, severity, impact in rules:
        c = F.col(field)
        text = c.cast("string")
        if kind == "required":
            bad = F.coalesce(F.length(F.trim(text)) < arg, F.lit(True))
        elif kind == "range":
            bad = (c < arg[0]) | ((c > arg[1]) if arg[1] is not None else F.lit(False))
        elif kind == "format":
            bad = ~F.rlike(text, F.lit(arg))
        elif kind == "one_of":
            bad = ~F.lower(F.trim(text)).isin(*arg)
        else:
            raise ValueError(f"no such kind of rule: {kind}")
        out.append(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.lit(impact).alias("impact"))))
    return F.array_compact(F.array(*out))


def range_hours(text: Column) -> Column:
    """the hours of a time range such as 12h, 7d or 2w; 24 for anything else."""
    n = F.regexp_extract(text, r"^(\d+)[hdw]$", 1).try_cast("bigint")
    return F.coalesce(n * F.when(text.endswith("h"), 1).when(text.endswith("d"), 24).otherwise(168), F.lit(24))
