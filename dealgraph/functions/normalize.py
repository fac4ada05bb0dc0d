"""Normalisers as column expressions (F01-F10, D01, D02, V08, V09, E21, F31). No UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lists, maps and weights that results depend on.
#: Company suffixes of which one is stripped, tried in this order.
COMPANY_SUFFIXES = ("Inc", "Inc.", "Incorporated", "LLC", "L.L.C.", "LLP", "Ltd", "Ltd.", "Limited", "Corp", "Corp.", "Corporation",
                    "Co", "Co.", "Company", "GmbH", "AG", "S.A.", "S.A", "SA", "Pty", "Pty.", "PLC")
#: Company suffixes that are stripped one after another for comparison.
TRAILING_SUFFIXES = ("inc", "corp", "corporation", "llc", "ltd", "limited", "co", "company")
DEAL_STATUS = {"new": "registered", "pending": "pending", "in progress": "in_progress", "in-progress": "in_progress", "approved": "approved",
               "rejected": "rejected", "denied": "rejected", "closed": "closed_won", "won": "closed_won", "closed won": "closed_won",
               "lost": "closed_lost", "closed lost": "closed_lost", "cancelled": "cancelled", "canceled": "cancelled"}
CURRENCY_SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "CAD": "CAD", "AUD": "AUD", "CHF": "CHF"}
MULTIPLIERS = {"K": 1e3, "M": 1e6, "B": 1e9, "T": 1e12}
LABEL_WEIGHTS = {"SENT": 50, "IMPORTANT": 40, "INBOX": 30, "STARRED": 25, "CATEGORY_PRIMARY": 20, "SPAM": -100, "TRASH": -100,
                 "CATEGORY_PROMOTIONS": -30, "CATEGORY_FORUMS": -20, "CATEGORY_SOCIAL": -15, "CATEGORY_UPDATES": -10, "DRAFT": -5}
LABEL_PASS = 30


def plain(text: Column) -> Column:
    """Lower case, without signs, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\w\s]", ""), r"\s+", " "))


def company_key(text: Column) -> Column:
    """plain(), then each trailing suffix in turn."""
    out = plain(text)
    for suffix in TRAILING_SUFFIXES:
        out = F.trim(F.regexp_replace(out, rf"\b{suffix}$", ""))
    return out


def vendor_key(text: Column) -> Column:
    """Letters, digits and blanks, without suffix words wherever they stand (the blanks around one stay)."""
    out = F.regexp_replace(F.regexp_replace(F.trim(F.lower(text)), r"[^a-z0-9\s]", ""), r"\s+", " ")
    return F.trim(F.regexp_replace(out, r"\b(inc|llc|ltd|corp|corporation|company|co)\b", ""))


def email_domain(text: Column) -> Column:
    """What follows the @ at the end, lower case; null without one."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(text)), r"@([a-z0-9.-]+\.[a-z]{2,})$", 1), F.lit(""))


def subject(text: Column) -> Column:
    """Lower case, without one reply or forward mark, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"^(re|fwd|fw):\s*", ""), r"\s+", " "))


def email(text: Column) -> Column:
    """(value, confidence)."""
    value = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.struct(value.alias("value"), F.when(value == "", 1.0).when(value.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), 1.0).otherwise(0.3).alias("confidence"))


def phone(text: Column, country: str = "+1") -> Column:
    """(value, confidence, valid)."""
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\d+]", "")
    n, plus = F.length(digits), digits.startswith("+")

    def result(value: Column, confidence: float, valid: bool) -> Column:
        return F.struct(value.alias("value"), F.lit(confidence).alias("confidence"), F.lit(valid).alias("valid"))

    return (F.when(F.trim(F.coalesce(text, F.lit(""))) == "", result(F.lit(""), 1.0, False))
            .when(n == 0, result(F.lit(""), 0.0, False))
            .when(plus & n.between(11, 15), result(digits, 0.95, True))
            .when(n == 10, result(F.concat(F.lit(country), digits), 0.85, True))
            .when((n == 11) & digits.startswith("1"), result(F.concat(F.lit(country), F.substring(digits, 2, 20)), 0.85, True))
            .when(n.between(11, 15), result(F.concat(F.lit("+"), digits), 0.7, True))
            .otherwise(result(digits, 0.3, False)))


def company(text: Column) -> Column:
    """(value, confidence): single blanks, and the first listed suffix that fits taken off."""
    squeezed = F.regexp_replace(F.trim(text), r"\s+", " ")
    value = squeezed
    for suffix in reversed(COMPANY_SUFFIXES):
        # a listed dot stands for any sign, as it always has
        pattern = rf"(?i)[,\s]+{suffix}$"
        value = F.when(squeezed.rlike(pattern), F.trim(F.regexp_replace(squeezed, pattern, ""))).otherwise(value)
    return F.struct(value.alias("value"), F.when(value == text, 1.0).otherwise(0.9).alias("confidence"))


def status(text: Column) -> Column:
    """(value, confidence)."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    mapped = F.lit(None).cast("string")
    for name, value in DEAL_STATUS.items():
        mapped = F.when(low == name, value).otherwise(mapped)
    return F.struct(F.when(low == "", "registered").otherwise(F.coalesce(mapped, low)).alias("value"),
                    F.when(low == "", 1.0).when(mapped.isNotNull(), 0.95).otherwise(0.7).alias("confidence"))


def currency(text: Column, default: str = "USD") -> Column:
    """(value, currency, confidence). The first symbol in the listed order counts; then a code of
    three capitals; then an amount with an optional K, M, B or T, the first of these that occurs."""
    clean = F.trim(F.coalesce(text, F.lit("")))
    code, rest = F.lit(default), clean
    for symbol, name in reversed(CURRENCY_SYMBOLS.items()):
        has = F.contains(clean, F.lit(symbol))
        code, rest = F.when(has, name).otherwise(code), F.when(has, F.trim(F.concat(F.split_part(clean, F.lit(symbol), F.lit(1)), F.substr(clean, F.instr(clean, F.lit(symbol)) + len(symbol))))).otherwise(rest)
    capitals = F.regexp_extract(rest, r"\b([A-Z]{3})\b", 1)
    code = F.when(capitals != "", capitals).otherwise(code)
    rest = F.when(capitals != "", F.regexp_replace(rest, r"^(.*?)\b[A-Z]{3}\b", "$1")).otherwise(rest)
    rest = F.regexp_replace(rest, r"[,\s]", "")
    factor, digits = F.lit(1.0), F.regexp_extract(rest, r"^([+-]?\d*\.?\d+)", 1)
    for letter, value in reversed(MULTIPLIERS.items()):
        hit = F.regexp_extract(rest, rf"(?i)(\d+\.?\d*){letter}", 1)
        factor, digits = F.when(hit != "", value).otherwise(factor), F.when(hit != "", hit).otherwise(digits)
    number = F.nullif(digits, F.lit("")).try_cast("double")
    empty, failed = clean == "", number.isNull()
    return F.struct(F.when(empty | failed, 0.0).otherwise(F.round(number * factor, 4)).alias("value"), F.when(empty | failed, default).otherwise(code).alias("currency"),
                    F.when(empty, 1.0).when(failed, 0.0).otherwise(0.9).alias("confidence"))


def date(text: Column) -> Column:
    """(value, confidence, format). Forms that any reader takes first (0.8), then month-day-year
    and day-month-year where only the latter is a date, and quarters (0.95); years 1900 to 2100."""
    clean = F.trim(text)
    slash = F.regexp_replace(clean, "-", "/")

    def parsed(x: Column, pattern: str) -> Column:
        return F.try_to_timestamp(x, F.lit(pattern)).cast("date")

    numeric = clean.rlike(r"^\d{1,2}[-/]\d{1,2}[-/]\d{4}$")
    native = F.coalesce(F.when(clean.rlike(r"^\d{4}-\d{2}-\d{2}$"), parsed(clean, "yyyy-MM-dd")), F.when(clean.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z?$"), parsed(F.substring(clean, 1, 10), "yyyy-MM-dd")),
                        F.when(numeric, parsed(slash, "M/d/yyyy")), F.when(clean.rlike(r"^[A-Za-z]{3} \d{1,2}, \d{4}$"), parsed(clean, "MMM d, yyyy")), F.when(clean.rlike(r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$"), parsed(clean, "MMMM d, yyyy")))
    british = F.when(numeric, parsed(slash, "d/M/yyyy"))
    quarter = F.regexp_extract(clean, r"(?i)^Q([1-4])\s+(\d{4})$", 1)
    first = F.when(quarter != "", F.make_date(F.regexp_extract(clean, r"(?i)^Q([1-4])\s+(\d{4})$", 2).try_cast("int"), quarter.try_cast("int") * 3 - 2, F.lit(1)))

    def sane(x: Column) -> Column:
        return x.isNotNull() & F.year(x).between(1900, 2100)

    def result(x: Column, confidence: float, name: str) -> Column:
        return F.struct(x.cast("string").alias("value"), F.lit(confidence).alias("confidence"), F.lit(name).alias("format"))

    return (F.when(F.coalesce(clean, F.lit("")) == "", result(F.lit(None), 1.0, "none")).when(sane(native), result(native, 0.8, "auto"))
            .when(sane(british), result(british, 0.95, "UK_DMY")).when(sane(first), result(first, 0.95, "QUARTER")).otherwise(result(F.lit(None), 0.0, "failed")))


def label_score(labels: Column) -> Column:
    """the sum of the labels' weights."""
    weights = F.create_map(*[F.lit(x) for pair in LABEL_WEIGHTS.items() for x in pair])
    return F.aggregate(labels, F.lit(0), lambda acc, x: acc + F.coalesce(F.try_element_at(weights, x), F.lit(0)))
