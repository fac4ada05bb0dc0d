"""Normalisers and checks of whole records, second forms of names, and signals in texts (F07-F09, F16, F24, E33). Built-in functions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealgraph.functions.normalize import company, currency, date, email, phone, status

# Words, names, currencies and patterns that results depend on.
GLUED_WORDS = ("telecom", "communications", "electric", "power", "energy", "solutions", "systems", "technologies", "services", "networks", "cable", "fiber", "wireless", "broadband", "internet", "digital", "group", "corporation", "incorporated", "company", "enterprises", "industries")
DOMAIN_NAMES = {"dell-emc": "Dell EMC", "hpe": "HPE", "aws": "AWS", "microsoft": "Microsoft", "google": "Google", "oracle": "Oracle", "ibm": "IBM", "cisco": "Cisco", "vmware": "VMware", "redhat": "Red Hat", "salesforce": "Salesforce", "adobe": "Adobe", "sap": "SAP"}
CURRENCIES = ("USD", "EUR", "GBP", "CAD", "AUD", "JPY", "CNY", "INR")
SIGNALS = {
    "quantities": (r"\b\d{1,3}(?:,\d{3})*(?:\s*[-–]\s*\d{1,3}(?:,\d{3})*)?\s*(?:units|pcs|pieces|systems|cabinets|boards|qty|units/yr|per year|yr)\b", r"\b\d+(?:\s*-\s*\d+)?\s*(?:k|K)\b"),
    "prices": (r"\$\s?\d+(?:,\d{3})*(?:\s*[-–]\s*(?:\$\s?)?\d+(?:,\d{3})*)?(?:\s*(?:k|K|m|M))?(?:\s*per\s*(?:unit|cabinet|board))?", r"\b\d+(?:\s*-\s*\d+)?\s*(?:k|K)\s*(?:USD|usd|dollars)?(?:\s*per\s*(?:unit|cabinet|board))?"),
    "timelines": (r"\bQ[1-4]\s*20\d{2}\b", r"\b\d+\s*(?:weeks?|months?|days?)\b", r"\b(?:July|August|September|October|November|December|January|February|March|April|May|June)\s+20\d{2}\b", r"\bETA\s*[:\-]?\s*[^\n]+"),
    "margins": (r"\b\d{1,2}\s*[-–]\s*\d{1,2}\s*%", r"\b\d{1,2}\s*[-–]\s*\d{1,2}\s*%\s*(?:margin|margins)\b", r"\b\d{1,2}\s*%\s*(?:margin|gm|gross margin)\b", r"\bmargin(?:s)?\s*(?:target|goal|expected)?\s*[:\-]?\s*\d{1,2}\s*%\b"),
}
STAGES = {"rfq": ("rfq", "request for quote", "quote request", "pricing request"), "quote": ("quote", "pricing needed", "price request"), "po_in_progress": ("purchase order", "PO", "ordered", "cutting PO", "cutting POs"),
          "research": ("prototype", "concept", "research", "lab", "materials lab"), "integration": ("field trial", "rollout", "integration", "deploy")}
#: A word's edge, words being of ASCII letters.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def _there(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("")) != ""


def squeezed(text: Column) -> Column:
    """A company's name with its suffix, single blanks."""
    return F.regexp_replace(F.trim(text), r"\s+", " ")


def vendor_records(vendors: DataFrame) -> DataFrame:
    """vendors (name, email_domains, website, ...): the name without its suffix, domains and website in lower case."""
    own = {"name": company(F.col("name"))["value"], "email_domains": F.transform("email_domains", lambda d: F.trim(F.lower(d))), "website": F.when(_there(F.col("website")), F.trim(F.lower("website")))}
    return vendors.withColumns(own)


def deal_records(deals: DataFrame) -> DataFrame:
    """deals (deal_value, customer_name, expected_close_date, status, decision_maker_email, decision_maker_phone, as texts, ...) with normalised values, and the value's currency. What gives several
    values is computed once, as a struct, and taken apart after it."""
    names = {"deal_value": currency, "expected_close_date": date, "status": status, "decision_maker_email": email, "decision_maker_phone": phone}
    told = deals.withColumns({f"_{n}": f(F.col(n)) for n, f in names.items()})
    out = {n: F.col(f"_{n}.value") for n in names}
    for n in ("decision_maker_email", "decision_maker_phone"):
        out[n] = F.when(_there(F.col(n)), out[n])
    return told.withColumns(out | {"currency": F.col("_deal_value.currency"), "customer_name": F.when(_there(F.col("customer_name")), squeezed(F.col("customer_name")))}).drop(*[f"_{n}" for n in names])


def contact_records(contacts: DataFrame) -> DataFrame:
    """contacts (name, email, phone, ...)."""
    of = {"email": email(F.col("email"))["value"], "phone": phone(F.col("phone"))["value"], "name": F.trim("name")}
    return contacts.withColumns({n: F.when(_there(F.col(n)), c) for n, c in of.items()})


def titled_company(name: Column) -> Column:
    """signs between words as blanks, words that are glued to others set apart, each word capitalised but for acronyms of two to four signs."""
    # a fold over the words: written out, each step would hold the one before four times
    def step(acc: Column, word: Column) -> Column:
        low = F.lower(acc)
        return F.when(F.contains(low, word) & ~F.contains(low, F.concat(F.lit(" "), word)), F.regexp_replace(acc, F.concat(F.lit("(?i)"), word), F.concat(F.lit(" "), F.initcap(word)))).otherwise(acc)

    out = F.aggregate(F.array(*[F.lit(w) for w in GLUED_WORDS]), F.regexp_replace(name, "[_-]", " "), step)
    words = F.transform(F.split(out, r"\s+"), lambda w: F.when(F.length(w).between(2, 4) & (w == F.upper(w)), w).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.length(w))))))
    return F.trim(F.array_join(words, " "))


def domains_of(mail: Column, website: Column, contacts: Column) -> Column:
    """the distinct domains of an address, a website and contacts' addresses (an array), in this order."""
    def of(x: Column) -> Column:
        return F.nullif(F.lower(F.regexp_extract(x, r"@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})", 1)), F.lit(""))

    address = F.when(website.startswith("http"), website).otherwise(F.concat(F.lit("https://"), website))
    host = F.nullif(F.lower(F.regexp_extract(address, r"^https?://(?:[^/?#@]*@)?([^/:?#\s]+)", 1)), F.lit(""))
    host = F.when(F.contains(host, F.lit("www.")), F.regexp_replace(host, r"^(.*?)www\.", "$1")).otherwise(host)
    return F.array_distinct(F.array_compact(F.concat(F.array(of(mail), host), F.coalesce(F.transform(contacts, of), F.array().cast("array<string>")))))


def company_of_domain(domain: Column) -> Column:
    """a company's name from its domain."""
    part = F.regexp_replace(F.regexp_replace(domain, r"^www\.", ""), r"\.(com|net|org|io|co|edu|gov)$", "")
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in DOMAIN_NAMES.items() for x in pair]), F.lower(part))
    words = F.transform(F.split(F.replace(part, F.lit("-"), F.lit(" ")), " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.length(w)))))
    return F.when(~_there(domain), "Unknown").otherwise(F.coalesce(known, F.array_join(words, " ")))


def value_issues(value: Column, code: Column, source: Column) -> Column:
    """F16: (issues, valid, adjustment) of a deal's value (a text or number): 'rule:severity' of each rule it breaks. With a source text, the value must stand in it, plain or in groups of three digits."""
    number = F.regexp_extract(value.cast("string"), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("decimal(24,6)")

    def short(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(x, r"(\.\d*?)0+$", "$1"), r"\.$", "")

    told = F.contains(source, short(number.cast("string"))) | F.contains(source, short(F.format_number(number, 3)))
    positive = F.coalesce(number > 0, F.lit(False))
    issues = F.array_compact(F.array(F.when(~positive, F.lit("value_positive:critical")), F.when((number < 100) | (number > 10_000_000), F.lit("value_range:warning")),
                                     F.when(_there(code) & ~F.upper(code).isin(*CURRENCIES), F.lit("currency_valid:warning")), F.when(positive & _there(source) & ~told, F.lit("value_context_check:warning"))))
    return F.struct(issues.alias("issues"), positive.alias("valid"), F.when(~positive, -0.3).when(F.size(issues) > 0, -0.1).otherwise(0.0).alias("adjustment"))


def enhanced_confidence(tiers: Sequence[Column], value: Column, customer: Column, product: Column, timeline: Column, stage: Column, value_confidence: Column, customer_confidence: Column) -> Column:
    """.3, .15 and .05 for each keyword of the three tiers, something for each part that is there, scaled by how sure value and customer are; at most 1."""
    score = 0.3 * tiers[0] + 0.15 * tiers[1] + 0.05 * tiers[2]
    for there, worth in ((value, 0.2), (customer, 0.2), (product, 0.1), (timeline, 0.1), (stage, 0.05)):
        score = score + F.when(there, worth).otherwise(0.0)
    for sure in (value_confidence, customer_confidence):
        score = score * F.when(F.coalesce(sure, F.lit(0.0)) != 0, 0.7 + sure * 0.3).otherwise(1.0)
    return F.least(F.lit(1.0), score)


def _found(text: Column, patterns: Sequence[str]) -> Column:
    """What the patterns match in a text, pattern by pattern, blanks squeezed, each once."""
    hits = F.concat(*[F.regexp_extract_all(text, F.lit("(?i)" + p.replace(r"\b", EDGE)), F.lit(0)) for p in patterns])
    return F.array_distinct(F.filter(F.transform(hits, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""))


def _named(text: Column, words: Mapping[str, Sequence[str]]) -> Column:
    """The names of which a text has one of the words."""
    if not words:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?i){EDGE}(?:" + "|".join(f"\\Q{w}\\E" for w in ws) + f"){EDGE}"), F.lit(n)) for n, ws in words.items()]))


def signals(text: Column, tags: Mapping[str, Sequence[str]], actors: Mapping[str, Sequence[str]], stages: Mapping[str, Sequence[str]] = STAGES) -> Column:
    """(quantities, prices, timelines, margins, tags, actors, hints) of a text; tags, actors and stages: the words that stand for each."""
    return F.struct(*[_found(text, p).alias(n) for n, p in SIGNALS.items()], _named(text, tags).alias("tags"), _named(text, actors).alias("actors"), _named(text, stages).alias("hints"))
