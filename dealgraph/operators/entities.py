"""Amounts, companies, entities and their relations in texts (E14, E15, E30, E31), and one deal of each of a text's like ones.

A pattern's matches are rows with their positions; all patterns of a query are looked for in one pass over the texts (functions.matches). Spans meet by equi
joins on the text and a bucket of positions or values, so that no text is carried along."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealgraph.functions import matches
from dealgraph.functions.workers import ship
from dealgraph.operators.dedupe import _cut

# Patterns, labels and confidences that results depend on.
LABELLED = r"(?i)(?:deal\s+(?:size|value|amount)|contract\s+value|total\s+value|project\s+(?:budget|cost)|purchase\s+(?:amount|value)|tcv|acv|arr|mrr)[:\s]+\$?\s?([\d,]+(?:\.\d{2})?)\s?(?:million|m|thousand|k)?"
QUALIFIED = r"(?i)\$\s?([\d,]+(?:\.\d{2})?)\s?(million|m|thousand|k)?\s+(?:deal|contract|project|opportunity|order|purchase)"
ABBREVIATED = r"(?i)\$\s?([\d.]+)\s?(k|m|million|thousand)"
WRITTEN = r"(?i)\b(?:one|two|three|four|five|six|seven|eight|nine|ten|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|and|\s)+dollars?\b"
PLAIN_AMOUNT = r"\$\s?([\d,]+(?:\.\d{2})?)"
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
LEAST_PLAIN, SAME_VALUE, SURE = 1000, 100, 0.7
CUSTOMERS = (r"(?i)(?:customer|client|end[- ]user|end[- ]customer)(?:\s+is|\s+name)?[:\s]+([A-Z][A-Za-z0-9\s&.,'-]{2,50}?)(?:\.|,|;|\s+will|\s+has|\s+is|\s+based|\s+located|\z)",
             r"(?i)(?:for|with)\s+([A-Z][A-Za-z0-9\s&]{2,40}?)\s+(?:customer|client|company|corporation|inc|llc)",
             r"(?i)([A-Z][A-Za-z0-9\s&]{2,40}?)\s+(?:is|are)\s+(?:our|the)\s+(?:customer|client|end[- ]user)")
SUFFIXED = r"\b([A-Z][A-Za-z0-9\s&.,'-]{2,50}?)\s+(Inc\.?|LLC|Corp\.?|Corporation|Ltd\.?|Limited|Co\.?|Company|Group|Partners|Solutions|Technologies|Systems|Services|Enterprises)\b"
NO_NAMES = ("the", "this", "that", "their", "our", "your", "my", "his", "her")
ROLE_WORDS = (("customer", "customer|client|end user"), ("vendor", "vendor|supplier"), ("partner", "partner"))
CONTEXT = 50
ENTITIES = (("EMAIL", 1.0, 0, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
            ("PHONE", 0.9, 0, r"\b(?:\+?1[-.]?)?\(?\d{3}\)?[-.]?\d{3}[-.]?\d{4}\b"),
            ("MONEY", 0.95, 0, r"(?i)\$\s?(?:\d{1,3}(?:,\d{3})*(?:\.\d{2})?)\s*(?:million|thousand|k|M)?|(?:\d+)\s*(?:million|thousand|k|M)\s*dollars?"),
            ("DATE", 0.85, 0, r"(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}|Q[1-4]\s+\d{4}|\d{1,2}/\d{1,2}/\d{2,4}|end\s+of\s+(?:month|quarter|year|Q[1-4])|next\s+(?:week|month|quarter)"),
            ("ORGANIZATION", 0.9, 0, r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Inc|Corp|Corporation|LLC|Ltd|Limited|Co|Company|Technologies|Systems|Solutions|Group|Partners|Associates)\b"),
            ("PERSON", 0.85, 2, r"(?i)\b(my\s+name\s+is|this\s+is|i'm|speaking\s+with|talk\s+to|reach\s+out\s+to)\s+([A-Z][a-z]+\s+[A-Z][a-z]+)"),
            ("JOB_TITLE", 0.8, 0, r"(?i)\b(?:CEO|CTO|CFO|COO|Director|Manager|VP|Vice\s+President|President|Head\s+of|Chief)\s+[A-Za-z\s]+\b"))
RELATIONS = (("works_for", 0.9, "PERSON", 1, "ORGANIZATION", 3, r"(?i)\b([A-Z][a-z]+\s+[A-Z][a-z]+)\s+(works?\s+for|at|with)\s+([A-Z][a-zA-Z\s]+(?:Inc|Corp|LLC|Company))"),
             ("has_title", 0.85, "PERSON", 1, "JOB_TITLE", 2, r"(?i)\b([A-Z][a-z]+\s+[A-Z][a-z]+),?\s+((?:CEO|CTO|CFO|Director|Manager|VP)[^,.\n]+)"),
             ("uses_product", 0.8, "ORGANIZATION", 1, "ORGANIZATION", 2, r"(?i)\b([A-Z][a-zA-Z\s]+(?:Inc|Corp|LLC|Company))\s+(?:is\s+)?(?:currently\s+)?(?:using|uses?|has)\s+([A-Z][a-zA-Z\s]+)"))


#: The same patterns with where they are tried: all matches of one of them begin with a word, or hold one.
_NAMED = matches.LETTERS + matches.DIGITS + matches.BLANKS + "&"
_FIRMS, _TITLES = ("inc", "corp", "llc", "company"), ("ceo", "cto", "cfo", "director", "manager", "vp")
_BUYERS = ("customer", "client", "end user", "end-user")
_FORMS = ("Inc", "LLC", "Corp", "Ltd", "Limited", "Co", "Group", "Partners", "Solutions", "Technologies", "Systems", "Services", "Enterprises", "Associates")
_BY_TYPE = {"EMAIL": matches.addresses, "PHONE": matches.phones, "MONEY": matches.sums, "DATE": matches.dates,
            "ORGANIZATION": matches.suffixed(matches.LETTERS + matches.LETTERS.upper() + matches.BLANKS, _FORMS, r"(?:Inc|Corp|Corporation|LLC|Ltd|Limited|Co|Company|Technologies|Systems|Solutions|Group|Partners|Associates)\b", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"),
            "PERSON": matches.at("my", "this", "i'm", "speaking", "talk", "reach"), "JOB_TITLE": matches.at("ceo", "cto", "cfo", "coo", "director", "manager", "vp", "vice", "president", "head", "chief")}
_BY_RELATION = {"works_for": matches.within(matches.LETTERS + matches.BLANKS, _FIRMS), "has_title": matches.after_two_words(*_TITLES), "uses_product": matches.to_the_end(_FIRMS, r"\s+(?:is\s+)?(?:currently\s+)?(?:using|uses?|has)\s")}
ENTITY_RULES = tuple(matches.Rule(p, _BY_TYPE[kind], (1, g) if g else ()) for kind, _, g, p in ENTITIES)
RELATION_RULES = tuple(matches.Rule(p, _BY_RELATION[name], (one, two)) for name, _, _, one, _, two, p in RELATIONS)
COMPANY_RULES = (matches.Rule(CUSTOMERS[0], matches.at(*_BUYERS, "end customer", "end-customer"), (1,)), matches.Rule(CUSTOMERS[1], matches.within(_NAMED, ("customer", "client", "company", "corporation", "inc", "llc"), after_blank=True), (1,)),
                 matches.Rule(CUSTOMERS[2], matches.called(_NAMED + "-", _BUYERS, ("our", "the"), ("is", "are")), (1,)),
                 matches.Rule(SUFFIXED, matches.suffixed(_NAMED + matches.LETTERS.upper() + ".,'-", _FORMS, SUFFIXED[SUFFIXED.index("(Inc") :]), (1, 2)))
ROLE_RULES = tuple(matches.Rule(f"(?i){p}", matches.at(*p.split("|"))) for _, p in ROLE_WORDS)
AMOUNT_RULES = (matches.Rule(LABELLED, matches.at("deal", "contract", "total", "project", "purchase", "tcv", "acv", "arr", "mrr"), (1,)), matches.Rule(QUALIFIED, matches.at("$"), (1, 2)), matches.Rule(ABBREVIATED, matches.at("$"), (1, 2)),
                matches.Rule(WRITTEN, matches.within(matches.LETTERS + matches.BLANKS, ("dollar",), more=2)), matches.Rule(PLAIN_AMOUNT, matches.at("$"), (1,)))


def number(text: Column) -> Column:
    """The number a text begins with, without its commas; null without one."""
    return F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"^(\d+\.?\d*|\.\d+)", 1).try_cast("double")


def _times(unit: Column) -> Column:
    low = F.lower(unit)
    return F.when(low.startswith("m"), 1e6).when(low.isin("k", "thousand"), 1e3).otherwise(1.0)


def written_number(words: Column) -> Column:
    """The value of a number in words."""
    values = F.create_map(*[F.lit(x) for w, v in NUMBER_WORDS.items() for x in (w, float(v))])

    def step(acc: Column, w: Column) -> Column:
        now, total = acc["now"], acc["total"]
        return F.struct((F.when(w == "thousand", total + now * 1e3).when(w == "million", total + now * 1e6).otherwise(total)).alias("total"),
                        (F.when(w == "hundred", now * 100).when(w.isin("thousand", "million"), 0.0).otherwise(now + F.coalesce(F.try_element_at(values, w), F.lit(0.0)))).alias("now"))

    return F.aggregate(F.split(F.lower(words), r"\s+"), F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("now")), step, lambda acc: acc["total"] + acc["now"])


def amounts(texts: DataFrame) -> DataFrame:
    """(text_id, label, value, confidence, start, end): amounts with a label (.9), abbreviated (.8), in words (.7), and plain ones from 1,000 on (.6) that are not within 100 of a
    surer one than .7 in the same text; those meet by buckets of values."""
    found = _cut(matches.found(texts, AMOUNT_RULES))

    def rows(rule: int, label: str, confidence: float, value: Column) -> DataFrame:
        return found.where(F.col("rule") == rule).select("text_id", F.lit(label).alias("label"), value.alias("value"), F.lit(confidence).alias("confidence"), "start", "end").where("value > 0")

    sure = rows(0, "deal_value", 0.9, number(F.col("g1"))).unionByName(rows(1, "deal_value", 0.9, number(F.col("g1")) * _times(F.col("g2")))).unionByName(rows(2, "estimated_value", 0.8, number(F.col("g1")) * _times(F.col("g2"))))
    plain = rows(4, "possible_value", 0.6, number(F.col("g1"))).where(F.col("value") >= LEAST_PLAIN)
    bucket = F.floor(F.col("value") / SAME_VALUE)
    near = sure.where(F.col("confidence") > SURE).select("text_id", F.col("value").alias("_v"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: bucket + k)).alias("_b"))
    left = plain.withColumn("_b", bucket).alias("p").join(near.alias("s"), (F.col("p.text_id") == F.col("s.text_id")) & (F.col("p._b") == F.col("s._b")) & (F.abs(F.col("p.value") - F.col("s._v")) < SAME_VALUE), "left_anti").drop("_b")
    return sure.unionByName(rows(3, "written_amount", 0.7, written_number(F.col("g0")))).unionByName(left)


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def companies(texts: DataFrame) -> DataFrame:
    """(text_id, name, type, confidence): companies called customers (.9), and names with a company's suffix (.75), whose role is that of the words within CONTEXT characters
    of them; of equal names in a text (in any case) the surest, then the first found."""
    def valid(found: DataFrame) -> DataFrame:
        name = F.col("name")
        return found.where(~F.lower(name).isin(*NO_NAMES) & F.length(name).between(3, 100) & ~name.rlike(r"^\d+$") & (F.size(F.split(name, r"\s+")) <= 8))

    found = _cut(matches.found(texts, (*COMPANY_RULES, *ROLE_RULES)))
    last = len(CUSTOMERS)
    customers = valid(found.where(F.col("rule") < last).select("text_id", "rule", "k", _trimmed(F.col("g1")).alias("name"))).select("text_id", "rule", "k", "name", F.lit("customer").alias("type"), F.lit(0.9).alias("confidence"))
    suffixed = valid(found.where(F.col("rule") == last).select("text_id", "k", "start", "end", F.concat(_trimmed(F.col("g1")), F.lit(" "), "g2").alias("name")))
    words = found.where(F.col("rule") > last).select("text_id", (F.col("rule") - (last + 1)).alias("role"), F.col("start").alias("at"), F.col("end").alias("to"))
    width = 4 * CONTEXT
    reach = F.sequence(F.floor((F.col("start") - CONTEXT) / width), F.floor((F.col("end") + CONTEXT) / width))
    placed = suffixed.withColumn("_b", F.explode(reach)).alias("c").join(words.withColumn("_b", F.floor(F.col("at") / width)).alias("w"), ["text_id", "_b"])
    near = placed.where((F.col("at") >= F.col("start") - CONTEXT) & (F.col("to") <= F.col("end") + CONTEXT)).groupBy("text_id", "k").agg(F.min("role").alias("role"))
    role = F.coalesce(F.get(F.array(*[F.lit(r) for r, _ in ROLE_WORDS]), F.col("role")), F.lit("unknown"))
    others = suffixed.join(near, ["text_id", "k"], "left").select("text_id", F.lit(len(CUSTOMERS)).alias("rule"), "k", "name", role.alias("type"), F.lit(0.75).alias("confidence"))
    clean = _trimmed(F.regexp_replace(F.regexp_replace("name", r"\s+", " "), "[,;]$", ""))
    whole = customers.unionByName(others).withColumn("name", clean)
    best = whole.groupBy("text_id", F.lower("name").alias("_n")).agg(F.min_by(F.struct("name", "type", "confidence"), F.struct(-F.col("confidence"), "rule", "k")).alias("b"))
    return best.select("text_id", "b.*")


def entities(texts: DataFrame) -> DataFrame:
    """(text_id, type, text, confidence, start, end) of addresses, phones, money, dates, organisations, people and titles."""
    return _typed(matches.found(texts, ENTITY_RULES))


def _typed(found: DataFrame) -> DataFrame:
    def of(value) -> Column:
        return F.get(F.array(*[value(*e) for e in ENTITIES]), F.col("rule"))

    start = of(lambda kind, confidence, group, p: F.col("start") + F.length("g1") + 1 if group else F.col("start"))
    return found.select("text_id", of(lambda kind, *_: F.lit(kind)).alias("type"), of(lambda kind, confidence, group, p: F.col(f"g{group}")).alias("text"), of(lambda kind, confidence, *_: F.lit(confidence)).alias("confidence"), start.alias("start"), "end")


def relations(texts: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(text_id, relation, one, two, confidence, start): who works for whom, has which title, uses what, where both ends are entities of the text (found: entities()); of several
    that fit, the first. A person is the words themselves; organisations and titles hold them."""
    ends = ("PERSON", "ORGANIZATION", "JOB_TITLE")
    # entities that are no ends are not looked for: rules keep their numbers
    wanted = [i for i, (kind, *_) in enumerate(ENTITIES) if kind in ends and found is None]
    told = _cut(matches.found(texts, [*(ENTITY_RULES[i] for i in wanted), *RELATION_RULES]))
    if found is None:
        found = _typed(told.where(F.col("rule") < len(wanted)).withColumn("rule", F.get(F.array(*[F.lit(i) for i in wanted]), F.col("rule"))))
    out = None
    for i, (relation, confidence, kind_1, group_1, kind_2, group_2, _) in enumerate(RELATIONS, len(wanted)):
        said = told.where(F.col("rule") == i).select("text_id", "k", "start", F.col(f"g{group_1}").alias("_1"), F.col(f"g{group_2}").alias("_2"))
        for side, kind in ((1, kind_1), (2, kind_2)):
            ends = found.where(F.col("type") == kind).groupBy("text_id", "text").agg(F.min("start").alias("_at"))
            fits = (F.col("text") == F.col(f"_{side}")) if kind == "PERSON" else F.contains("text", F.col(f"_{side}"))
            joined = said.alias("s").join(ends.alias("e"), (F.col("s.text_id") == F.col("e.text_id")) & fits).select("s.*", F.struct(F.col("_at"), F.col("text")).alias("_e"))
            first = joined.groupBy("text_id", "k").agg(F.min("_e").alias("_e")).select("text_id", "k", F.col("_e.text").alias(("one", "two")[side - 1]))
            said = said.join(first, ["text_id", "k"])
        said = said.select("text_id", F.lit(relation).alias("relation"), "one", "two", F.lit(confidence).alias("confidence"), "start")
        out = said if out is None else out.unionByName(said)
    return out


# ---------------------------------------------------------------- D23

#: Weights of name, customer, value and status, and the least similarity.
LIKE = {"name": 0.4, "customer": 0.3, "value": 0.2, "status": 0.1}
DUPLICATE = 0.85


def _tokens(x: Column) -> Column:
    return F.array_distinct(F.split(F.lower(x), r"\s+"))


def _similarity(a: tuple, b: tuple) -> float:
    """The weighted similarity of two deals (tokens of name, of customer, value, status; empty, 0 or '' where it lacks) over the fields that both have."""
    total = weight = 0.0
    for field, k in (("name", 0), ("customer", 1)):
        if a[k] and b[k]:
            common = len(a[k] & b[k])
            total, weight = total + LIKE[field] * (common / (len(a[k]) + len(b[k]) - common)), weight + LIKE[field]
    if a[2] != 0 and b[2] != 0:
        total, weight = total + LIKE["value"] * (1 - abs(a[2] - b[2]) / max(a[2], b[2])), weight + LIKE["value"]
    if a[3] and b[3]:
        total, weight = total + LIKE["status"] * (a[3] == b[3]), weight + LIKE["status"]
    return total / weight if weight > 0 else 0.0


def fold(deals: list[tuple], confidence: list[float], least: float) -> tuple[list[int], list[int]]:
    """Which deals of a text stay, and which are duplicates, by their numbers. Two deals with names need so many tokens of them in common that one looks up the uniques that have one of its rarest
    tokens, not all; where values may be negative, or least is low, it is compared with all."""
    share = 1 - (1 - least) / LIKE["name"]  # of the tokens of both names
    narrow = share > 0.01 and all(d[2] >= 0 for d in deals)
    unique, duplicates, held, unnamed = [], [], {}, set()
    for k, d in enumerate(deals):
        places = range(len(unique))
        if narrow and d[0]:
            tokens = sorted(d[0], key=lambda w: len(held.get(w, ())))
            probes = tokens[: len(tokens) - math.ceil(share * len(tokens) - 1e-6) + 1]
            places = sorted(unnamed.union(*[held.get(w, ()) for w in probes]))
        at = next((p for p in places if round(_similarity(d, deals[unique[p]]), 9) >= least), None)
        if at is not None and not confidence[k] > confidence[unique[at]]:
            duplicates.append(k)
            continue
        if at is None:
            at = len(unique)
            unique.append(k)
        else:
            duplicates.append(unique[at])
            unique[at] = k
        # a place keeps the tokens of what stood there before: it is only compared more often
        for w in d[0]:
            held.setdefault(w, set()).add(at)
        if not d[0]:
            unnamed.add(at)
    return unique, duplicates


def unique_deals(deals: Column, least: float = DUPLICATE) -> Column:
    """(unique, duplicates), both arrays, of a text's deals (an array of structs of name, customer, value, status and confidence, in their order). A deal is a duplicate of the first
    unique one that it is like; the surer of the two stays in that place. A fold over one row's array, in Arrow batches: texts never meet."""
    kinds = {"name": "string", "customer": "string", "value": "double", "status": "string", "confidence": "double"}

    def tokens(field: str) -> Column:
        return F.transform(deals, lambda d: F.when(F.coalesce(d[field], F.lit("")) != "", _tokens(d[field])).otherwise(F.array().cast("array<string>")))

    def of(names: pd.Series, customers: pd.Series, values: pd.Series, statuses: pd.Series, confidence: pd.Series) -> pd.DataFrame:
        rows = []
        for n, c, v, s, x in zip(names, customers, values, statuses, confidence, strict=True):
            rows.append(([], []) if n is None else fold(list(zip(map(frozenset, n), map(frozenset, c), map(float, v), s, strict=True)), [float(y) for y in x], least))
        return pd.DataFrame(rows, columns=["unique", "duplicates"])

    ship()
    none = float("nan")  # unknown confidences are never surer, nor less sure
    numbers = F.pandas_udf(of, "unique array<int>, duplicates array<int>").asNondeterministic()(
        tokens("name"), tokens("customer"), F.transform(deals, lambda d: F.coalesce(d["value"].cast("double"), F.lit(0.0))), F.transform(deals, lambda d: F.coalesce(d["status"].cast("string"), F.lit(""))), F.transform(deals, lambda d: F.coalesce(d["confidence"].cast("double"), F.lit(none))))

    def found(x: Column, which: str) -> Column:
        return F.transform(x["numbers"][which], lambda k: F.struct(*[F.get(x["deals"], k)[f].cast(kind).alias(f) for f, kind in kinds.items()])).alias(which)

    # bound to a variable: as an expression, the deals would be made anew for each number
    bound = F.array(F.struct(deals.alias("deals"), numbers.alias("numbers")))
    return F.get(F.transform(bound, lambda x: F.struct(found(x, "unique"), found(x, "duplicates"))), F.lit(0))
