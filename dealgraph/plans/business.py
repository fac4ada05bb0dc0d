"""Whole records, second forms of names, value checks and signals, with the SQL that gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgraph.functions import business, fields, text
from dealgraph.functions.normalize import vendor_key
from dealgraph.operators import vendor_match
from dealgraph.plans.extraction import texts, texts_sql
from dealgraph.plans.named import VENDORS, vendor_catalogue, vendor_mentions
from dealgraph.plans.registry import register
from dealgraph.plans.scalars import customers, customers_sql
from dealgraph.plans.written import written, written_sql
from dealgraph.sources.fixtures import table

RAW_NAMES = ["javelintelecom{}", "ACME_CORP {}", "northpowersystems", "IBM-{} group", "the  Energy company{}", "A solutionsSOLUTIONS {}", "abc DEF {}", "", None, "fiber{}cable"]


def _glued(x: str) -> str:
    out = f"regexp_replace({x}, '[_-]', ' ', 'g')"
    ctes = [f"g0 AS (SELECT id, {out} AS x FROM t)"]
    for i, word in enumerate(business.GLUED_WORDS):
        ctes.append(f"g{i + 1} AS (SELECT id, CASE WHEN contains(lower(x), '{word}') AND NOT contains(lower(x), ' {word}') THEN regexp_replace(x, '(?i){word}', ' {word.capitalize()}', 'g') ELSE x END AS x FROM g{i})")
    return ",".join(ctes)


register("f08_titled_company", lambda s, d: customers(s, d, RAW_NAMES).select("id", business.titled_company(F.col("x")).alias("y")), customers_sql(RAW_NAMES).rstrip() + "," + _glued("x") + rf"""
SELECT id, trim(array_to_string(list_transform(string_split_regex(x, '\s+'), lambda w: CASE WHEN length(w) BETWEEN 2 AND 4 AND w = upper(w) THEN w ELSE upper(w[1]) || lower(w[2:]) END), ' '), ' ') AS y FROM g{len(business.GLUED_WORDS)}""")

SITES = ["https://www.acme{}.com/x", "acme{}.org", "http://user@shop.www.acme.io:8080", "", None, "HTTP bad {}"]
DOMAINS = ["www.dell-emc.com", "ibm.com", "acme-{}-widgets.co", "x{}.gov", None, "", "RedHat.com", "sub.acme.net"]


def f09(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    n = k.cast("string")
    site = written(n, k, SITES)
    found = business.domains_of(F.when(k % 3 > 0, F.concat(F.lit("Ann <a@Mail"), n, F.lit(".Example.org>"))), site, F.array(F.lit("b@acme1.com"), F.lit(None).cast("string"), F.concat(F.lit("c@acme"), (k % 5).cast("string"), F.lit(".org"))))
    return table(s, d, "customer").select(k.alias("id"), F.array_join(found, ",").alias("domains"), business.company_of_domain(written(n, k, DOMAINS)).alias("company"))


register("f09_domains", f09, f"""
WITH t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN 'mail' || c_custkey || '.example.org' END AS m, {written_sql('c_custkey::VARCHAR', 'c_custkey', SITES)} AS site, 'acme' || (c_custkey % 5) || '.org' AS c, {written_sql('c_custkey::VARCHAR', 'c_custkey', DOMAINS)} AS dom FROM customer),
h AS (SELECT *, nullif(lower(regexp_extract(CASE WHEN starts_with(site, 'http') THEN site ELSE 'https://' || site END, '^https?://(?:[^/?#@]*@)?([^/:?#\\s]+)', 1)), '') AS host, regexp_replace(regexp_replace(dom, '^www\\.', ''), '\\.(com|net|org|io|co|edu|gov)$', '') AS part FROM t),
l AS (SELECT *, list_filter([m, regexp_replace(host, 'www\\.', ''), 'acme1.com', c], lambda v: v IS NOT NULL) AS vs FROM h)
SELECT id, array_to_string(list_filter(vs, lambda v, i: list_position(vs, v) = i), ',') AS domains, CASE WHEN coalesce(dom, '') = '' THEN 'Unknown' ELSE coalesce(MAP {{{', '.join(f"'{a}': '{b}'" for a, b in business.DOMAIN_NAMES.items())}}}[lower(part)],
 array_to_string(list_transform(string_split(replace(part, '-', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')) END AS company FROM l""")

VALUES = ["{}", "{}.50", "-{}", "n/a", "12", "99000000", "", None, " {}"]
CODES = ["usd", "EUR", "XYZ", "", None]
SOURCES = ["it costs {} in all", "a total of {}.5", "nothing here", "", None, "9,90 or 12 or 99,000,000 it is"]


def f16(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = F.floor("o_totalprice").cast("string")
    t = table(s, d, "orders").select(k.alias("id"), business.value_issues(written(n, k, VALUES), written(n, F.floor(k / 2), CODES), written(n, F.floor(k / 3), SOURCES)).alias("v"))
    return t.select("id", F.array_join("v.issues", ",").alias("issues"), "v.valid", "v.adjustment")


_N = "floor(o_totalprice)::BIGINT::VARCHAR"
register("f16_value_issues", f16, rf"""
WITH t AS (SELECT o_orderkey AS id, {written_sql(_N, 'o_orderkey', VALUES)} AS v, {written_sql(_N, '(o_orderkey // 2)', CODES)} AS c, {written_sql(_N, '(o_orderkey // 3)', SOURCES)} AS s FROM orders),
n AS (SELECT *, try_cast(nullif(regexp_extract(v, '^\s*([+-]?(?:\d+\.?\d*|\.\d+))', 1), '') AS DECIMAL(24, 6)) AS n FROM t),
x AS (SELECT *, coalesce(n > 0, false) AS p, CASE WHEN n = floor(n) THEN floor(n)::BIGINT::VARCHAR ELSE rtrim(n::VARCHAR, '0') END AS a FROM n),
i AS (SELECT id, p, NOT p AS r1, coalesce(n < 100 OR n > 10000000, false) AS r2, coalesce(c, '') <> '' AND upper(c) NOT IN {business.CURRENCIES} AS r3, p AND coalesce(s, '') <> '' AND NOT (contains(s, a) OR contains(s, format('{{:,}}', floor(n)::BIGINT) || CASE WHEN n = floor(n) THEN '' ELSE a[strpos(a, '.'):] END)) AS r4 FROM x)
SELECT id, concat_ws(',', CASE WHEN r1 THEN 'value_positive:critical' END, CASE WHEN r2 THEN 'value_range:warning' END, CASE WHEN r3 THEN 'currency_valid:warning' END, CASE WHEN r4 THEN 'value_context_check:warning' END) AS issues, p AS valid,
 CASE WHEN r1 THEN -0.3 WHEN r2 OR r3 OR r4 THEN -0.1 ELSE 0 END::DOUBLE AS adjustment FROM i""")


def f24(s: SparkSession, d: str) -> DataFrame:
    """How sure a deal is by its order's lines: cheap, middling and dear ones are the keywords of the tiers, what the lines have are the parts."""
    x = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(*[F.count_if(F.col("l_returnflag") == f).alias(f) for f in "ANR"], F.max("l_tax").alias("tax"), F.max("l_discount").alias("off"), F.sum("l_quantity").alias("q"))
    c = business.enhanced_confidence([F.col("A") * 0.5, F.col("N"), F.col("R")], F.col("q") > 50, F.col("q") > 100, F.col("tax") > 0.05, F.col("off") > 0.05, F.col("A") > 0, F.col("tax") * 10, F.when(F.col("off") > 0.03, F.col("off") * 8))
    return x.select("id", F.round(c, 6).alias("confidence"))


register("f24_enhanced_confidence", f24, """
WITH x AS (SELECT l_orderkey AS id, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r, max(l_tax) AS t, max(l_discount) AS o, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT id, round(least(1, (0.3::DOUBLE * (a * 0.5::DOUBLE) + 0.15::DOUBLE * n + 0.05::DOUBLE * r + CASE WHEN q > 50 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN q > 100 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN t > 0.05::DOUBLE THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN o > 0.05::DOUBLE THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN a > 0 THEN 0.05 ELSE 0 END::DOUBLE)
 * CASE WHEN t <> 0 THEN 0.7::DOUBLE + t * 10 * 0.3::DOUBLE ELSE 1 END * CASE WHEN o > 0.03::DOUBLE THEN 0.7::DOUBLE + o * 8 * 0.3::DOUBLE ELSE 1 END), 6)::DOUBLE AS confidence FROM x""")

NOTES = ["We need 5-10 cabinets, plus 40 units and 1,500 - 4,000 pcs. {} $7-8k per cabinet, margins must stay around 27-30%, a purchase order in 6 weeks", "{}\nETA: soon, 12k USD per board, Q3 2025 or March 2026, 30 % gross margin; ann lee asks for a quote request", "{}", None, "Bob: field trial of the buck-converter\n{} margin target: 15 % deployed lab"]
TAGS = {"cabinets": ("cabinet", "cabinets"), "converters": ("buck-converter", "buck converter"), "the": ("the",)}
ACTORS = {"ann": ("ann lee", "ann"), "bob": ("bob",)}


def e33(s: SparkSession, d: str) -> DataFrame:
    x = texts(s, d, NOTES).where("text is not null").select("text_id", business.signals(F.col("text"), TAGS, ACTORS).alias("x"))
    return x.select("text_id", *[F.array_join(f"x.{c}", "|").alias(c) for c in (*business.SIGNALS, "tags", "actors", "hints")])


def _hits(patterns) -> str:
    every = " || ".join("regexp_extract_all(text, '(?i)" + p.replace("'", "''") + "')" for p in patterns)
    return rf"list_filter(list_transform({every}, lambda v: trim(regexp_replace(v, '\s+', ' ', 'g'), ' ')), lambda v: v <> '')"


def _labels(words) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN regexp_matches(text, '(?i)\\b(?:{'|'.join(re.escape(w).replace(chr(92) + ' ', ' ') for w in ws)})\\b') THEN '{n}' END" for n, ws in words.items()) + ")"


register("e33_signals", e33, texts_sql(NOTES) + ", l AS (SELECT text_id, text, " + ", ".join(f"{_hits(p)} AS {n}" for n, p in business.SIGNALS.items()) + " FROM t WHERE text IS NOT NULL) SELECT text_id, "
         + ", ".join(f"array_to_string(list_filter({n}, lambda v, i: list_position({n}, v) = i), '|') AS {n}" for n in business.SIGNALS) + f", {_labels(TAGS)} AS tags, {_labels(ACTORS)} AS actors, {_labels(business.STAGES)} AS hints FROM l")


def f07_deals(s: SparkSession, d: str) -> DataFrame:
    """Orders as imports have them."""
    k = F.col("o_orderkey")
    n = F.floor("o_totalprice").cast("string")
    raw = {"deal_value": written(n, k, ["${}", "{}k", None]), "customer_name": written(k.cast("string"), k, ["Acme  {} Inc", "", " B "]), "expected_close_date": F.date_format("o_orderdate", "yyyy-MM-dd"), "status": written(F.lit(""), k, ["Won", "new", None]),
           "decision_maker_email": written(k.cast("string"), k, ["A{}@B.c", "", None]), "decision_maker_phone": written(F.lit(""), k, ["555-123-4567", None])}
    return business.deal_records(table(s, d, "orders").select(k.alias("id"), *[c.alias(n) for n, c in raw.items()]))


register("f07_deals", f07_deals, """
SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN floor(o_totalprice) WHEN 1 THEN floor(o_totalprice) * 1000 ELSE 0 END::DOUBLE AS deal_value, 'USD' AS currency, CASE o_orderkey % 3 WHEN 0 THEN 'Acme ' || o_orderkey || ' Inc' WHEN 2 THEN 'B' END AS customer_name, strftime(o_orderdate, '%Y-%m-%d') AS expected_close_date,
 CASE o_orderkey % 3 WHEN 0 THEN 'closed_won' ELSE 'registered' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'a' || o_orderkey || '@b.c' END AS decision_maker_email, CASE WHEN o_orderkey % 2 = 0 THEN '+15551234567' END AS decision_maker_phone FROM orders""")
register("f07_vendors", lambda s, d: business.vendor_records(customers(s, d, ["Acme {} Inc", "B  {} LLC", "{}"]).select("id", F.col("x").alias("name"), F.array(F.lit(" A.COM "), F.concat(F.lit("B"), F.col("id").cast("string"))).alias("email_domains"), written(F.col("id").cast("string"), F.col("id"), ["WWW.X{}.com ", "", None, "y"]).alias("website"))), """
SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'Acme ' || c_custkey WHEN 1 THEN 'B ' || c_custkey ELSE c_custkey::VARCHAR END AS name, ['a.com', 'b' || c_custkey] AS email_domains, CASE c_custkey % 4 WHEN 0 THEN 'www.x' || c_custkey || '.com' WHEN 3 THEN 'y' END AS website FROM customer""")
register("f07_contacts", lambda s, d: business.contact_records(customers(s, d, [" Ann {} ", ""]).select("id", F.col("x").alias("name"), written(F.col("id").cast("string"), F.col("id"), ["X{}@Y.Z", None, ""]).alias("email"), written(F.lit(""), F.col("id"), ["+1 555 123 4567", ""]).alias("phone"))), """
SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'Ann ' || c_custkey END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'x' || c_custkey || '@y.z' END AS email, CASE WHEN c_custkey % 2 = 0 THEN '+15551234567' END AS phone FROM customer""")

register("e09_links", lambda s, d: table(s, d, "pages").select("page_id", F.md5(text.linked_text(F.col("html"))).alias("digest"), text.is_html(written(F.col("html"), F.col("page_id"), ["{}", "a < b", "", None])).alias("is_html")),
         rf"""SELECT page_id, md5(regexp_replace(html, '(?i)<a\s+(?:[^>]*?\s+)?href="([^"]*)"[^>]*>(.*?)</a>', '[\2](\1)', 'g')) AS digest, coalesce(regexp_matches({written_sql('html', 'page_id', ["{}", "a < b", "", None])}, '(?i)<[a-z](?s:.*)>'), false) AS is_html FROM pages""")
RANGES = ["{}h", "{}d", "{}w", "{}", "h{}", "", None, "{}D"]
register("f42_time_ranges", lambda s, d: table(s, d, "events").select("event_id", fields.range_hours(written((F.col("user_id") % 50).cast("string"), F.col("event_id"), RANGES)).alias("hours")),
         rf"WITH t AS (SELECT event_id, {written_sql('(user_id % 50)::VARCHAR', 'event_id', RANGES)} AS x FROM events) SELECT event_id, CASE WHEN regexp_matches(x, '^\d+[hdw]$') THEN left(x, length(x) - 1)::BIGINT * CASE right(x, 1) WHEN 'h' THEN 1 WHEN 'd' THEN 24 ELSE 168 END ELSE 24 END::BIGINT AS hours FROM t")
register("f20_vendor_reference", lambda s, d: vendor_match.cross_reference(vendor_mentions(s, d), vendor_catalogue(s, d).withColumn("normalized_name", vendor_key(F.col("vendor_name")))), VENDORS + """
, x AS (SELECT mention_id, vendor_id, trim(lower(name)) AS m, trim(lower(vendor_name)) AS v, vc.k AS k, domains FROM vm, vc WHERE trim(coalesce(name, '')) <> ''),
f AS (SELECT mention_id, vendor_id, CASE WHEN m = v OR m = k THEN 0 WHEN len(list_filter(domains, lambda z: contains(m, z) OR contains(z, m))) > 0 THEN 1 WHEN contains(m, v) OR contains(v, m) THEN 2 END AS r FROM x)
SELECT mention_id, vendor_id, CASE r WHEN 0 THEN 'exact' WHEN 1 THEN 'partial' ELSE 'fuzzy' END AS match, CASE r WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.7 END::DOUBLE AS confidence FROM f WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY vendor_id) = 1""")
