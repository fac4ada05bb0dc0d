"""Vendors by products, containment and in texts, aliases, detections and reviews, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgraph.operators import vendor_match, vendor_search
from dealgraph.plans.named import VENDORS, ratio_ctes, vendor_catalogue, vendor_mentions
from dealgraph.plans.registry import register
from dealgraph.plans.written import written, written_sql
from dealgraph.sources.fixtures import SQL, deals, table

KEY = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'), '\\b(inc|llc|ltd|corp|corporation|company|co)\\b', '', 'g'))"


def products(s: SparkSession, d: str) -> DataFrame:
    """(mention_id, products): two parts' names an order, one of them shortened."""
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b"))
    p, q = table(s, d, "part").select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x")), table(s, d, "part").select(F.col("p_partkey").alias("b"), F.col("p_name").alias("y"))
    return lines.join(p, "a").join(q, "b").select(F.col("l_orderkey").alias("mention_id"), F.array(F.initcap("x"), F.element_at(F.split("y", " "), 1)).alias("products"))


def keywords(s: SparkSession, d: str) -> DataFrame:
    """(vendor_id, keywords): the part with the supplier's number, whole or its last word, and its type."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("vendor_id"), "p_name", "p_type")
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("vendor_id")).join(p, "vendor_id").select("vendor_id", F.array(F.when(F.col("vendor_id") % 2 == 0, F.col("p_name")).otherwise(F.element_at(F.split("p_name", " "), -1)), F.lower("p_type")).alias("keywords"))


_PRODUCTS = f"""WITH l AS (SELECT l_orderkey AS mention_id, min(l_partkey) AS a, max(l_partkey) AS b FROM lineitem GROUP BY 1),
m AS (SELECT mention_id, [p.p_name, string_split(q.p_name, ' ')[1]] AS products FROM l JOIN part p ON p.p_partkey = a JOIN part q ON q.p_partkey = b),
v AS (SELECT s_suppkey AS vendor_id, [CASE WHEN s_suppkey % 2 = 0 THEN p_name ELSE string_split(p_name, ' ')[-1] END, lower(p_type)] AS keywords FROM supplier JOIN part ON p_partkey = s_suppkey)"""
_HIT = "len(list_filter({0}, lambda p: len(list_filter({1}, lambda k: contains(p, k) OR contains(k, p))) > 0))"
register("v05_similar_name", lambda s, d: vendor_search.by_similar_name(vendor_mentions(s, d), vendor_catalogue(s, d)).withColumn("score", F.round("score", 5)), VENDORS + """
, f AS (SELECT mention_id, vendor_id, (ratio + dice) / 2 AS score FROM vm JOIN nr ON a = k JOIN vc ON vc.k = b QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY (ratio + dice) / 2 DESC, vendor_name, vendor_id) = 1)
SELECT mention_id, vendor_id, round(score, 5) AS score, CASE WHEN score >= 95 THEN 0.98 WHEN score >= 85 THEN 0.85 WHEN score >= 70 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN score >= 95 THEN 'fuzzy_exact' WHEN score >= 85 THEN 'fuzzy_high' WHEN score >= 70 THEN 'fuzzy_medium' ELSE 'fuzzy_low' END AS strategy FROM f WHERE score >= 50""")
register("v11_alias_suggestions", lambda s, d: vendor_search.suggestions(vendor_mentions(s, d), vendor_catalogue(s, d)), VENDORS + """
SELECT mention_id, row_number() OVER (PARTITION BY mention_id ORDER BY ratio DESC, vendor_name, vendor_id)::INT AS rank, vendor_id, ratio / 100 AS confidence FROM vm JOIN nr ON a = k JOIN vc ON vc.k = b WHERE ratio >= 50 AND ratio < 85 QUALIFY rank <= 5""")
_TERMS = VENDORS + "," + ratio_ctes("tr", "SELECT x.t AS a, y.t AS b FROM (SELECT DISTINCT unnest(products) AS t FROM vm) x, (SELECT DISTINCT unnest(products) AS t FROM vc) y") + """
, ph AS (SELECT mention_id, vendor_id, vendor_name, len(vm.products) AS n, len(list_filter(vm.products, lambda p: len(list_filter(vc.products, lambda k: contains(p, k) OR contains(k, p) OR list_contains(close, p || '|' || k))) > 0)) AS hits FROM vm, vc, (SELECT list(a || '|' || b) AS close FROM tr WHERE ratio >= 85) WHERE vc.products[1] IS NOT NULL)
, pm AS (SELECT mention_id, vendor_id, 'product_match' AS strategy, round(least(0.85, 0.5 + hits / n * 0.35), 6)::DOUBLE AS confidence FROM ph WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY hits DESC, vendor_name, vendor_id) = 1)"""
register("v06_product_match", lambda s, d: vendor_search.by_product_terms(vendor_mentions(s, d), vendor_catalogue(s, d)), _TERMS + " SELECT * FROM pm")
_COMBINED = f"""
, cs AS (SELECT mention_id, vendor_id, vendor_name, round(0.4 * coalesce(dice, 0) / 100 + CASE WHEN list_contains(domains, domain) THEN 0.25 ELSE 0 END + 0.2 * CASE WHEN len(vm.products) > 0 THEN {_HIT.format('vm.products', 'vc.products')} / len(vm.products) ELSE 0 END
    + 0.1 * CASE WHEN len(keywords) > 0 THEN {_HIT.format('keywords', 'vc.products')} / len(keywords) ELSE 0 END, 9)::DOUBLE AS score FROM vm CROSS JOIN vc LEFT JOIN nr ON a = vm.k AND b = vc.k)
, cm AS (SELECT mention_id, vendor_id, 'combined_factors' AS strategy, least(0.95, score) AS confidence FROM cs WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, vendor_name, vendor_id) = 1)"""
register("v07_combined_match", lambda s, d: vendor_search.by_factors(vendor_mentions(s, d), vendor_catalogue(s, d)).withColumn("confidence", F.round("confidence", 6)), VENDORS + _COMBINED + " SELECT * REPLACE (round(confidence, 6) AS confidence) FROM cm")


def vendor_aliases(s: SparkSession, d: str) -> DataFrame:
    """(alias, vendor_id, confidence): some mentions' names as aliases."""
    return vendor_mentions(s, d).where("mention_id % 9 = 2").select(F.col("name").alias("alias"), (F.col("mention_id") % 77).alias("vendor_id"), F.when(F.col("mention_id") % 2 == 0, F.col("mention_id") % 10 / 10).alias("confidence")).where("alias is not null").distinct()


_CASCADE = _TERMS + _COMBINED + """
, al AS (SELECT k, arg_max(mention_id % 77, (coalesce(CASE WHEN mention_id % 2 = 0 THEN mention_id % 10 / 10 END, 0.95), -(mention_id % 77))) AS vendor_id, max(coalesce(CASE WHEN mention_id % 2 = 0 THEN mention_id % 10 / 10 END, 0.95))::DOUBLE AS confidence FROM vm WHERE mention_id % 9 = 2 AND k <> '' GROUP BY 1)
, f AS (SELECT mention_id, vendor_id, (ratio + dice) / 2 AS score FROM vm JOIN nr ON a = k JOIN vc ON vc.k = b QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY (ratio + dice) / 2 DESC, vendor_name, vendor_id) = 1)
, found AS (SELECT mention_id, vendor_id, 'exact_name' AS strategy, 1.0::DOUBLE AS confidence, 1 AS r FROM vm JOIN vc USING (k) WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY vendor_name, vendor_id) = 1
UNION ALL SELECT mention_id, vendor_id, 'alias_match', confidence, 2 FROM vm JOIN al USING (k)
UNION ALL SELECT * FROM (SELECT mention_id, vendor_id, 'email_domain', 0.9, 3 FROM vm JOIN vc ON list_contains(domains, domain) QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY vendor_name, vendor_id) = 1)
UNION ALL SELECT mention_id, vendor_id, CASE WHEN score >= 95 THEN 'fuzzy_exact' WHEN score >= 85 THEN 'fuzzy_high' WHEN score >= 70 THEN 'fuzzy_medium' ELSE 'fuzzy_low' END, CASE WHEN score >= 95 THEN 0.98 WHEN score >= 85 THEN 0.85 WHEN score >= 70 THEN 0.7 ELSE 0.5 END, 4 FROM f WHERE score >= 50
UNION ALL SELECT mention_id, vendor_id, strategy, confidence, 5 FROM pm UNION ALL SELECT mention_id, vendor_id, strategy, confidence, 6 FROM cm)
SELECT mention_id, row_number() OVER (PARTITION BY mention_id ORDER BY confidence DESC, r)::INT AS rank, vendor_id, strategy, round(confidence, 6)::DOUBLE AS confidence FROM found WHERE confidence >= 0.3 QUALIFY rank <= 4"""


def v01(s: SparkSession, d: str) -> DataFrame:
    return vendor_search.cascade(vendor_mentions(s, d), vendor_catalogue(s, d), vendor_aliases(s, d))


register("v01_match_cascade", v01, _CASCADE)
register("v14_match_levels", lambda s, d: v01(s, d).where("rank = 1").groupBy(vendor_match.level(F.col("confidence")).alias("level")).agg(F.count("*").alias("n")), f"SELECT CASE WHEN confidence >= 0.9 THEN 'High' WHEN confidence >= 0.7 THEN 'Medium' ELSE 'Low' END AS level, count(*) AS n FROM ({_CASCADE}) WHERE rank = 1 GROUP BY 1")


def engine_inputs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = vendor_catalogue(s, d)
    return vendor_mentions(s, d), v.withColumn("aliases", F.array(F.concat(F.lit("the "), F.col("vendor_name")), F.concat(F.lit("V"), F.col("vendor_id").cast("string")))).withColumn("keywords", F.transform("products", lambda x: F.concat(x, F.lit(" kit"))))


_EKEY = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\s+(inc|llc|ltd|corp|corporation|company|co|limited|gmbh|ag|sa|bv|nv)\.?$', ''), '[^\w\s]', '', 'g'), '\s+', ' ', 'g'))"
_EHELD = "len(list_filter({0}, lambda p: len(list_filter({1}, lambda q: contains(" + _EKEY.format("q") + ", " + _EKEY.format("p") + "))) > 0)) / len({0})"
register("v15_engine", lambda s, d: vendor_search.engine(*engine_inputs(s, d)), VENDORS + f"""
, ev AS (SELECT *, {_EKEY.format('vendor_name')} AS e, [{_EKEY.format("'the ' || vendor_name")}, 'v' || vendor_id] AS aliases, list_transform(products, lambda x: x || ' kit') AS words FROM vc),
em AS (SELECT *, {_EKEY.format('name')} AS e FROM vm),
""" + ratio_ctes("er", "SELECT x.e AS a, y.e AS b FROM (SELECT DISTINCT e FROM em) x, (SELECT DISTINCT e FROM ev) y") + f"""
, x AS (SELECT mention_id, vendor_id, name, lower(name) = lower(vendor_name) AS same, em.e AS e, ev.e AS f, list_contains(aliases, em.e) AS aliased, list_contains(domains, domain) AS domained, round((ratio / 100 + dice / 100) / 2, 9) AS mean, dice / 100 AS dice,
  len(list_filter(em.products, lambda p: list_contains(list_transform(ev.products, lambda q: {_EKEY.format('q')}), {_EKEY.format('p')}) OR contains(ev.e, {_EKEY.format('p')}) OR contains({_EKEY.format('p')}, ev.e))) AS hits,
  CASE WHEN len(em.products) > 0 THEN {_EHELD.format('em.products', 'ev.products')} ELSE 0 END AS ps, CASE WHEN len(em.keywords) > 0 THEN {_EHELD.format('em.keywords', 'ev.words')} ELSE 0 END AS ks FROM em CROSS JOIN ev LEFT JOIN er ON a = em.e AND b = ev.e),
y AS (SELECT *, round(0.4 * coalesce(dice, 0) + CASE WHEN domained THEN 0.25 ELSE 0 END + 0.2 * ps + 0.1 * ks, 9) AS s FROM x),
found AS (SELECT mention_id, min(vendor_id) AS vendor_id, 'exact_name' AS strategy, 1.0::DOUBLE AS confidence, 1 AS r FROM x WHERE same AND name <> '' GROUP BY 1
UNION ALL SELECT mention_id, min(vendor_id), 'normalized_name', 1.0, 2 FROM x WHERE e = f AND e <> '' GROUP BY 1 UNION ALL SELECT mention_id, min(vendor_id), 'alias', 0.9, 3 FROM x WHERE aliased AND name <> '' GROUP BY 1
UNION ALL SELECT mention_id, min(vendor_id), 'email_domain', 0.9, 4 FROM x WHERE domained GROUP BY 1 UNION ALL SELECT mention_id, arg_max(vendor_id, (mean, -vendor_id)), 'fuzzy_name', max(mean), 5 FROM x WHERE mean >= 0.7 GROUP BY 1
UNION ALL SELECT mention_id, min(vendor_id), 'product', least(0.9, 0.7 + arg_min(hits, vendor_id) * 0.1), 6 FROM x WHERE hits > 0 GROUP BY 1 UNION ALL SELECT mention_id, arg_max(vendor_id, (s, -vendor_id)), 'combined', least(1, max(s)), 7 FROM y WHERE s >= 0.3 AND name <> '' GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY confidence DESC, r) AS k, first(vendor_id) OVER (PARTITION BY mention_id ORDER BY confidence DESC, r) AS best FROM found)
SELECT mention_id, row_number() OVER (PARTITION BY mention_id ORDER BY k)::INT AS rank, vendor_id, strategy, round(confidence, 6)::DOUBLE AS confidence FROM ranked WHERE k = 1 OR k <= 4 AND vendor_id <> best""")


def v10(s: SparkSession, d: str) -> DataFrame:
    m = products(s, d).join(deals(s, d).select(F.col("id").alias("mention_id"), "vendor_id"), "mention_id").join(keywords(s, d), "vendor_id")
    return m.select("mention_id", F.round(vendor_search.product_ratio(F.col("products"), F.col("keywords")), 6).alias("ratio"))


register("v10_product_ratio", v10, _PRODUCTS + """
, o AS (SELECT l_orderkey AS mention_id, min(l_suppkey) AS vendor_id FROM lineitem GROUP BY 1)
SELECT mention_id, round(len(list_filter(products, lambda p: len(list_filter(keywords, lambda k: contains(p, k) OR contains(k, p))) > 0)) / 2, 6)::DOUBLE AS ratio FROM m JOIN o USING (mention_id) JOIN v USING (vendor_id)""")

NAMES = ["Supplier#{} Inc.", "The Supplier#{} Holding", "Supplier{}", "plier#{}", "{}", "", None]


def mentions(s: SparkSession, d: str) -> DataFrame:
    n = F.lpad((F.col("c_custkey") * 7 % 140).cast("string"), 9, "0")
    return table(s, d, "customer").select(F.col("c_custkey").alias("mention_id"), written(n, F.col("c_custkey"), NAMES).alias("name"))


def catalogue(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("vendor_id"), F.col("s_name").alias("vendor_name"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".example.com")).alias("domain"))


TEXT_KEY = "trim(regexp_replace(regexp_replace(lower({0}), '\\b(inc|llc|ltd|corp|corporation|company|co)\\b\\.?', '', 'g'), '[^\\w\\s]', '', 'g'))"
_NUMBER = "lpad((c_custkey * 7 % 140)::VARCHAR, 9, '0')"
_MENTIONS = f"WITH m AS (SELECT c_custkey AS mention_id, {written_sql(_NUMBER, 'c_custkey', NAMES)} AS name FROM customer)"
register("v16_containment_match", lambda s, d: vendor_match.by_containment(mentions(s, d), catalogue(s, d)), _MENTIONS + f"""
, k AS (SELECT mention_id, {TEXT_KEY.format('name')} AS m FROM m), v AS (SELECT s_suppkey AS vendor_id, {TEXT_KEY.format('s_name')} AS v FROM supplier),
c AS (SELECT mention_id, vendor_id, least(length(m), length(v)) / greatest(length(m), length(v)) AS c FROM k JOIN v ON m <> '' AND (contains(m, v) OR contains(v, m)))
SELECT mention_id, arg_max(vendor_id, (c, -vendor_id)) AS vendor_id, round(max(c), 6)::DOUBLE AS confidence, CASE WHEN max(c) = 1 THEN 'normalized' ELSE 'fuzzy' END AS strategy FROM c WHERE c >= 0.75 GROUP BY 1""")

def v17(s: SparkSession, d: str) -> DataFrame:
    n, k = F.col("doc_id") % 130, F.col("doc_id")
    padded, text = F.lpad(n.cast("string"), 9, "0"), F.col("text")
    said = (F.when(k % 5 == 1, F.concat(F.lit("We spoke to SUPPLIER"), padded, F.lit(" about it. "), text)).when(k % 5 == 2, F.concat(text, F.lit(" ask jane.doe@S"), n.cast("string"), F.lit(".example.com or x@s1.example.com")))
            .when(k % 5 == 3, F.concat(F.lit("supplier"), padded, F.lit(": see a@s"), n.cast("string"), F.lit(".example.com "), text)).otherwise(text))
    return vendor_match.in_texts(table(s, d, "documents").select(k.alias("text_id"), said.alias("text")), catalogue(s, d))


register("v17_vendors_in_texts", v17, rf"""
WITH t AS (SELECT doc_id AS text_id, CASE doc_id % 5 WHEN 1 THEN 'We spoke to SUPPLIER' || lpad((doc_id % 130)::VARCHAR, 9, '0') || ' about it. ' || text WHEN 2 THEN text || ' ask jane.doe@S' || (doc_id % 130) || '.example.com or x@s1.example.com'
  WHEN 3 THEN 'supplier' || lpad((doc_id % 130)::VARCHAR, 9, '0') || ': see a@s' || (doc_id % 130) || '.example.com ' || text ELSE text END AS text FROM documents),
v AS (SELECT s_suppkey AS vendor_id, {TEXT_KEY.format('s_name')} AS v, 's' || s_suppkey || '.example.com' AS domain FROM supplier),
n AS (SELECT text_id, vendor_id FROM t JOIN v ON contains(lower(text), v)),
e AS (SELECT DISTINCT text_id, lower(unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{{2,}})\b', 1))) AS domain FROM t)
SELECT text_id, vendor_id, 'fuzzy' AS strategy, 0.8::DOUBLE AS confidence FROM n
UNION ALL SELECT text_id, vendor_id, 'domain', 0.9 FROM e JOIN v USING (domain) ANTI JOIN n USING (text_id, vendor_id)""")


def v03(s: SparkSession, d: str) -> DataFrame:
    aliases = table(s, d, "events").select(F.concat(F.lit("supplier#"), F.lpad((F.col("user_id") % 140).cast("string"), 9, "0")).alias("alias"), (F.col("event_id") % 97).alias("vendor_id"), F.when(F.col("event_id") % 4 > 0, F.floor("value") % 100 / 100).alias("confidence"), (F.col("event_id") % 5).alias("usage"))
    return vendor_match.best_alias(mentions(s, d), aliases)


register("v03_best_alias", v03, _MENTIONS + f"""
, a AS (SELECT 'supplier' || lpad((user_id % 140)::VARCHAR, 9, '0') AS k, event_id % 97 AS vendor_id, coalesce(CASE WHEN event_id % 4 > 0 THEN floor(value) % 100 / 100 END, 0.95)::DOUBLE AS confidence, event_id % 5 AS usage FROM events),
b AS (SELECT k, arg_max(vendor_id, (confidence, usage, -vendor_id)) AS vendor_id, max(confidence) AS confidence FROM a GROUP BY 1)
SELECT mention_id, vendor_id, confidence FROM m JOIN b ON k = {KEY.format('name')}""")


def v13(s: SparkSession, d: str) -> DataFrame:
    meta = F.when(F.col("event_id") % 6 > 0, F.to_json(F.struct(F.col("event_type").alias("matchStrategy"), (F.col("event_id") % 100 / 100).alias("matchConfidence")))).otherwise("{}")
    return vendor_match.strategy_statistics(table(s, d, "events").select(meta.alias("meta")), "meta")


register("v13_strategy_statistics", v13, "SELECT event_type AS strategy, count(*) AS matches, round(avg(event_id % 100 / 100), 6) AS avg_confidence FROM events WHERE event_id % 6 > 0 GROUP BY ROLLUP (event_type)")


def v19(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    score = vendor_match.detection_confidence(F.when(k % 3 > 0, k % 10 / 10), written(F.lit(""), k, ["email", "transcript", "csv", None]), written(F.lit(""), k, ["a.com", "", None]), k % 5 == 0, k % 7 == 0)
    return table(s, d, "customer").select(k.alias("id"), F.round(score, 6).alias("score"))


register("v19_detection_confidence", v19, """
SELECT c_custkey AS id, round(greatest(0, least(1, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 10 / 10 ELSE 0.45 END::DOUBLE + CASE WHEN c_custkey % 4 < 2 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN c_custkey % 3 = 0 THEN 0.1 ELSE 0 END::DOUBLE
 + CASE WHEN c_custkey % 5 = 0 THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN c_custkey % 7 = 0 THEN 0.1 ELSE 0 END::DOUBLE)), 6)::DOUBLE AS score FROM customer""")


def v20(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.col("user_id").alias("vendor_id"), F.concat(F.initcap("event_type"), F.lit(", Inc.")).alias("alias"), (F.col("event_id") % 50 / 100).alias("confidence"), F.lit(1).cast("long").alias("usage"), "event_id")
    return vendor_match.alias_usage(e.where("event_id % 3 = 0").groupBy("vendor_id", "alias").agg(F.max("confidence").alias("confidence"), F.count("*").alias("usage")), e.where("event_id % 3 = 1"), e.where("event_id % 3 = 2"))


register("v20_alias_usage", v20, """
WITH e AS (SELECT user_id AS vendor_id, event_type AS alias, CASE WHEN event_id % 3 < 2 THEN event_id % 50 / 100 END AS c, (event_id % 3 = 2)::INT AS k FROM events)
SELECT vendor_id, alias, round(least(1, coalesce(max(c) + 0.1 * sum(k), 0.8 + 0.1 * sum(k))), 6)::DOUBLE AS confidence, count(*) AS usage FROM e GROUP BY 1, 2""")
register("v23_unmatched_log", lambda s, d: vendor_match.unmatched_log(table(s, d, "events").select(F.concat(F.upper("event_type"), F.lit(" Co.")).alias("name"), F.col("user_id").alias("source"), F.col("ts").alias("at"))), "SELECT event_type AS name, count(*) AS occurrences, min(ts) AS first_at, max(ts) AS last_at, count(DISTINCT user_id) AS sources FROM events GROUP BY 1")


def v25(s: SparkSession, d: str) -> DataFrame:
    reviews = table(s, d, "supplier").select(F.col("s_suppkey").alias("review_id"), written(F.lit(""), F.col("s_suppkey"), ["approved", "denied", "pending"]).alias("status"), (F.col("s_suppkey") + 1000).alias("vendor_id"))
    return vendor_match.promote(deals(s, d).select(F.col("id").alias("deal_id"), (F.col("vendor_id") * 2).alias("review_id")), reviews)


register("v25_promoted_deals", v25, SQL + """
SELECT id AS deal_id, CASE WHEN s_suppkey % 3 = 0 THEN 'promoted' WHEN s_suppkey % 3 = 1 THEN 'dropped' ELSE 'pending' END AS state, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey + 1000 END AS vendor_id FROM deals LEFT JOIN supplier ON s_suppkey = vendor_id * 2""")
