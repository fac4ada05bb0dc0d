"""Duplicates, merges, vendor matching, scores and opportunities, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgraph.functions import fields, scoring, similarity
from dealgraph.functions.workers import cut
from dealgraph.operators import dedupe, joins, vendor_match
from dealgraph.plans.named import ASKED, NAMED, fuzzy_ctes, named_deals, product_sets
from dealgraph.plans.registry import register
from dealgraph.plans.scalars import customers_sql, customers
from dealgraph.sources.fixtures import SQL, deal_vendors, deals, source_files, table, vendors


_V = "CASE WHEN coalesce({a}, 0) = 0 OR coalesce({b}, 0) = 0 THEN 0 WHEN {a} = {b} THEN 1 WHEN abs({a} - {b}) / (({a} + {b}) / 2) * 100 <= 10 THEN 1 - abs({a} - {b}) / (({a} + {b}) / 2) * 100 / 10 * 0.3 WHEN abs({a} - {b}) / (({a} + {b}) / 2) * 100 <= 30 THEN 0.7 * (1 - (abs({a} - {b}) / (({a} + {b}) / 2) * 100 - 10) / 20) ELSE 0 END::DOUBLE".format(a="x.deal_value", b="y.deal_value")
_D = "CASE WHEN abs(date_diff('day', x.created_at, y.created_at)) <= 7 THEN 1 - abs(date_diff('day', x.created_at, y.created_at)) / 7 * 0.3 WHEN abs(date_diff('day', x.created_at, y.created_at)) <= 28 THEN 0.7 * (1 - (abs(date_diff('day', x.created_at, y.created_at)) - 7) / 21) ELSE 0 END::DOUBLE"
_W = "coalesce((x.vendor_id = y.vendor_id)::INT, 0)"
ASK = f"id % {ASKED} = 0"
#: All asked deals against all others, and the fuzzy similarities of their names, each by comparing all distinct pairs.
PAIRS = f"nd x JOIN nd y ON x.id % {ASKED} = 0 AND x.id <> y.id"
_SIMILAR = {c: fuzzy_ctes(f"s{c}", f"SELECT x.{c} AS a, y.{c} AS b FROM (SELECT DISTINCT {c} FROM nd WHERE id % {ASKED} = 0) x, (SELECT DISTINCT {c} FROM nd) y") for c in "nmk"}


def similar_sql(*forms: str) -> str:
    return NAMED + "," + ",".join(_SIMILAR[c] for c in forms)


def asked(f):
    """A strategy over the named deals: those with an id divisible by ASKED against all."""
    return lambda s, d: f(cut(dedupe.prepared(named_deals(s, d))), ASK).select("id_1", "id_2", F.round("score", 5).alias("score"))


_SK, _SN, _SM = (f"JOIN s{c} ON s{c}.a = x.{c} AND s{c}.b = y.{c}" for c in "knm")
_SCORES = {
    "exact": f"SELECT x.id AS id_1, y.id AS id_2, 1.0::DOUBLE AS score FROM {PAIRS} WHERE x.n = y.n AND x.k = y.k AND (coalesce(x.deal_value, 0) = 0 OR coalesce(y.deal_value, 0) = 0 OR abs(x.deal_value - y.deal_value) < 1)",
    "fuzzy_name": f"SELECT x.id AS id_1, y.id AS id_2, (sn.score + sm.score) / 200 AS score FROM {PAIRS} {_SN} {_SM} WHERE sn.score >= 70 AND sm.score >= 70 AND round(sn.score + sm.score, 7) >= 170",
    "customer_value": f"SELECT x.id AS id_1, y.id AS id_2, 0.6 * sk.score / 100 + 0.4 * {_V} AS score FROM {PAIRS} {_SK} WHERE sk.score >= 85 AND {_V} >= 0.85",
    "customer_date": f"SELECT x.id AS id_1, y.id AS id_2, 0.6 * sk.score / 100 + 0.4 * {_D} AS score FROM {PAIRS} {_SK} WHERE sk.score >= 85 AND {_D} >= 0.85",
    "vendor_customer": f"SELECT x.id AS id_1, y.id AS id_2, least(1, 0.3 + 0.5 * sk.score / 100 + 0.2 * sn.score / 100) AS score FROM {PAIRS} AND x.vendor_id = y.vendor_id {_SK} {_SN} WHERE sk.score >= 80",
    "multi_factor": f"SELECT x.id AS id_1, y.id AS id_2, round(0.25 * sn.score / 100 + 0.25 * sk.score / 100 + 0.15 * {_W} + 0.15 * {_V} + 0.10 * {_D}, 9) AS score FROM {PAIRS} {_SK} {_SN} WHERE round(0.25 * sn.score / 100 + 0.25 * sk.score / 100 + 0.15 * {_W} + 0.15 * {_V} + 0.10 * {_D}, 9) >= 0.70",
}
_NEEDS = {"exact": "", "fuzzy_name": "nm", "customer_value": "k", "customer_date": "k", "vendor_customer": "kn", "multi_factor": "kn"}
for _name, _strategy, _run in (("d09_exact", "exact", dedupe.exact), ("d10_fuzzy_name", "fuzzy_name", dedupe.fuzzy_name), ("d11_customer_value", "customer_value", dedupe.customer_value), ("d12_customer_date", "customer_date", dedupe.customer_date),
                               ("d13_vendor_customer", "vendor_customer", dedupe.vendor_customer), ("d14_multi_factor", "multi_factor", dedupe.multi_factor)):
    register(_name, asked(_run), (similar_sql(*_NEEDS[_strategy]) if _NEEDS[_strategy] else NAMED) + f" SELECT id_1, id_2, round(score, 5)::DOUBLE AS score FROM ({_SCORES[_strategy]})")
register("d04_similar_customers", lambda s, d: dedupe.alike(dedupe.prepared(named_deals(s, d)).select("id", "_k"), ASK, "_k", 0.85).select("a", "b", F.round("score", 6).alias("score")), similar_sql("k") + " SELECT a, b, round(score / 100, 6)::DOUBLE AS score FROM sk WHERE score >= 85")


def d08(s: SparkSession, d: str) -> DataFrame:
    """All seven factors of asked deals and the deals of alike customers."""
    r = named_deals(s, d).join(product_sets(s, d), "id")
    p = cut(dedupe.prepared(r))
    customers = cut(dedupe.alike(p, ASK, "_k", 0.85))
    pairs = dedupe.vendor_customer(p, ASK, 0.85).select("id_1", "id_2").unionByName(dedupe.customer_value(p, ASK, customers).select("id_1", "id_2")).distinct()
    fields = ["deal_name", "customer_name", "vendor_id", "deal_value", "created_at", "products", "emails"]
    both = pairs.join(r.select(F.col("id").alias("id_1"), *[F.col(c).alias(f"{c}_1") for c in fields]), "id_1").join(r.select(F.col("id").alias("id_2"), *[F.col(c).alias(f"{c}_2") for c in fields]), "id_2")
    return both.select("id_1", "id_2", F.round(similarity.weighted_score("_1", "_2"), 6).alias("score"))


register("d08_weighted_score", d08, similar_sql("k", "n") + f"""
, f AS (SELECT l_orderkey AS id, list_distinct(list(p_type)) AS products, [any_value('a' || (o_custkey % 100) || '@x.com'), any_value('b' || o_custkey || '@y.com')] AS emails FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
z AS (SELECT x.id AS id_1, y.id AS id_2, 0.25 * sn.score / 100 + 0.25 * sk.score / 100 + 0.15 * {_W} + 0.15 * {_V} + 0.10 * {_D} AS most FROM {PAIRS} {_SK} {_SN} WHERE sk.score >= 85 AND (x.vendor_id = y.vendor_id OR {_V} >= 0.85))
SELECT id_1, id_2, round(most + 0.05 * len(list_intersect(a.products, b.products)) / len(list_distinct(a.products || b.products)) + 0.05 * len(list_intersect(a.emails, b.emails)) / len(list_distinct(a.emails || b.emails)), 6)::DOUBLE AS score
FROM z JOIN f a ON a.id = id_1 JOIN f b ON b.id = id_2""")


def d15(s: SparkSession, d: str) -> DataFrame:
    return dedupe.detect(named_deals(s, d), ASK).select("id_1", "id_2", "strategy", F.round("score", 3).alias("score"), "action")


_BEST = similar_sql("n", "m", "k") + ", f AS (" + " UNION ALL ".join(f"SELECT id_1, id_2, '{name}' AS strategy, round(score, 6)::DOUBLE AS score, {k} AS r FROM ({sql})" for k, (name, sql) in enumerate(_SCORES.items())) + """),
best AS (SELECT id_1, id_2, strategy, score, CASE WHEN score >= 0.95 THEN 'auto_merge' ELSE 'manual_review' END AS action FROM f WHERE score >= 0.85 QUALIFY row_number() OVER (PARTITION BY id_1, id_2 ORDER BY score DESC, r) = 1)"""
register("d15_best_strategy", d15, _BEST + " SELECT id_1, id_2, strategy, round(score, 3)::DOUBLE AS score, action FROM best")

_ONLINE = f"""
o AS (SELECT x.id AS id_1, y.id AS id_2, y.created_at FROM nd x JOIN nd y ON x.id % {ASKED} = 0 AND y.status <> 'rejected' AND (x.vendor_id = y.vendor_id OR contains(lower(y.customer_name), lower(x.customer_name)))),
c AS (SELECT id_1, id_2, row_number() OVER (PARTITION BY id_1 ORDER BY created_at DESC, id_2)::INT AS rank FROM o QUALIFY rank <= 200)"""
register("d16_online_candidates", lambda s, d: dedupe.online_candidates(named_deals(s, d), ASK), NAMED + "," + _ONLINE + " SELECT id_1, id_2, rank FROM c WHERE id_1 <> id_2")


def d27(s: SparkSession, d: str) -> DataFrame:
    return dedupe.find_similar(named_deals(s, d), ASK)


_FOUND = _BEST + "," + _ONLINE + ", found AS (SELECT id_1, row_number() OVER (PARTITION BY id_1 ORDER BY score DESC, id_2)::INT AS rank, id_2, strategy, score, action FROM best SEMI JOIN c USING (id_1, id_2))"
register("d27_find_similar", lambda s, d: d27(s, d).withColumn("score", F.round("score", 5)), _FOUND + " SELECT id_1, rank, id_2, strategy, round(score, 5)::DOUBLE AS score, action FROM found")
register("d27_batch_summary", lambda s, d: dedupe.batch_summary(named_deals(s, d).where(ASK), d27(s, d)), _FOUND + f" SELECT count(*) AS total, count(h) AS duplicates_found, count(*) - count(h) AS unique_entities FROM nd LEFT JOIN (SELECT DISTINCT id_1 AS h FROM found) ON h = id WHERE id % {ASKED} = 0")


def d18(s: SparkSession, d: str) -> DataFrame:
    return dedupe.cluster_keys(dedupe.clusters(dedupe.vendor_customer(cut(dedupe.prepared(named_deals(s, d))), least=0.95).where("score >= 0.95")))


register("d18_clusters", d18, NAMED.replace("WITH deals", "WITH RECURSIVE deals", 1) + "," + fuzzy_ctes("sk", "SELECT x.k AS a, y.k AS b FROM (SELECT DISTINCT k FROM nd) x, (SELECT DISTINCT k FROM nd) y") + "," + fuzzy_ctes("sn", "SELECT x.n AS a, y.n AS b FROM (SELECT DISTINCT n FROM nd) x, (SELECT DISTINCT n FROM nd) y") + f"""
, e AS (SELECT x.id AS a, y.id AS b FROM nd x JOIN nd y ON x.id <> y.id AND x.vendor_id = y.vendor_id {_SK} {_SN} WHERE sk.score >= 95 AND least(1, 0.3 + 0.5 * sk.score / 100 + 0.2 * sn.score / 100) >= 0.95),
w(id, reached) AS (SELECT DISTINCT a, a FROM e UNION SELECT id, b FROM w JOIN e ON a = reached), c AS (SELECT id, min(reached) AS cluster_id FROM w GROUP BY 1)
SELECT cluster_id, count(*) AS size, min(id) AS first_id, max(id) AS last_id FROM c GROUP BY 1 HAVING count(*) > 1""")
register("d19_pair_log", lambda s, d: dedupe.ordered_pair_log(deal_vendors(s, d).select(F.col("vendor_id").alias("a"), (F.col("deal_id") % 100).alias("b"), F.lit(1).alias("score")).where("a <> b"), "a", "b", "score"), SQL + "SELECT least(vendor_id, deal_id % 100) AS id_1, greatest(vendor_id, deal_id % 100) AS id_2, max(1) AS score FROM deal_vendors WHERE vendor_id <> deal_id % 100 GROUP BY 1, 2")
register("d24_file_duplicates", lambda s, d: dedupe.file_duplicates(table(s, d, "documents"), "doc_id", "text"), "SELECT doc_id, first AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents) WHERE doc_id > first")
register("d25_cheap_duplicates", lambda s, d: dedupe.pairs_by(deals(s, d).withColumn("_k", F.concat(F.col("vendor_id").cast("string"), F.lit("|"), F.lower("deal_name"))), "_k", ()).select("id_1", "id_2"), SQL + "SELECT a.id AS id_1, b.id AS id_2 FROM deals a JOIN deals b ON a.vendor_id = b.vendor_id AND lower(a.deal_name) = lower(b.deal_name) AND a.id < b.id")


def keyed_deals(s: SparkSession, d: str) -> DataFrame:
    """(id, key): the named deals with their correlation keys; only every third one's value is known."""
    x = named_deals(s, d).join(vendors(s, d).select("vendor_id", "vendor_name"), "vendor_id", "left")
    return x.select("id", fields.deal_key(F.col("customer_name"), F.col("vendor_name"), F.when(F.col("id") % 3 == 0, F.col("deal_value"))).alias("key"))


WANTED = ["1996-01", "1996-02", "1997-07", "1998-12"]
PART = r"nullif(regexp_replace(regexp_replace(lower(trim({0})), '[^\w\s]', '', 'g'), '\s+', '_', 'g'), '')"
KEYED = NAMED + f", keyed AS (SELECT id, concat_ws(':', {PART.format('customer_name')}, {PART.format('vendor_name')}, CASE WHEN id % 3 = 0 THEN nullif(floor(coalesce(deal_value, 0) / 1000 + 0.5)::BIGINT, 0)::VARCHAR END) AS key FROM nd LEFT JOIN vendors USING (vendor_id)) "
register("c01_correlation_key", keyed_deals, KEYED + "SELECT id, key FROM keyed")
register("d26_cross_source", lambda s, d: joins.cross_source(keyed_deals(s, d), source_files(s, d).select(F.col("deal_id").alias("id"), F.col("file_id").alias("file")), WANTED), KEYED + f"""
SELECT key, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM keyed WHERE key <> '' AND id IN (SELECT deal_id FROM source_files WHERE file_id IN {tuple(WANTED)}) GROUP BY 1 HAVING count(*) > 1""")

# ---------------------------------------------------------------- survivorship: clusters are a customer's deals of one stage


def members(s: SparkSession, d: str) -> DataFrame:
    return deals(s, d).withColumn("cluster_id", F.concat_ws("/", F.col("customer_id").cast("string"), "stage"))


M = SQL + ", m AS (SELECT concat_ws('/', customer_id, stage) AS cluster_id, * FROM deals) "
register("m06_field_conflicts", lambda s, d: dedupe.field_conflicts(members(s, d), ("deal_name", "priority")), M + """
, v AS (SELECT cluster_id, unnest(['deal_name', 'priority']) AS field, unnest([deal_name, priority]) AS value FROM m)
SELECT cluster_id, field, count(DISTINCT value) + max((value IS NULL)::INT) AS values, count(DISTINCT value) + max((value IS NULL)::INT) > 2 AS manual_review FROM v GROUP BY 1, 2 HAVING count(DISTINCT value) + max((value IS NULL)::INT) > 1""")
register("m07_survivors", lambda s, d: dedupe.survivors(members(s, d), ("deal_name", "priority"), "created_at"), M + "SELECT cluster_id, arg_max(deal_name, (created_at, -id)) FILTER (deal_name IS NOT NULL) AS deal_name, arg_max(priority, (created_at, -id)) AS priority FROM m GROUP BY 1")


def m08(s: SparkSession, d: str) -> DataFrame:
    return dedupe.best_records(members(s, d).withColumn("q", F.round(F.col("deal_value"), 2)), "q")


register("m08_master_records", m08, M + "SELECT cluster_id, arg_max(id, (round(deal_value, 2), -id)) AS master_id, max(round(deal_value, 2)) AS quality FROM m GROUP BY 1")


def m05(s: SparkSession, d: str) -> DataFrame:
    x = deals(s, d)
    last = F.lit("2001-08-01").cast("date")
    c = scoring.completeness([F.col("customer_name"), F.col("deal_name"), F.col("vendor_id"), F.col("product_type")])
    q = scoring.entity_quality(c, F.when(F.col("id") % 10 > 1, F.col("deal_value") / 500_000).when(F.col("id") % 10 == 1, 0.0), scoring.validation_score(F.when(F.col("status") == "F", "passed").otherwise("open"), F.lit(None).cast("double"), F.lit(0.6)), scoring.recency(F.datediff(last, "created_at")))
    return x.select("id", F.round(c, 6).alias("completeness"), F.round(q, 5).alias("quality"))


register("m05_entity_quality", m05, SQL + """
, x AS (SELECT id, pow(((customer_name IS NOT NULL)::INT + (deal_name IS NOT NULL)::INT + (vendor_id IS NOT NULL)::INT + (product_type IS NOT NULL)::INT) / 4, 4) AS c, CASE WHEN id % 10 > 1 THEN deal_value / 500000 WHEN id % 10 = 1 THEN 0 ELSE 0.4 END AS ai, CASE WHEN status = 'F' THEN 1.0 ELSE 0.6 END AS v, date_diff('day', created_at::DATE, DATE '2001-08-01') AS n FROM deals)
SELECT id, round(c, 6)::DOUBLE AS completeness, round(0.4 * c + 0.3 * ai + 0.2 * v + 0.1 * CASE WHEN n <= 1 THEN 1 WHEN n <= 30 THEN 1 - (n - 1) / 29 * 0.5 WHEN n <= 180 THEN 0.5 - (n - 30) / 150 * 0.5 ELSE 0 END, 5)::DOUBLE AS quality FROM x""")
register("m11_merged_sources", lambda s, d: members(s, d).groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_set("vendor_id")).cast("array<string>"), ",").alias("vendors"), F.count("*").alias("merged")), M + "SELECT cluster_id, coalesce(array_to_string(list_sort(list(DISTINCT vendor_id) FILTER (vendor_id IS NOT NULL)), ','), '') AS vendors, count(*) AS merged FROM m GROUP BY 1")

# ---------------------------------------------------------------- scores


def f15(s: SparkSession, d: str) -> DataFrame:
    x = deals(s, d).select("id", scoring.validate_deal(F.when(F.col("id") % 7 > 0, F.col("deal_name")), F.when(F.col("id") % 5 > 0, F.col("customer_name")), F.col("deal_value") - 5000, F.lit(0.5)).alias("v"))
    return x.select("id", F.array_join("v.failed", ",").alias("failed"), F.round("v.confidence", 6).alias("confidence"), "v.valid")


register("f15_validate_deal", f15, SQL + """
, x AS (SELECT id, CASE WHEN id % 7 > 0 THEN deal_name END AS n, CASE WHEN id % 5 > 0 THEN customer_name END AS c, deal_value - 5000 AS v FROM deals),
r AS (SELECT id, n IS NULL AS a, length(coalesce(n, '')) NOT BETWEEN 5 AND 200 AS b, c IS NULL AS e, NOT v > 0 AS f, v NOT BETWEEN 100 AND 10000000 AS g FROM x)
SELECT id, concat_ws(',', CASE WHEN a THEN 'name_required' END, CASE WHEN b THEN 'name_length' END, CASE WHEN e THEN 'customer_required' END, CASE WHEN f THEN 'value_positive' END, CASE WHEN g THEN 'value_range' END) AS failed,
round(greatest(0, least(1, 0.5 + CASE WHEN a THEN -0.5 ELSE 0.05 END + CASE WHEN b THEN -0.1 ELSE 0 END + CASE WHEN e THEN -0.5 ELSE 0.05 END + CASE WHEN f THEN -0.3 ELSE 0 END + CASE WHEN g THEN -0.1 ELSE 0 END)), 6)::DOUBLE AS confidence, NOT (a OR e) AS valid FROM r""")


def f17(s: SparkSession, d: str) -> DataFrame:
    as_of = F.lit("1999-01-01").cast("date")
    return deals(s, d).select("id", F.array_join(scoring.date_issues(F.col("created_at").cast("date"), F.date_add("created_at", (F.col("id") % 9 - 5).cast("int")), as_of), ",").alias("issues")).where("issues <> ''")


register("f17_date_issues", f17, SQL + """
, x AS (SELECT id, created_at::DATE AS c, created_at::DATE + CAST(id % 9 - 5 AS INT) AS r, DATE '1999-01-01' AS n FROM deals)
SELECT id, concat_ws(',', CASE WHEN c - n < -180 THEN 'close_long_past' END, CASE WHEN c - n > 730 THEN 'close_far' END, CASE WHEN r > n THEN 'registered_in_future' END, CASE WHEN r > c THEN 'registered_after_close' END) AS issues FROM x WHERE issues <> ''""")

CUSTOMERS = ["John Smith", "ACME HOLDINGS {}", "globex", "info@acme{}.com", "A", "Acme Corp {}", "https://x{}.y", "Dr. {} Who", "mrs x", "", None, "12{}", "{} " + "long " * 30, "Prof Adams"]
register("f18_customer_issues", lambda s, d: customers(s, d, CUSTOMERS).select("id", scoring.customer_issues(F.col("x")).alias("c")).select("id", F.array_join("c.issues", ",").alias("issues"), "c.valid", "c.adjustment"), customers_sql(CUSTOMERS) + r"""
, r AS (SELECT id, coalesce(trim(x), '') = '' AS b, regexp_matches(x, '(?i)^(Mr|Mrs|Ms|Dr|Prof)\.?\s+[A-Z]') OR regexp_matches(x, '^[A-Z][a-z]+ [A-Z][a-z]+$') AS p, (x = upper(x) AND length(x) > 5) OR x = lower(x) AS c, contains(x, '@') OR contains(x, 'http://') OR contains(x, 'https://') AS u, length(x) AS n FROM t)
SELECT id, CASE WHEN b THEN 'name_required:critical' ELSE concat_ws(',', CASE WHEN p THEN 'name_not_person:warning' END, CASE WHEN c THEN 'name_capitalization:warning' END, CASE WHEN u THEN 'name_no_email_url:error' END, CASE WHEN n < 2 THEN 'name_length:error' WHEN n > 100 THEN 'name_length:warning' END) END AS issues,
NOT (b OR u OR n < 2) AS valid, CASE WHEN b THEN -0.5 WHEN u OR n < 2 THEN -0.3 WHEN p OR c OR n > 100 THEN -0.05 ELSE 0 END::DOUBLE AS adjustment FROM r""")


def f22(s: SparkSession, d: str) -> DataFrame:
    """Deals, vendors and contacts with the fields that extraction leaves: some lack their name, customer, value, currency or date."""
    x, k, none = deals(s, d), F.col("id"), F.lit(None).cast("string")
    rows = x.select(F.lit("deal").alias("kind"), k, (F.col("deal_value") / 500_000).alias("c"), F.when(k % 7 > 0, F.col("deal_name")).alias("name"), F.when(k % 5 > 0, F.col("customer_name")).alias("customer"), F.when(k % 3 > 0, F.col("deal_value")).otherwise(0.0).alias("value"),
                    F.when(k % 2 == 0, "EUR").alias("currency"), F.when(k % 4 > 0, F.col("created_at")).alias("close"), none.alias("email"), none.alias("phone"))
    c, m = table(s, d, "customer"), F.col("c_custkey")
    rows = rows.unionByName(c.select(F.when(m % 2 == 0, "vendor").otherwise("contact").alias("kind"), m.alias("id"), (m % 10 / 10).alias("c"), F.when(m % 7 > 0, F.col("c_name")).otherwise("").alias("name"), none.alias("customer"), F.lit(0.0).alias("value"), none.alias("currency"),
                                     F.lit(None).cast("timestamp_ntz").alias("close"), F.when(m % 3 == 0, "a@b.c").alias("email"), F.when(m % 5 == 0, "555").otherwise("").alias("phone")))
    return rows.select("kind", "id", F.round(scoring.calibrate(F.col("c"), F.col("kind"), F.col("name"), F.col("customer"), F.col("value"), F.col("currency"), F.col("close"), F.col("email"), F.col("phone")), 6).alias("confidence"))


register("f22_calibration", f22, SQL + """
, a AS (SELECT id, deal_value / 500000 * CASE WHEN id % 7 > 0 AND deal_name <> '' THEN 1.0 ELSE 0.8 END * CASE WHEN id % 5 > 0 AND customer_name <> '' THEN 1.0 ELSE 0.8 END * CASE WHEN id % 3 > 0 AND deal_value <> 0 THEN 1.0 ELSE 0.95 END AS c FROM deals),
b AS (SELECT id, CASE WHEN id % 2 = 0 THEN least(0.99, c * 1.05) ELSE c END AS c FROM a)
SELECT 'deal' AS kind, id, round(greatest(0, least(1, CASE WHEN id % 4 > 0 THEN least(0.99, c * 1.05) ELSE c END)), 6)::DOUBLE AS confidence FROM b
UNION ALL SELECT CASE WHEN c_custkey % 2 = 0 THEN 'vendor' ELSE 'contact' END, c_custkey, round(c_custkey % 10 / 10 * CASE WHEN c_custkey % 7 > 0 THEN 1.0 ELSE 0.8 END * CASE WHEN c_custkey % 2 = 1 AND c_custkey % 3 > 0 AND c_custkey % 5 > 0 THEN 0.9 ELSE 1 END, 6)::DOUBLE FROM customer""")


def insights(s: SparkSession, d: str) -> DataFrame:
    """F25-F27 over deals: more than two vendors are actors, an even id has next steps, quiet days count to 1999."""
    actors = deal_vendors(s, d).groupBy(F.col("deal_id").alias("id")).agg(F.count("*").alias("actors"))
    x = deals(s, d).join(actors, "id", "left")
    steps, quiet = F.col("id") % 2 == 0, F.abs(F.datediff(F.lit("1999-01-01").cast("date"), "created_at"))
    x = x.withColumn("win", scoring.win_probability(F.col("stage"), F.col("priority"), F.col("deal_value") > 250_000, steps)).withColumn("momentum", scoring.momentum(steps, F.coalesce("actors", F.lit(0)), quiet))
    flags = scoring.risk_flags(F.col("win"), F.col("momentum"), steps, F.col("vendor_id").isNotNull())
    return x.select("id", "stage", "priority", "win", "momentum", flags.alias("f")).select("id", "stage", "priority", "win", "momentum", F.array_join("f", ",").alias("flags"), F.array_join(scoring.insight_notes(F.col("stage"), F.col("priority"), F.col("f")), " ").alias("notes"))


INSIGHTS = SQL + """
, a AS (SELECT deal_id, count(*) AS actors FROM deal_vendors GROUP BY 1),
x AS (SELECT id, stage, priority, vendor_id, id % 2 = 0 AS steps,
  round(greatest(0.05, least(0.95, CASE stage WHEN 'po_in_progress' THEN 0.8 WHEN 'quote' THEN 0.55 ELSE 0.4 END::DOUBLE + CASE priority WHEN 'high' THEN 0.1 WHEN 'low' THEN -0.05 ELSE 0 END::DOUBLE + CASE WHEN deal_value > 250000 THEN 0.05 ELSE 0 END::DOUBLE - CASE WHEN id % 2 = 0 THEN 0 ELSE 0.05 END::DOUBLE)), 2) AS win,
  round(greatest(0, least(1, 0.5::DOUBLE + CASE WHEN id % 2 = 0 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN coalesce(actors, 0) > 2 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN abs(date_diff('day', created_at::DATE, DATE '1999-01-01')) <= 7 THEN 0.1 WHEN abs(date_diff('day', created_at::DATE, DATE '1999-01-01')) > 21 THEN -0.1 ELSE 0 END::DOUBLE)), 2) AS momentum
  FROM deals LEFT JOIN a ON deal_id = id),
i AS (SELECT id, stage, priority, win::DOUBLE AS win, momentum::DOUBLE AS momentum, concat_ws(',', CASE WHEN win < 0.3 THEN 'low_win_probability' END, CASE WHEN momentum < 0.4 THEN 'stalled' END, CASE WHEN NOT steps THEN 'missing_next_steps' END, CASE WHEN vendor_id IS NULL THEN 'incomplete_metadata' END) AS flags,
  concat_ws(' ', CASE WHEN priority = 'high' AND stage = 'rfq' THEN 'High-priority RFQ: ensure follow-up on pricing.' END, CASE WHEN momentum < 0.4 THEN 'No recent activity detected; consider re-engaging stakeholders.' END) AS notes FROM x)
"""
register("f25_insights", insights, INSIGHTS + "SELECT * FROM i")
register("f28_notifications", lambda s, d: insights(s, d).where((F.col("win") <= 0.35) | F.contains("flags", F.lit("stalled"))).select("id", F.when(F.col("win") <= 0.3, "critical").otherwise("warning").alias("severity")), INSIGHTS + "SELECT id, CASE WHEN win <= 0.3 THEN 'critical' ELSE 'warning' END AS severity FROM i WHERE win <= 0.35 OR flags LIKE '%stalled%'")
register("a39_insight_summary", lambda s, d: insights(s, d).groupBy("stage").agg(F.count_if(F.col("win") >= 0.7).alias("high"), F.count_if((F.col("win") >= 0.4) & (F.col("win") < 0.7)).alias("medium"), F.count_if(F.col("win") < 0.4).alias("low"), F.round(F.avg("momentum"), 5).alias("avg_momentum")), INSIGHTS + "SELECT stage, count(*) FILTER (win >= 0.7) AS high, count(*) FILTER (win >= 0.4 AND win < 0.7) AS medium, count(*) FILTER (win < 0.4) AS low, round(avg(momentum), 5) AS avg_momentum FROM i GROUP BY 1")


def f29(s: SparkSession, d: str) -> DataFrame:
    c = members(s, d).groupBy("cluster_id").agg(F.sum(F.col("vendor_id").isNull().cast("int")).alias("missing"), (F.countDistinct("priority") - 1).alias("conflicts"), F.min(F.datediff(F.lit("2001-08-01").cast("date"), "created_at")).alias("days"))
    return c.select("cluster_id", scoring.composite_quality(F.col("missing"), F.col("conflicts"), F.col("days")).alias("q")).select("cluster_id", "q.*")


register("f29_composite_quality", f29, M + """
, c AS (SELECT cluster_id, count(*) FILTER (vendor_id IS NULL) AS missing, count(DISTINCT priority) - 1 AS conflicts, min(date_diff('day', created_at::DATE, DATE '2001-08-01')) AS days FROM m GROUP BY 1),
q AS (SELECT cluster_id, greatest(0, least(100, 100 - 12.5 * missing))::DOUBLE AS completeness, greatest(0, least(100, 100 - 15.0 * conflicts))::DOUBLE AS consistency, CASE WHEN days >= 45 THEN 40.0 WHEN days >= 30 THEN 65.0 ELSE 100.0 END::DOUBLE AS freshness FROM c),
o AS (SELECT *, round(0.4 * completeness + 0.3 * consistency + 0.3 * freshness)::DOUBLE AS overall FROM q) SELECT *, CASE WHEN overall < 60 THEN 'high' WHEN overall < 80 THEN 'medium' ELSE 'low' END AS severity FROM o""")

# ---------------------------------------------------------------- vendor matching


def mentions(s: SparkSession, d: str) -> DataFrame:
    """Customers as vendor mentions: the name with its number, an e-mail at a vendor-like domain, and the nation."""
    c = table(s, d, "customer")
    return c.select(F.col("c_custkey").alias("mention_id"), F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") * 7 % 140).cast("string"), 9, "0")).alias("name"), F.concat(F.lit("x@s"), (F.col("c_custkey") % 120).cast("string"), F.lit(".example.com")).alias("email"))


def catalogue(s: SparkSession, d: str) -> DataFrame:
    return vendors(s, d).select("vendor_id", "vendor_name", F.concat(F.lit("s"), F.col("vendor_id").cast("string"), F.lit(".example.com")).alias("domain"), F.concat(F.lit("alias "), (F.col("vendor_id") % 40).cast("string")).alias("alias"))


register("v04_domain_match", lambda s, d: vendor_match.by_domain(mentions(s, d), catalogue(s, d)).select("mention_id", "vendor_id"), "SELECT c_custkey AS mention_id, s_suppkey AS vendor_id FROM customer JOIN supplier ON c_custkey % 120 = s_suppkey")
register("v12_learned_aliases", lambda s, d: vendor_match.learn_aliases(table(s, d, "events").select(F.col("user_id").alias("vendor_id"), F.col("event_type").alias("alias"), (F.col("value") / 100).alias("confidence")), 0.85, 3), """
SELECT user_id AS vendor_id, event_type AS alias, count(*) AS frequency, round(least(0.95, 0.7 + count(*) / 10 * 0.25), 6)::DOUBLE AS confidence FROM events WHERE value / 100 >= 0.85 GROUP BY 1, 2 HAVING count(*) >= 3""")
register("v18_review_queue", lambda s, d: vendor_match.review_queue(table(s, d, "events").select(F.col("event_type").alias("name"), "ts", "value")), "SELECT event_type AS alias, count(*) AS detections, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1")
register("v22_domain_owner", lambda s, d: vendor_match.domain_owner(vendors(s, d).select((F.col("nation_id")).alias("domain"), "vendor_id", F.col("balance").alias("match_count"))), "SELECT s_nationkey AS domain, arg_max(s_suppkey, (s_acctbal, -s_suppkey)) AS vendor_id FROM supplier GROUP BY 1")
