"""Queries over records and logs with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dealgraph.operators import joins, rollups, search
from dealgraph.plans.registry import register
from dealgraph.sources.fixtures import SQL, deal_vendors, deals, source_files, table, vendors


def a01(s: SparkSession, d: str) -> DataFrame:
    return rollups.vendor_rollup(vendors(s, d), deals(s, d))


register("a01_vendor_rollup", a01, SQL + """
SELECT v.vendor_id, vendor_name, count(d.id) AS deal_count, round(coalesce(sum(deal_value), 0), 2) AS total_value
FROM vendors v LEFT JOIN deals d ON d.vendor_id = v.vendor_id GROUP BY 1, 2""")

register("p01_deal_search", lambda s, d: search.deal_search(deals(s, d), vendors(s, d), query="RED", low=50_000, high=300_000, sort="deal_value", limit=40, offset=20), SQL + """
, f AS (SELECT d.*, vendor_name FROM deals d LEFT JOIN vendors v ON v.vendor_id = d.vendor_id
  WHERE deal_value BETWEEN 50000 AND 300000 AND (deal_name ILIKE '%red%' OR customer_name ILIKE '%red%' OR vendor_name ILIKE '%red%' OR product_type ILIKE '%red%'))
SELECT *, (SELECT count(*) FROM f) AS total_count FROM f ORDER BY deal_value DESC, id LIMIT 40 OFFSET 20""")

register("p02_vendor_list", lambda s, d: search.page(vendors(s, d).where(search.contains_any("#00000001", ["vendor_name"])), [F.asc("vendor_name"), F.asc("vendor_id")], 20, 0, "total_count"), SQL + """
, f AS (SELECT * FROM vendors WHERE vendor_name ILIKE '%#00000001%') SELECT *, (SELECT count(*) FROM f) AS total_count FROM f ORDER BY vendor_name, vendor_id LIMIT 20""")

register("p03_vendor_deals", lambda s, d: deals(s, d).where("vendor_id = 7").select("id", "deal_value", "created_at").orderBy(F.desc("created_at"), "id"), SQL + "SELECT id, deal_value, created_at FROM deals WHERE vendor_id = 7")

register("p04_opportunity_filter", lambda s, d: search.opportunity_filter(deals(s, d), stage="rfq", name="ring", after="1996-01-01", before="2000-01-01", limit=30).select("id", "stage", "priority", "priority_rank", "deal_name"), SQL + """
SELECT id, stage, priority, CASE priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS priority_rank, deal_name FROM deals
WHERE stage = 'rfq' AND deal_name ILIKE '%ring%' AND created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '2000-01-01' ORDER BY priority_rank DESC, id LIMIT 30""")


def p05(s: SparkSession, d: str) -> DataFrame:
    actors = deal_vendors(s, d).join(vendors(s, d), "vendor_id").groupBy(F.col("deal_id").alias("id")).agg(F.array_sort(F.collect_set("vendor_name")).alias("actors"))
    r = deals(s, d).where("stage = 'quote'").join(actors, "id", "left").withColumn("actor_text", F.concat_ws(" ", "actors"))
    r = r.where(search.contains_any("000000012", ["actor_text", "customer_name"]))
    return search.page(r.select("id", "customer_name", "actor_text"), [F.asc("id")], 100)


register("p05_repository_search", p05, SQL + """
, a AS (SELECT deal_id, string_agg(vendor_name, ' ' ORDER BY vendor_name) AS actor_text FROM deal_vendors JOIN vendors USING (vendor_id) GROUP BY 1)
SELECT id, customer_name, coalesce(actor_text, '') AS actor_text FROM deals LEFT JOIN a ON deal_id = id
WHERE stage = 'quote' AND (actor_text ILIKE '%000000012%' OR customer_name ILIKE '%000000012%') ORDER BY id LIMIT 100""")

register("p06_distinct_json_keys", lambda s, d: table(s, d, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("k")).distinct(), "SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")

register("p07_find_by_ids", lambda s, d: deals(s, d).where(F.col("id").isin(1, 5, 11, 400, 999_999_999)).select("id", "customer_name", "deal_value"), SQL + "SELECT id, customer_name, deal_value FROM deals WHERE id IN (1, 5, 11, 400, 999999999)")

register("p08_recent_errors", lambda s, d: search.recent(table(s, d, "events").where("event_type = 'error'"), "ts", 7, 100, "event_id"), """
WITH e AS (SELECT * FROM events WHERE event_type = 'error') SELECT * FROM e WHERE ts >= (SELECT max(ts) FROM e) - INTERVAL 7 DAY ORDER BY ts DESC, event_id LIMIT 100""")

register("p09_critical_errors", lambda s, d: table(s, d, "events").where((F.col("event_type") == "error") & (F.col("value") > 50)).select("event_id", "user_id", "value"), "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND value > 50")


def p10(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_at"))
    return e.join(vendors(s, d), F.col("user_id") == F.col("vendor_id"), "left").select("user_id", "vendor_name", "n", "last_at").orderBy(F.desc("n"), F.desc("last_at"), "user_id").limit(50)


register("p10_top_unmatched", p10, SQL + """
SELECT user_id, vendor_name, n, last_at FROM (SELECT user_id, count(*) AS n, max(ts) AS last_at FROM events GROUP BY 1) LEFT JOIN vendors ON vendor_id = user_id
ORDER BY n DESC, last_at DESC, user_id LIMIT 50""")

register("p11_errors_of_user", lambda s, d: table(s, d, "events").where("user_id = 8 and event_type in ('error', 'signup')").select("event_id", "event_type", "ts").orderBy(F.desc("ts"), "event_id").limit(25),
         "SELECT event_id, event_type, ts FROM events WHERE user_id = 8 AND event_type IN ('error', 'signup') ORDER BY ts DESC, event_id LIMIT 25")

register("p12_needs_enrichment", lambda s, d: table(s, d, "customer").where("c_name is null or c_name = '' or c_acctbal is null or c_acctbal <= 0").select("c_custkey", "c_acctbal").orderBy("c_custkey").limit(100),
         "SELECT c_custkey, c_acctbal FROM customer WHERE c_name IS NULL OR c_name = '' OR c_acctbal IS NULL OR c_acctbal <= 0 ORDER BY c_custkey LIMIT 100")


def p13(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("last_sync_at"))
    due = last.crossJoin(F.broadcast(e.agg(F.max("ts").alias("as_of")))).where(F.expr("last_sync_at + interval 6 hours <= as_of"))
    return due.join(vendors(s, d).where("balance > 0"), F.col("user_id") == F.col("vendor_id")).select("vendor_id", "last_sync_at")


register("p13_due_syncs", p13, SQL + """
, l AS (SELECT user_id, max(ts) AS last_sync_at FROM events GROUP BY 1)
SELECT vendor_id, last_sync_at FROM l JOIN vendors ON vendor_id = user_id WHERE balance > 0 AND last_sync_at + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events)""")

register("p14_recommendation", lambda s, d: table(s, d, "events").withColumn("score", F.col("value") / 100).where("score >= 0.7").groupBy(search.recommendation("score").alias("action")).agg(F.count("*").alias("n")), """
SELECT CASE WHEN value / 100 >= 0.95 THEN 'auto_merge' WHEN value / 100 >= 0.85 THEN 'high_confidence' ELSE 'medium' END AS action, count(*) AS n FROM events WHERE value / 100 >= 0.7 GROUP BY 1""")


def p15(s: SparkSession, d: str) -> DataFrame:
    n = deal_vendors(s, d).groupBy("deal_id").agg(F.count("*").alias("n"))
    return n.withColumn("summary", F.when(F.col("n") >= 5, "large cluster").when(F.col("n") >= 2, "small cluster").otherwise("single")).groupBy("summary").agg(F.count("*").alias("clusters"), F.sum("n").alias("members"))


register("p15_cluster_summary", p15, SQL + """
, n AS (SELECT deal_id, count(*) AS n FROM deal_vendors GROUP BY 1)
SELECT CASE WHEN n >= 5 THEN 'large cluster' WHEN n >= 2 THEN 'small cluster' ELSE 'single' END AS summary, count(*) AS clusters, CAST(sum(n) AS BIGINT) AS members FROM n GROUP BY 1""")

register("p16_confidence_filter", lambda s, d: search.confident(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount"), "l_discount", 0.08), "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount IS NULL OR l_discount = 0 OR l_discount >= 0.08")


def p17(s: SparkSession, d: str) -> DataFrame:
    c = deals(s, d).groupBy("customer_id").agg(F.collect_set("stage").alias("stages"), F.collect_set("priority").alias("priorities"))
    parts = [F.when(F.size(x) > 1, F.size(x)).otherwise(0) for x in ("stages", "priorities")]
    score = sum(((p > 0).cast("int") + p for p in parts), F.lit(0))
    return c.select("customer_id", score.alias("conflict_score")).where("conflict_score > 0").orderBy(F.desc("conflict_score"), "customer_id").limit(10)


register("p17_top_conflicts", p17, SQL + """
, c AS (SELECT customer_id, count(DISTINCT stage) AS a, count(DISTINCT priority) AS b FROM deals GROUP BY 1)
SELECT customer_id, CAST((a > 1)::INT + CASE WHEN a > 1 THEN a ELSE 0 END + (b > 1)::INT + CASE WHEN b > 1 THEN b ELSE 0 END AS INT) AS conflict_score FROM c
WHERE a > 1 OR b > 1 ORDER BY conflict_score DESC, customer_id LIMIT 10""")

register("p18_nulls_last_sort", lambda s, d: joins.count_per(vendors(s, d), deals(s, d).where("deal_value > 400000"), "vendor_id", "n").withColumn("n", F.nullif("n", F.lit(0))).orderBy(F.col("n").desc_nulls_last(), "vendor_id").limit(60).select("vendor_id", "n"), SQL + """
SELECT v.vendor_id, nullif(count(d.id), 0) AS n FROM vendors v LEFT JOIN deals d ON d.vendor_id = v.vendor_id AND deal_value > 400000 GROUP BY 1 ORDER BY n DESC NULLS LAST, v.vendor_id LIMIT 60""")

register("p19_predicates", lambda s, d: deals(s, d).where((F.col("status") != "O") & F.col("deal_value").between(1e5, 2e5) & F.col("priority").isin("high", "medium") & F.col("deal_name").like("%e%ring%") & F.col("customer_name").isNotNull()).select("id"), SQL + """
SELECT id FROM deals WHERE status <> 'O' AND deal_value BETWEEN 100000 AND 200000 AND priority IN ('high', 'medium') AND deal_name LIKE '%e%ring%' AND customer_name IS NOT NULL""")

register("w01_total_count", lambda s, d: search.page(deals(s, d).select("id", "deal_value"), [F.desc("deal_value"), F.asc("id")], 10, 0, "total"), SQL + "SELECT id, deal_value, count(*) OVER () AS total FROM deals ORDER BY deal_value DESC, id LIMIT 10")

# ---------------------------------------------------------------- joins

register("j01_deals_with_vendor", lambda s, d: deals(s, d).join(vendors(s, d), "vendor_id", "left").select("id", "vendor_name", "deal_value"), SQL + "SELECT id, vendor_name, deal_value FROM deals d LEFT JOIN vendors v ON v.vendor_id = d.vendor_id")


def j02(s: SparkSession, d: str) -> DataFrame:
    primary = table(s, d, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_suppkey").alias("primary_vendor"))
    return deals(s, d).join(primary, "id", "left").select("id", "primary_vendor")


register("j02_primary_vendor", j02, SQL + "SELECT id, primary_vendor FROM deals LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS primary_vendor FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) ON l_orderkey = id")


def j04(s: SparkSession, d: str) -> DataFrame:
    labels, docs = table(s, d, "labels").where("quality = 0"), table(s, d, "documents").select("doc_id", "source", "lang")
    return labels.join(docs, "doc_id").join(table(s, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("turns")), "doc_id", "left").select("doc_id", "source", "lang", "turns")


register("j04_join_chain", j04, """SELECT l.doc_id, source, lang, turns FROM labels l JOIN documents d ON d.doc_id = l.doc_id
LEFT JOIN (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1) c ON conv_id = l.doc_id WHERE quality = 0""")

register("j05_vendor_pairs", lambda s, d: joins.co_occurring(deal_vendors(s, d), "deal_id", "vendor_id", 2), SQL + """
SELECT x.vendor_id AS a, y.vendor_id AS b, count(*) AS shared FROM deal_vendors x JOIN deal_vendors y ON x.deal_id = y.deal_id AND x.vendor_id < y.vendor_id GROUP BY 1, 2 HAVING count(*) >= 2""")


def j07(s: SparkSession, d: str) -> DataFrame:
    files = source_files(s, d).groupBy("deal_id").agg(F.collect_set("file_id").alias("files"))
    return files.where(F.array_contains("files", "1998-03")).select("deal_id", F.size("files").alias("n_files"))


register("j07_array_member", j07, SQL + "SELECT deal_id, CAST(count(*) AS INT) AS n_files FROM source_files GROUP BY 1 HAVING bool_or(file_id = '1998-03')")


def j08(s: SparkSession, d: str) -> DataFrame:
    files = source_files(s, d).where("deal_id < 600").groupBy("deal_id").agg(F.collect_set("file_id").alias("files"))
    return joins.overlapping(files, "deal_id", "files").where("shared >= 2")


register("j08_array_overlap", j08, SQL + """
SELECT a.deal_id AS id_1, b.deal_id AS id_2, count(*) AS shared FROM source_files a JOIN source_files b ON a.file_id = b.file_id AND a.deal_id < b.deal_id
WHERE a.deal_id < 600 AND b.deal_id < 600 GROUP BY 1, 2 HAVING count(*) >= 2""")

register("j09_deal_files", lambda s, d: deals(s, d).where("stage = 'rfq'").select("id").join(source_files(s, d), F.col("id") == F.col("deal_id")).groupBy("file_id").agg(F.count("*").alias("n_deals")), SQL + "SELECT file_id, count(*) AS n_deals FROM deals JOIN source_files ON deal_id = id WHERE stage = 'rfq' GROUP BY 1")


def j10(s: SparkSession, d: str) -> DataFrame:
    r = deals(s, d).select("id", "customer_id", "vendor_id")
    return joins.related_either(r, "id", ("customer_id", "vendor_id"), r.where("id % 50 = 0"))


register("j10_related_deals", j10, SQL + "SELECT DISTINCT a.id AS of_id, b.id AS related_id FROM deals a JOIN deals b ON (a.customer_id = b.customer_id OR a.vendor_id = b.vendor_id) AND a.id <> b.id WHERE a.id % 50 = 0")

register("j12_similar_nearby", lambda s, d: joins.similar_nearby(deals(s, d), "customer_name", "deal_value", "created_at"), SQL + """
SELECT a.id AS id_1, b.id AS id_2, a.customer_name FROM deals a JOIN deals b ON a.customer_name = b.customer_name AND a.id < b.id
AND b.deal_value BETWEEN a.deal_value * 0.9 AND a.deal_value * 1.1 AND abs(date_diff('day', a.created_at, b.created_at)) <= 90""")

register("j13_vendor_contacts", lambda s, d: deal_vendors(s, d).join(deals(s, d).select(F.col("id").alias("deal_id"), "customer_id"), "deal_id").select("vendor_id", "customer_id").distinct(), SQL + "SELECT DISTINCT vendor_id, customer_id FROM deal_vendors JOIN (SELECT id, customer_id FROM deals) ON id = deal_id")

register("j14_semi", lambda s, d: vendors(s, d).join(deals(s, d).where("deal_value > 490000"), "vendor_id", "left_semi"), SQL + "SELECT * FROM vendors WHERE vendor_id IN (SELECT vendor_id FROM deals WHERE deal_value > 490000)")

register("j15_anti", lambda s, d: table(s, d, "customer").select("c_custkey", "c_name").join(table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti"), "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")

register("j16_count_per_row", lambda s, d: joins.count_per(table(s, d, "documents").select("doc_id", "source"), table(s, d, "conversations").select(F.col("conv_id").alias("doc_id")), "doc_id", "n_turns"), "SELECT doc_id, source, (SELECT count(*) FROM conversations WHERE conv_id = doc_id) AS n_turns FROM documents")


def j17(s: SparkSession, d: str) -> DataFrame:
    return (deals(s, d).agg(F.count("*").alias("deals")).crossJoin(vendors(s, d).agg(F.count("*").alias("vendors")))
            .crossJoin(table(s, d, "events").agg(F.count_if(F.col("event_type") == "error").alias("errors"))))


register("j17_scalar_counts", j17, SQL + "SELECT (SELECT count(*) FROM deals) AS deals, (SELECT count(*) FROM vendors) AS vendors, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors")


def j18(s: SparkSession, d: str) -> DataFrame:
    notes = table(s, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "flagged").alias("override"))
    return table(s, d, "documents").select("doc_id", "lang").join(notes, "doc_id", "left").select("doc_id", F.coalesce("override", "lang").alias("tag"))


register("j18_annotations", j18, "SELECT d.doc_id, coalesce(CASE WHEN toxic = 1 THEN 'flagged' END, lang) AS tag FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")

# ---------------------------------------------------------------- aggregates

register("a04_stats_by_type", lambda s, d: rollups.log_stats(table(s, d, "events"), ["event_type"]), "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, round(avg(value), 6) AS avg_value, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1")
register("a06_alias_stats", lambda s, d: joins.count_per(vendors(s, d).select("vendor_id", "vendor_name"), deal_vendors(s, d), "vendor_id", "usage"), SQL + "SELECT v.vendor_id, vendor_name, count(deal_id) AS usage FROM vendors v LEFT JOIN deal_vendors d ON d.vendor_id = v.vendor_id GROUP BY 1, 2")
register("a07_strategy_bands", lambda s, d: rollups.bands(table(s, d, "events"), ["event_type"], "value", 90, 70), "SELECT event_type, count(*) AS n, count(*) FILTER (value >= 90) AS high, count(*) FILTER (value >= 70 AND value < 90) AS medium, count(*) FILTER (value < 70) AS low FROM events GROUP BY 1")
register("a08_per_day", lambda s, d: rollups.per_period(table(s, d, "events"), "day"), "SELECT date_trunc('day', ts)::TIMESTAMP AS period, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY 1")
register("a12_daily_average", lambda s, d: rollups.per_period(table(s, d, "events"), "day", ["event_type"]), "SELECT date_trunc('day', ts)::TIMESTAMP AS period, event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY 1, 2")
register("a13_error_statistics", lambda s, d: rollups.log_stats(table(s, d, "events").where("event_type = 'error'"), ["event_type", "user_id"]), "SELECT event_type, user_id, count(*) AS n, count(DISTINCT user_id) AS n_users, round(avg(value), 6) AS avg_value, min(ts) AS first_at, max(ts) AS last_at FROM events WHERE event_type = 'error' GROUP BY 1, 2")
register("a14_pass_rates", lambda s, d: rollups.pass_rates(table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang"), "doc_id"), ["lang"], F.col("quality") == 1), """
SELECT lang, count(*) AS total, count(*) FILTER (quality = 1) AS passed, count(*) FILTER (quality <> 1) AS failed, round(count(*) FILTER (quality = 1) * 100.0 / count(*), 2) AS pass_rate FROM labels JOIN documents USING (doc_id) GROUP BY 1""")


def a09(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    g = e.agg(F.count("*").alias("attempts"), F.count_if(F.col("event_type") == "purchase").alias("matched"), F.round(F.avg("value"), 6).alias("avg_value"))
    return g.withColumn("success_rate", rollups.rate(F.col("matched") * 100, F.col("attempts"), 2)).crossJoin(vendors(s, d).agg(F.count("*").alias("n_vendors")))


register("a09_matching_stats", a09, SQL + "SELECT count(*) AS attempts, count(*) FILTER (event_type = 'purchase') AS matched, round(avg(value), 6) AS avg_value, round(count(*) FILTER (event_type = 'purchase') * 100.0 / count(*), 2) AS success_rate, (SELECT count(*) FROM vendors) AS n_vendors FROM events")


def a02(s: SparkSession, d: str) -> DataFrame:
    m = source_files(s, d).groupBy("deal_id").agg(F.count("*").alias("n")).join(deals(s, d).select(F.col("id").alias("deal_id"), "status", "created_at", "customer_id"), "deal_id")
    return m.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "F").alias("automatic"), F.count_if(F.col("status") == "O").alias("manual"), F.round(F.avg("n"), 6).alias("avg_merged"),
                 F.max("created_at").alias("last_at"), F.countDistinct("customer_id").alias("users"))


register("a02_merge_statistics", a02, SQL + """
, n AS (SELECT deal_id, count(*) AS n FROM source_files GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (status = 'F') AS automatic, count(*) FILTER (status = 'O') AS manual, round(avg(n), 6) AS avg_merged, max(created_at) AS last_at, count(DISTINCT customer_id) AS users FROM n JOIN deals ON id = deal_id""")


def a16(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    last = e.agg(F.max("ts").alias("as_of"))
    return e.crossJoin(F.broadcast(last)).where(F.expr("ts >= as_of - interval 24 hours")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.round(F.avg("k"), 6).alias("avg_k"))


register("a16_upload_metrics", a16, "SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS failed, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS avg_k FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")


def a17(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return e.groupBy("event_type").agg(F.sum("k").alias("records"), F.round(F.sum("value"), 4).alias("seconds"), rollups.rate(F.sum("k"), F.sum("value"), 4).alias("records_per_second"))


register("a17_processing_metrics", a17, "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS records, round(sum(value), 4) AS seconds, round(sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) / nullif(sum(value), 0), 4) AS records_per_second FROM events GROUP BY 1")


def a18(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_at"))
    return e.crossJoin(F.broadcast(e.agg(F.max("last_at").alias("as_of")))).agg(F.count("*").alias("users"), F.count_if(F.expr("last_at < as_of - interval 30 minutes")).alias("stalled"))


register("a18_stalled", a18, "WITH u AS (SELECT user_id, max(ts) AS last_at FROM events GROUP BY 1) SELECT count(*) AS users, count(*) FILTER (last_at < (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE) AS stalled FROM u")
register("a19_hourly_trend", lambda s, d: rollups.per_period(table(s, d, "events"), "hour", ["event_type"]), "SELECT date_trunc('hour', ts)::TIMESTAMP AS period, event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY 1, 2")
register("a20_security_metrics", lambda s, d: table(s, d, "labels").agg(F.count_if(F.col("toxic") == 1).alias("blocked"), F.count_if(F.col("quality") == 0).alias("quarantined"), F.count("*").alias("scanned")), "SELECT count(*) FILTER (toxic = 1) AS blocked, count(*) FILTER (quality = 0) AS quarantined, count(*) AS scanned FROM labels")
register("a21_completeness", lambda s, d: rollups.completeness(deals(s, d), ["customer_name", "vendor_id", "deal_name", "deal_value"]), SQL + """
SELECT count(*) AS total, round(count(customer_name) * 100.0 / count(*), 2) AS pct_customer_name, round(count(vendor_id) * 100.0 / count(*), 2) AS pct_vendor_id, round(count(deal_name) * 100.0 / count(*), 2) AS pct_deal_name,
round(count(deal_value) * 100.0 / count(*), 2) AS pct_deal_value, round((count(customer_name) + count(vendor_id) + count(deal_name) + count(deal_value)) * 100.0 / (count(*) * 4), 2) AS pct_all FROM deals""")
register("a24_timeliness", lambda s, d: rollups.timeliness(table(s, d, "events"), "ts", 21, 7), """
WITH a AS (SELECT (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 86400000000.0 AS age FROM events) SELECT round(avg(age), 4) AS avg_age_days, count(*) FILTER (age > 21) AS stale, count(*) FILTER (age <= 7) AS recent FROM a""")


def a25(s: SparkSession, d: str) -> DataFrame:
    c = rollups.completeness(deals(s, d), ["customer_name", "vendor_id", "deal_name"]).select("pct_all")
    a = rollups.pass_rates(table(s, d, "labels"), [], F.col("quality") == 1).select("pass_rate")
    t = rollups.timeliness(table(s, d, "events"), "ts").select("avg_age_days")
    u = table(s, d, "documents").agg(F.count("*").alias("n"), F.countDistinct(F.md5("text")).alias("k")).select(rollups.rate(F.col("k") * 100, F.col("n"), 2).alias("unique_pct"))
    one = c.crossJoin(a).crossJoin(t).crossJoin(u)
    return one.select("pct_all", "pass_rate", "avg_age_days", "unique_pct", rollups.overall_quality(F.col("pct_all"), F.col("pass_rate"), F.lit(90.0), F.col("avg_age_days"), F.col("unique_pct")).alias("overall"))


register("a25_overall_quality", a25, SQL + """
, c AS (SELECT round((count(customer_name) + count(vendor_id) + count(deal_name)) * 100.0 / (count(*) * 3), 2) AS pct_all FROM deals),
a AS (SELECT round(count(*) FILTER (quality = 1) * 100.0 / count(*), 2) AS pass_rate FROM labels),
t AS (SELECT round(avg((epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 86400000000.0), 4) AS avg_age_days FROM events),
u AS (SELECT round(count(DISTINCT md5(text)) * 100.0 / count(*), 2) AS unique_pct FROM documents)
SELECT *, round(0.25 * pct_all + 0.30 * pass_rate + 0.25 * 90.0 + 0.15 * greatest(0, 100 - 2 * avg_age_days) + 0.05 * unique_pct, 2) AS overall FROM c, a, t, u""")


def a26(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("in_groups"), F.count_if(F.col("n") > 1).alias("groups")).withColumn("duplicate_pct", rollups.rate(F.col("in_groups") * 100, F.col("total"), 2))


register("a26_duplicate_statistics", a26, "WITH g AS (SELECT md5(text) AS h, count(*) AS n FROM documents GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) FILTER (n > 1) AS BIGINT) AS in_groups, count(*) FILTER (n > 1) AS groups, round(sum(n) FILTER (n > 1) * 100.0 / sum(n), 2) AS duplicate_pct FROM g")


def a27(s: SparkSession, d: str) -> DataFrame:
    x = deals(s, d)
    def branch(kind: str, rank: int, test: str) -> DataFrame:
        return x.where(test).orderBy(F.desc("deal_value"), "id").limit(20).select(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), "id")
    return branch("low_value", 3, "deal_value < 2000").unionByName(branch("missing_vendor", 1, "vendor_id is null")).unionByName(branch("stale_rfq", 2, "stage = 'rfq' and created_at < timestamp_ntz'1996-01-01'"))


register("a27_issue_list", a27, SQL + """
(SELECT 'low_value' AS kind, 3 AS rank, id FROM deals WHERE deal_value < 2000 ORDER BY deal_value DESC, id LIMIT 20)
UNION ALL (SELECT 'missing_vendor', 1, id FROM deals WHERE vendor_id IS NULL ORDER BY deal_value DESC, id LIMIT 20)
UNION ALL (SELECT 'stale_rfq', 2, id FROM deals WHERE stage = 'rfq' AND created_at < TIMESTAMP '1996-01-01' ORDER BY deal_value DESC, id LIMIT 20)""")

register("a30_stage_breakdown", lambda s, d: rollups.breakdown(deals(s, d), "stage").unionByName(rollups.breakdown(deals(s, d), "priority")), SQL + "SELECT stage AS value, count(*) AS n FROM deals GROUP BY 1 UNION ALL SELECT priority, count(*) FROM deals GROUP BY 1")
register("a31_parser_stats", lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.count_if(F.col("value") < 5).alias("low")), "SELECT user_id, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, count(*) FILTER (value < 5) AS low FROM events GROUP BY 1")
register("a34_phase_duration", lambda s, d: search.within_days(table(s, d, "events").where("event_type <> 'error'"), "ts", 7).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("avg_value")), """
WITH e AS (SELECT * FROM events WHERE event_type <> 'error') SELECT event_type, round(avg(value), 6) AS avg_value FROM e WHERE ts >= (SELECT max(ts) FROM e) - INTERVAL 7 DAY GROUP BY 1""")
register("a36_frequency", lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("users")), "SELECT n, count(*) AS users FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) GROUP BY 1")
register("a39_insight_bands", lambda s, d: deals(s, d).groupBy("stage").agg(F.count_if(F.col("deal_value") >= 3e5).alias("high"), F.count_if(F.col("deal_value").between(1e5, 299_999.999)).alias("medium"), F.round(F.avg("deal_value"), 4).alias("avg_value")), SQL + "SELECT stage, count(*) FILTER (deal_value >= 300000) AS high, count(*) FILTER (deal_value BETWEEN 100000 AND 299999.999) AS medium, round(avg(deal_value), 4) AS avg_value FROM deals GROUP BY 1")
register("a38_retention", lambda s, d: table(s, d, "events").crossJoin(F.broadcast(table(s, d, "events").agg(F.max("ts").alias("as_of")))).groupBy(F.expr("ts < as_of - interval 20 days").alias("expired")).agg(F.count("*").alias("n")), "SELECT ts < (SELECT max(ts) FROM events) - INTERVAL 20 DAY AS expired, count(*) AS n FROM events GROUP BY 1")
register("a42_job_counts", lambda s, d: table(s, d, "orders").agg(*[F.count_if(F.col("o_orderstatus") == x).alias(f"n_{x}") for x in "FOP"]), "SELECT count(*) FILTER (o_orderstatus = 'F') AS \"n_F\", count(*) FILTER (o_orderstatus = 'O') AS \"n_O\", count(*) FILTER (o_orderstatus = 'P') AS \"n_P\" FROM orders")

# ---------------------------------------------------------------- correlation, lineage, windows, sets

def c05(s: SparkSession, d: str) -> DataFrame:
    h = table(s, d, "events").withColumn("file", F.get_json_object("props", "$.k"))
    return joins.lineage(h, "user_id", "event_type", "ts", "file")


register("c05_lineage", c05, "SELECT user_id, event_type, count(*) AS changes, count(DISTINCT json_extract_string(props, '$.k')) AS source_count, max(ts) AS last_at FROM events GROUP BY 1, 2")


def c06(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("customer_id", "stage").orderBy(F.desc("created_at"), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = deals(s, d).withColumn("big_name", F.when(F.col("deal_value") > 2e5, F.col("deal_name")))
    r = r.select("customer_id", "stage", F.first("big_name", ignorenulls=True).over(w).alias("deal_name"), F.first("id").over(w).alias("primary_id"), F.count("*").over(w).alias("n")).distinct()
    return r.withColumn("confidence", F.when(F.col("n") > 1, 0.9).otherwise(0.7))


register("c06_reconcile", c06, SQL + """
SELECT customer_id, stage, arg_min(CASE WHEN deal_value > 200000 THEN deal_name END, (-epoch_us(created_at), id)) FILTER (deal_value > 200000) AS deal_name,
arg_min(id, (-epoch_us(created_at), id)) AS primary_id, count(*) AS n, CAST(CASE WHEN count(*) > 1 THEN 0.9 ELSE 0.7 END AS DOUBLE) AS confidence FROM deals GROUP BY 1, 2""")


def c08(s: SparkSession, d: str) -> DataFrame:
    f = source_files(s, d).groupBy("deal_id").agg(F.collect_set("file_id").alias("files")).select(F.lit("deal").alias("kind"), F.col("deal_id").alias("id"), F.size("files").alias("n"))
    v = deal_vendors(s, d).groupBy("vendor_id").agg(F.collect_set("deal_id").alias("d")).select(F.lit("vendor").alias("kind"), F.col("vendor_id").alias("id"), F.size("d").alias("n"))
    return f.unionByName(v).where("n > 1")


register("c08_multi_source", c08, SQL + "SELECT * FROM (SELECT 'deal' AS kind, deal_id AS id, CAST(count(*) AS INT) AS n FROM source_files GROUP BY 2 UNION ALL SELECT 'vendor', vendor_id, CAST(count(*) AS INT) FROM deal_vendors GROUP BY 2) WHERE n > 1")
register("c09_correlation_stats", lambda s, d: c08(s, d).groupBy("kind").agg(F.count("*").alias("entities"), F.round(F.avg("n"), 6).alias("avg_sources"), F.max("n").alias("max_sources")), SQL + """
SELECT kind, count(*) AS entities, round(avg(n), 6) AS avg_sources, max(n) AS max_sources FROM (SELECT 'deal' AS kind, deal_id AS id, CAST(count(*) AS INT) AS n FROM source_files GROUP BY 2 UNION ALL SELECT 'vendor', vendor_id, CAST(count(*) AS INT) FROM deal_vendors GROUP BY 2) WHERE n > 1 GROUP BY 1""")
register("c11_supersession", lambda s, d: joins.supersede(table(s, d, "events").select("event_id", "user_id", "event_type", "ts"), "user_id", "event_type", "ts", "event_id"), """
SELECT event_id, user_id, event_type, ts, lead(event_id) OVER w AS superseded_by, lead(ts) OVER w AS superseded_at, lead(event_id) OVER w IS NULL AS is_current FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""")


def c10(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    best = e.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("m"))
    return best.select("user_id", "event_type", "m.event_id", "m.value")


register("c10_current_provenance", c10, "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")


def c13(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("v"))
    return g.groupBy("user_id").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 3).alias("weighted"))


register("c13_weighted_confidence", c13, "SELECT user_id, count(*) AS n, round(avg(value), 3) AS weighted FROM events GROUP BY 1")


def c14(s: SparkSession, d: str) -> DataFrame:
    x = deals(s, d).select("id", "customer_name", "deal_name", "stage")
    return x.unpivot("id", ["customer_name", "deal_name", "stage"], "field", "value").where("value is not null and value <> ''")


register("c14_field_rows", c14, SQL + "SELECT * FROM (SELECT id, unnest(['customer_name', 'deal_name', 'stage']) AS field, unnest([customer_name, deal_name, stage]) AS value FROM deals) WHERE value <> ''")


def r06(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").where("event_type = 'error'").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-6 * 3_600_000_000, 0)
    return e.select("event_id", "user_id", F.count("*").over(w).alias("failures")).where("failures >= 2")


register("r06_failure_alerts", r06, "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS failures FROM events WHERE event_type = 'error' QUALIFY failures >= 2")


def w02(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("vendor_id").orderBy(F.desc("deal_value"), "id")
    return deals(s, d).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("vendor_id", "rank", "id")


register("w02_best_per_vendor", w02, SQL + "SELECT vendor_id, CAST(row_number() OVER (PARTITION BY vendor_id ORDER BY deal_value DESC, id) AS INT) AS rank, id FROM deals QUALIFY rank <= 3")


def w06(s: SparkSession, d: str) -> DataFrame:
    return rollups.per_period(table(s, d, "events"), "day").orderBy(F.desc("period")).limit(10)


register("w06_trend_series", w06, "SELECT date_trunc('day', ts)::TIMESTAMP AS period, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 10")


def u04(s: SparkSession, d: str) -> DataFrame:
    old = deals(s, d).where("id % 3 <> 0").select("id", "deal_value", F.lit(1).alias("version"))
    new = deals(s, d).where("id % 3 <> 1").select("id", (F.col("deal_value") * 2).alias("deal_value"), F.lit(2).alias("version"))
    joined = old.join(new.select("id", F.col("deal_value").alias("v"), F.col("version").alias("n")), "id", "full_outer")
    return joined.select("id", F.coalesce("v", "deal_value").alias("deal_value"), F.coalesce("n", "version").alias("version"), F.col("version").isNull().alias("created"))


register("u04_upsert", u04, SQL + "SELECT id, CASE WHEN id % 3 <> 1 THEN deal_value * 2 ELSE deal_value END AS deal_value, CASE WHEN id % 3 <> 1 THEN 2 ELSE 1 END AS version, id % 3 = 0 AS created FROM deals")
register("k06_upsert_counts", lambda s, d: u04(s, d).groupBy("created").agg(F.count("*").alias("n"), F.count_if(F.col("version") == 2).alias("written")), SQL + "SELECT id % 3 = 0 AS created, count(*) AS n, count(*) FILTER (id % 3 <> 1) AS written FROM deals GROUP BY 1")
register("k04_joined_lists", lambda s, d: source_files(s, d).groupBy("deal_id").agg(F.array_join(F.array_sort(F.collect_set("file_id")), ";").alias("files")), SQL + "SELECT deal_id, string_agg(file_id, ';' ORDER BY file_id) AS files FROM source_files GROUP BY 1")
