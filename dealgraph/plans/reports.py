"""Queries of reports, validation and field coercions with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgraph.functions import fields
from dealgraph.operators import reports
from dealgraph.plans.registry import register
from dealgraph.plans.written import written, written_sql
from dealgraph.sources.fixtures import SQL, deal_vendors, deals, source_files, table, vendors


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---------------------------------------------------------------- reports

def a03(s: SparkSession, d: str) -> DataFrame:
    n = source_files(s, d).groupBy(F.col("deal_id").alias("merge_id")).agg(F.count("*").alias("n_sources"))
    m = deals(s, d).select(F.col("id").alias("merge_id"), F.col("stage").alias("entity_type"), F.when(F.col("priority") == "low", "automatic").otherwise("manual").alias("merge_type"),
                           (F.col("deal_value") < 50_000).alias("unmerged"), F.col("created_at").alias("merged_at")).join(n, "merge_id")
    return reports.merge_statistics(m, table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("merge_id")), 900)


register("a03_merge_statistics", a03, SQL + """
, m AS (SELECT id, stage, priority, deal_value, created_at, n FROM deals JOIN (SELECT deal_id, count(*) AS n FROM source_files GROUP BY 1) ON deal_id = id),
c AS (SELECT l_orderkey, count(*) AS k FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT stage AS entity_type, count(*) AS total_merges, count(*) FILTER (priority = 'low') AS automatic_merges, count(*) FILTER (priority <> 'low') AS manual_merges,
  count(*) FILTER (deal_value < 50000) AS unmerged_count, round(avg(n), 6) AS avg_entities_per_merge, round(avg(coalesce(k, 0)), 6) AS avg_conflicts_per_merge,
  round((1 - count(*) FILTER (deal_value < 50000) / count(*)) * 100, 4) AS success_rate
FROM m LEFT JOIN c ON l_orderkey = id WHERE created_at >= (SELECT max(created_at) FROM m) - INTERVAL 900 DAY GROUP BY 1""")

register("a05_detections", lambda s, d: reports.detection_breakdown(table(s, d, "events"), "event_type", "value", "ts", 14), """
SELECT event_type AS strategy, count(*) AS n, round(avg(value), 6) AS avg_score, max(value) AS best, count(*) FILTER (value >= 90) AS certain
FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY GROUP BY ROLLUP (event_type)""")


def a10(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumns({"kind": F.pmod("user_id", F.lit(7)), "k": F.get_json_object("props", "$.k").cast("bigint")})
    return reports.extraction_summary(e, "kind", F.col("event_type") != "error", "value", "k", "value", "ts")


register("a10_extraction_summary", a10, """
SELECT user_id % 7 AS extraction_type, count(*) AS total, count(*) FILTER (event_type <> 'error') AS successful, count(*) FILTER (event_type = 'error') AS failed, round(avg(value), 2) AS avg_confidence,
  CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS DOUBLE) AS total_tokens, round(avg(value), 0) AS avg_ms, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1""")

register("a11_usage", lambda s, d: reports.usage_summary(table(s, d, "events"), "event_type", F.get_json_object("props", "$.k").cast("int") >= 50), """
SELECT event_type AS kind, count(*) AS requests, count(*) FILTER (k >= 50) AS hits, round(count(*) FILTER (k >= 50) * 100 / count(*), 2) AS hit_rate
FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) GROUP BY 1""")


def a15(s: SparkSession, d: str) -> DataFrame:
    x = deals(s, d)
    status = F.when(F.col("stage") == "quote", "passed").when(F.col("stage") == "rfq", "pending").otherwise("failed")
    checked = x.select(status.alias("status"), (F.col("deal_value") / 1e6).alias("before"), (F.col("deal_value") / 5e5).alias("after"), F.col("created_at").alias("at"))
    bad = table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.when(F.col("l_quantity") >= 40, "critical").otherwise("warning").alias("severity"), F.col("l_shipdate").alias("at"))
    return reports.validation_statistics(checked, bad, 365)


register("a15_validation_statistics", a15, SQL + """
, r AS (SELECT * FROM lineitem WHERE l_returnflag = 'R')
SELECT count(*) AS total, count(*) FILTER (stage = 'quote') AS passed, count(*) FILTER (stage = 'po_in_progress') AS failed, count(*) FILTER (stage = 'rfq') AS pending,
  round(count(*) FILTER (stage = 'quote') * 100 / count(*), 2) AS pass_rate, round(avg(deal_value / 1e6), 2) AS avg_before, round(avg(deal_value / 5e5), 2) AS avg_after,
  (SELECT count(*) FROM r WHERE l_shipdate >= (SELECT max(l_shipdate) FROM r) - INTERVAL 365 DAY) AS failures,
  (SELECT count(*) FROM r WHERE l_quantity >= 40 AND l_shipdate >= (SELECT max(l_shipdate) FROM r) - INTERVAL 365 DAY) AS critical_failures
FROM deals WHERE created_at >= (SELECT max(created_at) FROM deals) - INTERVAL 365 DAY""")

# ---------------------------------------------------------------- rules

RULES = [
    ("deal_name_required", "required", "deal_name", 10, "critical", -0.5), ("deal_value_positive", "range", "deal_value", (0, None), "error", -0.3),
    ("deal_value_reasonable", "range", "deal_value", (20_000, 300_000), "warning", -0.1), ("customer_name_required", "required", "customer_name", 2, "critical", -0.5),
    ("customer_name_format", "format", "customer_name", "^Customer#[0-9]*[1-9]$", "warning", -0.1), ("status_valid", "one_of", "stage", ["rfq", "pending"], "warning", -0.05),
]
_FAILED = """
, f AS (SELECT id, deal_value, list_filter([
    CASE WHEN coalesce(length(trim(deal_name)) < 10, true) THEN ROW('deal_name_required', 'critical', -0.5) END, CASE WHEN deal_value < 0 THEN ROW('deal_value_positive', 'error', -0.3) END,
    CASE WHEN deal_value < 20000 OR deal_value > 300000 THEN ROW('deal_value_reasonable', 'warning', -0.1) END, CASE WHEN coalesce(length(trim(customer_name)) < 2, true) THEN ROW('customer_name_required', 'critical', -0.5) END,
    CASE WHEN NOT regexp_matches(customer_name, '^Customer#[0-9]*[1-9]$') THEN ROW('customer_name_format', 'warning', -0.1) END, CASE WHEN stage NOT IN ('rfq', 'pending') THEN ROW('status_valid', 'warning', -0.05) END
  ], lambda x: x IS NOT NULL) AS failed FROM deals)"""


def f21(s: SparkSession, d: str) -> DataFrame:
    x = deals(s, d).select("id", fields.rule_failures(RULES).alias("failed"))
    return x.select("id", F.array_join(F.transform("failed", lambda r: F.concat_ws(":", r["rule"], r["severity"])), ",").alias("failed"),
                    F.round(F.aggregate("failed", F.lit(0.0), lambda a, r: a + r["impact"]), 4).alias("adjustment"))


register("f21_rule_table", f21, SQL + _FAILED + """
SELECT id, array_to_string(list_transform(failed, lambda x: x[1] || ':' || x[2]), ',') AS failed, round(coalesce(list_sum(list_transform(failed, lambda x: CAST(x[3] AS DOUBLE))), 0), 4) AS adjustment FROM f""")


def a22(s: SparkSession, d: str) -> DataFrame:
    # the failures as the JSON array in which they are kept
    x = deals(s, d).select(F.to_json(F.transform(fields.rule_failures(RULES), lambda r: F.struct(r["rule"].alias("rule")))).alias("failures"))
    return reports.failing_rules(x, "failures", 3)


register("a22_failing_rules", a22, SQL + _FAILED + ", r AS (SELECT unnest(list_transform(failed, lambda x: x[1])) AS rule FROM f) SELECT rule, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, rule LIMIT 3")

register("a23_consistency", lambda s, d: reports.consistency(table(s, d, "documents").select(F.md5("text").alias("k"), "source"), "k", "source"), """
WITH g AS (SELECT md5(text) AS k, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1) SELECT count(DISTINCT k) AS clusters, count(*) AS cluster_size, count(DISTINCT source) AS inconsistent_targets FROM documents JOIN g ON md5(text) = k""")


def scores(s: SparkSession, d: str) -> DataFrame:
    """Shares of quality a source: labels passed, texts that are distinct, texts that are long, and the share of its language."""
    x = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    return x.groupBy(F.col("source").alias("entity_type")).agg(F.avg(F.coalesce("quality", F.lit(0)).cast("double")).alias("accuracy"), (F.countDistinct(F.md5("text")) / F.count("*")).alias("uniqueness"),
                                                             F.avg(F.when(F.col("n_chars") >= 700, 1.0).otherwise(0.0)).alias("timeliness"), F.avg(F.when(F.col("lang") == "en", 1.0).otherwise(0.0)).alias("overall"))


_SCORES = """
WITH s AS (SELECT source AS entity_type, avg(CAST(coalesce(quality, 0) AS DOUBLE)) AS accuracy, count(DISTINCT md5(text)) / count(*) AS uniqueness, avg(CASE WHEN n_chars >= 700 THEN 1.0::DOUBLE ELSE 0 END) AS timeliness,
  avg(CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0 END) AS overall FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)"""


def a28(s: SparkSession, d: str) -> DataFrame:
    x = scores(s, d).select("entity_type", *[F.round(F.col(c) * 100, 2).alias(n) for c, n in (("overall", "completeness"), ("accuracy", "accuracy"), ("uniqueness", "consistency"), ("timeliness", "timeliness"))])
    return reports.recommendations(x)


register("a28_recommendations", a28, _SCORES + """
, p AS (SELECT entity_type, round(overall * 100, 2) AS completeness, round(accuracy * 100, 2) AS accuracy, round(uniqueness * 100, 2) AS consistency, round(timeliness * 100, 2) AS timeliness FROM s)
SELECT *, concat_ws(',', CASE WHEN completeness < 80 THEN 'completeness' END, CASE WHEN accuracy < 80 THEN 'accuracy' END, CASE WHEN consistency < 90 THEN 'consistency' END, CASE WHEN timeliness < 70 THEN 'timeliness' END) AS recommendations FROM p""")

register("a29_alerts", lambda s, d: reports.alerts(scores(s, d)), _SCORES + """
SELECT entity_type, 'quality_drop' AS alert, CASE WHEN overall < 0.5 THEN 'critical' ELSE 'high' END AS severity, round(overall, 4) AS value FROM s WHERE overall < 0.7
UNION ALL SELECT entity_type, 'duplicate_spike', CASE WHEN (1 - uniqueness) * 100 > 20 THEN 'critical' ELSE 'high' END, round((1 - uniqueness) * 100, 4) FROM s WHERE uniqueness < 0.9
UNION ALL SELECT entity_type, 'validation_failure_rate', CASE WHEN 100 - accuracy * 100 > 40 THEN 'critical' ELSE 'medium' END, round(100 - accuracy * 100, 4) FROM s WHERE 100 - accuracy * 100 > 20
UNION ALL SELECT entity_type, 'stale_data', CASE WHEN timeliness < 0.3 THEN 'high' ELSE 'medium' END, round(round((1 - timeliness) * 60, 0), 4) FROM s WHERE timeliness < 0.5""")

register("a32_cleaning_stats", lambda s, d: reports.cleaning_stats(table(s, d, "documents").select("text", F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ").alias("clean")), "text", "clean"), r"""
WITH c AS (SELECT length(text) AS a, length(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')) AS b FROM documents)
SELECT count(*) AS n, CAST(sum(a) AS BIGINT) AS chars_before, CAST(sum(b) AS BIGINT) AS chars_after, round((sum(a) - sum(b)) * 100 / sum(a), 2) AS reduction_pct FROM c""")

register("a33_label_filter", lambda s, d: table(s, d, "labels").groupBy("toxic").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("accepted"), F.count_if(F.col("quality") != 1).alias("rejected"), F.round(F.avg("quality"), 6).alias("avg_score")),
         "SELECT toxic, count(*) AS n, count(*) FILTER (quality = 1) AS accepted, count(*) FILTER (quality <> 1) AS rejected, round(avg(quality), 6) AS avg_score FROM labels GROUP BY 1")

register("a35_merge_totals", lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_returnflag").alias("c")).agg(F.count("*").alias("merges"), F.count_if(F.col("c") > 1).alias("with_conflicts"), F.sum("c").alias("values"), F.max("c").alias("most")),
         'SELECT count(*) AS merges, count(*) FILTER (c > 1) AS with_conflicts, CAST(sum(c) AS BIGINT) AS "values", max(c) AS most FROM (SELECT count(DISTINCT l_returnflag) AS c FROM lineitem GROUP BY l_orderkey)')

register("a37_alias_totals", lambda s, d: deal_vendors(s, d).groupBy("vendor_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("vendors"), F.sum("n").alias("aliases"), F.round(F.avg("n"), 4).alias("avg_per_vendor")), SQL + """
SELECT count(*) AS vendors, CAST(sum(n) AS BIGINT) AS aliases, round(avg(n), 4) AS avg_per_vendor FROM (SELECT vendor_id, count(*) AS n FROM deal_vendors GROUP BY 1)""")


def a40(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select(F.lit("contact").alias("entity"), (F.col("c_acctbal") >= 0).alias("ok"))
    v = vendors(s, d).select(F.lit("vendor").alias("entity"), (F.col("balance") >= 0).alias("ok"))
    x = deals(s, d).select(F.lit("deal").alias("entity"), (F.col("deal_value") >= 20_000).alias("ok")).unionByName(c).unionByName(v)
    per = x.groupBy("entity").agg(F.round(F.avg(F.col("ok").cast("double")) * 100, 4).alias("score"))
    return per.unionByName(per.agg(F.lit("all").alias("entity"), F.round(F.avg("score"), 4).alias("score")))


register("a40_entities_report", a40, SQL + """
, x AS (SELECT 'deal' AS entity, deal_value >= 20000 AS ok FROM deals UNION ALL SELECT 'contact', c_acctbal >= 0 FROM customer UNION ALL SELECT 'vendor', balance >= 0 FROM vendors),
p AS (SELECT entity, round(avg(CAST(ok AS DOUBLE)) * 100, 4) AS score FROM x GROUP BY 1) SELECT * FROM p UNION ALL SELECT 'all', round(avg(score), 4) FROM p""")

register("a41_distinct_counts", lambda s, d: table(s, d, "events").agg(F.count("*").alias("jobs"), F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("kinds"), F.count_if(F.col("event_type") == "error").alias("failed")),
         "SELECT count(*) AS jobs, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds, count(*) FILTER (event_type = 'error') AS failed FROM events")

# ---------------------------------------------------------------- correlation

_KEY = r"CASE WHEN coalesce(lower(trim({e})), '') <> '' THEN 'email:' || lower(trim({e})) ELSE 'name:' || regexp_replace(regexp_replace(lower(trim({n})), '[^\w\s]', '', 'g'), '\s+', '_', 'g') END"


def contacts(s: SparkSession, d: str) -> DataFrame:
    """Customers as contacts; those with a debt have no address."""
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") >= 0, F.concat(F.lit(" "), F.regexp_replace("c_name", "#", "."), F.lit("@Example.org "))).alias("email"),
                                          F.concat(F.lit(" "), F.regexp_replace("c_name", "#", "  No. ")).alias("name"))


_CONTACTS = "WITH c AS (SELECT c_custkey AS id, CASE WHEN c_acctbal >= 0 THEN ' ' || replace(c_name, '#', '.') || '@Example.org ' END AS email, ' ' || replace(c_name, '#', '  No. ') AS name FROM customer)"

VENDORS = ["{}, Inc.", " The  {} ", "{}", None, "A & {} (EU)"]
register("c02_contact_key", lambda s, d: contacts(s, d).select("id", fields.contact_key(F.col("email"), F.col("name")).alias("key")), _CONTACTS + " SELECT id, " + _KEY.format(e="email", n="name") + " AS key FROM c")
register("c02_vendor_key", lambda s, d: table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), fields.key_part(written(F.col("s_name"), F.col("s_suppkey"), VENDORS)).alias("key")), f"WITH v AS (SELECT s_suppkey AS id, {written_sql('s_name', 's_suppkey', VENDORS)} AS x FROM supplier) SELECT id, coalesce(regexp_replace(regexp_replace(lower(trim(x)), '[^\\w\\s]', '', 'g'), '\\s+', '_', 'g'), '') AS key FROM v")
register("c07_backfill_keys", lambda s, d: contacts(s, d).withColumn("key", F.when(F.col("id") % 3 == 0, F.concat(F.lit("kept:"), F.col("id").cast("string")))).select("id", F.coalesce("key", fields.contact_key(F.col("email"), F.col("name"))).alias("key"), F.col("key").isNull().alias("filled")),
         _CONTACTS + " SELECT id, CASE WHEN id % 3 = 0 THEN 'kept:' || id ELSE " + _KEY.format(e="email", n="name") + " END AS key, id % 3 <> 0 AS filled FROM c")


def c03(s: SparkSession, d: str) -> DataFrame:
    v = deal_vendors(s, d).select(F.col("deal_id").alias("entity_id"), F.col("vendor_id").alias("other_id"), F.lit(1.0).alias("weight"))
    x = deals(s, d)
    of_vendor = x.where("vendor_id is not null").select(F.col("vendor_id").alias("entity_id"), F.col("id").alias("other_id"), F.col("deal_value").alias("weight"))
    of_customer = x.select(F.col("customer_id").alias("entity_id"), F.col("id").alias("other_id"), F.col("deal_value").alias("weight"))
    return reports.related({"deal_vendor": (v, 0.9, 10), "vendor_deal": (of_vendor, 0.8, 20), "contact_deal": (of_customer, 0.7, 20)})


register("c03_related_entities", c03, SQL + """
, e AS (SELECT 'deal_vendor' AS kind, 0.9::DOUBLE AS strength, 10 AS most, deal_id AS entity_id, vendor_id AS other_id, 1.0::DOUBLE AS weight FROM deal_vendors
  UNION ALL SELECT 'vendor_deal', 0.8, 20, vendor_id, id, deal_value FROM deals WHERE vendor_id IS NOT NULL UNION ALL SELECT 'contact_deal', 0.7, 20, customer_id, id, deal_value FROM deals),
r AS (SELECT *, row_number() OVER (PARTITION BY kind, entity_id ORDER BY weight DESC, other_id) AS r FROM e) SELECT entity_id, kind, other_id, strength FROM r WHERE r <= most""")


def c04(s: SparkSession, d: str) -> DataFrame:
    files = source_files(s, d).groupBy("deal_id").agg(F.array_join(F.array_sort(F.collect_list("file_id")), ",").alias("sources"))
    links = deal_vendors(s, d).groupBy("deal_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("vendor_id")), lambda v: F.concat(v.cast("string"), F.lit(":0.95"))), ",").alias("vendors"))
    return deals(s, d).select(F.col("id").alias("deal_id"), "customer_id").join(files, "deal_id", "left").join(links, "deal_id", "left")


register("c04_correlation_map", c04, SQL + """
SELECT id AS deal_id, customer_id, sources, vendors FROM deals LEFT JOIN (SELECT deal_id, string_agg(file_id, ',' ORDER BY file_id) AS sources FROM source_files GROUP BY 1) f ON f.deal_id = id
LEFT JOIN (SELECT deal_id, string_agg(vendor_id || ':0.95', ',' ORDER BY vendor_id) AS vendors FROM deal_vendors GROUP BY 1) v ON v.deal_id = id""")


def c12(s: SparkSession, d: str) -> DataFrame:
    """Per entity and field the number of its values, and the current one: the last that was seen."""
    e = table(s, d, "events").groupBy(F.col("user_id").alias("entity_id"), F.col("event_type").alias("field"))
    return e.agg(F.count("*").alias("history"), F.max_by("value", F.struct("ts", "event_id")).alias("current"), F.max("ts").alias("seen_at"))


register("c12_provenance_map", c12, "SELECT user_id AS entity_id, event_type AS field, count(*) AS history, last(value ORDER BY ts, event_id) AS current, max(ts) AS seen_at FROM events GROUP BY 1, 2")

# ---------------------------------------------------------------- duplicates, merges

def d21(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "lineitem").select(F.col("l_orderkey").alias("entity_1"), F.col("l_partkey").alias("entity_2"), (F.col("l_quantity") / 50).alias("confidence"), F.when(F.col("l_returnflag") == "N", "pending").otherwise("settled").alias("status"),
                                       F.col("l_shipdate").alias("detected_at"), F.concat_ws(":", "l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey").alias("key"))
    return reports.top_candidates(x, deals(s, d).where("id % 50 = 0").select(F.col("id").alias("entity_id"))).drop("rank")


register("d21_duplicate_candidates", d21, SQL + """
, k AS (SELECT l_orderkey AS e1, l_partkey AS e2, l_quantity / 50 AS confidence, l_shipdate AS detected_at, concat_ws(':', l_orderkey, l_linenumber, l_extendedprice, l_suppkey) AS key FROM lineitem WHERE l_returnflag = 'N' AND l_quantity / 50 >= 0.7),
b AS (SELECT e1 AS entity_id, e2 AS candidate_id, confidence, detected_at, key FROM k UNION ALL SELECT e2, e1, confidence, detected_at, key FROM k WHERE e1 <> e2),
r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, detected_at DESC, candidate_id, key) AS r FROM b WHERE entity_id IN (SELECT id FROM deals WHERE id % 50 = 0))
SELECT entity_id, candidate_id, confidence, detected_at FROM r WHERE r <= 10""")

register("d22_rule_duplicates", lambda s, d: reports.first_duplicates(deals(s, d)), SQL + """
, x AS (SELECT id, lower(trim(deal_name)) AS name, lower(trim(customer_name)) AS customer, deal_value AS v, string_split(lower(trim(deal_name)), ' ') AS words FROM deals WHERE deal_value > 0 AND customer_name IS NOT NULL AND deal_name IS NOT NULL),
p AS (SELECT a.id, b.id AS match_id, len(list_filter(a.words, lambda w: contains(b.name, w) AND length(w) > 3)) / len(a.words) * 0.4::DOUBLE + 0.3::DOUBLE + 0.3::DOUBLE AS score
  FROM x a JOIN x b ON a.customer = b.customer AND b.id < a.id AND abs(a.v - b.v) / greatest(a.v, b.v) < 0.1)
SELECT id, min(match_id) AS match_id, round(arg_min(score, match_id), 6) AS score FROM p WHERE score > 0.7 GROUP BY 1""")


def m09(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("pos"), F.when(F.col("l_linenumber") % 4 == 0, F.lit(None)).when(F.col("l_linenumber") % 4 == 1, " ").otherwise(F.concat("l_returnflag", "l_linestatus")).alias("value"),
                                       (F.col("l_discount") >= 0.08).alias("validated"), F.col("l_extendedprice").alias("weight"), "l_suppkey", "l_linenumber")
    # one row a record: the records of an order are its parts
    x = x.groupBy("l_orderkey", "pos").agg(F.max(F.struct("weight", "l_suppkey", "l_linenumber", "value", "validated")).alias("_m")).select("l_orderkey", "pos", "_m.value", "_m.validated", "_m.weight")
    return reports.conflict_strategies(x, ["l_orderkey"]).drop("manual")


register("m09_conflict_strategies", m09, """
WITH x AS (SELECT l_orderkey, l_partkey AS pos, l_extendedprice AS weight, l_suppkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE l_returnflag || l_linestatus END AS value, l_discount >= 0.08 AS validated FROM lineitem),
o AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY l_orderkey, pos ORDER BY weight DESC, l_suppkey DESC, l_linenumber DESC) = 1),
g AS (SELECT l_orderkey, list({'p': pos, 'v': value, 'ok': validated} ORDER BY pos) AS v, list(value ORDER BY weight DESC, pos)[1] AS suggested FROM o GROUP BY 1),
h AS (SELECT *, list_filter(v, lambda a: a.v IS NOT NULL AND trim(a.v) <> '') AS f, list_filter(v, lambda a: a.ok) AS k FROM g)
SELECT l_orderkey, coalesce(v[1].v, suggested) AS prefer_source, coalesce(v[len(v)].v, suggested) AS prefer_target, coalesce(f[1].v, suggested) AS prefer_complete, coalesce(k[1].v, suggested) AS prefer_validated,
  coalesce(array_to_string(list_transform(list_filter(list_transform(f, lambda a: a.v), lambda a, i: list_position(list_transform(f, lambda b: b.v), a) = i), lambda a: a), ','), '') AS merged, suggested FROM h""")

# ---------------------------------------------------------------- fields

register("f10_commodity", lambda s, d: table(s, d, "part").select("p_partkey", fields.commodity(F.col("p_name"), F.col("p_type")).alias("commodity")).unionByName(
    table(s, d, "documents").select("doc_id", fields.commodity(F.col("text")).alias("commodity")).withColumnRenamed("doc_id", "p_partkey")), f"""
WITH w AS (SELECT [{", ".join(quoted(x) for x in fields.COMMODITIES)}] AS words), t AS (SELECT p_partkey, lower(concat_ws(' ', p_name, p_type)) AS t FROM part UNION ALL SELECT doc_id, lower(text) FROM documents)
SELECT p_partkey, upper(substr(k, 1, 1)) || substr(k, 2) AS commodity FROM (SELECT p_partkey, list_filter(words, lambda x: contains(t, x))[1] AS k FROM t, w)""")

def f12(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(6)).alias("k"), F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("v"))
    v, v1, v3, c = F.col("v").cast("string"), (F.col("v") + 1).cast("string"), (F.col("v") + 3).cast("string"), (F.col("v") % 900 + 100).cast("string")
    text = (F.when(F.col("k") == 0, F.concat(F.lit("$"), v, F.lit("K per year"))).when(F.col("k") == 1, F.concat(F.lit("€ "), v, F.lit(" - "), v3, F.lit(" M"))).when(F.col("k") == 2, F.concat(F.lit("approx. £1,"), c, F.lit(".50")))
            .when(F.col("k") == 3, F.concat(F.lit("¥"), v, F.lit("k to "), v1, F.lit("K annually"))).when(F.col("k") == 4, F.lit("none")).otherwise(F.concat(F.lit("estimated "), v, F.lit(".25b"))))
    x = x.select("o_orderkey", text.alias("t"))
    return x.select("o_orderkey", fields.amount_currency(F.col("t")).alias("currency"), fields.amount_upside(F.col("t")).alias("upside"))




register("f12_cost_upside", f12, """
WITH x AS (SELECT o_orderkey, o_orderkey % 6 AS k, CAST(floor(o_totalprice / 1000) AS BIGINT) AS v FROM orders)
SELECT o_orderkey, CASE k WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'JPY' ELSE 'USD' END AS currency,
  CAST(CASE k WHEN 0 THEN CASE WHEN v > 0 THEN v * 1000 END WHEN 1 THEN (v + 3) * 1000000 WHEN 2 THEN 1101 + v % 900 WHEN 3 THEN (v + 1) * 1000 WHEN 4 THEN NULL ELSE v * 1000000000 + 250000000 END AS BIGINT) AS upside FROM x""")


def f13(s: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    text = (F.when(F.col("o_orderkey") % 3 == 0, F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "d MMM yyyy")).otherwise(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00"))))
    return table(s, d, "orders").select("o_orderkey", text.alias("t")).select("o_orderkey", fields.spreadsheet_date(F.col("t")).alias("day"))


register("f13_spreadsheet_date", f13, "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")


def f14(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select("event_id", fields.csv_amount(F.concat(F.lit("$1,"), F.col("props"))).alias("a"), fields.csv_amount(F.concat(F.floor("value").cast("string"), F.lit(",000.5 USD"))).alias("b"),
                    fields.csv_status(F.concat(F.lit("Is "), F.element_at(F.array(*[F.lit(x) for x in ("Closed WON", "lost", "Approved", "REJECTED!", "open")]), (F.col("event_id") % 5 + 1).cast("int")))).alias("status"))


register("f14_csv_fields", f14, """
SELECT event_id, 1.0::DOUBLE AS a, floor(value) * 1000 + 0.5 AS b, ['closed-won', 'closed-lost', 'approved', 'rejected', 'registered'][event_id % 5 + 1] AS status FROM events""")

register("f19_status_check", lambda s, d: deals(s, d).select("id", "stage", fields.status_adjustment(F.when(F.col("id") % 4 == 0, F.lit(" Closed_Won")).when(F.col("id") % 4 == 1, F.lit(None)).otherwise(F.col("stage"))).alias("adjustment")),
         SQL + "SELECT id, stage, CASE WHEN id % 4 = 0 THEN 0.05::DOUBLE ELSE -0.05 END AS adjustment FROM deals")
