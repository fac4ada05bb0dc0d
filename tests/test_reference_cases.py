"""Cases with known answers, written from the rules themselves and not from our SQL."""

import datetime

from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)
from dealgraph.functions import fields, normalize, scoring, text
from dealgraph.operators import dedupe, entities, merges, vendor_match, vendor_search


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_names(spark):
    rows = [("Inc",), ("Acme Inc",), ("Acme Ltd Co",), ("Acme, Inc.",), ("company",), ("Coinc",)]
    assert [x for x, in values(spark, rows, "x string", normalize.company_key(F.col("x")))] == ["", "acme", "acme ltd", "acme", "", "coinc"]
    assert [x for x, in values(spark, [("Acme Limited",), ("Acme Co. Holdings Inc",)], "x string", normalize.vendor_key(F.col("x")))] == ["acme limited", "acme  holdings"]
    assert [x for x, in values(spark, [("Acme, Inc.",), (" A  &  B ",)], "x string", fields.key_part(F.col("x")))] == ["acme_inc", "a_b"]
    keys = values(spark, [("Acme, Inc.", "Big Vendor", 1499.0), ("Acme", None, 400.0), (None, "V", 1500.0)], "c string, v string, x double", fields.deal_key(F.col("c"), F.col("v"), F.col("x")))
    assert keys == [("acme_inc:big_vendor:1",), ("acme",), ("v:2",)]


def test_scores(spark):
    assert values(spark, [("plain text.",), ("\ufffd" * 60,), ("",)], "x string", F.round(text.quality_score(F.col("x")), 6)) == [(1.0,), (0.0,), (0.5,)]
    rows = [("deal", "n", "c", 5.0, None, None), ("deal", "", None, 0.0, "USD", datetime.date(2024, 1, 1)), ("vendor", None, None, None, "USD", None), ("contact", "n", None, None, None, None)]
    got = values(spark, rows, "kind string, name string, customer string, value double, currency string, close date", F.round(scoring.calibrate(F.lit(0.5), *[F.col(c) for c in ("kind", "name", "customer", "value", "currency", "close")], F.lit(None).cast("string"), F.lit("")), 6))
    assert got == [(0.5,), (round(0.5 * 0.8 * 0.8 * 0.95 * 1.05 * 1.05, 6),), (0.4,), (0.45,)]
    assert values(spark, [(0.0,), (None,)], "ai double", F.round(scoring.entity_quality(F.lit(0.0), F.col("ai"), F.lit(0.0), F.lit(0.0)), 6)) == [(0.0,), (0.12,)]
    names = [("Dr. Who",), ("John Smith",), ("ACME HOLDINGS",), ("12",), ("a@b",), ("x",), ("Ab" * 51,), (" ",), (None,), ("www.acme Corp",)]
    got = [tuple(r[0]) for r in spark.createDataFrame(names, "x string").select(scoring.customer_issues(F.col("x")).alias("i")).collect()]
    person, case = ["name_not_person:warning"], ["name_capitalization:warning"]
    assert got == [(person, True, -0.05), (person, True, -0.05), (case, True, -0.05), (case, True, -0.05), (case + ["name_no_email_url:error"], False, -0.3), (case + ["name_length:error"], False, -0.3), (["name_length:warning"], True, -0.05),
                   (["name_required:critical"], False, -0.5), (["name_required:critical"], False, -0.5), ([], True, 0.0)]


def test_value_similarity_and_jaccard(spark):
    from dealgraph.functions import similarity

    rows = [(100.0, 100.0), (100.0, 105.0), (100.0, 111.0), (100.0, 120.0), (100.0, 140.0), (100.0, 0.0)]
    assert [round(x, 6) for x, in values(spark, rows, "a double, b double", similarity.value_similarity(F.col("a"), F.col("b")))] == [1.0, 0.853659, 0.685071, 0.413636, 0.0, 0.0]
    assert values(spark, [(["a", "b"], ["b", "a", "c"])], "a array<string>, b array<string>", similarity.jaccard(F.col("a"), F.col("b"))) == [(2 / 3,)]


DEALS = [(1, "Cloud rollout", "Acme Inc", 7, 100_000.0, "2024-01-01"), (2, "cloud  rollout!", "ACME Corp", 7, 100_000.5, "2024-01-03"), (3, "Rollout cloud", "Acme", 8, 104_000.0, "2024-06-01"), (4, "Other thing", "Zeta Systems", 7, 100_000.0, "2024-01-01"),
         (5, None, "Acme Inc", None, None, None), (6, "", "", 7, 0.0, None), (7, "Cloud rollout", "Acme Inc", 7, 100_000.0, "2024-01-01")]


def records(spark, rows=DEALS):
    return spark.createDataFrame(rows, "id bigint, deal_name string, customer_name string, vendor_id bigint, deal_value double, created_at string").withColumn("created_at", F.to_date("created_at")).withColumn("status", F.lit("open"))


def test_duplicate_strategies(spark):
    r = dedupe.prepared(records(spark))

    def pairs(found):
        return {(x.id_1, x.id_2): round(x.score, 6) for x in found.collect()}

    assert pairs(dedupe.exact(r)) == {(1, 2): 1.0, (1, 7): 1.0, (2, 7): 1.0}
    # suffixes stay: "acme inc" and "acme corp" are 82 percent alike, and as words one holds "acme"
    assert set(pairs(dedupe.fuzzy_name(r))) == {(1, 2), (1, 3), (1, 7), (2, 3), (2, 7), (3, 7)}
    assert set(pairs(dedupe.customer_value(r))) == {(1, 2), (1, 3), (1, 7), (2, 3), (2, 7), (3, 7)}
    assert pairs(dedupe.customer_date(r)) == {(1, 2): round(0.6 + 0.4 * (1 - 2 / 7 * 0.3), 6), (1, 7): 1.0, (2, 7): round(0.6 + 0.4 * (1 - 2 / 7 * 0.3), 6)}
    assert pairs(dedupe.vendor_customer(r)) == {(1, 2): 1.0, (1, 7): 1.0, (2, 7): 1.0}
    best = {(x.id_1, x.id_2): (x.strategy, x.action) for x in dedupe.detect(records(spark)).collect()}
    assert best[(1, 2)] == ("exact", "auto_merge") and best[(1, 7)] == ("exact", "auto_merge") and (1, 4) not in best
    mine = {(x.id_1, x.id_2) for x in dedupe.detect(records(spark), "id = 3").collect()}
    assert mine == {(3, 1), (3, 2), (3, 7)}
    assert dedupe.detect(records(spark, DEALS[:0])).collect() == []


def test_online_candidates(spark):
    rows = [(k, "n", "acme" if k % 2 else "The ACME group", k % 3, 1.0, f"2024-01-{k + 1:02d}") for k in range(12)]
    got = {}
    for x in dedupe.online_candidates(records(spark, rows), "id = 0 or id = 1", newest=4).collect():
        got.setdefault(x.id_1, []).append((x.rank, x.id_2))
    # 0 ("the acme group", vendor 0) holds in even ones, and has vendor 0; 1 ("acme") is in all
    assert sorted(got[0]) == [(1, 10), (2, 9), (3, 8), (4, 6)] and sorted(got[1]) == [(1, 11), (2, 10), (3, 9), (4, 8)]


def test_vendors(spark):
    m = spark.createDataFrame([(1, "Acme Systms", "a@acme.com", ["Red Widgets"], []), (2, None, None, [], []), (3, "Zzz", "x@none.org", [], []), (4, "Inc", None, ["gear"], ["gear", "q"])], "mention_id bigint, name string, email string, products array<string>, keywords array<string>")
    c = spark.createDataFrame([(10, "Acme Systems", ["acme.com"], ["widget"]), (11, "Acme System", ["other.com"], ["gearbox"]), (12, "Beta", [], ["nothing"])], "vendor_id bigint, vendor_name string, domains array<string>, products array<string>")
    assert [(r.mention_id, r.vendor_id, r.strategy) for r in vendor_search.by_similar_name(m, c).collect()] == [(1, 10, "fuzzy_high")]
    assert {(r.mention_id, r.vendor_id, r.confidence) for r in vendor_search.by_product_terms(m, c).collect()} == {(1, 10, 0.85), (4, 11, 0.85)}
    combined = {r.mention_id: (r.vendor_id, round(r.confidence, 6)) for r in vendor_search.by_factors(m, c).collect()}
    assert set(combined) == {1} and combined[1][0] == 10
    assert vendor_search.by_similar_name(m.limit(0), c).collect() == vendor_search.suggestions(m, c.limit(0)).collect() == []


def test_names_in_long_texts(spark):
    body = "lorem ipsum dolor " * 300_000
    texts = spark.createDataFrame([(1, body + "xACME Widgetsx" + body), (2, "acm"), (3, None), (4, "beta")], "text_id bigint, text string")
    names = spark.createDataFrame([("acme widgets",), ("beta",), ("a long name that no text has",), ("",), (None,)], "name string")
    assert sorted(tuple(r) for r in vendor_match.found_in_texts(texts, names).collect()) == [(1, "acme widgets"), (4, "beta")]
    edge = spark.createDataFrame([(k, "x" * k + "acme widgets" + "y" * 9) for k in range(40)], "text_id bigint, text string")
    assert vendor_match.found_in_texts(edge, names, piece=7).count() == 40


def test_amounts_and_companies(spark):
    t = spark.createDataFrame([(1, "Deal value: $1,200,000 now, $2.5M later, $1,200,050 or $900, one hundred fifty thousand dollars"), (2, None), (3, "")], "text_id bigint, text string")
    got = sorted((r.label, r.value, r.confidence) for r in entities.amounts(t).collect())
    assert got == [("deal_value", 1_200_000.0, 0.9), ("estimated_value", 2_500_000.0, 0.8), ("written_amount", 150_000.0, 0.7)]
    t = spark.createDataFrame([(1, "We met the supplier: Initech Group! Nothing is near here for a while; really nothing at all; not a word! Hooli Systems did it.")], "text_id bigint, text string")
    assert {(r.name, r.type) for r in entities.companies(t).collect()} >= {("Initech Group", "vendor"), ("Hooli Systems", "unknown")}


def test_unique_deals(spark):
    deals = [("Big deal", "Acme", 100.0, "won", 0.5), ("big DEAL", "acme", 100.0, "won", 0.9), ("Small one", None, None, None, 0.1), ("small ONE", None, 5.0, None, 0.1), (None, None, None, None, 0.3)]
    row = spark.createDataFrame([(deals,), ([],), (None,)], "d array<struct<name:string,customer:string,value:double,status:string,confidence:double>>").select(entities.unique_deals(F.col("d")).alias("u")).collect()
    assert [(x.name, x.confidence) for x in row[0].u.unique] == [("big DEAL", 0.9), ("Small one", 0.1), (None, 0.3)] and [(x.name, x.confidence) for x in row[0].u.duplicates] == [("Big deal", 0.5), ("small ONE", 0.1)]
    assert [len(r.u.unique) for r in row] == [3, 0, 0]


def test_merge_then_unmerge(spark):
    members = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 5)], "cluster_id string, id bigint")
    masters = spark.createDataFrame([("a", 2), ("b", 4)], "cluster_id string, master_id bigint")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    log = spark.createDataFrame([], merges.LOG)
    log = log.unionByName(merges.new_rows(log, merges.merge_rows(members, masters, at, "me", F.col("cluster_id") == "a")))
    assert merges.new_rows(log, merges.merge_rows(members, masters, at, "me")).count() == 0  # a repeated batch is harmless
    before = {r.id: r.merged_into for r in merges.replayed(members, log).collect()}
    assert before == {1: 2, 2: None, 3: 2, 4: None, 5: 4}
    ids = {r.target_id: r.merge_id for r in merges.merges(log).collect()}
    asked = spark.createDataFrame([(ids[2], datetime.datetime(2024, 1, 1, 23), "no"), (ids[4], datetime.datetime(2024, 1, 1, 1), "no"), ("x", datetime.datetime(2024, 1, 1), "no")], "merge_id string, at timestamp_ntz, reason string")
    decided = merges.unmerge(log, asked)
    assert {r.merge_id: r.refused for r in decided.collect()} == {ids[2]: None, ids[4]: "irreversible", "x": "not found or already unmerged"}
    log = log.unionByName(merges.unmerge_rows(decided))
    assert {r.id: r.merged_into for r in merges.replayed(members, log).collect()} == {1: None, 2: None, 3: None, 4: None, 5: 4}
    assert {r.refused for r in merges.unmerge(log, asked.where(F.col("merge_id") == ids[2])).collect()} == {"not found or already unmerged"}
    h = {(r.entity_id, r.was_source, r.was_target, r.source_count, r.unmerged) for r in merges.history(log).collect()}
    assert h == {(1, True, False, 2, True), (2, False, True, 2, True), (3, True, False, 2, True), (4, False, True, 1, False), (5, True, False, 1, False)}
