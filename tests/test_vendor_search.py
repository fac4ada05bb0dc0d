"""The vendor search doesn't pair mentions with all vendors that fit one of their terms or tie."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dealgraph.operators import vendor_match, vendor_search


def most_rows(df) -> int:
    """The most rows that a step of the executed plan gave."""
    df._jdf.collect()
    most, steps = 0, [df._jdf.queryExecution().executedPlan()]
    while steps:
        p = steps.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            steps.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            steps.append(p.plan())
        rows = p.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        children = p.children()
        steps += [children.apply(k) for k in range(children.size())]
    return most


@pytest.fixture(scope="module")
def many(spark):
    names = F.concat(F.lit("name "), F.chr(97 + F.col("id") % 26), F.chr(97 + F.floor(F.col("id") / 26) % 26), F.chr(98 + F.col("id") % 19), F.lit(" works"))
    m = spark.range(400).select(F.col("id").alias("mention_id"), names.alias("name"), F.lit("x@same.com").alias("email"), F.array(F.lit("Widgets")).alias("products"), F.array(F.lit("gear")).alias("keywords"))
    v = spark.range(400).select(F.col("id").alias("vendor_id"), F.concat(F.lit("other "), names).alias("vendor_name"), F.array(F.lit("same.com"), F.concat(F.lit("d"), F.col("id").cast("string"))).alias("domains"), F.array(F.lit("widget"), F.lit("gear")).alias("products"))
    return m, v


def test_factors_meet_profiles(spark, many):
    m, v = many
    m, v = m.withColumn("email", F.lit("x@none.com")), v
    found = vendor_search.by_factors(m, v)
    assert most_rows(found) < 40_000  # 160,000 pairs of mentions and vendors share a product
    assert found.count() == 400


def test_first_vendor_of_a_domain(spark, many):
    m, v = many
    known = vendor_search.cascade(m, v, spark.createDataFrame([], "alias string, vendor_id bigint, confidence double"))
    assert {(r.vendor_id, r.confidence) for r in known.where("strategy = 'email_domain'").collect()} == {(v.orderBy("vendor_name", "vendor_id").first().vendor_id, 0.9)}


def test_suggestions_of_many_ties(spark):
    m = spark.range(300).select(F.col("id").alias("mention_id"), F.lit("abcdefgh").alias("name"))
    v = spark.range(300).select(F.col("id").alias("vendor_id"), F.concat(F.lit("abcde"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("vendor_name"))
    found = vendor_search.suggestions(m, v)
    assert most_rows(found) < 20_000  # 90,000 pairs tie
    assert {(r.rank, r.vendor_id) for r in found.collect()} == {(k + 1, k) for k in range(5)}


def test_repeated_mentions(spark, many):
    """Of rows with one mention_id the best result counts."""
    m, v = many
    m = m.where("mention_id < 40").withColumn("mention_id", F.col("mention_id") % 20)
    for found in (vendor_search.by_similar_name(m, v), vendor_search.by_factors(m, v)):
        assert found.count() == found.select("mention_id").distinct().count() == 20
    assert max(r.n for r in vendor_search.suggestions(m, v).groupBy("mention_id").agg(F.count("*").alias("n")).collect()) <= 5


def test_factors_equal_brute_force(spark):
    """Domains, products and names that pull apart, names of one character, and blanks."""
    names = ["ab cd", "abcd", "a", "xy zt inc", "", None, "abab ab", "qq"]
    m = [(k, names[k % 8], [None, "u@p.com", "u@q.com"][k % 3], [["tool"], [], ["tool", "gear"], ["zzz"]][k % 4], [["gear"], []][k % 2]) for k in range(96)]
    v = [(k, (names[(k * 3) % 7] or "b") + " ltd" * (k % 2), [["p.com"], ["q.com", "p.com"], []][k % 3], [["tools"], ["gear", "tool"], ["other"], [None]][k % 4]) for k in range(40)]
    ms = spark.createDataFrame(m, "mention_id bigint, name string, email string, products array<string>, keywords array<string>")
    vs = spark.createDataFrame(v, "vendor_id bigint, vendor_name string, domains array<string>, products array<string>")
    got = {r.mention_id: (r.vendor_id, round(r.confidence, 6)) for r in vendor_search.by_factors(ms, vs).collect()}

    from dealgraph.functions.similarity import _dice

    def key(x):
        return " ".join((x or "").replace(" ltd", "").replace(" inc", "").split())

    def share(terms, words):
        return sum(any(t in w or w in t for w in words if w) for t in terms) / len(terms) if terms else 0.0

    want = {}
    for i, name, email, products, keywords in m:
        best = None
        for j, vendor, domains, words in v:
            x, y = key(name), key(vendor)
            s = round(0.4 * (_dice(x, y) if x and y else 0) + 0.25 * (bool(email) and email.split("@")[1] in domains) + 0.2 * share(products, words) + 0.1 * share(keywords, words), 9)
            if s >= 0.3 and (best is None or (-s, vendor, j) < best):
                best = (-s, vendor, j)
        if best:
            want[i] = (best[2], round(min(0.95, -best[0]), 6))
    assert got == want


def test_names_with_one_beginning(spark):
    """Names that begin alike meet a text only where it holds them, and more beginnings than tasks should hold give the same."""
    texts = spark.range(300).select(F.col("id").alias("text_id"), F.concat(F.lit("😀 see SUPPLIER00000"), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit(" or b and \u00e9t\u00e9.")).alias("text"))
    names = spark.range(250).select(F.concat(F.lit("supplier00000"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("name")).unionByName(spark.createDataFrame([("b",), ("\u00c9T\u00c9",), ("zz",), ("supplier00000",)], "name string"))
    found = vendor_match.found_in_texts(texts, names)
    assert most_rows(found) < 20_000  # 300 places and 250 names have one beginning
    rows = sorted(tuple(r) for r in found.collect())
    assert rows == sorted(tuple(r) for r in vendor_match.found_in_texts(texts, names, most=2).collect())
    assert rows == sorted([(k, n) for k in range(300) for n in ("b", "\u00c9T\u00c9", "supplier00000")] + [(k, f"supplier00000{k:04d}") for k in range(250)])
