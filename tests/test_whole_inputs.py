"""Operators and queries on inputs beyond the size of the test tables: nothing is left out."""

import __spark_entry__ as contract
from dealgraph.operators import opportunity


def test_stage_hint_far_into_a_text(spark, tmp_path):
    spark.range(1).selectExpr("id as doc_id", "concat(repeat('x', 10000001), ' rfq') as text").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in contract.queries()["e34_stage_hints"](spark, str(tmp_path)).collect()] == [("quote", 1)]


def test_every_general_insight_applies(spark):
    insights = spark.range(150).selectExpr("id as insight_id", "if(id >= 130, id % 2, null) as vendor_id", "if(id < 5, 0.5, 0.9) as confidence")
    records = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "id bigint, vendor_id bigint")
    got = sorted(tuple(r) for r in opportunity.applicable(insights, records).collect())
    assert got == sorted((r, i) for r, v in ((1, 0), (2, 1), (3, None)) for i in range(5, 150) if i < 130 or i % 2 == v)


def test_trigrams_are_made_once_a_text(spark):
    """What the pairs are compared by is made below the join, for each name once."""
    import __spark_entry__ as contract

    plan = contract.queries()["j06_trigram_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join Inner")
    assert "regexp_replace" in below and "regexp_replace" not in above
