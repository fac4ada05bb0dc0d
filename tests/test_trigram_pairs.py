"""J06 in parts of blocks gives what comparing each pair by itself gives."""

import random

from pyspark.sql import functions as F

from dealgraph.functions import similarity
from dealgraph.operators import joins


def test_parts_of_blocks_give_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(joins, "TOGETHER", 7)
    monkeypatch.setattr(joins, "PAIRS_AT_ONCE", 20)
    r = random.Random(5)
    rows = [(k, "".join(r.choices("ab1 é-", k=r.randint(0, 9))), r.choice(["x", "y", None])) for k in r.sample(range(500), 60)] + [(900, "", "x"), (901, "--", "x"), (902, None, "y"), (3, "ab", "x"), (3, "ab", "x")]
    v = spark.createDataFrame(rows, "id bigint, name string, block string").where("name is not null").withColumn("grams", similarity.trigrams(F.col("name")))
    a, b = (v.select(F.col("id").alias(f"id_{k}"), F.col("grams").alias(f"g{k}"), "block") for k in (1, 2))
    want = a.join(b, "block").where("id_1 < id_2").select("id_1", "id_2", F.round(similarity.similarity_of_trigrams(F.col("g1"), F.col("g2")), 6).alias("sim"))
    got = joins.trigram_pairs(v)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert got.where("sim is null").count() > 0
    # no join makes a row a pair of names
    assert "array_intersect" not in got._jdf.queryExecution().optimizedPlan().toString()
