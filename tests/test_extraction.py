"""Threads against a union-find, sections and boundaries on small texts, containment against all pairs."""

import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

import __spark_entry__ as contract
from dealgraph.operators import extraction, vendor_match

SF = "/root/testdata/sf0.001"


def union(messages):
    parent = {m["id"]: m["id"] for m in messages}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def link(a, b):
        a, b = sorted((root(a), root(b)))
        parent[b] = a

    plain = {m["id"]: re.sub(r"\s+", " ", re.sub(r"^(re|fwd|fw):\s*", "", m["subject"].strip().lower())).strip() for m in messages}
    for m in messages:
        linked = [x for x in [*(m["refs"] or []), m["in_reply_to"]] if x in parent and x != m["id"]]
        for x in linked:
            link(m["id"], x)
        if not linked and plain[m["id"]]:
            same = sorted((o for o in messages if plain[o["id"]] == plain[m["id"]]), key=lambda o: (o["at"], o["id"]))
            k = next(i for i, o in enumerate(same) if o["id"] == m["id"])
            for o in same[max(0, k - 1) : k] + same[k + 1 : k + 2]:
                if abs((o["at"] - m["at"]).total_seconds()) <= 7 * 86400:
                    link(m["id"], o["id"])
    return {m["id"]: root(m["id"]) for m in messages}


def test_threads(spark):
    r = random.Random(5)
    rows = [{"id": k, "in_reply_to": r.choice([None, None, None, r.randrange(200), 999]), "refs": r.choice([None, [], [r.randrange(200), 7]]) if r.random() < 0.3 else [], "subject": f"{r.choice(['Re: ', '', 'fw: '])}S {r.randrange(6)}" if r.random() < 0.8 else "",
             "at": datetime(2024, 1, 1) + timedelta(hours=r.randrange(24 * 400))} for k in range(200)]
    df = spark.createDataFrame(rows, "id bigint, in_reply_to bigint, refs array<bigint>, subject string, at timestamp")
    got = {x.id: x.thread_id for x in extraction.threads(df).collect()}
    assert got == union(rows) and 5 < len(set(got.values())) < 150
    assert extraction.threads(df.limit(0)).collect() == []


def test_threads_of_the_query(spark):
    got = contract.queries()["e18_threads"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/events.parquet").count() and len({x.thread_id for x in got}) < len(got)


def test_merge_of_methods(spark):
    rows = [("a", 0, 100, 0.5, 1, "keyword"), ("a", 40, 200, 0.7, 2, "pattern"), ("a", 95, 300, 0.9, 3, "keyword"), ("a", 400, 500, 0.6, 9, "keyword"), ("b", 3, 9, 0.65, 1, "pattern"), ("b", 5, 30, 0.6, 1, "keyword"), ("b", 29, 40, 0.75, 2, "hybrid")]
    got = extraction.merged_boundaries(spark.createDataFrame(rows, 'text_id string, start int, end int, confidence double, line int, method string')).orderBy("text_id", "start").collect()
    # a surer one takes over with its own method; one that stays beside another method becomes a hybrid and gains 0.1
    assert [(x.text_id, x.start, x.end, round(x.confidence, 6), x.line, x.method) for x in got] == [("a", 95, 300, 0.9, 3, "keyword"), ("a", 400, 500, 0.6, 9, "keyword"), ("b", 3, 40, 0.75, 1, "hybrid")]


def test_containment(spark):
    r = random.Random(3)
    words = ["".join(r.choice("ab") for _ in range(r.randrange(1, 12))) for _ in range(80)] + [""]
    df = spark.createDataFrame([(w,) for w in words], "x string")
    for gram in (1, 4, 6):
        got = {tuple(x) for x in vendor_match.contained_in(df.select(F.col("x").alias("short")), df.select(F.col("x").alias("long")), gram).collect()}
        assert got == {(a, b) for a in words for b in words if a and a in b}
    assert vendor_match.contained_in(df.where("false").select(F.col("x").alias("short")), df.select(F.col("x").alias("long"))).collect() == []
