"""Rows of one key whose names are alike, found in cells, and the scores of many pairs at once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealgraph.functions import similarity
from dealgraph.functions.similarity import fuzzy_scores
from dealgraph.operators import dedupe, fuzzy_join
from tests.test_fuzzy_join import deals, names


def spelt(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(x) for x in ("bcdfg", "aeiou", "klmnp", "aeiou", "rstvw"))
    forms = ["{}", "{} corporation", "the {}", "{} co ltd", "{}s", "{} inc", "{} and sons", "{} of {}", "a {}"]
    return [r.choice(forms).format(f"{word()} {word()}", word()) for _ in range(n)]


@pytest.mark.parametrize("least", [55, 70, 85])
def test_scores_of_many_pairs_equal_those_of_one(least):
    left, right = names(51, 90)[1:] + spelt(52, 60) + ["ab cd", "abcd", "a"], names(53, 90)[1:] + spelt(54, 60) + ["abc d", "b a", "x" * 64, "x" * 65]
    x, y = fuzzy_join._Marks(left), fuzzy_join._Marks(right)
    a, b = (k.ravel() for k in np.meshgrid(np.arange(len(left)), np.arange(len(right)), indexing="ij"))
    got = fuzzy_join._scores(x, y, a, b, np.full(len(a), float(least)))
    want = fuzzy_scores([x.texts[k] for k in a], [y.texts[k] for k in b])
    assert (want >= least).sum() > 200
    assert got[want >= least].tolist() == want[want >= least].tolist() and (got[want < least] < least).all()


def test_rows_of_a_key_meet_in_several_cells(spark, monkeypatch):
    monkeypatch.setattr(fuzzy_join, "LEFT_AT_ONCE", 7)
    monkeypatch.setattr(fuzzy_join, "RIGHT_AT_ONCE", 11)
    r = random.Random(61)
    some = names(62, 30) + spelt(63, 20)
    left = [(r.choice(["p", "q", "only left", None]), k, r.choice([*some, None]), r.choice([60.0, 71.5, 85.0]), float(k % 3)) for k in range(120)]
    right = [(r.choice(["p", "q", "only right", None]), k, r.choice([*some, None])) for k in range(130)]
    pairs = [(x, y) for x in left for y in right if x[0] and x[0] == y[0] and x[2] and y[2]]
    score = fuzzy_scores([x[2] for x, _ in pairs], [y[2] for _, y in pairs]).tolist()
    want = sorted((x[1], y[1], x[4], s) for (x, y), s in zip(pairs, score, strict=True) if s >= x[3])
    got = fuzzy_join.similar_rows(spark.createDataFrame(left, "key string, id bigint, text string, least double, given double"), spark.createDataFrame(right, "key string, id bigint, text string"))
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("asked", [None, "id % 3 = 0"])
def test_deals_of_alike_names_are_found(spark, asked):
    """D10 finds what comparing all finds."""
    r = deals(spark, 150)
    x, y = (r.select([F.col(c).alias(f"{c}_{k}") for c in ("id", "_n", "_m")]) for k in (1, 2))
    order = F.col("id_1") < F.col("id_2") if asked is None else (F.col("id_1") % 3 == 0) & (F.col("id_1") != F.col("id_2"))
    every = x.crossJoin(y).where(order).withColumn("n", dedupe.both(similarity.fuzzy_of_plain, "_n")).withColumn("m", dedupe.both(similarity.fuzzy_of_plain, "_m")).collect()
    want = {(p.id_1, p.id_2, round((p.n + p.m) / 200, 9)) for p in every if p.n >= 70 and p.m >= 70 and round(p.n + p.m, 7) >= 170}
    found = dedupe.fuzzy_name(r, asked)
    got = [(p.id_1, p.id_2, round(p.score, 9)) for p in found.collect()]
    assert len(want) > 20 and len(got) == len(set(got)) and set(got) == want
