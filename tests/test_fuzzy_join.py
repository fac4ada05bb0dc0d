"""The fuzzy similarity join finds every pair that comparing all of them finds."""

import random

import pytest
from pyspark.sql import functions as F

from dealgraph.functions import similarity
from dealgraph.functions.similarity import fuzzy_scores
from dealgraph.operators import dedupe, fuzzy_join
from tests.test_literals import brute_fuzzy


def names(seed, n):
    r = random.Random(seed)
    words = ["acme", "global", "holdings", "north", "norte", "systems", "system", "data", "date", "x", "of", "the", "red", "blue"]
    out = {"", "a", "ab", "a b", "x x x", "acme acme"}
    while len(out) < n:
        w = r.choices(words, k=r.randrange(1, 5))
        if r.random() < 0.4:
            k = r.randrange(len(w))
            j = r.randrange(len(w[k]) + 1)
            w[k] = w[k][:j] + r.choice("abxz01_") + w[k][j + r.randrange(2):]
        out.add(" ".join(w))
    return sorted(out)


def test_scores_equal_brute_force():
    some = names(1, 60)
    pairs = [(a, b) for a in some for b in some]
    got = fuzzy_scores([a for a, _ in pairs], [b for _, b in pairs])
    assert [round(x, 6) for x in got] == [round(brute_fuzzy(a, b), 6) for a, b in pairs]
    long = ["word " * 200 + "end", "word " * 190 + "other end", "x"]
    assert fuzzy_scores(long, long[::-1]).tolist() == [0 if {a, b} == {long[0], "x"} else brute_fuzzy(a, b) for a, b in zip(long, long[::-1])]


@pytest.mark.parametrize("least", [60, 70, 80, 85, 95, 100])
def test_no_pair_is_lost(spark, least):
    left, right = names(2, 90), names(3, 110)
    score = fuzzy_scores([a for a in left for _ in right], [b for _ in left for b in right])
    want = {(a, b, s) for (a, b), s in zip(((a, b) for a in left for b in right), score.tolist(), strict=True) if s >= least}
    l, r = (spark.createDataFrame([(x, "clash") for x in [*side, None, side[-1]]], "text string, piece string") for side in (left, right))
    got = [tuple(x) for x in fuzzy_join.similar_pairs(l, r, least).collect()]
    assert len(got) == len(set(got)) and {(a, b, round(s, 6)) for a, b, s in got} == {(a, b, round(s, 6)) for a, b, s in want}
    assert fuzzy_join.similar_pairs(l.limit(0), r, least).collect() == []


def test_candidates_are_few():
    """Most texts that are not alike do not meet."""
    some = [" ".join(random.Random(k).choices(["bramont", "calvik", "delster", "fosdale", "gorford", "kinham", "anatech", "beltware", "corsoft", "dundata"], k=2)) + str(k) for k in range(400)]
    often = {}
    held = {}
    for x in some:
        bare = x.replace(" ", "")
        held[x] = {bare[k : k + 2] for k in range(len(bare) - 1)} | set(bare)
        for p in held[x]:
            often[p] = often.get(p, 0) + 1
    met = sum(bool(held[b] & set(fuzzy_join.pieces(a, 0.945, often))) for a in some for b in some)
    assert met < 0.35 * len(some) ** 2


def test_few_candidates_leave_the_join(spark):
    """The outlines rule out what can't reach the score before it is shuffled and scored, and nothing that does."""
    from pyspark.sql import functions as F

    from dealgraph.functions.similarity import may_reach, outline

    some = sorted({*names(5, 120), *(" ".join(random.Random(k).choices(["bramont", "calvik", "delster", "fosdale", "gorford", "kinham"], k=2)) + str(k) for k in range(120))})
    df = spark.createDataFrame([(x,) for x in some], "text string").select("text", outline(F.col("text")).alias("o"))
    for least in (70, 80, 85, 95):
        kept = {tuple(x) for x in df.alias("x").crossJoin(df.alias("y")).where(may_reach(F.col("x.o"), F.col("y.o"), least)).select("x.text", "y.text").collect()}
        score = fuzzy_scores([a for a in some for _ in some], some * len(some))
        reached = {(a, b) for (a, b), s in zip(((a, b) for a in some for b in some), score.tolist(), strict=True) if s >= least and a and b}
        assert reached <= kept
        assert least < 80 or len(kept) < 0.25 * len(some) ** 2


def test_common_lengths_by_bits_equal_tables():
    from dealgraph.functions.similarity import _common_by_tables, common_lengths

    r = random.Random(7)
    texts = ["".join(r.choices("abcé ", k=r.choice([0, 1, 5, 20, 63, 64, 65, 90]))) for _ in range(120)]
    a, b = texts[:60], texts[60:]
    assert common_lengths(a, b).tolist() == _common_by_tables(a, b).tolist()


def test_shorter_texts_look_up_longer_ones():
    """A text probes only those that are not shorter, with as many pieces as their two lengths ask for."""
    assert fuzzy_join.edits(11, 11, 0.845) == 2 and fuzzy_join.edits(11, 15, 0.845) == 4 and fuzzy_join.edits(11, 40, 0.845) == 2
    assert len(fuzzy_join.pieces("bacad kifol", 0.845, {}, 2)) < len(fuzzy_join.pieces("bacad kifol", 0.845, {}))


def deals(spark, n):
    """Deals of few vendors whose names, values and dates are near those of some others."""
    r = random.Random(11)
    some, rows = names(12, 40), []
    for k in range(n):
        rows.append((k, r.choice(some[:12]) or None, r.choice(some), r.choice(some) or None, r.choice([1, 2, 3, None]), r.choice([None, 0.0, 100.0, 103.0, 109.0, 128.0, 135.0, 5000.0]), f"2024-0{r.randrange(1, 4)}-{r.randrange(10, 28)}"))
    return spark.createDataFrame(rows, "id bigint, _n string, _m string, _k string, vendor_id bigint, deal_value double, created_at string").withColumn("created_at", F.to_date("created_at"))


@pytest.mark.parametrize("asked", [None, "id % 3 = 0"])
def test_vendor_and_factors_need_no_join_of_all_names(spark, monkeypatch, asked):
    """D13 and D14 find the pairs that comparing all finds, and don't join the names of all deals for it."""
    r = deals(spark, 160)
    monkeypatch.setattr(dedupe, "similar_pairs", None)
    x, y = (r.select([F.col(c).alias(f"{c}_{k}") for c in r.columns]) for k in (1, 2))
    order = F.col("id_1") < F.col("id_2") if asked is None else (F.col("id_1") % 3 == 0) & (F.col("id_1") != F.col("id_2"))
    w = similarity.WEIGHTS
    every = x.crossJoin(y).where(order).withColumn("n", dedupe.both(similarity.fuzzy_of_plain, "_n") / 100).withColumn("c", dedupe.both(similarity.fuzzy_of_plain, "_k") / 100)
    same = F.coalesce((F.col("vendor_id_1") == F.col("vendor_id_2")).cast("double"), F.lit(0.0))
    score = F.round(w["name"] * F.col("n") + w["customer"] * F.col("c") + w["vendor"] * same + w["value"] * dedupe.both(similarity.value_similarity, "deal_value") + w["date"] * dedupe.both(similarity.date_similarity, "created_at"), 9)
    rows = every.select("id_1", "id_2", "n", "c", same.alias("same"), score.alias("score")).collect()
    for run, want in ((dedupe.vendor_customer, {(p.id_1, p.id_2, round(min(1, 0.3 + 0.5 * p.c + 0.2 * p.n), 6)) for p in rows if p.same and p.c >= 0.8}), (dedupe.multi_factor, {(p.id_1, p.id_2, round(p.score, 6)) for p in rows if p.score >= 0.7})):
        got = [(p.id_1, p.id_2, round(p.score, 6)) for p in run(r, asked).collect()]
        assert len(want) > 20 and len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("least", [60, 70, 85, 95])
def test_cells_lose_no_pair(least):
    """Bounds by characters, bigrams, words and common subsequences rule out no pair that comparing all finds; short, long and repeating texts."""
    r = random.Random(31)
    word = lambda: "".join(r.choice(x) for x in ("bcdfg", "aeiou", "klmnp", "aeiou", "rstvw"))
    some = [f"{word()} {word()}" for _ in range(12)]
    forms = ["{}", "{} corporation", "the {}", "{} co ltd", "{}s", "{} {} a b c d e f", "{} of the corporation of {} " + "x" * 50]
    spelt = sorted({f.format(x, x[::-1]) for x in some for f in forms} | {x[:k] + x[k + 1 :] for x in some for k in (2, 5)})
    left, right = spelt[::2] + names(32, 40)[1:], spelt[1::2] + names(33, 40)[1:] + [spelt[0]]
    score = fuzzy_scores([a for a in left for _ in right], right * len(left))
    want = {(a, b): s for (a, b), s in zip(((a, b) for a in left for b in right), score.tolist(), strict=True) if s >= least}
    got = [tuple(x) for part in fuzzy_join.compared(left, right, least) for x in part.itertuples(index=False)]
    assert len(want) > 50 and len(got) == len(want) and {(a, b): s for a, b, s in got} == want
    assert not list(fuzzy_join.compared([], right, least)) + list(fuzzy_join.compared(left, [], least))


def test_texts_are_shuffled_bare_and_in_several_cells(spark, monkeypatch):
    """No pieces and no outlines are shuffled: a text goes to one cell for each group of the other side, and to no join."""
    monkeypatch.setattr(fuzzy_join, "LEFT_AT_ONCE", 20)
    monkeypatch.setattr(fuzzy_join, "RIGHT_AT_ONCE", 30)
    left, right = names(41, 50), names(42, 70)
    out = fuzzy_join.similar_pairs(*(spark.createDataFrame([(x,) for x in side], "text string") for side in (left, right)), 80)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    score = fuzzy_scores([a for a in left for _ in right], right * len(left))
    assert sorted((a, b) for a, b, _ in out.collect()) == sorted(p for p, s in zip(((a, b) for a in left for b in right), score.tolist(), strict=True) if s >= 80)


def test_candidates_on_line_are_judged_by_themselves(spark, monkeypatch):
    """D27 gives what D15 finds among the candidates, without a join of all names."""
    r = deals(spark, 140).withColumn("status", F.when(F.col("id") % 7 == 0, "rejected").otherwise("open"))
    named = r.select("id", F.col("_n").alias("deal_name"), F.col("_m").alias("customer_name"), "vendor_id", "deal_value", "created_at", "status")
    pairs = dedupe.online_candidates(named, "id % 3 = 0").select("id_1", "id_2")
    want = {tuple(x) for x in dedupe.detect(named, "id % 3 = 0").join(pairs, ["id_1", "id_2"], "left_semi").select("id_1", "id_2", "strategy", "score", "action").collect()}
    monkeypatch.setattr(dedupe, "similar_pairs", None)
    got = [(x.id_1, x.id_2, x.strategy, x.score, x.action) for x in dedupe.find_similar(named, "id % 3 = 0").collect()]
    assert len(want) > 20 and len(got) == len(set(got)) and set(got) == want
    with pytest.raises(ValueError):
        dedupe.judged(dedupe.prepared(named), pairs, 0.8)
