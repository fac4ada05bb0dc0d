"""Patterns that are looked for in one pass find what each pattern alone finds, in texts of any kind and length."""

import random
import re
import time

import pytest

from dealgraph.functions import matches
from dealgraph.operators import entities

RULES = [*entities.ENTITY_RULES, *entities.RELATION_RULES, *entities.COMPANY_RULES, *entities.ROLE_RULES, *entities.AMOUNT_RULES]
WORDS = ["Jane", "Doe", "works for", "work  for", "at", "with", "for", "Acme", "Widgets", "Inc", "inc.", "Inc.x", "Corp", "Corporation", "LLC", "Company", "company", "Co", "Co.", "is", "is our", "are the", "currently", "using", "uses", "has",
         "CEO", "ceo of", "Director", "managers", "VP", "Vice President", "Head of", ",", ".", ";", "\n", "  ", "customer", "client", "end-user", "end user", "end customer", ":", "name", "our", "the", "will", "Group", "Systems", "my name is",
         "i'm", "talk to", "Jan 5, 2025", "march 3 2020", "Q3 2024", "12/31/2024", "1/2/33", "end of month", "next week", "$", "$1,250.00", "$ 40", "k", "million", "dollars", "1234567", "one", "hundred", "and", "555-123-4567", "+1-5551234567",
         "a@b.co", "x.y@acme.com|x", "@", "_", "é", "İ", "ſ", "K", "9", "x", "deal value", "tcv", "budget", "&", "-", "'", "vendor", "partner", "\t", "\v"]


def spans(found):
    return [m.span() for m in found]


@pytest.mark.parametrize("rule", RULES, ids=[f"{k}" for k in range(len(RULES))])
def test_a_rule_finds_what_its_pattern_finds(rule):
    r, p, hits = random.Random(7), re.compile(rule.pattern.replace(r"\z", r"\Z"), re.A), 0
    for _ in range(6000):
        text = "".join(w + r.choice([" ", " ", " ", "", "\n", "  "]) for w in r.choices(WORDS, k=r.randint(1, 40)))
        alone = spans(p.finditer(text))
        assert spans(rule.find(p, text, matches.lowered(text))) == alone, text
        hits += len(alone)
    assert hits > 10


@pytest.mark.parametrize("text", ["Word " * 40_000, "word " * 40_000, "Jane Doe at " * 15_000, "Acme Inc using " * 10_000, "inc uses x " + "word " * 40_000, "Acme inc " * 20_000], ids=range(6))
def test_long_runs_of_words_take_no_time_of_their_square(text):
    started = time.process_time()
    for rule in RULES:
        list(rule.find(re.compile(rule.pattern.replace(r"\z", r"\Z"), re.A), text, matches.lowered(text)))
    assert time.process_time() - started < 10


def test_a_text_of_one_long_run_of_names_passes_and_texts_are_read_once(spark, tmp_path):
    spark.createDataFrame([(1, "Word " * 20_000 + "Acme Inc"), (2, None), (3, "Jane Doe works for Acme Inc. Speaking with Jane Doe")], "text_id long, text string").write.parquet(str(tmp_path / "t"))
    texts = spark.read.parquet(str(tmp_path / "t"))
    got = entities.entities(texts)
    assert sorted((r.text_id, r.type, r.start, r.end) for r in got.collect()) == [(1, "ORGANIZATION", 0, 100_008), (3, "ORGANIZATION", 19, 27), (3, "PERSON", 43, 51)]
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert [tuple(r) for r in entities.relations(texts).collect()] == [(3, "works_for", "Jane Doe", "Acme Inc", 0.9, 0)]
