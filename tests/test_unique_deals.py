"""The fold of D23 looks up few of a text's unique deals, and gives what comparing with all gives."""

import random

import pytest

from dealgraph.operators import entities


def naive(deals, confidence, least):
    unique, duplicates = [], []
    for k, d in enumerate(deals):
        at = next((p for p, u in enumerate(unique) if round(entities._similarity(d, deals[u]), 9) >= least), None)
        if at is None:
            unique.append(k)
        elif confidence[k] > confidence[unique[at]]:
            duplicates.append(unique[at])
            unique[at] = k
        else:
            duplicates.append(k)
    return unique, duplicates


@pytest.mark.parametrize("least", [0.5, 0.7, 0.85, 0.95, 1.0])
@pytest.mark.parametrize("negative", [False, True])
def test_fold_equals_comparing_with_all(least, negative):
    r = random.Random(3)
    words = lambda most: frozenset(r.choices("abcdefgh", k=r.randrange(most + 1)))
    for _ in range(20):
        deals = [(words(4), words(2), r.choice([0.0, 10.0, 11.0, 50.0, -5.0 if negative else 12.0]), r.choice(["", "won", "open"])) for _ in range(60)]
        confidence = [r.choice([0.1, 0.5, 0.9, float("nan")]) for _ in deals]
        assert entities.fold(deals, confidence, least) == naive(deals, confidence, least)


def test_fold_compares_few(monkeypatch):
    r, calls, real = random.Random(4), [], entities._similarity
    deals = [(frozenset(r.choices([f"w{k}" for k in range(500)], k=3)), frozenset("c"), 10.0, "won") for _ in range(800)]
    monkeypatch.setattr(entities, "_similarity", lambda a, b: calls.append(1) or real(a, b))
    entities.fold(deals, [0.5] * len(deals), 0.85)
    assert len(calls) < len(deals) ** 2 / 40
