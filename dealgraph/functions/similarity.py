"""Similarities as column expressions (D03-D08, J06, V05-V07) and the edit-based family as a pandas UDF."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from dealgraph.functions.normalize import company_key, plain
from dealgraph.functions.workers import ship

#: Weights of name, customer, vendor, value, date, products and contacts.
WEIGHTS = {"name": 0.25, "customer": 0.25, "vendor": 0.15, "value": 0.15, "date": 0.10, "products": 0.05, "contacts": 0.05}


def grams(text: Column, n: int) -> Column:
    """The n-grams of a text, in order, with repeats."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Twice the common bigrams (with repeats) over all bigrams, blanks left out; 1 for equal texts."""
    x, y = F.regexp_replace(a, r"\s+", ""), F.regexp_replace(b, r"\s+", "")
    gx, gy = grams(x, 2), grams(y, 2)
    common = F.aggregate(F.array_distinct(gx), F.lit(0), lambda acc, g: acc + F.least(F.size(F.filter(gx, lambda e: e == g)), F.size(F.filter(gy, lambda e: e == g))))
    return F.when(x == y, 1.0).when((F.length(x) < 2) | (F.length(y) < 2), 0.0).otherwise(2.0 * common / (F.size(gx) + F.size(gy)))


def gram_keys(text: Column) -> Column:
    """The bigrams of a text without blanks (of one character: that), each with the number of its occurrence, so that common ones are counted as dice does, by an equi join or array_intersect."""
    bare = F.regexp_replace(text, r"\s+", "")
    g = F.when(F.length(bare) == 1, F.array(bare)).otherwise(grams(bare, 2))
    return F.transform(g, lambda e, i: F.concat(e, F.lit("|"), F.size(F.filter(F.slice(g, F.lit(1), i + 1), lambda o: o == e)).cast("string")))


def trigrams(t: Column) -> Column:
    """The distinct trigrams of a text's words, padded by two blanks before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(t), r"[^a-z0-9]+", " "), " "), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: grams(F.concat(F.lit("  "), w, F.lit(" ")), 3))))


def similarity_of_trigrams(x: Column, y: Column) -> Column:
    """J06 of two texts' trigrams, which are made once a text, not once a pair."""
    common = F.size(F.array_intersect(x, y)).cast("double")
    return F.try_divide(common, F.size(x) + F.size(y) - common)


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words' trigrams."""
    return similarity_of_trigrams(trigrams(a), trigrams(b))


def jaccard(a: Column, b: Column) -> Column:
    """Common over all elements; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def _falling(x: Column, tolerance: float) -> Column:
    """1 at 0, 0.7 at the tolerance, 0 from three (values) or four (dates) times it."""
    return 1 - x / tolerance * 0.3


def value_similarity(a: Column, b: Column) -> Column:
    """By the difference in percent of the mean, 0.7 at 10 percent, 0 from 30 percent."""
    pct = F.abs(a - b) / ((a + b) / 2) * 100
    missing = F.coalesce(a, F.lit(0)) == 0, F.coalesce(b, F.lit(0)) == 0
    return F.when(missing[0] | missing[1], 0.0).when(a == b, 1.0).when(pct <= 10, _falling(pct, 10)).when(pct <= 30, 0.7 * (1 - (pct - 10) / 20)).otherwise(0.0)


def date_similarity(a: Column, b: Column) -> Column:
    """By the days between, 0.7 at 7, 0 from 28."""
    days = F.abs(F.datediff(a, b))
    return F.when(a.isNull() | b.isNull(), 0.0).when(days <= 7, _falling(days, 7)).when(days <= 28, 0.7 * (1 - (days - 7) / 21)).otherwise(0.0)


def weighted(**parts: Column) -> Column:
    """The weighted mean of all seven factors; a missing one counts as 0 and so lowers it."""
    total = F.lit(0.0)
    for name, value in parts.items():
        total = total + WEIGHTS[name] * F.coalesce(value, F.lit(0.0))
    return total / sum(WEIGHTS.values())


# ---------------------------------------------------------------- the edit-based family, on Arrow batches

_CELLS = 20_000_000  # characters compared at once


def _codes(texts: list[str], pad: int) -> np.ndarray:
    width = max(map(len, texts), default=0)
    raw = np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le"), np.uint32).reshape(len(texts), width).astype(np.int64)
    return np.where(np.arange(width) < np.array([len(t) for t in texts])[:, None], raw, pad)


def common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of the pairs: with the bits of one number where the shorter text has at most 64 characters, else by their whole tables."""
    out = np.zeros(len(a), np.int64)
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    small = np.array([k for k, (x, _) in enumerate(pairs) if len(x) <= 64], np.int64)
    small = small[np.argsort(np.array([len(pairs[k][1]) for k in small]), kind="stable")] if len(small) else small
    for k in range(0, len(small), 50_000):
        rows = small[k : k + 50_000]
        out[rows] = _common_by_bits([pairs[j] for j in rows.tolist()])
    large = [k for k, (x, _) in enumerate(pairs) if len(x) > 64]
    if large:
        out[large] = _common_by_tables([pairs[k][0] for k in large], [pairs[k][1] for k in large])
    return out


def _common_by_bits(pairs: list[tuple[str, str]]) -> np.ndarray:
    kinds = {x: k for k, x in enumerate(dict.fromkeys(x for x, _ in pairs))}
    codes = _codes(list(kinds), -1)
    letters = np.unique(codes[codes >= 0])
    places = np.zeros((len(kinds), len(letters) + 1), np.uint64)  # where a text has a letter; the last column: none
    rows, columns = np.nonzero(codes >= 0)
    np.bitwise_or.at(places, (rows, np.searchsorted(letters, codes[rows, columns])), np.uint64(1) << columns.astype(np.uint64))
    others = _codes([y for _, y in pairs], -1)
    at = np.searchsorted(letters, others)
    at[(at == len(letters)) | (np.append(letters, -3)[at] != others)] = len(letters)
    mine = np.array([kinds[x] for x, _ in pairs])
    state = np.full(len(pairs), ~np.uint64(0))
    for column in at.T:
        met = state & places[mine, column]
        state = (state + met) | (state - met)
    lengths = np.array([len(x) for x in kinds])[mine]
    return np.bitwise_count(~state & np.where(lengths == 0, np.uint64(0), ~np.uint64(0) >> (64 - np.maximum(lengths, 1)).astype(np.uint64))).astype(np.int64)


def _common_by_tables(a: list[str], b: list[str]) -> np.ndarray:
    """Row by row of all the pairs' tables at once; pairs of like lengths go together."""
    out = np.zeros(len(a), np.int64)
    order = sorted(range(len(a)), key=lambda k: (len(a[k]), len(b[k])))
    at = 0
    while at < len(order):
        n, end = 0, at
        while end < len(order) and (end == at or ((n := len(a[order[end]]) * max(len(b[order[at]]), len(b[order[end]]))) * (end - at + 1) <= _CELLS and len(a[order[end]]) <= 2 * len(a[order[at]]) + 8)):
            end += 1
        rows = order[at:end]
        x, y = _codes([a[k] for k in rows], -1), _codes([b[k] for k in rows], -2)
        last = np.zeros((len(rows), y.shape[1] + 1), np.int32)
        for column in x.T:
            step = np.maximum(last[:, 1:], last[:, :-1] + (column[:, None] == y))
            last[:, 1:] = np.maximum.accumulate(step, axis=1)
        out[rows] = last[:, -1]
        at = end
    return out


def _ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Whole percents of matched characters: twice the longest common subsequence over both lengths, halves up."""
    if not pairs:
        return np.zeros(0)
    total = np.array([len(x) + len(y) for x, y in pairs])
    common = common_lengths([x for x, _ in pairs], [y for _, y in pairs])
    both = np.array([bool(x and y) for x, y in pairs])
    return np.where(both, np.floor(200.0 * common / np.maximum(total, 1) + 0.5), 0.0)


def _dice(a: str, b: str) -> float:
    x, y = "".join(a.split()), "".join(b.split())
    if x == y:
        return 1.0
    if len(x) < 2 or len(y) < 2:
        return 0.0
    gx, gy = Counter(x[k : k + 2] for k in range(len(x) - 1)), Counter(y[k : k + 2] for k in range(len(y) - 1))
    return 2.0 * sum((gx & gy).values()) / (len(x) + len(y) - 2)


def _arranged(a: str, b: str) -> list[tuple[str, str]]:
    """The pairs of the whole, token-sort and token-set ratios."""
    ta, tb = a.split(), b.split()
    sa, sb = set(ta), set(tb)
    base = " ".join(sorted(sa & sb))
    one, two = (" ".join(x for x in (base, " ".join(sorted(rest))) if x) for rest in (sa - sb, sb - sa))
    return [(a, b), (" ".join(sorted(ta)), " ".join(sorted(tb))), (one, two)] + ([(base, one), (base, two)] if base else [])


def _overlaps(a: list[str], b: list[str]) -> np.ndarray:
    """How many characters (with repeats) the pairs have in common."""
    kinds = {t: k for k, t in enumerate(dict.fromkeys([*a, *b]))}
    codes = _codes(list(kinds), -1)
    counts = np.stack([(codes == c).sum(1) for c in np.unique(codes[codes >= 0])] or [np.zeros(len(kinds), np.int64)], axis=1).astype(np.int16)
    out = np.zeros(len(a), np.int64)
    for k in range(0, len(a), 50_000):
        out[k : k + 50_000] = np.minimum(counts[[kinds[t] for t in a[k : k + 50_000]]], counts[[kinds[t] for t in b[k : k + 50_000]]]).sum(1)
    return out


def fuzzy_scores(a: list[str | None], b: list[str | None], least: float = 0.0) -> np.ndarray:
    """D03 of pairs of plain texts, in percent; 0 where one is empty. The partial ratio is the best one of the shorter text with a window of its length in the
    longer. Scores below `least` may be given as 0: pairs whose characters in common can't make it are not looked at any further."""
    best = np.zeros(len(a))
    rows = np.array([k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x and y], np.int64)
    if not len(rows):
        return best
    common = _overlaps([a[k] for k in rows], [b[k] for k in rows])
    # a token-set ratio counts a word once
    lengths = {t: len(" ".join(dict.fromkeys(t.split(" ")))) for k in rows for t in (a[k], b[k])}
    shorter = np.array([min(lengths[a[k]], lengths[b[k]]) for k in rows])
    bare = np.array([min(len(a[k]) - a[k].count(" "), len(b[k]) - b[k].count(" ")) for k in rows])
    # the most that a whole, sorted or partial ratio (common of the shorter text) or dice (common of its bigrams) can be
    hope = 100.0 * np.maximum(common / shorter, common / np.maximum(1, bare - 1)) + 0.5
    # words in common against one of the texts: c of its characters give 2 c / (c + all)
    loose = np.flatnonzero((hope < least) & (200.0 * common / (common + shorter) + 0.5 >= least))
    words = {t: set(t.split()) for k in rows[loose] for t in (a[k], b[k])}
    for j in loose.tolist():
        one, two = words[a[rows[j]]], words[b[rows[j]]]
        base = one & two
        if base:
            c, n = (sum(map(len, w)) + len(w) - 1 for w in (base, min(one, two, key=lambda w: sum(map(len, w)) + len(w))))
            hope[j] = 200.0 * c / (c + n) + 0.5
    rows = rows[hope >= least]
    pairs, owner = [], []
    for k in rows.tolist():
        x, y = a[k], b[k]
        if x == y:
            best[k] = 100.0
        else:
            best[k] = 100.0 * _dice(x, y)
            found = _arranged(x, y)
            pairs += found
            owner += [k] * len(found)
    np.maximum.at(best, owner, _ratios(pairs))
    pairs, owner = [], []
    for k in rows[best[rows] < 100].tolist():
        x, y = sorted((a[k], b[k]), key=len)
        # no window matches more than the characters that both have
        if 100.0 * sum((Counter(x) & Counter(y)).values()) / len(x) + 0.5 >= max(best[k], least):
            found = [(x, y[i : i + len(x)]) for i in range(len(y) - len(x) + 1)]
            pairs += found
            owner += [k] * len(found)
    np.maximum.at(best, owner, _ratios(pairs))
    return best


# ---------------------------------------------------------------- outlines: bounds that the JVM checks inside a join

_FIRST = {c: k for k, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789_ ")}
#: Fields of an outline: characters (their first and second occurrences as bits), bigrams without blanks (hashed to bits), lengths of the text and of its words without
#: repeats, number of bigrams, words.
OUTLINE = "struct<chars:bigint,grams:bigint,n:int,d:int,g:int,words:array<string>>"


def outline_of(text: str) -> tuple[int, int, int, int, int, list[str]]:
    chars, grams_, seen = 0, 0, set()
    for c in text:
        k = _FIRST.get(c)
        if k is not None:
            if c not in seen:
                seen.add(c)
                chars |= 1 << k
            elif k < 25:
                chars |= 1 << (38 + k)
    bare = text.replace(" ", "")
    for k in range(len(bare) - 1):
        grams_ |= 1 << ((_FIRST.get(bare[k], 40) * 41 + _FIRST.get(bare[k + 1], 40)) % 63)
    words = list(dict.fromkeys(text.split(" ")))
    return chars, grams_, len(text), len(" ".join(words)), max(0, len(bare) - 1), words


def outline(text: Column) -> Column:
    """The outline of a plain text, for may_reach."""
    def of(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([outline_of(t or "") for t in x], columns=["chars", "grams", "n", "d", "g", "words"])

    ship()
    return F.pandas_udf(of, OUTLINE).asNondeterministic()(text)


def may_reach(a: Column, b: Column, least: float | Column) -> Column:
    """False only if D03 of two texts with these outlines is below `least` (percent, above 50). What one text has and the other has not bounds what both have; so few of the pairs that meet in a
    join leave it. Every step is compiled, no lambda among them."""
    t, eps = (least - 0.5) / 100, 1e-9

    def both_have(bits: str, size: str) -> Column:
        x, y = a[bits], b[bits]
        return F.least(a[size] - F.bit_count(x.bitwiseAND(F.bitwise_not(y))), b[size] - F.bit_count(y.bitwiseAND(F.bitwise_not(x))))

    common, shorter = both_have("chars", "n"), F.least(a["d"], b["d"])
    words = F.length(F.array_join(F.array_intersect(a["words"], b["words"]), " "))
    in_common_words = (common >= t / (2 - t) * shorter - eps) & (words >= t / (2 - t) * shorter - eps)
    return (common >= t * shorter - eps) | (both_have("grams", "g") >= t / 2 * (a["g"] + b["g"]) - eps) | in_common_words


def _ratio_series(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_ratios([(x or "", y or "") for x, y in zip(a, b, strict=True)]))


def fuzzy_of_plain(a: Column, b: Column, least: float = 0.0) -> Column:
    """D03 of two plain texts; with `least`, what doesn't reach it may be 0. It is dear, so it is marked as one that must stay where it is written: a filter on it
    would be moved below joins and distinct(), and evaluated there for all rows, and once more above."""
    def scores(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = list(zip(x, y, strict=True))
        kinds = list(dict.fromkeys(pairs))  # a batch's equal pairs are scored once
        score = dict(zip(kinds, fuzzy_scores([a for a, _ in kinds], [b for _, b in kinds], least).tolist(), strict=True))
        return pd.Series([score[p] for p in pairs], dtype="float64")

    ship()
    return F.pandas_udf(scores, "double").asNondeterministic()(a, b)


def ratio(a: Column, b: Column) -> Column:
    """The whole ratio of two texts as they are, in whole percents; 0 where one is empty."""
    ship()
    return F.pandas_udf(_ratio_series, "double").asNondeterministic()(a, b)


def dice_of_plain(a: Column, b: Column) -> Column:
    """dice in Arrow batches, for pairs of names: the compiled form compares all bigrams with all and costs some 40 times as much a pair."""
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_dice(p or "", q or "") for p, q in zip(x, y, strict=True)], dtype="float64")

    ship()
    return F.pandas_udf(of, "double").asNondeterministic()(a, b)


def fuzzy(a: Column, b: Column) -> Column:
    """The best of whole, partial, token-sort and token-set ratios (whole percents) and dice, of plain texts. Meant for candidates
    that fuzzy_join has left."""
    return fuzzy_of_plain(plain(a), plain(b))


def weighted_score(one: str, two: str) -> Column:
    """D08 of the columns deal_name, customer_name, vendor_id, deal_value, created_at, products and emails with the suffixes `one` and `two`."""
    def of(f, name: str) -> Column:
        return f(F.col(name + one), F.col(name + two))

    return weighted(name=of(fuzzy, "deal_name") / 100, customer=of(lambda a, b: fuzzy_of_plain(company_key(a), company_key(b)), "customer_name") / 100, vendor=of(lambda a, b: (a == b).cast("double"), "vendor_id"),
                    value=of(value_similarity, "deal_value"), date=of(date_similarity, "created_at"), products=of(lambda a, b: jaccard(F.transform(a, plain), F.transform(b, plain)), "products"),
                    contacts=of(lambda a, b: jaccard(F.transform(a, F.lower), F.transform(b, F.lower)), "emails"))
