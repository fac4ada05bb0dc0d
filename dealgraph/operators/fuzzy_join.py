"""Threshold joins on the fuzzy similarity of D03, without an equality block and without losing a pair.

Both sides' distinct texts are dealt into groups, and each pair of groups (a cell) is compared in one task with numpy: for each text of the left, bounds over all texts of the
right at once, on bits of characters and bigrams, leave few candidates, which are scored exactly, many at once. Rows that share a key are compared the same way, key by key (similar_rows). What is shuffled is the bare texts, once for each group of the other side
(32,768 and 65,536 texts a group), not an index of their pieces. Compared pairs of texts still grow as the product of both sides, at about a nanosecond each.

The bounds. A whole, sorted or partial ratio of at least t needs t of the shorter text's characters in the longer one, and leaves few bigrams inside the shorter one's words without a like one in the
longer (see broken). Dice needs t of both texts' bigrams in common. A token-set ratio by the words in common needs t / (2 - t) of the shorter text in such words.

Pieces, for other searches (operators.vendor_search). Of two plain texts with a score of at least t, one holds, unbroken, at least one of few pieces of the other.
Each edit of the alignment behind a whole, partial or token ratio (a character of one text that is not
matched, or one of the other in between) breaks at most one of any disjoint pieces of a text, a piece being one, two
or three neighbouring characters of a word (words may move, pieces do not cross them). The ratios allow at most
2 (1 - t) / t edits per character of the text in question (the shorter one for partial and token-set ratios, either
for the others; both are tried), so one more piece than that is enough, and the globally rarest pieces are taken. For
dice, t / (2 - t) of a text's bigrams must be common, so the rarest of them, one more than may miss, must
hold a common one. Plain texts consist of letters, digits and signs of words (37 characters), so the
table of frequencies has at most 52,059 rows whatever the input, and is handed to the tasks."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealgraph.functions.similarity import _FIRST as FIRST
from dealgraph.functions.similarity import fuzzy_scores, grams
from dealgraph.functions.workers import cut, ship


def pieces_of(text) -> F.Column:
    """The distinct pieces of one to three characters of a text without blanks."""
    bare = F.regexp_replace(text, " ", "")
    return F.array_distinct(F.concat(grams(bare, 3), grams(bare, 2), F.split(bare, "")))


def frequencies(texts: DataFrame) -> dict[str, int]:
    """In how many texts each piece is; at most 37 + 37**2 + 37**3 rows of plain texts."""
    return {r["p"]: r["n"] for r in texts.select(F.explode(pieces_of(F.col("text"))).alias("p")).groupBy("p").agg(F.count("*").alias("n")).toLocalIterator()}


def _disjoint(places: list[tuple[int, str]], need: int, threes: int, rare) -> list[str] | None:
    """`need` disjoint pieces, the rarest `threes` trigrams first, then bigrams, then characters; None if there are not so many."""
    used, out = set(), []
    for size, most in ((3, threes), (2, need), (1, need)):
        for k, p in sorted(((k, p[:size]) for k, p in places if len(p) >= size), key=lambda x: rare(x[1])):
            if len(out) >= most:
                break
            if not any(j in used for j in range(k, k + size)):
                used |= set(range(k, k + size))
                out.append(p)
    return out if len(out) >= need else None


def edits(n: int, m: int, t: float) -> int:
    """How many edits a text of n characters and one of m, not shorter, may be apart with a score of at least t by a ratio; neither repeats a word."""
    def least(x: float) -> int:
        return math.ceil(x - 1e-9)

    whole = n + m - 2 * least(t * (n + m) / 2) if least(t * (n + m) / 2) <= n else 0
    return max(whole, 2 * (n - least(t * n)), n - least(t / (2 - t) * n))


def pieces(text: str, t: float, often: dict[str, int], apart: int | None = None) -> list[str]:
    """The pieces of which a text with a score of at least t (0 to 1, above 0.5) must hold one; see above. apart: the most edits, if they are known to be fewer."""
    def rare(p: str) -> tuple[int, str]:
        return often.get(p, 0), p

    need = (math.floor(2 * (1 - t) / t * len(text)) if apart is None else apart) + 1
    places, at, seen = [], 0, set()
    for word in text.split(" "):
        if word not in seen:  # a token-set ratio counts a word once
            seen.add(word)
            places += [(at + k, word[k : k + 3]) for k in range(len(word))]
        at += len(word) + 1
    # as many trigrams as leave room for the others; a text so short that all of its characters are needed gives these
    out = next((x for threes in range(min(need, len(places) // 3), -1, -1) if (x := _disjoint(places, need, threes, rare)) is not None), [p[0] for _, p in places])
    bare = text.replace(" ", "")
    all_grams = sorted((bare[k : k + 2] for k in range(len(bare) - 1)), key=rare)
    common = math.ceil(t / (2 - t) * len(all_grams) - 1e-9)
    return sorted({*out, *all_grams[: len(all_grams) - common + 1]})


#: Texts of the left and of the right that one task compares at most; each side is sent once for every group of the other's, as bare texts.
LEFT_AT_ONCE, RIGHT_AT_ONCE = 32_768, 65_536
#: Pairs that are scored at once, pairs whose windows are compared at once, and pairs of rows that are handed on at once.
SCORED_AT_ONCE, WINDOWED_AT_ONCE, ROWS_AT_ONCE = 50_000, 10_000, 200_000
#: Longest common subsequences are counted with the bits of one number, for texts of at most so many characters and words; longer ones are not ruled out by them.
CHARACTERS, WORDS = 64, 6
#: A word of so many texts is one of a form ("corporation"), which alone makes texts alike only where they hold little else.
COMMON_WORD = 500


class _Marks:
    """Texts of one side, the shortest first, as arrays: bits of characters (first and second occurrences), of bigrams of the bare text, and of bigrams inside words; lengths, and words."""

    def __init__(self, texts: list[str]):
        words = [list(dict.fromkeys(x.split(" "))) for x in texts]
        d = np.array([sum(map(len, w)) + len(w) - 1 for w in words], np.int64)
        order = np.argsort(d, kind="stable")
        #: where a text was among those given
        self.order = order
        self.texts, self.words, self.d = [texts[k] for k in order], [words[k] for k in order], d[order]
        self.n = np.array([len(x) for x in self.texts], np.int64)
        count = len(texts)
        points = np.frombuffer("".join(self.texts).encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(count), self.n)
        table = np.full(128, 40, np.int64)
        for c, k in FIRST.items():
            table[ord(c)] = k
        codes = np.where(points < 128, table[np.minimum(points, 127)], 40)
        blank = FIRST[" "]
        #: a repeated word, or a character that plain texts lack: only the bounds that hold for all texts are used
        self.odd = (self.n != self.d) | (np.bincount(owner, codes == 40, count) > 0)
        # characters: first occurrences as bits 0 to 37, second ones of the first 25 as bits 38 to 62
        key = owner * 41 + codes
        key = np.sort(key)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        times = np.diff(np.append(first, len(key)))
        kinds = key[first]
        o, c = kinds // 41, kinds % 41
        one = np.where(c < 40, np.uint64(1) << np.minimum(c, 62).astype(np.uint64), np.uint64(0))
        two = np.where((c < 25) & (times > 1), np.uint64(1) << np.minimum(c + 38, 62).astype(np.uint64), np.uint64(0))
        self.chars = _bits(o, one | two, count)
        # bigrams of the bare text, and of words
        solid = codes != blank
        o, c = owner[solid], codes[solid]
        same = o[1:] == o[:-1]
        grams, o = (c[:-1] * 41 + c[1:])[same], o[1:][same]
        self.grams, self.g = _bits(o, np.uint64(1) << (grams % 63).astype(np.uint64), count), np.bincount(o, minlength=count)
        inside = solid[1:] & solid[:-1] & (owner[1:] == owner[:-1])
        grams, o = (codes[:-1] * 41 + codes[1:])[inside] % 127, owner[1:][inside]
        bit = np.uint64(1) << (grams % 64).astype(np.uint64)
        self.low, self.high = (_bits(o, np.where((grams < 64) == low, bit, np.uint64(0)), count) for low in (True, False))
        self.short = np.flatnonzero(~self.odd & (self.n <= CHARACTERS) & (np.array([len(w) for w in self.words], np.int64) <= WORDS))
        self.at = np.full(count, -1)
        self.at[self.short] = np.arange(len(self.short))
        chosen = [sorted(self.words[k]) for k in self.short.tolist()]
        #: the short texts as they are, and with their words sorted: where each letter is, and the letters in a row; 40 is none
        self.whole, self.sorted = _Spelt([self.texts[k] for k in self.short.tolist()]), _Spelt([" ".join(w) for w in chosen])
        # the sorted words' numbers, and the bits of each with the blank that follows
        self.kinds, self.spans, self.sizes, self.blanks = (np.zeros((len(chosen), max(map(len, chosen), default=0)), x) for x in (np.int64, np.uint64, np.int64, np.uint64))
        for k, of in enumerate(chosen):
            at = 0
            for j, w in enumerate(of):
                self.kinds[k, j], self.sizes[k, j], self.spans[k, j], self.blanks[k, j] = hash(w) | 1, len(w) + 1, ((1 << (len(w) + 1)) - 1 << at) & (2**64 - 1), (1 << (at + len(w))) & (2**64 - 1)
                at += len(w) + 1

    def pairs_of(self, rows: np.ndarray, none: int) -> np.ndarray:
        """The bigrams of the bare short texts `rows`, each with the number of its occurrence; `none` where there are no more."""
        out = np.full((len(rows), CHARACTERS), none, np.int32)
        for j, k in enumerate(self.short[rows].tolist()):
            bare, seen = self.texts[k].replace(" ", ""), {}
            for i in range(len(bare) - 1):
                gram = FIRST.get(bare[i], 40) * 41 + FIRST.get(bare[i + 1], 40)
                out[j, i] = gram * CHARACTERS + seen.setdefault(gram, 0)
                seen[gram] += 1
        return out


class _Spelt:
    def __init__(self, texts: list[str]):
        width = max(map(len, texts), default=0)
        points = np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le"), np.uint32).reshape(len(texts), width)
        table = np.full(128, 40, np.int8)
        for c, k in FIRST.items():
            table[ord(c)] = k
        self.codes = table[np.minimum(points, 127)]
        self.places = np.zeros((len(texts), 41), np.uint64)
        for k in range(width):
            self.places[np.arange(len(texts)), self.codes[:, k]] |= np.uint64(1 << k)
        self.places[:, 40] = 0
        self.codes = np.ascontiguousarray(self.codes.T)


def _common(x: _Spelt, y: _Spelt, a: np.ndarray, b: np.ndarray, gone: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Lengths of the longest common subsequences of the texts a of x and b of y; gone: bits of characters that are left out."""
    state = np.full(len(a), ~np.uint64(0))
    flat, base = x.places.ravel(), a * 41
    for k, column in enumerate(y.codes):
        place = flat[base + column[b]]
        if gone is not None:
            place = np.where(gone[1] >> np.uint64(k) & np.uint64(1), np.uint64(0), place & ~gone[0])
        met = state & place
        state = (state + met) | (state - met)
    return np.bitwise_count(~state).astype(np.int64)


def _windows(short: _Spelt, long: _Spelt, a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The longest common subsequence of the texts a of `short` (of p characters) with any window of as many characters of the texts b of `long` (of q)."""
    best, flat, wide = np.zeros(len(a), np.int64), short.places.ravel(), long.codes.shape[0]
    for at in range(0, len(a), WINDOWED_AT_ONCE):
        part = slice(at, at + WINDOWED_AT_ONCE)
        times = (q - p + 1)[part]
        owner = np.repeat(np.arange(len(times)), times)
        begin = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
        base, other, size = (a[part] * 41)[owner], b[part][owner], p[part][owner]
        state = np.full(len(owner), ~np.uint64(0))
        for k in range(int(size.max())):
            place = np.where(k < size, flat[base + long.codes[np.minimum(begin + k, wide - 1), other]], np.uint64(0))
            met = state & place
            state = (state + met) | (state - met)
        np.maximum.at(best[part], owner, np.bitwise_count(~state).astype(np.int64))
    return best


def _short_scores(x: _Marks, y: _Marks, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """D03 of the short texts a of x and b of y (numbers among all), in percent, all at once; scores below `least` may be too low. The same as similarity.fuzzy_scores."""
    n, m = x.n[a], y.n[b]
    one, two = x.at[a], y.at[b]

    def ratio(common: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.floor(200.0 * common / np.maximum(total, 1) + 0.5)

    whole = _common(x.whole, y.whole, one, two)
    best = np.maximum(ratio(whole, n + m), ratio(_common(x.sorted, y.sorted, one, two), n + m))
    # token sets: what is common to the texts with their words in common first is these, and what is common to the others
    kinds = [[z.kinds[rows, j] for j in range(z.kinds.shape[1])] for z, rows in ((x, one), (y, two))]
    shared = [[np.zeros(len(a), bool) for _ in k] for k in kinds]
    for j, u in enumerate(kinds[0]):
        for k, v in enumerate(kinds[1]):
            same = (u == v) & (u != 0)
            shared[0][j] |= same
            shared[1][k] |= same
    held = np.flatnonzero(np.logical_or.reduce(shared[0])) if shared[0] else np.zeros(0, np.int64)
    if len(held):
        rest, some, base = [], [], np.full(len(held), -1)
        for z, rows, is_shared, of in ((x, one[held], shared[0], kinds[0]), (y, two[held], shared[1], kinds[1])):
            mask, last = np.zeros(len(held), np.uint64), np.zeros(len(held), np.uint64)
            for j, u in enumerate(of):
                kept = ~is_shared[j][held] & (u[held] != 0)
                mask |= np.where(kept, z.spans[rows, j], np.uint64(0))
                last = np.where(kept, z.blanks[rows, j], last)
                if z is x and is_shared is shared[0]:
                    base += np.where(is_shared[j][held], z.sizes[rows, j], 0)
            rest.append(~(mask & ~last))
            some.append(mask != 0)
        common = np.where(some[0] & some[1], base + 1 + _common(x.sorted, y.sorted, one[held], two[held], (rest[0], rest[1])), base)
        sets = np.maximum(ratio(common, n[held] + m[held]), np.maximum(ratio(base, base + n[held]), ratio(base, base + m[held])))
        best[held] = np.maximum(best[held], sets)
    # dice, where the bits of bigrams allow it more
    g, h, bits = x.g[a], y.g[b], (x.grams[a], y.grams[b])
    most = np.minimum(g - np.bitwise_count(bits[0] & ~bits[1]), h - np.bitwise_count(bits[1] & ~bits[0]))
    hope = np.where((g > 0) & (h > 0), 200.0 * most / np.maximum(g + h, 1), 0.0)
    open_ = np.flatnonzero((hope > best) & (hope >= least - 1e-6))
    for part in np.array_split(open_, len(open_) // 5_000 + 1):
        if len(part):
            (u, at_u), (v, at_v) = (np.unique(rows[part], return_inverse=True) for rows in (one, two))
            left, right = x.pairs_of(u, -1)[at_u], y.pairs_of(v, -2)[at_v]
            width = int(max(g[part].max(), h[part].max()))
            common = sum((left[:, :width] == right[:, k : k + 1]).any(1).astype(np.int64) for k in range(width))
            best[part] = np.maximum(best[part], 100.0 * (2.0 * common / (g[part] + h[part])))
    # no window has more in common than the whole text
    p, q = np.minimum(n, m), np.maximum(n, m)
    hope = np.floor(100.0 * whole / np.maximum(p, 1) + 0.5)
    open_ = np.flatnonzero((hope > best) & (hope >= least) & (q > p))
    for first in (True, False):
        rows = open_[(n[open_] < m[open_]) == first]
        if len(rows):
            short, long, s, t = (x.whole, y.whole, one, two) if first else (y.whole, x.whole, two, one)
            best[rows] = np.maximum(best[rows], ratio(_windows(short, long, s[rows], t[rows], p[rows], q[rows]), 2 * p[rows]))
    return best


def _scores(x: _Marks, y: _Marks, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """D03 of the texts a of x and b of y; scores below `least` may be too low."""
    out = np.zeros(len(a))
    short = (x.at[a] >= 0) & (y.at[b] >= 0)
    if short.any():
        out[short] = _short_scores(x, y, a[short], b[short], least[short])
    others = np.flatnonzero(~short)
    if len(others):
        out[others] = fuzzy_scores([x.texts[k] for k in a[others].tolist()], [y.texts[k] for k in b[others].tolist()], float(least[others].min()))
    return out


def _bits(owner: np.ndarray, bits: np.ndarray, count: int) -> np.ndarray:
    """The bits of each owner (in ascending order) put together."""
    out = np.zeros(count, np.uint64)
    if len(owner):
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        out[owner[first]] = np.bitwise_or.reduceat(bits, first)
    return out


def broken(n: np.ndarray, m: np.ndarray, t: float | np.ndarray) -> np.ndarray:
    """How many bigrams inside the words of a text of n characters may be missing in one of m, not shorter, with a whole, sorted or partial ratio of at least t; neither repeats a word. A character
    that is not matched breaks two, one in between breaks one."""
    c = np.ceil(t * (n + m) / 2 - 1e-9)
    return np.maximum(np.where(c <= n, 2 * (n - c) + m - c, -1), 3 * (n - np.ceil(t * n - 1e-9)))


def _candidates(x: _Marks, y: _Marks, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, rows, others): for each text of x, the texts of y whose characters allow it a ratio of at least its `least`, and those that dice or the words in common allow it. Bounds are taken at whole percents, so
    that there are few."""
    eps = 1e-9
    count = len(y.texts)
    not_chars, not_grams = ~y.chars, ~y.grams
    bounds: dict[float, tuple] = {}
    held: dict[str, list[int]] = {}
    for k, words in enumerate(y.words):
        for w in words:
            held.setdefault(w, []).append(k)
    sets: dict[int, set[str]] = {}
    shorter = np.searchsorted(y.d, x.d).tolist()
    met, ones, fits = np.empty(count, np.uint64), np.empty(count, np.uint8), np.empty(count, bool)
    signed = ones.view(np.int8)  # at most 64
    none = np.zeros(0, np.int64)
    for k, (n, d, g, t) in enumerate(zip(x.n.tolist(), x.d.tolist(), x.g.tolist(), _shares(least).tolist(), strict=True)):
        if t not in bounds:
            bounds[t] = t / (2 - t), *(np.clip(s.n - np.ceil(t * s.d - eps), 0, 127).astype(np.uint8) for s in (x, y)), {}
        ratio, spare_x, spare, limits = bounds[t]
        # ratios: characters of the shorter text that the longer one has not
        p, chars = shorter[k], x.chars[k]
        np.bitwise_and(y.chars[:p], ~chars, out=met[:p])
        np.bitwise_and(not_chars[p:], chars, out=met[p:])
        np.bitwise_count(met, out=ones)
        np.less_equal(ones[:p], spare[:p], out=fits[:p])
        np.less_equal(ones[p:], spare_x[k], out=fits[p:])
        rows = fits.nonzero()[0]
        # dice: bigrams that the other has not
        if g not in limits:
            limits.clear()
            limits[g] = np.clip(np.floor(g - t / 2 * (g + y.g) + eps), -1, 127).astype(np.int8)
        np.bitwise_and(not_grams, x.grams[k], out=met)
        np.bitwise_count(met, out=ones)
        np.less_equal(signed, limits[g], out=fits)
        alike = fits.nonzero()[0]
        # words in common against one of the texts. Common words alone reach only short texts
        mine = [w for w in x.words[k] if w in held]
        named = none
        if mine:
            often = [w for w in mine if len(held[w]) > COMMON_WORD]
            most = sum(map(len, often)) + len(often) - 1
            end = count if most >= ratio * d - eps else int(np.searchsorted(y.d, (most + eps) / ratio + eps, side="right"))
            words, found = set(mine), []
            for j in {j for w in mine for j in (held[w][: bisect_left(held[w], end)] if len(held[w]) > COMMON_WORD else held[w])}:
                base = words & (sets.get(j) or sets.setdefault(j, set(y.words[j])))
                if sum(map(len, base)) + len(base) - 1 >= ratio * min(d, int(y.d[j])) - eps:
                    found.append(j)
            named = np.array(found, np.int64)
        if len(rows) + len(alike) + len(named):
            yield k, rows, np.concatenate([alike, named]) if len(named) else alike


def _shares(least: np.ndarray) -> np.ndarray:
    """The least shares that a score of at least `least` percent asks for, halves being rounded up."""
    return (np.floor(least) - 0.5) / 100


def _reached(x: _Marks, y: _Marks, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers in x, numbers in y, scores) of the pairs whose score is at least the `least` of the text of x, some at a time."""
    share, held, waiting = _shares(least), [], 0

    def scored() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        sure = np.concatenate([h[2] for h in held]) | x.odd[a] | y.odd[b]
        # bigrams of the shorter text's words that the longer one has not
        rest = np.flatnonzero(~sure)
        one, two = a[rest], b[rest]
        n, m = x.n[one], y.n[two]
        of_x, of_y = ((u.low[i], u.high[i]) for u, i in ((x, one), (y, two)))
        first = x.d[one] <= y.d[two]
        missing = sum(np.bitwise_count(np.where(first, u & ~v, v & ~u)).astype(np.int64) for u, v in zip(of_x, of_y, strict=True))
        sure[rest] = missing <= broken(np.minimum(n, m), np.maximum(n, m), share[one])
        # a pair may have been found by both
        pairs = np.sort(a[sure] * len(y.texts) + b[sure])
        a, b = np.divmod(pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]], len(y.texts))
        score = _scores(x, y, a, b, least[a])
        kept = score >= least[a]
        return a[kept], b[kept], score[kept]

    for k, *found in _candidates(x, y, least):
        # both for one text are scored together
        held += [(np.full(len(rows), k), rows, np.full(len(rows), sure)) for rows, sure in zip(found, (False, True), strict=True) if len(rows)]
        waiting += sum(map(len, found))
        if waiting >= SCORED_AT_ONCE:
            yield scored()
            held, waiting = [], 0
    if held:
        yield scored()


def compared(left: list[str], right: list[str], least: float) -> Iterator[pd.DataFrame]:
    """(a, b, score) of the pairs of texts (none empty) of a score of at least `least`, in frames."""
    if not left or not right:
        return
    x, y = _Marks(left), _Marks(right)
    for a, b, score in _reached(x, y, np.full(len(left), float(least))):
        yield pd.DataFrame({"a": [x.texts[k] for k in a.tolist()], "b": [y.texts[k] for k in b.tolist()], "score": score})


def similar_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, score) of all pairs of a text of `left` and one of `right` (both: a column `text` of plain texts) whose fuzzy score is
    at least `least` (percent, above 50), each once. Nulls and empty texts have no pairs; repeated texts count once."""
    sides = left.select("text", F.lit(True).alias("l"), F.lit(False).alias("r")).unionByName(right.select("text", F.lit(False).alias("l"), F.lit(True).alias("r")))
    # read by a count and two sides, so that it is computed once
    every = cut(sides.where("text <> ''").groupBy("text").agg(F.max("l").alias("l"), F.max("r").alias("r")))
    lefts, rights = every.agg(F.count(F.when(F.col("l"), 1)), F.count(F.when(F.col("r"), 1))).first()
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = max(1, math.ceil(lefts / LEFT_AT_ONCE))
    # as many cells as a shuffle has tasks, where there are texts enough
    columns = max(1, math.ceil(rights / RIGHT_AT_ONCE), min(math.ceil(n / rows), math.ceil(rights / 2_000)))

    def side(which: str, own: int, others: int, cell: str) -> DataFrame:
        dealt = every.where(which).select("text", F.pmod(F.xxhash64("text"), F.lit(own)).alias("k"), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias("j"))
        return dealt.select(F.expr(cell).alias("cell"), F.lit(which == "l").alias("left"), "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, one, two = None, [], []
        for frame in frames:
            for key, part in frame.groupby("cell"):
                if key != cell:
                    yield from compared(one, two, least)
                    cell, one, two = key, [], []
                one.extend(part["text"][part["left"]])
                two.extend(part["text"][~part["left"]])
        yield from compared(one, two, least)

    ship(left.sparkSession)
    cells = side("l", rows, columns, f"k * {columns} + j").unionByName(side("r", columns, rows, f"j * {columns} + k"))
    return cells.repartition(rows * columns, "cell").sortWithinPartitions("cell").mapInPandas(run, "a string, b string, score double")


def _rows_alike(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """similar_rows of one cell: texts are compared once for all rows that have them."""
    if not len(left) or not len(right):
        return
    asked, asks = left.groupby(["text", "least"], sort=False).ngroup().to_numpy(), right.groupby("text", sort=False).ngroup().to_numpy()
    by_text = [np.argsort(k, kind="stable") for k in (asked, asks)]
    begin = [np.searchsorted(k[o], np.arange(k.max() + 2)) for k, o in zip((asked, asks), by_text, strict=True)]
    firsts = [o[s[:-1]] for o, s in zip(by_text, begin, strict=True)]
    x, y = _Marks(left["text"].to_numpy()[firsts[0]].tolist()), _Marks(right["text"].to_numpy()[firsts[1]].tolist())
    one, given, two = left["id"].to_numpy(), left["given"].to_numpy(), right["id"].to_numpy()
    for a, b, score in _reached(x, y, left["least"].to_numpy()[firsts[0]][x.order]):
        a, b = x.order[a], y.order[b]
        many = np.diff(begin[0])[a], np.diff(begin[1])[b]
        # so many pairs at a time that few rows are made, as a text may be that of many rows
        step = max(1, ROWS_AT_ONCE // int((many[0] * many[1]).max(initial=1)))
        for at in range(0, len(a), step):
            part = slice(at, at + step)
            times = (many[0] * many[1])[part]
            owner = np.repeat(np.arange(len(times)), times)
            k = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
            rows = by_text[0][begin[0][a[part][owner]] + k // many[1][part][owner]], by_text[1][begin[1][b[part][owner]] + k % many[1][part][owner]]
            yield pd.DataFrame({"id_1": one[rows[0]], "id_2": two[rows[1]], "given": given[rows[0]], "score": score[part][owner]})


def similar_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id_1, id_2, given, score): the rows of left (key string, id bigint, text, least, given) and right (key, id, text) of one key whose texts' fuzzy score is at least the left row's `least` (percent, above 50). Only
    keys that both have are compared, in cells as those of similar_pairs: a key's rows are dealt into several where there are many, so that no task holds more than a cell, and no pair is made but those found."""
    left, right = left.where("text <> '' and key is not null"), right.where("text <> '' and key is not null")
    counts = left.groupBy("key").agg(F.count("*").alias("l")).join(right.groupBy("key").agg(F.count("*").alias("r")), "key")
    counts = cut(counts.select("key", F.ceil(F.col("l") / LEFT_AT_ONCE).cast("int").alias("ls"), F.ceil(F.col("r") / RIGHT_AT_ONCE).cast("int").alias("rs")))
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = "cell string, left boolean, id bigint, text string, least double, given double"

    def side(rows: DataFrame, is_left: bool) -> DataFrame:
        own, others = ("ls", "rs") if is_left else ("rs", "ls")
        dealt = rows.join(counts, "key").withColumn("_own", F.pmod(F.xxhash64("id"), F.col(own))).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        cell = F.concat_ws("|", *([F.col("_own"), F.col("_other")] if is_left else [F.col("_other"), F.col("_own")]), "key")
        return dealt.select(cell.alias("cell"), F.lit(is_left).alias("left"), "id", "text", *([F.col(c).cast("double").alias(c) for c in ("least", "given")] if is_left else [F.lit(None).cast("double").alias(c) for c in ("least", "given")]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, parts = None, []

        def done() -> Iterator[pd.DataFrame]:
            if parts:
                whole = pd.concat(parts, ignore_index=True)
                yield from _rows_alike(whole[whole["left"]], whole[~whole["left"]])

        for frame in frames:
            for key, part in frame.groupby("cell", sort=False):
                if key != cell:
                    yield from done()
                    cell, parts = key, []
                parts.append(part)
        yield from done()

    ship(left.sparkSession)
    cells = side(left, True).unionByName(side(right, False)).select(*[c.split(" ")[0] for c in kind.split(", ")])
    return cells.repartition(n, "cell").sortWithinPartitions("cell").mapInPandas(run, "id_1 bigint, id_2 bigint, given double, score double")
