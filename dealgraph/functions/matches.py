"""Where patterns match in texts, several patterns in one pass over each text.

A pattern is not tried at every place. Either its matches begin with one of a few words, and it is tried where these stand; or they hold one and otherwise consist of few characters, and it is tried in the
runs of such characters that hold the word, up to its last place there. The words are found by str.find. What is found are all matches of the pattern from left to right, none
overlapping, as the pattern alone finds them. Classes (\\w, \\s, \\b) and letters without case are those of ASCII."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from dealgraph.functions.workers import ship

#: (pattern, text, the text in lower case) to the matches.
Finder = Callable[[re.Pattern, str, str], Iterator[re.Match]]
BLANKS, LETTERS, DIGITS = " \t\n\v\f\r", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Rows that are handed on at once.
ROWS = 50_000


class Rule(NamedTuple):
    pattern: str
    find: Finder
    groups: tuple[int, ...] = ()


def lowered(text: str) -> str:
    """The text with A to Z in lower case; every character keeps its place."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def places(text: str, words: Sequence[str]) -> list[int]:
    """Where the words begin, in ascending order."""
    out = set()
    for w in words:
        k = text.find(w)
        while k >= 0:
            out.add(k)
            k = text.find(w, k + 1)
    return sorted(out)


def _back(text: str, at: int, chars: str) -> int:
    """Where the run of `chars` that ends before `at` begins."""
    while at and text[at - 1] in chars:
        at -= 1
    return at


def _tried(p: re.Pattern, text: str, starts: list[int]) -> Iterator[re.Match]:
    end = 0
    for k in starts:
        if k >= end and (m := p.match(text, k)):
            yield m
            end = m.end()


def _runs(text: str, chars: str, held: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(start, end, last): the runs of `chars` that hold a word, and the end of the last one there; held: where the words begin and end, in ascending order."""
    run, found = re.compile(f"[{re.escape(chars)}]*"), None
    for start, end in held:
        if found is None or start >= found[1]:
            before = 0 if found is None else found[1]
            if found:
                yield found
            found = before + len(text[before:start].rstrip(chars)), run.match(text, start).end(), end
        else:
            found = found[0], found[1], max(found[2], end)
    if found:
        yield found


def at(*words: str) -> Finder:
    """For patterns whose matches begin with one of the words (in lower case)."""
    return lambda p, text, low: _tried(p, text, places(low, words))


def within(chars: str, words: Sequence[str], after_blank: bool = False, more: int = 0) -> Finder:
    """For patterns whose matches consist of `chars` and end with one of the words and at most `more` characters (all in lower case)."""
    def find(p: re.Pattern, text: str, low: str) -> Iterator[re.Match]:
        held = sorted((k, k + len(w)) for w in words for k in places(low, [w]) if not after_blank or k and low[k - 1] in BLANKS)
        for start, end, last in _runs(low, chars, held):
            # a character that is none of these tells where a word ends
            yield from p.finditer(text, start, min(end + 1, last + more))

    return find


def addresses(p: re.Pattern, text: str, low: str) -> Iterator[re.Match]:
    for start, end, _ in _runs(low, LETTERS + DIGITS + "._%+@|-", [(k, k + 1) for k in places(low, "@")]):
        yield from p.finditer(text, start, end + 1)


_DIALLED = re.compile(r"[0-9+().\-]{10,}")


def phones(p: re.Pattern, text: str, low: str) -> Iterator[re.Match]:
    for run in _DIALLED.finditer(text):
        yield from p.finditer(text, run.start(), run.end() + 1)


_SUMS = re.compile(r"\$|[0-9]+")


def sums(p: re.Pattern, text: str, low: str) -> Iterator[re.Match]:
    """Amounts after a sign, or before the word dollar; of digits in a row, all fail if the first does."""
    if "dollar" not in low:
        yield from _tried(p, text, places(text, "$"))
        return
    begun = _SUMS.search(text)
    while begun:
        if m := p.match(text, begun.start()):
            yield m
        begun = _SUMS.search(text, (m or begun).end())


_DATED = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec", "q1", "q2", "q3", "q4", "end", "next")


def dates(p: re.Pattern, text: str, low: str) -> Iterator[re.Match]:
    starts = places(low, _DATED)
    slashes = [k for k in places(low, "/") if k and low[k - 1] in DIGITS]
    if slashes:
        starts = sorted({*starts, *(k - 1 for k in slashes), *(k - 2 for k in slashes if k > 1 and low[k - 2] in DIGITS)})
    yield from _tried(p, text, starts)


def suffixed(chars: str, words: Sequence[str], suffix: str, chain: str | None = None) -> Finder:
    """For patterns whose matches consist of `chars` and end with a blank and a suffix (as written), a word that the pattern `suffix` knows. chain: what a match begins with as far as it goes; if none begins
    with its first word, then none does inside it."""
    ends, chained = re.compile(suffix, re.A), chain and re.compile(chain, re.A)

    def find(p: re.Pattern, text: str, low: str) -> Iterator[re.Match]:
        held = [(k, m.end()) for k in places(text, words) if k and text[k - 1] in BLANKS and (m := ends.match(text, k))]
        for start, _, last in _runs(text, chars, held):
            if not chained:
                yield from p.finditer(text, start, last + 1)
                continue
            for c in chained.finditer(text, start, last + 1):
                if m := p.match(text, c.start(), last + 1):
                    yield m

    return find


def after_two_words(*words: str) -> Finder:
    """For patterns of two whole words of letters, a comma or none, blanks, and one of the words, with which the rest begins: for each place of that there is one beginning."""
    def begin(low: str, k: int) -> int | None:
        one = _back(low, k, BLANKS)
        two = one - (one > 0 and low[one - 1] == ",")
        three = _back(low, two, LETTERS)
        four = _back(low, three, BLANKS)
        first = _back(low, four, LETTERS)
        return first if first < four < three < two and one < k else None

    return lambda p, text, low: _tried(p, text, sorted({s for k in places(low, words) if (s := begin(low, k)) is not None}))


_FIRST_WORD = re.compile(r"\b[a-z]", re.A)


def to_the_end(words: Sequence[str], then: str) -> Finder:
    """For patterns of letters and blanks that begin with a word and take all of the run of such characters that holds one of the words and what follows (`then`): the first word of the run begins the only match, if there is one."""
    followed = re.compile(then, re.A)

    def find(p: re.Pattern, text: str, low: str) -> Iterator[re.Match]:
        held = sorted((k, k + len(w)) for w in words for k in places(low, [w]) if followed.match(low, k + len(w)))
        for start, end, _ in _runs(low, LETTERS + BLANKS, held):
            if (first := _FIRST_WORD.search(low, start, end)) and (m := p.match(text, first.start())):
                yield m

    return find


def called(chars: str, words: Sequence[str], joined: Sequence[str], verbs: Sequence[str]) -> Finder:
    """For patterns that consist of `chars` and end with a verb, a word of `joined` and one of `words`, blanks between."""
    def before(low: str, k: int, these: Sequence[str]) -> int:
        end = _back(low, k, BLANKS)
        return next((end - len(w) for w in these if end < k and low.endswith(w, 0, end)), -1)

    def find(p: re.Pattern, text: str, low: str) -> Iterator[re.Match]:
        held = sorted((k, k + len(w)) for w in words for k in places(low, [w]) if (j := before(low, k, joined)) > 0 and (v := before(low, j, verbs)) > 0 and low[v - 1] in BLANKS)
        for start, _, last in _runs(low, chars, held):
            yield from p.finditer(text, start, last)

    return find


def found(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(text_id, rule, k, start, end, g0, g1, ...): the matches of all rules in texts (text_id, text), those of a rule in a text counted from 0, with the groups it asks for ('' where one
    has no part in the match). Null texts have none. Texts are read once, and only matches leave the task."""
    kind, most = texts.schema["text_id"].dataType.simpleString(), max(g for r in rules for g in (0, *r.groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(i, re.compile(r.pattern.replace(r"\z", r"\Z"), re.A), r.find, r.groups) for i, r in enumerate(rules)]
        numbers = pa.int32()
        for batch in batches:
            key, columns = batch.schema.field(0).type, [[] for _ in range(6 + most)]

            def made(key=key, columns=columns) -> pa.RecordBatch:
                kinds = [key, numbers, numbers, numbers, numbers, *[pa.string()] * (most + 1)]
                out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["text_id", "rule", "k", "start", "end", *[f"g{g}" for g in range(most + 1)]])
                for c in columns:
                    c.clear()
                return out

            for text_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                low = lowered(text)
                for i, p, find, groups in compiled:
                    for k, m in enumerate(find(p, text, low)):
                        for c, x in zip(columns, (text_id, i, k, m.start(), m.end(), m[0], *((m[g] or "") if g in groups else None for g in range(1, most + 1))), strict=True):
                            c.append(x)
                if len(columns[0]) >= ROWS:
                    yield made()
            yield made()

    ship(texts.sparkSession)
    return texts.select("text_id", "text").mapInArrow(run, f"text_id {kind}, rule int, k int, start int, end int, " + ", ".join(f"g{g} string" for g in range(most + 1)))
