"""Values of the tables as people write them: a row's key picks one of several forms. The same in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for the value in a form.
VALUE = "{}"


def written(value: Column, key: Column, forms: Sequence[str | None]) -> Column:
    """The value put into the form at key modulo the number of forms; a form of None gives null."""
    def one(form: str | None) -> Column:
        if form is None:
            return F.lit(None).cast("string")
        if VALUE not in form:
            return F.lit(form)
        before, _, after = form.partition(VALUE)
        return F.concat(F.lit(before), value, F.lit(after))

    out = F.when(key % len(forms) == 0, one(forms[0]))
    for k, form in enumerate(forms[1:], 1):
        out = out.when(key % len(forms) == k, one(form))
    return out


def quoted(text: str) -> str:
    """An SQL string, control characters written as chr()."""
    parts, plain = [], ""
    for c in text:
        if c < " " or c == "\x7f":
            parts += ([f"'{plain}'"] if plain else []) + [f"chr({ord(c)})"]
            plain = ""
        else:
            plain += "''" if c == "'" else c
    return " || ".join(parts + ([f"'{plain}'"] if plain or not parts else []))


def written_sql(value: str, key: str, forms: Sequence[str | None]) -> str:
    def one(form: str | None) -> str:
        if form is None:
            return "NULL"
        before, found, after = form.partition(VALUE)
        return " || ".join([quoted(before), value, quoted(after)]) if found else quoted(form)

    return f"CASE {key} % {len(forms)} " + " ".join(f"WHEN {k} THEN {one(form)}" for k, form in enumerate(forms)) + " END"
