"""Transforms of columns by specifications (F35, F41): JSON from a table, compiled to column expressions.

A specification is {"type": ..., "params": {...}}; an unknown type, like none, leaves the value as it is. There are as many
specifications as columns, so they are read by the driver; the rows are not."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(text: Column) -> Column:
    """The number that a text begins with."""
    return F.regexp_extract(F.regexp_replace(text, r"^\s+", ""), r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def parse_currency(x: Column) -> Column:
    """Without signs of currencies, commas and blanks; K and M at the end multiply."""
    clean = F.regexp_replace(x, r"[$€£¥₹,\s]", "")
    last = F.lower(F.right(clean, F.lit(1)))
    return _number(F.when(last.isin("k", "m"), F.left(clean, F.length(clean) - 1)).otherwise(clean)) * F.when(last == "k", 1e3).when(last == "m", 1e6).otherwise(1.0)


def parse_number(x: Column) -> Column:
    """Without commas; of a percentage the hundredth part."""
    clean = _trimmed(x)
    return F.when(clean.endswith("%"), _number(clean) / 100).otherwise(_number(F.replace(clean, F.lit(","), F.lit(""))))


def parse_date(x: Column) -> Column:
    """A date as any reader takes it, as yyyy-MM-dd."""
    clean = _trimmed(x)
    forms = [F.when(clean.rlike(p), F.try_to_timestamp(F.substring(clean, 1, n), F.lit(f)).cast("date")) for p, f, n in ((r"^\d{4}-\d{2}-\d{2}(?:T[0-9:.]+Z?)?$", "yyyy-MM-dd", 10), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy", 10), (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy", 30), (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy", 30))]
    return F.coalesce(*forms).cast("string")


def _split(x: Column, params: dict) -> Column:
    parts = F.transform(F.split(x, _quoted(params.get("separator") or ",")), _trimmed)
    return F.get(parts, F.lit(int(params["index"]))) if params.get("index") is not None else parts


def _quoted(separator: str) -> str:
    return "\\Q" + separator + "\\E"


#: How a kind's values are made: of the first source column, or (concat) of all.
KINDS: dict[str, Callable[[Column, dict], Column]] = {
    "parse_currency": lambda x, _: parse_currency(x), "parse_number": lambda x, _: parse_number(x), "parse_date": lambda x, _: parse_date(x), "split": _split,
    "lowercase": lambda x, _: F.lower(x), "uppercase": lambda x, _: F.upper(x), "trim": lambda x, _: _trimmed(x)}


def transformed(sources: list[Column], spec: str | None) -> Column:
    """The value that a specification makes of its source columns (texts). Of several sources only concat takes more than the first."""
    told = json.loads(spec) if spec else {}
    kind, params = told.get("type"), told.get("params") or {}
    if kind == "concat" and len(sources) > 1:
        there = F.filter(F.array(*sources), lambda x: x.isNotNull() & (x != ""))
        return F.array_join(there, params.get("separator") or " ")
    return KINDS[kind](sources[0], params) if kind in KINDS else sources[0]


def apply_specs(rows: DataFrame, specs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a column for each of specs (target, sources: an array of names, spec: JSON or null), beside those to keep; in the order of the targets."""
    told = specs.select("target", "sources", "spec").orderBy("target").collect()
    return rows.select(*keep, *[transformed([F.col(c).cast("string") for c in r["sources"]], r["spec"]).alias(r["target"]) for r in told])
