"""Filters, searches, pages and top-k lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIORITY_RANK = {"high": 3, "medium": 2, "low": 1}


def contains_any(query: str, columns: Sequence[str]) -> Column:
    """Case-insensitive substring in any of the columns."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
    return found


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0, total: str | None = None) -> DataFrame:
    """One page of a total order. The count of all rows is an aggregate of its own that one row per
    partition feeds, not a window over everything in one task."""
    rows = df.orderBy(*order).offset(offset).limit(limit)
    if total is None:
        return rows
    return rows.crossJoin(F.broadcast(df.agg(F.count("*").alias(total))))  # a single row


def deal_search(deals: DataFrame, vendors: DataFrame, query: str | None = None, status: str | None = None, vendor_id: int | None = None,
                low: float | None = None, high: float | None = None, sort: str = "created_at", limit: int = 50, offset: int = 0) -> DataFrame:
    """Equality, range and substring filters over deals with their vendor's name, one page, total count."""
    if sort not in ("created_at", "deal_value", "deal_name", "customer_name", "status"):
        raise ValueError(f"can't sort by {sort}")
    df = deals.join(vendors.select("vendor_id", "vendor_name"), "vendor_id", "left")
    for wanted, test in ((status, F.col("status") == status), (vendor_id, F.col("vendor_id") == vendor_id),
                         (low, F.col("deal_value") >= low), (high, F.col("deal_value") <= high)):
        if wanted is not None:
            df = df.where(test)
    if query:
        df = df.where(contains_any(query, ("deal_name", "customer_name", "vendor_name", "product_type")))
    return page(df, [F.desc(sort), F.asc("id")], limit, offset, "total_count")


def opportunity_filter(records: DataFrame, stage: str | None = None, priority: str | None = None, name: str | None = None,
                       after: str | None = None, before: str | None = None, limit: int = 50) -> DataFrame:
    """Opportunities by stage, priority, name and date, highest priority first."""
    for wanted, test in ((stage, F.col("stage") == stage), (priority, F.col("priority") == priority),
                         (after, F.col("created_at") >= F.lit(after).cast("timestamp_ntz")), (before, F.col("created_at") < F.lit(before).cast("timestamp_ntz"))):
        if wanted is not None:
            records = records.where(test)
    if name:
        records = records.where(contains_any(name, ("deal_name",)))
    return page(records.withColumn("priority_rank", priority_rank()), [F.desc("priority_rank"), F.asc("id")], limit)


def priority_rank(column: str = "priority") -> Column:
    rank = F.lit(0)
    for name, value in PRIORITY_RANK.items():
        rank = F.when(F.col(column) == name, value).otherwise(rank)
    return rank


def within_days(df: DataFrame, at: str, days: int) -> DataFrame:
    """The rows of the last days before the newest one (the data's own clock)."""
    last = df.agg(F.max(at).alias("_as_of"))  # a single row
    return df.crossJoin(F.broadcast(last)).where(F.col(at) >= F.col("_as_of") - F.make_dt_interval(F.lit(days))).drop("_as_of")


def recent(df: DataFrame, at: str, days: int, limit: int, tie: str) -> DataFrame:
    """The newest rows of those within_days()."""
    return within_days(df, at, days).orderBy(F.desc(at), F.asc(tie)).limit(limit)


def recommendation(score: str) -> Column:
    """What to do with a pair of that similarity."""
    return F.when(F.col(score) >= 0.95, "auto_merge").when(F.col(score) >= 0.85, "high_confidence").otherwise("medium")


def confident(df: DataFrame, column: str, least: float) -> DataFrame:
    """Unknown (null or zero) or high enough."""
    return df.where(F.col(column).isNull() | (F.col(column) == 0) | (F.col(column) >= least))
