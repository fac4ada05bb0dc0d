"""Aggregates over records and logs (A01-A42). All are partial-then-final hash aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """A share that is null where there is nothing to share."""
    return F.round(F.try_divide(part, F.nullif(whole, F.lit(0))), digits)


def vendor_rollup(vendors: DataFrame, deals: DataFrame) -> DataFrame:
    """Deals per vendor with their number and value; the deals are summed before the join."""
    sums = deals.groupBy("vendor_id").agg(F.count("*").alias("deal_count"), F.sum("deal_value").alias("total_value"))
    return vendors.join(sums, "vendor_id", "left").select("vendor_id", "vendor_name", F.coalesce("deal_count", F.lit(0)).alias("deal_count"),
                                                          F.round(F.coalesce("total_value", F.lit(0.0)), 2).alias("total_value"))


def log_stats(log: DataFrame, keys: Sequence[str], at: str = "ts", user: str = "user_id", value: str = "value") -> DataFrame:
    """Per key, the number of rows and users, the mean value and the time span."""
    return log.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(user).alias("n_users"), F.round(F.avg(value), 6).alias("avg_value"),
                                  F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def bands(df: DataFrame, keys: Sequence[str], value: str, high: float, medium: float) -> DataFrame:
    """Numbers of values in three bands, per key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(value) >= high).alias("high"),
                                 F.count_if((F.col(value) >= medium) & (F.col(value) < high)).alias("medium"), F.count_if(F.col(value) < medium).alias("low"))


def per_period(log: DataFrame, unit: str, keys: Sequence[str] = (), at: str = "ts", value: str = "value") -> DataFrame:
    """Rows and mean value by truncated time."""
    return log.groupBy(F.date_trunc(unit, at).alias("period"), *keys).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("avg_value"))


def pass_rates(checks: DataFrame, keys: Sequence[str], passed: Column) -> DataFrame:
    """Checked, passed and failed rows with the share passed in percent (100 where none was checked)."""
    out = checks.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(passed).alias("passed"), F.count_if(~passed).alias("failed"))
    return out.withColumn("pass_rate", F.coalesce(rate(F.col("passed") * 100, F.col("total"), 2), F.lit(100.0)))


def completeness(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The share of filled values per field and over all of them, in one pass."""
    filled = df.agg(F.count("*").alias("total"), *[F.count(F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), 1)).alias(f) for f in fields])
    return filled.select("total", *[rate(F.col(f) * 100, F.col("total"), 2).alias(f"pct_{f}") for f in fields],
                         rate(sum((F.col(f) for f in fields[1:]), F.col(fields[0])) * 100, F.col("total") * len(fields), 2).alias("pct_all"))


def timeliness(df: DataFrame, at: str, stale_days: int = 30, recent_days: int = 7) -> DataFrame:
    """Mean age in days at the newest row, and the numbers of stale and recent rows."""
    last = df.agg(F.max(at).alias("_as_of"))
    age = (F.unix_micros(F.col("_as_of").cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / F.lit(86_400_000_000.0)
    aged = df.crossJoin(F.broadcast(last)).select(age.alias("age"))
    return aged.agg(F.round(F.avg("age"), 4).alias("avg_age_days"), F.count_if(F.col("age") > stale_days).alias("stale"), F.count_if(F.col("age") <= recent_days).alias("recent"))


def overall_quality(completeness: Column, accuracy: Column, consistency: Column, age_days: Column, uniqueness: Column) -> Column:
    """The weighted score of the five dimensions."""
    fresh = F.greatest(F.lit(0.0), 100 - 2 * age_days)
    return F.round(0.25 * completeness + 0.30 * accuracy + 0.25 * consistency + 0.15 * fresh + 0.05 * uniqueness, 2)


def breakdown(df: DataFrame, column: str) -> DataFrame:
    """How many rows have each value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
