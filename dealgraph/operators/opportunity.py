"""Opportunities: correlation groups, summaries, consolidation, overrides."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Orders of precedence.
STAGES = ("po_in_progress", "quote", "rfq", "integration", "research", "unknown")
PRIORITIES = ("high", "medium", "low")
STAGE_ALIASES = {"po": "po_in_progress", "purchase_order": "po_in_progress", "deploy": "integration", "rollout": "integration", "discovery": "research"}


def precedence(column: Column, order: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in order]), column)


def correlate(records: DataFrame, key: str, actors: str, tags: str | None = None) -> DataFrame:
    """Groups of two and more by key: stage by precedence, the share of the most frequent
    stage as confidence, common actors, and a score.

    Counts per (group, stage) are aggregated first; actors common to all members are those whose
    number of members equals the group's."""
    base = records.where(F.col(key).isNotNull())
    stages = base.groupBy(key, "stage").agg(F.count("*").alias("n"))
    groups = stages.groupBy(key).agg(F.sum("n").alias("members"), F.max("n").alias("most"), F.min(precedence(F.col("stage"), STAGES)).alias("rank")).where("members >= 2")
    one = base.select(key, "id", F.explode(actors).alias("actor")).distinct().groupBy(key, "actor").agg(F.count("*").alias("n"))
    common = one.join(groups.select(key, "members"), key).where("n = members").groupBy(key).agg(F.count("*").alias("common_actors"))
    out = groups.join(common, key, "left").withColumn("common_actors", F.coalesce("common_actors", F.lit(0)))
    confidence = F.col("most") / F.col("members")
    shared = F.lit(0.5) if tags is None else F.when(F.col(tags) > 0, 0.5).otherwise(0.0)
    score = F.round(shared + 0.3 * F.least(F.col("common_actors") / 3, F.lit(1.0)) + 0.2 * confidence, 3)
    return out.select(key, "members", F.element_at(F.array(*[F.lit(x) for x in STAGES]), F.col("rank").cast("int")).alias("stage"), F.round(confidence, 6).alias("stage_confidence"), "common_actors", score.alias("score"))


def consolidate(records: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """A row per group or single record, with conflicts only where a field has several values."""
    def values(c: str) -> Column:
        found = F.array_sort(F.collect_set(c))  # sets of a fixed vocabulary: stages, priorities
        return F.when(F.size(found) > 1, F.array_join(found, ";")).otherwise("").alias(f"{c}_conflicts")

    return records.groupBy(key).agg(F.count("*").alias("members"), *[values(c) for c in fields])


def stage_alias(column: Column) -> Column:
    """O01."""
    low = F.lower(F.trim(column))
    out = F.when(low.isin(*STAGES), low).otherwise("unknown")
    for name, stage in STAGE_ALIASES.items():
        out = F.when(low == name, stage).otherwise(out)
    return out


def record_id(*parts: Column) -> Column:
    """twelve digits of the SHA-1 of the joined parts."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12)


def override(records: DataFrame, notes: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Annotated values replace the records'."""
    n = notes.select("id", *[F.col(f).alias(f"_{f}") for f in fields])
    return records.join(n, "id", "left").withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])


def applicable(insights: DataFrame, records: DataFrame, least: float = 0.8) -> DataFrame:
    """Sure insights by the vendor they are about, or about any (null): each of those applies to
    every record, so that there are as many rows as general insights times records."""
    sure = insights.where(F.col("confidence") >= least)
    named = records.select("id", "vendor_id").join(sure.where("vendor_id is not null"), "vendor_id").select("id", "insight_id")
    anyone = records.select("id").crossJoin(sure.where("vendor_id is null").select("insight_id"))
    return named.unionByName(anyone)


def reseeded_intersections(lists: DataFrame, key: str, order: str, items: str) -> DataFrame:
    """(key, items): what the lists of a key have in common, taken in order, starting from the first; when nothing is left, the next list starts anew. The result depends on the order, so
    it is a fold: rows are sorted by key and order within partitions and streamed past one list that is kept, so a key's rows are never gathered. Rows of
    one order go by their lists, so that the result depends on the rows alone. Null lists count as empty; a key's rows are all read by one task."""
    kind, item = lists.schema[key].dataType.simpleString(), lists.schema[items].dataType.simpleString()
    rows = lists.select(F.col(key).alias("k"), F.col(order).alias("o"), F.coalesce(F.col(items), F.array().cast(item)).alias("xs")).repartition("k").sortWithinPartitions("k", "o", "xs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, begun, types = None, [], False, None

        def made(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], types[0]), pa.array([x for _, x in done], types[1])], names=[key, items])

        for batch in batches:
            done, types = [], [batch.column(c).type for c in (0, 1)]
            for k, xs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not begun or k != now:
                    if begun:
                        done.append((now, kept))
                    now, kept, begun = k, xs, True
                elif not kept:
                    kept = list(dict.fromkeys(xs))
                else:
                    there = set(xs)
                    kept = [x for x in kept if x in there]
            yield made(done)
        if begun:
            yield made([(now, kept)])

    return rows.select("k", "xs").mapInArrow(run, f"{key} {kind}, {items} {item}")
