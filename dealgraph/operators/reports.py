"""Reports over logs, merges, validations and quality scores. Every one is a grouped or one-row aggregate
with partial aggregation before its shuffle; "now" is the newest row's time, a one-row table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealgraph.operators.rollups import rate


def recent(df: DataFrame, at: str, days: int) -> DataFrame:
    """The rows of the last days, counted from the newest row."""
    last = df.agg(F.max(at).alias("_as_of"))
    return df.crossJoin(F.broadcast(last)).where(F.col(at) >= F.col("_as_of") - F.expr(f"interval {int(days)} days")).drop("_as_of")


def merge_statistics(merges: DataFrame, conflicts: DataFrame, days: int) -> DataFrame:
    """merges (merge_id, entity_type, merge_type, unmerged, n_sources, merged_at), conflicts (merge_id), by type of entity."""
    per = conflicts.groupBy("merge_id").agg(F.count("*").alias("_c"))
    m = recent(merges, "merged_at", days).join(per, "merge_id", "left")
    return m.groupBy("entity_type").agg(
        F.count("*").alias("total_merges"), F.count_if(F.col("merge_type") == "automatic").alias("automatic_merges"), F.count_if(F.col("merge_type") == "manual").alias("manual_merges"),
        F.count_if("unmerged").alias("unmerged_count"), F.round(F.avg("n_sources"), 6).alias("avg_entities_per_merge"), F.round(F.avg(F.coalesce("_c", F.lit(0))), 6).alias("avg_conflicts_per_merge"),
        F.round((1 - F.try_divide(F.count_if("unmerged"), F.count("*"))) * 100, 4).alias("success_rate"))


def detection_breakdown(log: DataFrame, strategy: str, score: str, at: str, days: int) -> DataFrame:
    """Detections of the last days by strategy, and all of them (strategy null)."""
    return recent(log, at, days).rollup(F.col(strategy).alias("strategy")).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("avg_score"), F.max(score).alias("best"), F.count_if(F.col(score) >= 90).alias("certain"))


def extraction_summary(log: DataFrame, kind: str, success: Column, confidence: str, tokens: str, ms: str, at: str) -> DataFrame:
    return log.groupBy(F.col(kind).alias("extraction_type")).agg(
        F.count("*").alias("total"), F.count_if(success).alias("successful"), F.count_if(~success).alias("failed"), F.round(F.avg(confidence), 2).alias("avg_confidence"),
        F.sum(tokens).cast("double").alias("total_tokens"), F.round(F.avg(ms), 0).alias("avg_ms"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def usage_summary(log: DataFrame, kind: str, hit: Column) -> DataFrame:
    return log.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("requests"), F.count_if(hit).alias("hits"), rate(F.count_if(hit) * 100, F.count("*"), 2).alias("hit_rate"))


def validation_statistics(checked: DataFrame, failures: DataFrame, days: int) -> DataFrame:
    """checked (status, before, after, at), failures (severity, at): one row."""
    c = recent(checked, "at", days).agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("passed", "failed", "pending")],
        F.round(F.try_divide(F.count_if(F.col("status") == "passed") * 100, F.count("*")), 2).alias("pass_rate"), F.round(F.avg("before"), 2).alias("avg_before"), F.round(F.avg("after"), 2).alias("avg_after"))
    f = recent(failures, "at", days).agg(F.count("*").alias("failures"), F.count_if(F.col("severity") == "critical").alias("critical_failures"))
    return c.crossJoin(f)


def failing_rules(entities: DataFrame, failures: str, top: int = 10) -> DataFrame:
    """The rules that fail most, from a JSON array of {"rule": ...} a row; ties by name."""
    each = entities.select(F.explode(F.from_json(failures, "array<struct<rule:string>>")).alias("_f")).select(F.coalesce("_f.rule", F.lit("unknown")).alias("rule"))
    return each.groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule").limit(top)


def consistency(entities: DataFrame, key: str, target: str) -> DataFrame:
    """Clusters of entities with equal keys, the entities in them, and the targets that they touch."""
    sized = entities.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    return entities.join(sized, key).agg(F.countDistinct(key).alias("clusters"), F.count("*").alias("cluster_size"), F.countDistinct(target).alias("inconsistent_targets"))


#: Score and threshold below which a recommendation is given.
RECOMMENDED = {"completeness": 80, "accuracy": 80, "consistency": 90, "timeliness": 70}


def recommendations(scores: DataFrame) -> DataFrame:
    """The scores with the names of those that are too low, worst rule first in the fixed order."""
    low = [F.when(F.col(name) < least, F.lit(name)) for name, least in RECOMMENDED.items()]
    return scores.withColumn("recommendations", F.array_join(F.array_compact(F.array(*low)), ","))


def alerts(scores: DataFrame, quality_min: float = 0.7, duplicates_max: float = 10, failures_max: float = 20) -> DataFrame:
    """(entity_type, alert, severity, value) from shares overall, uniqueness, accuracy and timeliness (0 to 1)."""
    dup, fail = (1 - F.col("uniqueness")) * 100, 100 - F.col("accuracy") * 100

    def alert(when: Column, name: str, grave: Column, high: str, low: str, value: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("alert"), F.when(grave, high).otherwise(low).alias("severity"), F.round(value, 4).alias("value")))

    found = F.array_compact(F.array(
        alert(F.col("overall") < quality_min, "quality_drop", F.col("overall") < 0.5, "critical", "high", F.col("overall")),
        alert(F.col("uniqueness") < (100 - duplicates_max) / 100, "duplicate_spike", dup > 20, "critical", "high", dup),
        alert(fail > failures_max, "validation_failure_rate", fail > 40, "critical", "medium", fail),
        alert(F.col("timeliness") < 0.5, "stale_data", F.col("timeliness") < 0.3, "high", "medium", F.round((1 - F.col("timeliness")) * 60, 0))))
    return scores.select("entity_type", F.inline(found))


def cleaning_stats(texts: DataFrame, before: str, after: str) -> DataFrame:
    return texts.agg(F.count("*").alias("n"), F.sum(F.length(before)).alias("chars_before"), F.sum(F.length(after)).alias("chars_after"),
                     rate((F.sum(F.length(before)) - F.sum(F.length(after))) * 100, F.sum(F.length(before)), 2).alias("reduction_pct"))


def conflict_strategies(values: DataFrame, key: Sequence[str]) -> DataFrame:
    """A column per way to resolve a field's conflict. values: key columns and (pos, value, validated, weight), one row
    per record; the suggested value is that of the largest weight, then the first. A manual one stays null."""
    sorted_ = F.array_sort(F.collect_list(F.struct("pos", "value", "validated")))
    g = values.groupBy(*key).agg(sorted_.alias("_v"), F.max_by("value", F.struct("weight", -F.col("pos"))).alias("suggested"))
    full = F.filter("_v", lambda x: x["value"].isNotNull() & (F.trim(x["value"]) != ""))
    valid = F.filter("_v", lambda x: x["validated"])
    return g.select(*key, F.coalesce(F.col("_v")[0]["value"], "suggested").alias("prefer_source"), F.coalesce(F.element_at("_v", -1)["value"], "suggested").alias("prefer_target"),
                    F.coalesce(F.get(full, F.lit(0))["value"], "suggested").alias("prefer_complete"), F.coalesce(F.get(valid, F.lit(0))["value"], "suggested").alias("prefer_validated"),
                    F.array_join(F.array_distinct(F.transform(full, lambda x: x["value"])), ",").alias("merged"), F.lit(None).cast("string").alias("manual"), "suggested")


def top_candidates(detections: DataFrame, ids: DataFrame, threshold: float = 0.7, most: int = 10) -> DataFrame:
    """Per id of ids(entity_id), its `most` surest pending candidates. detections: (entity_1, entity_2, confidence, status, detected_at, key)."""
    kept = detections.where((F.col("status") == "pending") & (F.col("confidence") >= threshold))
    one = kept.select(F.col("entity_1").alias("entity_id"), F.col("entity_2").alias("candidate_id"), "confidence", "detected_at", "key")
    two = kept.where("entity_1 <> entity_2").select(F.col("entity_2").alias("entity_id"), F.col("entity_1").alias("candidate_id"), "confidence", "detected_at", "key")
    order = Window.partitionBy("entity_id").orderBy(F.desc("confidence"), F.desc("detected_at"), "candidate_id", "key")
    return one.unionByName(two).join(ids, "entity_id", "left_semi").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("key")


def first_duplicates(deals: DataFrame) -> DataFrame:
    """Per deal its first (smallest id) earlier duplicate by rule: words of more than three characters that stand in the
    other's name (.4), the same customer (.3), and values within 10 % (.3), above .7 in all. Only pairs with the same
    customer and near values can pass, so they are joined on the customer and steps of the value's logarithm,
    of the width that near values may differ in, and never all of a customer's."""
    step = F.floor(F.log(F.col("deal_value")) / -F.log(F.lit(0.9)))
    x = deals.where("deal_value > 0 and customer_name is not null and deal_name is not null").select(
        "id", F.lower(F.trim("deal_name")).alias("name"), F.lower(F.trim("customer_name")).alias("customer"), F.col("deal_value").alias("value"), step.alias("step"))
    old = x.select(F.col("id").alias("match_id"), F.col("name").alias("old_name"), "customer", F.col("value").alias("old_value"), F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"))
    pairs = x.join(old, ["customer", "step"]).where((F.col("match_id") < F.col("id")) & (F.abs(F.col("value") - F.col("old_value")) / F.greatest("value", "old_value") < 0.1))
    words = F.split("name", " ")
    common = F.size(F.filter(words, lambda w: F.contains(F.col("old_name"), w) & (F.length(w) > 3)))
    scored = pairs.withColumn("score", common / F.size(words) * 0.4 + 0.3 + 0.3).where("score > 0.7")
    return scored.groupBy("id").agg(F.min(F.struct("match_id", "score")).alias("_m")).select("id", "_m.match_id", F.round("_m.score", 6).alias("score"))


def related(edges: Mapping[str, tuple[DataFrame, float, int]]) -> DataFrame:
    """One edge list of several: each (entity_id, other_id, weight), its strength, and how many it keeps per entity, those of
    the largest weight first."""
    parts = []
    for kind, (df, strength, most) in edges.items():
        order = Window.partitionBy("entity_id").orderBy(F.desc("weight"), "other_id")
        parts.append(df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select("entity_id", F.lit(kind).alias("kind"), "other_id", F.lit(strength).alias("strength")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
