"""A reversible log of merges (M10, M12, M13): append-only, replayed to know what holds.

The log has a row per merge and source record: (merge_id, kind, target_id, source_id, at, by, reason, can_unmerge), where kind is 'merge', or 'unmerge' (a row per merge, without a source). A merge's id is
a digest of its cluster and target, so a batch that is appended twice, or runs again after a failure, adds nothing. Nothing
is ever changed or deleted: a record is merged while a merge of it has no unmerge in the log, so undoing is another row and gives the
records back as they were. Sources are rows, not arrays: a cluster of any size is split like any other rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hours in which a merge can be undone, the least confidence of an automatic merge, and of a preview without a warning, and how many conflicts are many.
UNDO_HOURS, AUTO_LEAST, SURE, MANY = 24, 0.95, 0.7, 5
LOG = "merge_id string, kind string, target_id bigint, source_id bigint, at timestamp_ntz, by string, reason string, can_unmerge boolean"


def preview(members: DataFrame, fields: tuple[str, ...], quality: str, key: str = "id") -> DataFrame:
    """Per cluster (cluster_id) of at least two records: master_id (the highest quality, the smallest id among equals), size, conflicts and manual (fields with more than one and more
    than two values, null being a value), confidence (mean quality, less a tenth per manual one) and warnings. Nothing is written."""
    rows = members.unpivot(["cluster_id"], [F.col(f).cast("string").alias(f) for f in fields], "field", "value")
    n = F.countDistinct("value") + F.max(F.col("value").isNull().cast("int"))
    found = rows.groupBy("cluster_id", "field").agg(n.alias("n")).groupBy("cluster_id").agg(F.count_if(F.col("n") > 1).alias("conflicts"), F.count_if(F.col("n") > 2).alias("manual"))
    whole = members.groupBy("cluster_id").agg(F.max_by(key, F.struct(F.col(quality), -F.col(key))).alias("master_id"), F.count("*").alias("size"), F.avg(quality).alias("_q")).where("size >= 2").join(found, "cluster_id")
    confidence = F.col("_q") * (1 - F.col("manual") * 0.1)
    warnings = F.array_compact(F.array(F.when(F.col("conflicts") > MANY, F.concat(F.lit("High number of conflicts ("), F.col("conflicts").cast("string"), F.lit("). Manual review recommended."))),
                                       F.when(F.col("manual") > 0, F.concat(F.col("manual").cast("string"), F.lit(" conflicts require manual review"))), F.when(confidence < SURE, F.lit("Low merge confidence. Verify results carefully."))))
    return whole.select("cluster_id", "master_id", "size", "conflicts", "manual", confidence.alias("confidence"), warnings.alias("warnings"))


def merge_id(cluster: Column, target: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("merge"), cluster.cast("string"), target.cast("string")), 256)


def merge_rows(members: DataFrame, masters: DataFrame, at: Column, by: str, can_unmerge: Column | None = None, key: str = "id") -> DataFrame:
    """The log's rows for merging the members (cluster_id, id) of each cluster into its master (cluster_id, master_id). at and can_unmerge: of columns of masters."""
    told = masters.select("cluster_id", F.col("master_id").alias("target_id"), at.alias("at"), (F.lit(True) if can_unmerge is None else can_unmerge).alias("can_unmerge"))
    rows = members.select("cluster_id", F.col(key).alias("source_id")).join(told, "cluster_id").where("source_id <> target_id")
    return rows.select(merge_id(F.col("cluster_id"), F.col("target_id")).alias("merge_id"), F.lit("merge").alias("kind"), "target_id", "source_id", "at", F.lit(by).alias("by"), F.lit(None).cast("string").alias("reason"), "can_unmerge")


def new_rows(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows that are not in the log yet, each once; to be appended to it."""
    keys = ["merge_id", "kind", "source_id"]
    known = log.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = (F.col("merge_id") == F.col("_merge_id")) & (F.col("kind") == F.col("_kind")) & F.col("source_id").eqNullSafe(F.col("_source_id"))
    return rows.dropDuplicates(keys).join(known, same, "left_anti")


def merges(log: DataFrame) -> DataFrame:
    """The log by merge: (merge_id, target_id, merged_at, merged_by, source_count, can_unmerge, unmerged, unmerged_at)."""
    done = F.col("kind") == "merge"
    return log.groupBy("merge_id").agg(F.max(F.when(done, F.col("target_id"))).alias("target_id"), F.min(F.when(done, F.col("at"))).alias("merged_at"), F.max(F.when(done, F.col("by"))).alias("merged_by"), F.countDistinct(F.when(done, F.col("source_id"))).alias("source_count"),
                                       F.bool_and(F.when(done, F.col("can_unmerge"))).alias("can_unmerge"), F.bool_or(~done).alias("unmerged"), F.min(F.when(~done, F.col("at"))).alias("unmerged_at"))


def unmerge(log: DataFrame, asked: DataFrame, by: str = "system") -> DataFrame:
    """For asked (merge_id, at, reason): (merge_id, at, reason, refused): why a merge can't be undone, or null; unmerge_rows() of what is not refused go into the log. Of several requests for one merge the first counts."""
    first = asked.groupBy("merge_id").agg(F.min(F.struct("at", "reason")).alias("f")).select("merge_id", "f.*")
    m = merges(log).where("merged_at is not null")
    late = F.col("at") > F.col("merged_at") + F.expr(f"interval {UNDO_HOURS} hours")
    refused = F.when(F.col("merged_at").isNull() | F.col("unmerged"), "not found or already unmerged").when(late, f"more than {UNDO_HOURS} hours ago").when(~F.col("can_unmerge"), "irreversible")
    return first.join(m, "merge_id", "left").select("merge_id", "at", "reason", F.lit(by).alias("by"), refused.alias("refused"))


def unmerge_rows(decided: DataFrame) -> DataFrame:
    none = F.lit(None)
    return decided.where("refused is null").select("merge_id", F.lit("unmerge").alias("kind"), none.cast("bigint").alias("target_id"), none.cast("bigint").alias("source_id"), "at", "by", "reason", none.cast("boolean").alias("can_unmerge"))


def replayed(records: DataFrame, log: DataFrame, key: str = "id") -> DataFrame:
    """Records with merged_into: the target of the latest merge of them that is not undone, or null."""
    standing = merges(log).where(~F.col("unmerged")).select("merge_id", F.col("merged_at").alias("_at"))
    into = log.where("kind = 'merge'").join(standing, "merge_id").groupBy(F.col("source_id").alias(key)).agg(F.max(F.struct("_at", "merge_id", "target_id")).alias("_m")).select(key, F.col("_m.target_id").alias("merged_into"))
    return records.join(into, key, "left")


def history(log: DataFrame) -> DataFrame:
    """(entity_id, merge_id, merged_at, merged_by, was_source, was_target, source_count, unmerged, rank), a row per record that a merge concerns, the newest merge of a record first."""
    m = merges(log)
    ends = log.where("kind = 'merge'").select("merge_id", F.explode(F.array(F.struct(F.col("source_id").alias("entity_id"), F.lit(True).alias("s")), F.struct(F.col("target_id").alias("entity_id"), F.lit(False).alias("s")))).alias("e")).select("merge_id", "e.*")
    of = ends.groupBy("merge_id", "entity_id").agg(F.bool_or("s").alias("was_source"), F.bool_or(~F.col("s")).alias("was_target"))
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("merged_at"), "merge_id"))
    return of.join(m, "merge_id").select("entity_id", "merge_id", "merged_at", "merged_by", "was_source", "was_target", "source_count", "unmerged", rank.alias("rank"))


def auto_merge(log: DataFrame, members: DataFrame, clusters: DataFrame, at: Column, least: float = AUTO_LEAST, dry_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """Merges of active clusters (cluster_id, master_id, confidence, status) of at least the least confidence: (summary, rows for the log). A dry run, as by default, counts clusters and has no rows."""
    chosen = clusters.where((F.col("status") == "active") & (F.col("confidence") >= least))
    rows = new_rows(log, merge_rows(members, chosen, at, "auto-merge-system"))
    rows = rows.limit(0) if dry_run else rows
    summary = chosen.agg(F.count("*").alias("total_clusters")).crossJoin(F.broadcast(rows.agg(F.countDistinct("merge_id").alias("merged_clusters"), F.count("*").alias("merged_records"))))
    return summary, rows
