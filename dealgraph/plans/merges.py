"""Previews, merges, their undoing and history over clusters of deals, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgraph.functions import scoring
from dealgraph.operators import merges
from dealgraph.plans.linkage import M, members
from dealgraph.plans.registry import register

FIELDS = ("deal_name", "priority", "product_type", "status", "vendor_id", "created_at")


def rated(s: SparkSession, d: str) -> DataFrame:
    """Deals with their cluster (a customer's deals of one stage) and quality."""
    complete = scoring.completeness([F.col(c) for c in ("customer_name", "deal_name", "vendor_id", "product_type", "deal_value")])
    return members(s, d).withColumn("quality", F.round(0.6 * complete + 0.4 * F.least(F.lit(1.0), F.col("deal_value") / 500_000), 3))


RATED = M + ", r AS (SELECT *, round(0.6 * pow(((customer_name IS NOT NULL)::INT + (deal_name IS NOT NULL)::INT + (vendor_id IS NOT NULL)::INT + (product_type IS NOT NULL)::INT + (deal_value IS NOT NULL)::INT) / 5, 4) + 0.4 * least(1, deal_value / 500000), 3)::DOUBLE AS quality FROM m)"
register("m10_merge_preview", lambda s, d: merges.preview(rated(s, d), FIELDS, "quality").withColumns({"confidence": F.round("confidence", 6), "warnings": F.array_join("warnings", " ")}), RATED + f"""
, u AS (SELECT cluster_id, unnest({list(FIELDS)}) AS field, unnest([{', '.join(f'{f}::VARCHAR' for f in FIELDS)}]) AS value FROM r),
n AS (SELECT cluster_id, field, count(DISTINCT value) + max((value IS NULL)::INT) AS n FROM u GROUP BY 1, 2), c AS (SELECT cluster_id, count(*) FILTER (n > 1) AS conflicts, count(*) FILTER (n > 2) AS manual FROM n GROUP BY 1),
w AS (SELECT cluster_id, arg_max(id, (quality, -id)) AS master_id, count(*) AS size, avg(quality) AS q FROM r GROUP BY 1 HAVING count(*) >= 2), z AS (SELECT *, q * (1 - manual * 0.1::DOUBLE) AS confidence FROM w JOIN c USING (cluster_id))
SELECT cluster_id, master_id, size, conflicts, manual, round(confidence, 6)::DOUBLE AS confidence, concat_ws(' ', CASE WHEN conflicts > 5 THEN 'High number of conflicts (' || conflicts || '). Manual review recommended.' END, CASE WHEN manual > 0 THEN manual || ' conflicts require manual review' END,
 CASE WHEN confidence < 0.7 THEN 'Low merge confidence. Verify results carefully.' END) AS warnings FROM z""")


def logged(s: SparkSession, d: str) -> DataFrame:
    """The log after all clusters were merged (twice, as by a batch that ran again) and some merges undone: early, too late, or never to be undone."""
    x = rated(s, d)
    masters = merges.preview(x, FIELDS, "quality").withColumn("at", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("master_id") % 50).cast("int")))
    empty = s.createDataFrame([], merges.LOG)
    rows = merges.merge_rows(x, masters, F.col("at"), "user", F.col("master_id") % 5 > 0)
    log = empty.unionByName(merges.new_rows(empty, rows))
    log = log.unionByName(merges.new_rows(log, rows))
    asked = masters.where("master_id % 3 < 2").select(merges.merge_id(F.col("cluster_id"), F.col("master_id")).alias("merge_id"), (F.col("at") + F.make_dt_interval(hours=F.when(F.col("master_id") % 3 == 0, 24).otherwise(F.lit(20) + (F.col("master_id") % 10).cast("int")))).alias("at"), F.lit("wrong").alias("reason"))
    decided = merges.unmerge(log, asked.unionByName(s.createDataFrame([("unknown", "no such merge")], "merge_id string, reason string").withColumn("at", F.lit("2024-01-02").cast("timestamp_ntz")).select("merge_id", "at", "reason")))
    return log.unionByName(merges.unmerge_rows(decided))


LOGGED = RATED + """
, w AS (SELECT cluster_id, arg_max(id, (quality, -id)) AS target_id, count(*) AS size FROM r GROUP BY 1 HAVING count(*) >= 2),
g AS (SELECT *, sha256('merge|' || cluster_id || '|' || target_id) AS merge_id, TIMESTAMP '2024-01-01' + to_hours((target_id % 50)::INT) AS merged_at, target_id % 5 > 0 AND (target_id % 3 = 0 OR target_id % 3 = 1 AND target_id % 10 <= 4) AS unmerged FROM w)"""
register("m12_replayed", lambda s, d: merges.replayed(rated(s, d).select("id", "cluster_id"), logged(s, d)), LOGGED + " SELECT id, cluster_id, CASE WHEN id <> target_id AND NOT unmerged THEN target_id END AS merged_into FROM r LEFT JOIN g USING (cluster_id)")
register("m13_merge_history", lambda s, d: merges.history(logged(s, d)), LOGGED + """
SELECT id AS entity_id, merge_id, merged_at, 'user' AS merged_by, id <> target_id AS was_source, id = target_id AS was_target, size - 1 AS source_count, unmerged, 1 AS rank FROM r JOIN g USING (cluster_id)""")


def m12_auto(s: SparkSession, d: str) -> DataFrame:
    """A dry run and a real one over clusters whose confidence is their preview's, scaled; every eleventh was merged before."""
    x = rated(s, d)
    clusters = merges.preview(x, FIELDS, "quality").select("cluster_id", "master_id", F.round(F.col("confidence") * 2, 5).alias("confidence"), F.when(F.col("master_id") % 11 == 0, "merged").otherwise("active").alias("status"))
    empty, at = s.createDataFrame([], merges.LOG), F.lit("2024-01-01").cast("timestamp_ntz")
    runs = [merges.auto_merge(empty, x, clusters, at, dry_run=dry)[0].withColumn("dry_run", F.lit(dry)) for dry in (True, False)]
    return runs[0].unionByName(runs[1])


register("m12_auto_merge", m12_auto, RATED + f"""
, u AS (SELECT cluster_id, unnest({list(FIELDS)}) AS field, unnest([{', '.join(f'{f}::VARCHAR' for f in FIELDS)}]) AS value FROM r),
n AS (SELECT cluster_id, field, count(DISTINCT value) + max((value IS NULL)::INT) AS n FROM u GROUP BY 1, 2), c AS (SELECT cluster_id, count(*) FILTER (n > 2) AS manual FROM n GROUP BY 1),
w AS (SELECT cluster_id, arg_max(id, (quality, -id)) AS target_id, count(*) AS size, avg(quality) AS q FROM r GROUP BY 1 HAVING count(*) >= 2),
z AS (SELECT * FROM w JOIN c USING (cluster_id) WHERE round(q * (1 - manual * 0.1::DOUBLE) * 2, 5) >= 0.95 AND target_id % 11 > 0)
SELECT count(*) AS total_clusters, 0 AS merged_clusters, 0 AS merged_records, true AS dry_run FROM z UNION ALL SELECT count(*), count(*), sum(size - 1)::BIGINT, false FROM z""")
