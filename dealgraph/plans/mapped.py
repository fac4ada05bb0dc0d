"""Columns mapped by specifications, chunks and ordered intersections, with the SQL that gives the same rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgraph.functions import transforms
from dealgraph.operators import opportunity
from dealgraph.plans.registry import register
from dealgraph.plans.written import written, written_sql
from dealgraph.sources.fixtures import table
from dealgraph.streaming import jobs

SPECS = ({"type": "parse_currency"}, {"type": "parse_number"}, {"type": "parse_date"}, {"type": "concat", "params": {"separator": " / "}}, {"type": "split", "params": {"separator": ".", "index": 1}}, {"type": "lowercase"}, {"type": "uppercase"}, {"type": "trim"},
         {"type": "reverse"}, None, {"type": "split", "params": {"separator": "$"}}, {"type": "concat"})
VALUES = ["$ {} K", "{}.50 m", "  {},000 ", "{}%", "", None, "a. {} .c", "€1,{}", "x{}", "-{}e2 kg", "A$b$ {}", "MiXed {}"]
MAPPED_DATES = ["2024-03-0{}", "{}/5/2024", "Mar {}, 2024", "March 1{}, 2023", "2024-03-1{}T10:00:00Z", "soon", None, " 2024-12-2{} "]


def raw(s: SparkSession, d: str) -> DataFrame:
    """(id, a, b, c): orders' numbers, statuses and dates as an import has them."""
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(k.alias("id"), written((k % 1000).cast("string"), k, VALUES).alias("a"), F.when(k % 4 > 0, F.col("o_orderstatus")).alias("b"), written((k % 9 + 1).cast("string"), k, MAPPED_DATES).alias("c"))


def specs(s: SparkSession, d: str) -> DataFrame:
    """A specification per nation: its target is the nation's number."""
    k = F.col("n_nationkey")
    spec = F.get(F.array(*[F.lit(json.dumps(x) if x else None).cast("string") for x in SPECS]), k % len(SPECS))
    return table(s, d, "nation").select(F.concat(F.lit("t"), F.lpad(k.cast("string"), 2, "0")).alias("target"), F.when(k % len(SPECS) == 2, F.array(F.lit("c"))).when(k % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("sources"), spec.alias("spec"))


_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_NUMBER = r"try_cast(nullif(regexp_extract(regexp_replace({0}, '^\s+', ''), '^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)', 1), '') AS DOUBLE)"


def _spec_sql(k: int) -> str:
    spec = SPECS[k % len(SPECS)] or {}
    kind, params = spec.get("type"), spec.get("params", {})
    x = "c" if k % len(SPECS) == 2 else "a"
    clean = _TRIM.format(x)
    if kind == "parse_currency":
        bare = rf"regexp_replace({x}, '[$€£¥₹,\s]', '', 'g')"
        return f"{_NUMBER.format(f'CASE WHEN lower(right({bare}, 1)) IN (chr(107), chr(109)) THEN left({bare}, length({bare}) - 1) ELSE {bare} END')} * CASE lower(right({bare}, 1)) WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 ELSE 1 END"
    if kind == "parse_number":
        number = _NUMBER.format("replace(" + clean + ", ',', '')")
        return f"CASE WHEN right({clean}, 1) = '%' THEN {_NUMBER.format(clean)} / 100 ELSE {number} END"
    if kind == "parse_date":
        return rf"CASE WHEN regexp_matches({clean}, '^\d{{4}}-\d{{2}}-\d{{2}}') THEN strftime(try_strptime({clean}[1:10], '%Y-%m-%d'), '%Y-%m-%d') ELSE strftime(coalesce(try_strptime({clean}, '%m/%d/%Y'), try_strptime({clean}, '%b %d, %Y'), try_strptime({clean}, '%B %d, %Y')), '%Y-%m-%d') END"
    if kind == "concat" and k % 2 == 1:
        return f"array_to_string(list_filter([a, b], lambda v: v IS NOT NULL AND v <> ''), '{params.get('separator', ' ')}')"
    if kind == "split":
        parts = f"list_transform(string_split({x}, '{params['separator']}'), lambda v: {_TRIM.format('v')})"
        return f"{parts}[{params['index'] + 1}]" if "index" in params else parts
    return {"lowercase": f"lower({x})", "uppercase": f"upper({x})", "trim": clean}.get(kind, x)


register("f41_transforms", lambda s, d: transforms.apply_specs(raw(s, d), specs(s, d), ("id",)), f"WITH r AS (SELECT o_orderkey AS id, {written_sql('(o_orderkey % 1000)::VARCHAR', 'o_orderkey', VALUES)} AS a, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS b, {written_sql('(o_orderkey % 9 + 1)::VARCHAR', 'o_orderkey', MAPPED_DATES)} AS c FROM orders) SELECT id, "
         + ", ".join(f"{_spec_sql(k)} AS t{k:02d}" for k in range(25)) + " FROM r")


def chunk_log(events: DataFrame) -> DataFrame:
    """Events as a log of chunks: a user is a chunk, what it does decides the action."""
    action = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "processing").otherwise("seen")
    return events.select(F.col("user_id").alias("chunk_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), action.alias("action"), (F.col("event_id") % 1000).alias("offset"), F.concat(F.lit("error "), F.col("event_id").cast("string")).alias("error"))


_LOG = """WITH l AS (SELECT user_id AS chunk_id, ts, event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'processing' END AS action FROM events),
s AS (SELECT chunk_id, arg_max(action, (ts, event_id)) AS status, coalesce(arg_max(event_id % 1000, (ts, event_id)) FILTER (action = 'processing'), 0)::BIGINT AS resume_point, max(ts) FILTER (action = 'completed') AS processed_at, arg_max(event_id, (ts, event_id)) AS e FROM l WHERE action IS NOT NULL GROUP BY 1)"""
register("r04_chunk_states", lambda s, d: jobs.chunk_states(chunk_log(table(s, d, "events"))).withColumn("processed_at", F.date_format("processed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")), _LOG + " SELECT chunk_id, status, resume_point, strftime(processed_at, '%Y-%m-%d %H:%M:%S.%f') AS processed_at, CASE WHEN status = 'failed' THEN 'error ' || e END AS error FROM s")


def pending_chunks(s: SparkSession, d: str) -> DataFrame:
    """The next chunk by each order: customers are chunks, and the users' states are theirs."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("chunk_id"), (F.col("c_custkey") * 37 % 1009).alias("date_start"), F.col("c_acctbal").alias("size_bytes"))
    states = jobs.chunk_states(chunk_log(table(s, d, "events")))
    out = [jobs.next_chunk(c, states, by).select(F.lit(by).alias("by"), "chunk_id") for by in ("date", "size", "label_score")]
    return out[0].unionByName(out[1]).unionByName(out[2])


register("r04_next_chunk", pending_chunks, _LOG + ", c AS (SELECT c_custkey AS chunk_id, c_custkey * 37 % 1009 AS d, c_acctbal AS z FROM customer ANTI JOIN s ON chunk_id = c_custkey) SELECT 'date' AS by, arg_min(chunk_id, (d, chunk_id)) AS chunk_id FROM c UNION ALL SELECT 'size', arg_min(chunk_id, (z, chunk_id)) FROM c UNION ALL SELECT 'label_score', arg_min(chunk_id, (-d, chunk_id)) FROM c")


def o03(s: SparkSession, d: str) -> DataFrame:
    """Tags of a supplier's lines, in their order: the part's words and type."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.array_append(F.split("p_name", " "), F.col("p_type")).alias("tags"))
    lines = table(s, d, "lineitem").join(p, "l_partkey").select(F.col("l_suppkey").alias("vendor_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), "tags")
    return opportunity.reseeded_intersections(lines, "vendor_id", "at", "tags").withColumn("tags", F.array_join("tags", ","))


register("o03_shared_tags", o03, """
WITH RECURSIVE l AS (SELECT l_suppkey AS v, string_split(p_name, ' ') || [p_type] AS tags, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS k FROM lineitem JOIN part ON p_partkey = l_partkey),
f(v, k, tags) AS (SELECT v, k, tags FROM l WHERE k = 1 UNION ALL SELECT l.v, l.k, CASE WHEN len(f.tags) = 0 THEN l.tags ELSE list_filter(f.tags, lambda t: list_contains(l.tags, t)) END FROM f JOIN l ON l.v = f.v AND l.k = f.k + 1)
SELECT v AS vendor_id, array_to_string(tags, ',') AS tags FROM f QUALIFY row_number() OVER (PARTITION BY v ORDER BY k DESC) = 1""")
