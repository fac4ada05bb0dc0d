"""Batch twins of the streaming jobs, and sources over texts made of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgraph.plans.registry import register
from dealgraph.plans.written import written, written_sql
from dealgraph.sources import files
from dealgraph.sources.fixtures import table
from dealgraph.streaming import jobs

register("r03_once_only", lambda s, d: jobs.once_only(table(s, d, "events").unionByName(table(s, d, "events"))).select("event_id"), "SELECT event_id FROM events")
register("r05_throttle", lambda s, d: jobs.throttle(table(s, d, "events"), 12 * 3600, 2), """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, event_id, us, k, us AS start, 1 AS used FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.us, e.k, CASE WHEN e.us - w.start >= 43200000000 THEN e.us ELSE w.start END, CASE WHEN e.us - w.start >= 43200000000 THEN 1 ELSE w.used + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT user_id, event_id FROM w WHERE used <= 2""")
register("r10_hourly_trend", lambda s, d: jobs.hourly_trend(table(s, d, "events")).select(F.col("period").cast("timestamp_ntz").alias("period"), "event_type", "n", F.round("total", 4).alias("total")), "SELECT date_trunc('hour', ts)::TIMESTAMP AS period, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
register("r06_sliding_failures", lambda s, d: jobs.sliding_failures(table(s, d, "events")).groupBy("user_id").agg(F.count("*").alias("windows"), F.max("failures").alias("most")), """
WITH w AS (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * i AS start, count(*) AS failures FROM events, range(6) r(i) WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT user_id, count(*) AS windows, max(failures) AS most FROM w GROUP BY 1""")

PATHS = ["/x/{} - Deals.xlsx", "/y/{}_deals.csv", "/z/{}.TXT", "teams_2024-05-01_{}.vtt", "/m/in.mbox", "/q/{}-pipeline.json", "zoom-us_2023-12-31_a_{}.txt", "no-extension-{}", "{} Registrations.pdf"]


def paths(s: SparkSession, d: str) -> DataFrame:
    """(id, x): files named after the customers' segments."""
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), written(F.lower("c_mktsegment"), F.col("c_custkey"), PATHS).alias("x"))


_PATHS = f"WITH t AS (SELECT c_custkey AS id, {written_sql('lower(c_mktsegment)', 'c_custkey', PATHS)} AS x FROM customer) "
register("s07_vendor_of_file", lambda s, d: paths(s, d).select("id", files.vendor_from_file_name(F.col("x")).alias("vendor")), _PATHS + r"""
, n AS (SELECT id, CASE WHEN regexp_matches(x, '\.[A-Za-z0-9]+$') THEN regexp_replace(list_last(string_split(x, '/')), '\.[A-Za-z0-9]+$', '') ELSE '' END AS n FROM t)
SELECT id, trim(replace(regexp_replace(n, '(?i)[\s_-]*(deal|deals|registration|registrations|pipeline|vendor|vendors)\s*$', ''), '_', ' ')) AS vendor FROM n""")
register("s21_file_kind", lambda s, d: paths(s, d).select("id", files.file_kind(F.col("x")).alias("kind")), _PATHS + """
SELECT id, coalesce(MAP {'mbox': 'mail', 'eml': 'mail', 'csv': 'table', 'tsv': 'table', 'xlsx': 'spreadsheet', 'xls': 'spreadsheet', 'vtt': 'transcript', 'pdf': 'document', 'docx': 'document', 'txt': 'document', 'json': 'json', 'jsonl': 'json'}[lower(list_last(string_split(x, '.')))], 'unknown') AS kind FROM t""")
register("s29_file_name_parts", lambda s, d: paths(s, d).select("id", files.file_name_parts(F.col("x")).alias("p")).select("id", "p.*"), _PATHS + r"""
, p AS (SELECT id, CASE WHEN regexp_matches(x, '^[A-Za-z0-9-]+_\d{4}-\d{2}-\d{2}_.+\.[A-Za-z0-9]+$') THEN x END AS x FROM t)
SELECT id, split_part(x, '_', 1) AS source, split_part(x, '_', 2) AS date, regexp_replace(array_to_string(string_split(x, '_')[3:], '_'), '\.[A-Za-z0-9]+$', '') AS description FROM p""")
SPOKEN = ["[00:00:05] Ann Lee: {}", "Bob: Hi: {}", "noise {}", "[01:02] O'Neil-X. Jr: {} ", "lower: {}"]


def s17(s: SparkSession, d: str) -> DataFrame:
    """Every turn as two lines of a transcript: itself, and one that no one speaks."""
    t = table(s, d, "conversations").withColumn("line", written(F.element_at(F.split("text", "\n"), 1), F.col("conv_id") + F.col("turn"), SPOKEN))
    return t.select("conv_id", "turn", F.explode(files.speaker_turns(F.concat(F.lit("(applause)\n"), F.col("line")))).alias("t")).select("conv_id", "turn", "t.*")


register("s17_speaker_turns", s17, rf"""
WITH t AS (SELECT conv_id, turn, {written_sql('string_split(text, chr(10))[1]', '(conv_id + turn)', SPOKEN)} AS x FROM conversations),
a AS (SELECT conv_id, turn, CASE WHEN x LIKE '[%' THEN x[2:strpos(x, ']') - 1] END AS "at", CASE WHEN x LIKE '[%' THEN trim(x[strpos(x, ']') + 1:]) ELSE x END AS x FROM t)
SELECT conv_id, turn, 0 AS pos, "at", x[1:strpos(x, ':') - 1] AS speaker, trim(x[strpos(x, ':') + 1:]) AS text FROM a WHERE regexp_matches(x, '^[A-Z][A-Za-z ''.-]*: ')""")


def s18(s: SparkSession, d: str) -> DataFrame:
    """Every turn as a meeting's export, in two dialects."""
    c, odd = table(s, d, "conversations"), F.col("turn") % 2 == 1
    one = F.to_json(F.struct(F.array(F.struct(F.col("role").alias("name"), F.col("text").alias("content"), (F.col("turn") * 1.5).alias("timestamp"))).alias("segments")))
    other = F.to_json(F.struct(F.array(F.struct(F.lit("x").alias("text"), F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("double").alias("start")), F.struct(F.col("text"), F.when(F.col("turn") % 4 == 0, F.col("role")).alias("speaker"), F.col("turn").cast("double").alias("start"))).alias("transcript")))
    return c.select("conv_id", "turn", F.explode(files.json_turns(F.when(odd, one).otherwise(other))).alias("t")).select("conv_id", "turn", "t.pos", "t.at", "t.speaker", F.md5("t.text").alias("digest"))


register("s18_json_turns", s18, """
SELECT conv_id, turn, 0 AS pos, turn * 1.5::DOUBLE AS "at", role AS speaker, md5(text) AS digest FROM conversations WHERE turn % 2 = 1
UNION ALL SELECT conv_id, turn, 0, NULL, 'Unknown', md5('x') FROM conversations WHERE turn % 2 = 0
UNION ALL SELECT conv_id, turn, 1, turn::DOUBLE, CASE WHEN turn % 4 = 0 THEN role ELSE 'Unknown' END, md5(text) FROM conversations WHERE turn % 2 = 0""")
