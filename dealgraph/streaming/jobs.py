"""Structured Streaming jobs (R01-R06, R10) and their batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dealgraph.functions.workers import ship

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, schema: str = EVENTS, files_per_trigger: int = 1) -> DataFrame:
    """New files of a folder as a stream; its checkpoint is the resume offset."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def hourly_trend(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events per type and hour, with a watermark for late rows (batch or stream)."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("period"), "event_type", "n", "total")


def once_only(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each key once; on a stream, state is dropped behind the watermark."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key]).drop("at")


def sliding_failures(events: DataFrame, window: str = "6 hours", step: str = "1 hour", least: int = 2) -> DataFrame:
    """Users with at least that many errors in a sliding window."""
    timed = events.where("event_type = 'error'").withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at", "1 hour")
    return timed.groupBy(F.window("at", window, step).alias("w"), "user_id").agg(F.count("*").alias("failures")).where(F.col("failures") >= least).select(
        F.col("w.start").alias("window_start"), "user_id", "failures")


def _pass(times, start: int, used: int, width: int, most: int) -> tuple[list[bool], int, int]:
    """Which of ascending times pass: `most` per window, which starts at the first event after the last window's end."""
    out = []
    for t in times:
        if start < 0 or t - start >= width:
            start, used = t, 0
        used += 1
        out.append(used <= most)
    return out, start, used


def throttle(events: DataFrame, seconds: int = 3600, most: int = 2, key: str = "user_id") -> DataFrame:
    """(user_id, event_id) of the events that pass. On a stream the window's start and use are
    kept as state per key; a key with very many events holds two numbers, not its events."""
    ship(events.sparkSession)
    width = seconds * 1_000_000
    rows = events.select(F.col(key).cast("bigint").alias("user_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))

    if rows.isStreaming:
        def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            start, used = state.get if state.exists else (-1, 0)
            pdf = pd.concat(list(batches)).sort_values(["us", "event_id"])
            keep, start, used = _pass(pdf["us"], start, used, width, most)
            state.update((int(start), int(used)))
            yield pdf.loc[keep, ["event_id"]].assign(user_id=name[0])[["user_id", "event_id"]]

        return rows.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, event_id bigint", "start bigint, used bigint", "append", GroupStateTimeout.NoTimeout)

    # The batch twin sorts by (key, time) and carries the two numbers from row to row of a partition,
    # so that a key's rows are streamed, never gathered.
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, start, used = None, -1, 0
        for pdf in batches:
            keep = []
            for user, us in zip(pdf["user_id"], pdf["us"], strict=True):
                if user != name:
                    name, start, used = user, -1, 0
                ok, start, used = _pass([us], start, used, width, most)
                keep += ok
            yield pdf.loc[keep, ["user_id", "event_id"]]

    return rows.repartition("user_id").sortWithinPartitions("user_id", "us", "event_id").mapInPandas(run, "user_id bigint, event_id bigint")


#: What an event does to a chunk; anything else leaves it as it is.
ACTIONS = ("processing", "completed", "failed")


def chunk_states(log: DataFrame) -> DataFrame:
    """(chunk_id, status, resume_point, processed_at, error) of chunks by their log (chunk_id, at, seq, action, offset, error): the last action is the status, the offset of the last
    start of processing the resume point (0 if it has none), the time of the last completion is kept. On a stream, the state per chunk is these five values and the time
    of the last event, put out whenever it changes; late rows are placed by (at, seq), so that a restart anywhere, or rows in another order, end in the same states as the batch."""
    rows = log.where(F.col("action").isin(*ACTIONS)).select("chunk_id", F.unix_micros(F.col("at").cast("timestamp")).alias("us"), "seq", "action", F.coalesce("offset", F.lit(0)).cast("bigint").alias("offset"), "error")
    if not rows.isStreaming:
        order = F.struct("us", "seq")

        def last(column: str, action: str | None = None) -> Column:
            return F.max_by(column, order if action is None else F.when(F.col("action") == action, order))

        g = rows.groupBy("chunk_id").agg(last("action").alias("status"), F.coalesce(last("offset", "processing"), F.lit(0)).alias("resume_point"), F.max(F.when(F.col("action") == "completed", F.col("us"))).alias("us"),
                                         F.when(last("action") == "failed", last("error")).alias("error"))
        return g.select("chunk_id", "status", "resume_point", F.timestamp_micros("us").alias("processed_at"), "error")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # (us, seq) of the last event and of the last start, then what they say
        last, lseq, status, error, start, sseq, resume, done = state.get if state.exists else (-1, -1, "", None, -1, -1, 0, -1)
        for pdf in batches:
            for us, seq, action, offset, why in zip(pdf["us"], pdf["seq"], pdf["action"], pdf["offset"], pdf["error"], strict=True):
                if (us, seq) > (last, lseq):
                    last, lseq, status, error = us, seq, action, why if action == "failed" else None
                if action == "processing" and (us, seq) > (start, sseq):
                    start, sseq, resume = us, seq, offset
                if action == "completed":
                    done = max(done, us)
        state.update((int(last), int(lseq), status, error, int(start), int(sseq), int(resume), int(done)))
        yield pd.DataFrame({"chunk_id": [key[0]], "status": [status], "resume_point": [int(resume)], "processed_at": [pd.Timestamp(done, unit="us", tz="UTC") if done >= 0 else pd.NaT], "error": [error]})

    kept = "last bigint, lseq bigint, status string, error string, start bigint, sseq bigint, resume bigint, done bigint"
    return rows.groupBy("chunk_id").applyInPandasWithState(step, "chunk_id bigint, status string, resume_point bigint, processed_at timestamp, error string", kept, "update", GroupStateTimeout.NoTimeout)


def next_chunk(chunks: DataFrame, states: DataFrame, by: str = "date") -> DataFrame:
    """The next pending chunk of chunks (chunk_id, date_start, size_bytes): the oldest, the smallest (`size`) or the newest (`label_score`); then the smallest id."""
    order = {"date": F.asc("date_start"), "size": F.asc("size_bytes"), "label_score": F.desc("date_start")}[by]
    return chunks.join(states.select("chunk_id", "status"), "chunk_id", "left").where("status is null").drop("status").orderBy(order, "chunk_id").limit(1)


def run_to_memory(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns the rows that it has put out (for tests and small jobs)."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def upsert_batches(df: DataFrame, path: str, key: str, at: str, checkpoint: str):
    """K06, U04 on a stream: each micro-batch is merged with the table so far, the newest row per key
    winning, and written as a new version; the version's number makes a repeated batch harmless."""
    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number:
            batch = spark.read.schema(batch.schema).parquet(f"{path}/v{number - 1}").unionByName(batch)
        cols = [c for c in batch.columns if c != key]
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(at)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])
        newest.write.mode("overwrite").parquet(f"{path}/v{number}")

    return df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
