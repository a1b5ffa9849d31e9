"""Structured Streaming jobs over arriving messages (ST1-ST4).

The same column expressions as the batch pipeline run on a ``readStream`` of
the events table, stored as one file or as a folder of files.

- ``stream_reports`` (ST1): stateless, append mode, parquet sink.
- ``stream_verdict_windows`` (ST2): event-time windows, tumbling or sliding, with a
  watermark; rows later than the watermark are dropped.
- ``stream_session_counts`` (ST2): sessions of a user, merged in the state store.
- ``stream_history`` (ST3): ``foreachBatch`` merges each batch into the keyed history
  store (``sources.history``): a batch reads and writes the buckets of its users only,
  and a replayed batch is merged once.
- ``stream_dedup`` (ST4): repeated submissions of a message collapse with
  ``dropDuplicatesWithinWatermark``.

Windows and sessions run in append mode: the sink gets those that the watermark has
closed. Those still open when a bounded run ends are in the stream's own state, which is
read from the checkpoint (Spark's ``statestore`` source) and added to the result. Nothing
is computed again from the input, and an open window goes on growing in the next run.

The ``run_*`` helpers run a job to completion with an ``availableNow`` trigger and return
the result as a batch DataFrame. ``at`` names the folder of a job (sink and checkpoint): a
run on the folder of an earlier run resumes from its offsets and state. Without ``at`` a
job starts in a new folder below the shared one. An input without files, or without rows,
gives an empty result.
"""
from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.investigate import investigate
from ..session import work_folder
from ..sources.folders import Folder
from ..sources.history import HistoryStore, newest_cases
from ..sources.intake import split_intake
from ..sources.messages import view
from ..sources.tables import deal, table_path

EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def message_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None, dealt: bool = False) -> DataFrame:
    """The ``messages`` view over a stream of event files; ``max_files`` bounds a
    micro-batch (default: all files that are there). ``dealt``: rows are dealt out to tasks first."""
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # a file source takes folders or patterns: this pattern matches the table's name alone,
    # be it a file or a folder
    path = table_path(sf_dir, "events")
    events = reader.parquet(f"{path[:-1]}[{path[-1]}]").select("event_id", "ts", "user_id", "event_type")
    return _view(deal(events) if dealt else events)


def _view(events: DataFrame) -> DataFrame:
    # watermarks need TIMESTAMP (the table stores wall-clock TIMESTAMP_NTZ; with
    # the session in UTC the instants equal the wall clock)
    return view(events).withColumn("ts", F.col("ts").cast("timestamp"))


def _clock(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def report_columns(rep: DataFrame) -> DataFrame:
    return rep.select("msg_id", "user_id", "ts", "situation", "verdict", "risk_score", "confidence",
                      F.size("domain_reports").alias("domain_count"),
                      F.size("indicators").alias("indicator_count"), "report_draft")


def stream_reports(messages: DataFrame) -> DataFrame:
    """ST1: full reports for accepted messages (stateless)."""
    accepted, _ = split_intake(messages)
    return report_columns(investigate(accepted))


def stream_verdict_windows(reports: DataFrame, window: str = "1 day",
                           delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """ST2: verdict counts per event-time window; late rows are dropped."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    counted = (reports.withWatermark("ts", delay)
               .groupBy(w.alias("w"), "verdict")
               .agg(F.count(F.lit(1)).alias("n_messages"),
                    F.max("risk_score").alias("max_score")))
    return counted.select(_clock(F.col("w.start")).alias("window_start"), _clock(F.col("w.end")).alias("window_end"),
                          "verdict", "n_messages", "max_score")


def stream_session_counts(reports: DataFrame, gap: str = "30 minutes",
                          delay: str = "1 hour") -> DataFrame:
    """ST2 (session windows): cases per user session."""
    counted = (reports.withWatermark("ts", delay)
               .groupBy(F.session_window("ts", gap).alias("s"), "user_id")
               .agg(F.count(F.lit(1)).alias("n_messages"), F.max("risk_score").alias("max_score")))
    return counted.select("user_id", _clock(F.col("s.start")).alias("session_start"),
                          _clock(F.col("s.end")).alias("session_end"), "n_messages", "max_score")


HISTORY_COLUMNS = ["user_id", "msg_id", "ts", "verdict", "risk_score"]


def history_upsert(root: str):
    """ST3: ``foreachBatch`` function merging a batch into the history store at ``root``."""
    def upsert(batch: DataFrame, batch_id: int) -> None:
        HistoryStore(batch.sparkSession, root).merge(batch.select(*HISTORY_COLUMNS), batch_id)
    return upsert


def stream_dedup(messages_a: DataFrame, messages_b: DataFrame, delay: str = "1 hour") -> DataFrame:
    """ST4: the same message submitted twice is kept once."""
    both = messages_a.unionByName(messages_b)
    return (both.withWatermark("ts", delay)
            .dropDuplicatesWithinWatermark(["msg_id"])
            .select("msg_id", "user_id", _clock(F.col("ts")).alias("ts")))


# --- runners (availableNow) ----------------------------------------------------------

def _folders(spark: SparkSession, name: str, at: str | None) -> tuple[str, str]:
    base = (at or work_folder(spark, "streams", name)).rstrip("/")
    return Folder(spark, os.path.join(base, "out")).make().path, os.path.join(base, "checkpoint")


def _run_to_parquet(df: DataFrame, out: str, ckpt: str) -> DataFrame:
    """Run an append stream to its end; everything its sink holds."""
    (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return df.sparkSession.read.schema(df.schema).parquet(out)


def open_groups(spark: SparkSession, ckpt: str, columns: list[Column], schema: StructType) -> DataFrame:
    """Groups that the stream of a checkpoint still holds open: ``columns`` over the ``key``
    and ``value`` of its state after the last batch."""
    if not Folder(spark, ckpt).names("commits"):
        return spark.createDataFrame([], schema)
    return spark.read.format("statestore").load(ckpt).select(*columns)


def run_stream_reports(spark: SparkSession, sf_dir: str, at: str | None = None) -> DataFrame:
    return _run_to_parquet(stream_reports(message_stream(spark, sf_dir, dealt=True)), *_folders(spark, "reports", at))


def run_windows(windows: DataFrame, out: str, ckpt: str) -> DataFrame:
    """Run a stream of ``stream_verdict_windows``: closed windows, then open ones."""
    closed = _run_to_parquet(windows, out, ckpt)
    w, value = F.col("key.window"), F.col("value")
    return closed.unionByName(open_groups(windows.sparkSession, ckpt, [
        _clock(w["start"]).alias("window_start"), _clock(w["end"]).alias("window_end"),
        F.col("key.verdict").alias("verdict"), value["count"].alias("n_messages"), value["max"].alias("max_score")],
        windows.schema))


def run_session_counts(sessions: DataFrame, out: str, ckpt: str) -> DataFrame:
    """Run a stream of ``stream_session_counts``: closed sessions, then open ones."""
    closed = _run_to_parquet(sessions, out, ckpt)
    value = F.col("value")
    return closed.unionByName(open_groups(sessions.sparkSession, ckpt, [
        value["user_id"].alias("user_id"), _clock(value["session_window"]["start"]).alias("session_start"),
        _clock(value["session_window"]["end"]).alias("session_end"), value["count"].alias("n_messages"),
        value["max"].alias("max_score")], sessions.schema))


def run_verdict_windows(spark: SparkSession, sf_dir: str, at: str | None = None) -> DataFrame:
    rep = stream_reports(message_stream(spark, sf_dir, dealt=True))
    return run_windows(stream_verdict_windows(rep), *_folders(spark, "windows", at))


def run_sliding_windows(spark: SparkSession, sf_dir: str, at: str | None = None) -> DataFrame:
    rep = stream_reports(message_stream(spark, sf_dir, dealt=True))
    return run_windows(stream_verdict_windows(rep, "1 day", "1 hour", "6 hours"), *_folders(spark, "sliding", at))


def run_sessions(spark: SparkSession, sf_dir: str, at: str | None = None) -> DataFrame:
    rep = stream_reports(message_stream(spark, sf_dir, dealt=True))
    return run_session_counts(stream_session_counts(rep), *_folders(spark, "sessions", at))


def run_history(spark: SparkSession, sf_dir: str, at: str | None = None) -> DataFrame:
    """The history after all batches, with the rank of each case."""
    out, ckpt = _folders(spark, "history", at)
    rep = stream_reports(message_stream(spark, sf_dir, dealt=True))
    (rep.writeStream.foreachBatch(history_upsert(out)).option("checkpointLocation", ckpt)
     .trigger(availableNow=True).start().awaitTermination())
    return newest_cases(HistoryStore(spark, out, rep.select(*HISTORY_COLUMNS).schema).read())


def run_dedup(spark: SparkSession, sf_dir: str, at: str | None = None) -> DataFrame:
    return _run_to_parquet(stream_dedup(message_stream(spark, sf_dir), message_stream(spark, sf_dir)),
                           *_folders(spark, "dedup", at))
