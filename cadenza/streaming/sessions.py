"""W2b on a stream: incremental listening sessions with Structured Streaming.

The batch operator ``sequence.sessions_by_window`` is Spark's
``session_window``; the same expression runs on a streaming play table.  A
watermark on ``ts`` bounds the state: a session is emitted (append mode) once
the watermark passes its end, i.e. no later play can extend it.  Late plays
older than the watermark are dropped by Spark, as usual for event-time state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cadenza.functions import constants as C
from cadenza.sources.schema import PLAY_SCHEMA, clean_plays


def read_play_stream(spark, path: str, fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:  # noqa: ANN001
    """Stream canonical plays from files arriving in ``path`` (explicit schema)."""
    r = spark.readStream.schema(PLAY_SCHEMA).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return clean_plays(r.load(path))


def stream_sessions(plays: DataFrame, keys: Sequence[str] = ("user_id",),
                    gap_minutes: int = C.SESSION_GAP_MINUTES, watermark: str = "2 hours") -> DataFrame:
    """Streaming sessions (end-to-end gap): keys, start_ts, end_ts, plays, ms.

    Watermarks need an instant (TIMESTAMP); ``ts`` is the UTC wall clock
    (TIMESTAMP_NTZ), so the event time is the same instant built from its
    epoch microseconds (exact, independent of the session time zone)."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    event = F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col("ts")))
    w = F.session_window("event_time", f"{gap_minutes} minutes")
    timed = plays.withColumn("event_time", event).withWatermark("event_time", watermark)
    return timed.groupBy(*keys, w.alias("w")).agg(
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.count(F.lit(1)).alias("plays"),
        F.sum("ms_played").alias("ms"),
    ).drop("w")


def write_sessions(sessions: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append closed sessions to a Parquet table; progress in ``checkpoint``
    (a shared folder, so a restarted query resumes exactly once)."""
    q = sessions.writeStream.outputMode("append").format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint)
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 minute")
    return q.start()
