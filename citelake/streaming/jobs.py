"""Job logs ``(job_id, event_id, ts, status, progress)``: state, sessions, statistics, windows.

The windowed metrics take a batch or a stream; the rest are batch tables over the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake import dims
from citelake.functions.text import rounded

TERMINAL = ("completed", "failed", "cancelled")
ACTIVE = ("pending", "running")


def job_latest(log: DataFrame) -> DataFrame:
    """Newest state of each job, newest job first."""
    last = F.max(F.struct("ts", "event_id", "status", "progress"))
    return (
        log.groupBy("job_id")
        .agg(last.alias("__l"), F.min("ts").alias("created_at"))
        .select("job_id", "created_at", "__l.ts", "__l.event_id", "__l.status", "__l.progress")
        .orderBy(F.desc("ts"), F.desc("event_id"))
    )


def job_sessions(log: DataFrame) -> DataFrame:
    """Created, first running and last terminal time of each job, and seconds from start to end."""
    times = log.groupBy("job_id").agg(
        F.min("ts").alias("created_at"),
        F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"),
        F.max(F.when(F.col("status").isin(*TERMINAL), F.col("ts"))).alias("finished_at"),
        F.count(F.lit(1)).alias("events"),
    )
    return times.withColumn("seconds", F.timestamp_diff("SECOND", F.col("started_at"), F.col("finished_at")))


def job_retention(log: DataFrame, as_of: Column, max_age_hours: int = 24) -> DataFrame:
    """Jobs that stay: all active ones, and ended ones created within ``max_age_hours``."""
    latest = job_latest(log)
    old = F.col("created_at") < as_of - F.expr(f"INTERVAL {max_age_hours} HOURS")
    return latest.where(~(F.col("status").isin(*TERMINAL) & old)).select("job_id", "status", "created_at")


def job_stats(log: DataFrame) -> DataFrame:
    """Totals over the jobs' newest states: success rate, mean seconds of completed jobs, results."""
    jobs = job_latest(log).select("job_id", "status", "progress").join(
        job_sessions(log).select("job_id", "seconds"), "job_id"
    )
    done = F.col("status") == "completed"
    total = F.count(F.lit(1))
    return jobs.agg(
        total.alias("total_jobs"),
        F.count_if(done).alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status").isin(*ACTIVE)).alias("active"),
        rounded(F.count_if(done) / total, 6).alias("success_rate"),
        rounded(F.coalesce(F.avg(F.when(done, F.col("seconds"))), F.lit(0.0)), 6).alias("mean_seconds"),
        F.coalesce(F.sum(F.when(done, F.floor("progress"))), F.lit(0)).alias("extracted"),
    )


def progress_phase(percent: Column) -> Column:
    phase = None
    for bound, name in reversed(dims.PROGRESS_PHASES):
        phase = F.lit(name) if bound is None else F.when(percent < bound, F.lit(name)).otherwise(phase)
    return phase


def job_windows(log: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Events and mean progress per window and status. On a stream, rows later than ``delay`` are dropped."""
    timed = log.withWatermark("ts", delay) if log.isStreaming else log
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        timed.groupBy(window, "status")
        .agg(F.count(F.lit(1)).alias("events"), rounded(F.avg("progress"), 6).alias("mean_progress"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "status", "events", "mean_progress")
    )


def stream_sessions(log: DataFrame, gap: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Streaming sessions of a job: events closer than ``gap`` belong together."""
    timed = log.withWatermark("ts", delay) if log.isStreaming else log
    return (
        timed.groupBy(F.session_window("ts", gap), "job_id")
        .agg(F.count(F.lit(1)).alias("events"))
        .select("job_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events")
    )
