"""The job queue as snapshot transforms: claim order, coalescing, retries, promotion, reclaim and recurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def claim_order(jobs: DataFrame) -> DataFrame:
    """Position of each queued job: by priority, scheduled_for (none first), created_at, id."""
    queued = jobs.where(F.col("status") == "queued")
    order = [F.asc("priority"), F.asc_nulls_first("scheduled_for"), F.asc("created_at"), F.asc("id")]
    return queued.withColumn("position", F.row_number().over(Window.partitionBy("queue").orderBy(*order)).cast("long"))


def coalesce_jobs(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """One job for each key: the least priority and schedule, the most attempts, the last payload, and how many."""
    return jobs.groupBy(*keys).agg(
        F.min("priority").alias("priority"),
        F.max("max_attempts").alias("max_attempts"),
        F.min("scheduled_for").alias("scheduled_for"),
        F.max_by("payload", F.struct("created_at", "id")).alias("payload"),
        F.count(F.lit(1)).alias("coalesced"),
    )


def after_failure(attempts: Column, most: Column) -> Column:
    return F.when(attempts < most, "retry_wait").otherwise("failed")


def next_state(status: Column, now: Column, wait_until: Column, started: Column, reclaim_minutes: int = 45) -> Column:
    """What time alone makes of a job: a wait that is over queues it; a run that is too old is taken back."""
    old = F.unix_micros(now.cast("timestamp")) - F.unix_micros(started.cast("timestamp")) > reclaim_minutes * 60_000_000
    return F.when((status == "retry_wait") & (wait_until <= now), "queued").when((status == "running") & old, "queued").otherwise(status)


def due_note(due: Column, fired: Column, late_minutes: int = 15) -> Column:
    """Whether a reminder fires so late that it says so."""
    return F.unix_micros(fired.cast("timestamp")) - F.unix_micros(due.cast("timestamp")) > late_minutes * 60_000_000


def recurrence_seconds(rule: Column) -> Column:
    """Seconds of an "every:<N><smhdw>" rule; null for other rules."""
    number = F.regexp_extract(rule, r"^every:([0-9]+)([smhdw])$", 1)
    unit = F.regexp_extract(rule, r"^every:([0-9]+)([smhdw])$", 2)
    seconds = F.element_at(F.create_map(*(F.lit(x) for kv in {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}.items() for x in kv)), F.when(unit != "", unit))
    return F.when(number != "", number.cast("long") * seconds).cast("long")


def next_occurrence(last: Column, rule: Column, now: Column) -> Column:
    """The first time after now that lies whole periods after last (epoch seconds)."""
    period = recurrence_seconds(rule)
    return F.when(now < last, last).otherwise(last + (F.floor((now - last) / period) + 1) * period)


def task_order(confirmed: Column, priority: Column, due: Column, created: Column) -> list[Column]:
    """Confirmed tasks first, then by priority, due day (none last), creation."""
    return [F.desc(confirmed), F.asc(priority), F.asc(F.coalesce(due, F.lit("9999-12-31"))), F.asc(created)]
