"""The job queue as a state machine for each kind of work: requests for the same work become one job, a running job has
one follow-up at most, and time alone ends waits and runs that are stuck."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds after which a run is stuck, and after which a failure is put away.
STUCK_MS, ARCHIVE_MS = 15 * 60_000, 14 * 86_400_000
KEYS = ["job_type", "work"]
#: What happens: enqueue, claim, succeed, fail, cancel or retry; `at` and `due` are epoch milliseconds, seq orders equal times.
EVENT = "job_type string, work string, at long, seq long, event string, job_id string, priority int, max_attempts int, payload string, due long, retry boolean, error string"
JOB = "job_type string, work string, job_id string, status string, priority int, attempts int, max_attempts int, payload string, due long, replaces string, coalesced int, created long, started long, finished long, error string, change int, at long"
EVENT_NAMES, JOB_NAMES = ([x.split()[0] for x in kind.split(", ")] for kind in (EVENT, JOB))
JOB_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}


@dataclass
class Job:
    job_id: str
    status: str
    priority: int
    attempts: int
    max_attempts: int
    payload: str
    due: int | None
    replaces: str | None
    coalesced: int
    created: int
    started: int | None = None
    finished: int | None = None
    error: str | None = None
    change: int = 0  # how often the job has changed


def merged_payload(old: str | None, new: str | None) -> str:
    """The new payload over the old one, key by key; batches of both are kept, the newest as batch_id. A payload that is
    no object is replaced."""
    a, b = ((json.loads(x) if x else {}) for x in (old, new))
    if not (isinstance(a, dict) and isinstance(b, dict)):
        return json.dumps(b, sort_keys=True)
    batches = list(dict.fromkeys(str(x) for p in (a, b) for x in [p.get("batch_id"), *(p.get("batch_ids") or [])] if x))
    both = a | {k: v for k, v in b.items() if k not in ("batch_id", "batch_ids")}
    return json.dumps(both | ({"batch_ids": batches, "batch_id": batches[-1]} if batches else {}), sort_keys=True)


@dataclass
class Work:
    """The jobs of one key that are not over, and failed ones until they are put away. `changed` is what is new."""

    stuck_ms: int = STUCK_MS
    stuck_is: str = "failure"  # or "requeued": taken back without counting as a failure
    jobs: dict[str, Job] = field(default_factory=dict)
    changed: list[tuple[Job, int]] = field(default_factory=list)

    def _put(self, job: Job, at: int, **new: Any) -> None:
        for k, v in new.items():
            setattr(job, k, v)
        job.change += 1
        self.jobs[job.job_id] = job
        self.changed.append((Job(**asdict(job)), at))
        if job.status in ("succeeded", "canceled", "archived"):
            del self.jobs[job.job_id]

    def _first(self, status: str) -> Job | None:
        return min((j for j in self.jobs.values() if j.status == status), key=lambda j: (j.priority, j.created, j.job_id), default=None)

    def _failed(self, job: Job, at: int, error: str | None, retry: bool) -> None:
        again = retry and job.attempts < job.max_attempts
        self._put(job, at, status="retry_wait" if again else "failed", due=at if again else None, started=None, finished=at, error=error)

    def deadline(self, job: Job) -> int | None:
        """When time alone changes a job."""
        return {"retry_wait": job.due, "running": (job.started or 0) + self.stuck_ms, "failed": (job.finished or 0) + ARCHIVE_MS}.get(job.status)

    def pass_time(self, now: int) -> None:
        """All that time brings about until now, in order."""
        while True:
            due = min(((d, j.job_id) for j in self.jobs.values() if (d := self.deadline(j)) is not None and d <= now), default=None)
            if due is None:
                return
            at, job = due[0], self.jobs[due[1]]
            if job.status == "retry_wait":
                self._put(job, at, status="queued")
            elif job.status == "failed":
                self._put(job, at, status="archived")
            elif self.stuck_is == "requeued":
                self._put(job, at, status="queued", started=None)
            else:
                self._failed(job, at, "stuck", True)

    def handle(self, e: dict) -> None:
        """One event. Without a job id, it is for the queued job (claim), the running one (succeed, fail), or either."""
        at, kind = e["at"], e["event"]
        self.pass_time(at - 1)
        if kind == "enqueue":
            return self._enqueue(e)
        job = self.jobs.get(e["job_id"]) if e["job_id"] else self._first("queued" if kind == "claim" else "running") or (self._first("queued") if kind == "cancel" else None)
        if job is None:
            return None
        if kind == "claim" and job.status == "queued" and (job.due is None or job.due <= at):
            self._put(job, at, status="running", attempts=job.attempts + 1, started=at, error=None)
        elif kind == "succeed" and job.status == "running":
            self._put(job, at, status="succeeded", finished=at, error=None)
        elif kind == "fail" and job.status == "running":
            self._failed(job, at, e["error"], e["retry"] is not False)
        elif kind == "cancel":
            self._put(job, at, status="canceled", finished=at, error=job.error or "canceled by user")
        elif kind == "retry" and job.status in ("failed", "retry_wait"):
            self._put(job, at, status="queued", due=None, finished=None)
        return None

    def _enqueue(self, e: dict) -> None:
        at, job = e["at"], self._first("queued")
        priority, most = e["priority"] if e["priority"] is not None else 100, e["max_attempts"] or 3
        if job is None:
            running = self._first("running")
            self._put(Job(e["job_id"] or f"{at}-{e['seq']}", "queued", priority, 0, most, merged_payload("{}", e["payload"]), e["due"], running and running.job_id, 0, at), at)
        else:
            due = min((x for x in (job.due, e["due"]) if x is not None), default=None)
            self._put(job, at, priority=min(job.priority, priority), max_attempts=max(job.max_attempts, most), payload=merged_payload(job.payload, e["payload"]), due=due, coalesced=job.coalesced + 1)

    def rows(self, key: tuple) -> list[tuple]:
        """The changes since the last call."""
        out = [(*key, *asdict(job).values(), at) for job, at in self.changed]
        self.changed = []
        return out


def keyed(events: DataFrame) -> DataFrame:
    """Events with the columns of EVENT (missing ones null): work is the coalesce key, or the job where there is none, so
    that jobs without a key never meet."""
    have = set(events.columns)
    kinds = dict(x.split() for x in EVENT.split(", "))
    columns = [F.col(c).cast(k).alias(c) if c in have else F.lit(None).cast(k).alias(c) for c, k in kinds.items()]
    return events.select(*columns).withColumn("work", F.coalesce("work", "job_id")).where("work IS NOT NULL AND at IS NOT NULL AND event IS NOT NULL")


class _Machine(StatefulProcessor):
    def __init__(self, stuck_ms: int, stuck_is: str):
        self.stuck_ms, self.stuck_is = stuck_ms, stuck_is

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("jobs", "jobs string")

    def _load(self) -> Work:
        work = Work(self.stuck_ms, self.stuck_is)
        if self.state.exists():
            work.jobs = {j["job_id"]: Job(**j) for j in json.loads(self.state.get()[0])}
        return work

    def _save(self, key: tuple, work: Work) -> Iterator[pd.DataFrame]:
        if work.jobs:
            self.state.update((json.dumps([asdict(j) for j in work.jobs.values()]),))
            for at in {work.deadline(j) for j in work.jobs.values()} - {None}:
                self.handle.registerTimer(int(at))
        elif self.state.exists():
            self.state.clear()
        yield _frame(work.rows(key))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        work = self._load()
        events = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable").astype(object)
        for e in events.where(events.notna(), None).to_dict("records"):
            work.handle({k: int(v) if k in ("at", "seq", "due", "priority", "max_attempts") and v is not None else v for k, v in e.items()})
        yield from self._save(key, work)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        work = self._load()
        work.pass_time(int(expiredTimerInfo.getExpiryTimeInMs()))
        yield from self._save(key, work)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    whole = [x.split()[0] for x in JOB.split(", ") if x.split()[1] in ("int", "long")]
    return pd.DataFrame(rows, columns=JOB_NAMES).astype({c: "Int64" for c in whole})


def run_queue(events: DataFrame, late: str = "1 minute", stuck_ms: int = STUCK_MS, stuck_is: str = "failure") -> DataFrame:
    """A stream of job changes (JOB: a job as it is after each) from a stream of events.

    State: the jobs of a key that are not over. Timers of event time end waits and stuck runs, and put failures away,
    once the watermark is past them. Events that come together are taken in the order of time and seq. Needs the
    RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    timed = keyed(events).withColumn("event_time", F.timestamp_millis("at")).withWatermark("event_time", late)
    return timed.groupBy(*KEYS).transformWithStateInPandas(_Machine(stuck_ms, stuck_is), JOB, "append", "eventTime")


def replay(events: DataFrame, until: int | None = None, stuck_ms: int = STUCK_MS, stuck_is: str = "failure") -> DataFrame:
    """The same changes from a table of events. Each key's events pass through one task in order, one at a time: only
    its jobs are held. `until` lets time pass to that moment after the last event."""
    own = keyed(events).repartition(*KEYS).sortWithinPartitions(*KEYS, "at", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, work, kinds = None, None, [JOB_KINDS[x.split()[1]] for x in JOB.split(", ")]
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=JOB_NAMES)
        for batch in batches:
            rows: list[tuple] = []
            for e in batch.to_pylist():
                if (e["job_type"], e["work"]) != key:
                    if work and until is not None:
                        work.pass_time(until)
                        rows += work.rows(key)
                    key, work = (e["job_type"], e["work"]), Work(stuck_ms, stuck_is)
                work.handle(e)
                rows += work.rows(key)
            yield table(rows)
        if work and until is not None:
            work.pass_time(until)
            yield table(work.rows(key))

    return own.mapInArrow(run, JOB)


def latest(changes: DataFrame) -> DataFrame:
    """Each job as its last change left it."""
    rest = [c for c in changes.columns if c not in ("job_type", "work", "job_id")]
    return changes.groupBy("job_type", "work", "job_id").agg(F.max_by(F.struct(*rest), "change").alias("job")).select("job_type", "work", "job_id", "job.*")
