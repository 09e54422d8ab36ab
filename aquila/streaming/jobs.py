"""Queries as jobs: phases, a bounded queue, limits of time, and lists."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from enum import Enum
from io import BytesIO

from aquila.session import Engine


class Phase(Enum):
    PENDING = "PENDING"
    QUEUED = "QUEUED"
    EXECUTING = "EXECUTING"
    COMPLETED = "COMPLETED"
    ERROR = "ERROR"
    ABORTED = "ABORTED"
    UNKNOWN = "UNKNOWN"
    HELD = "HELD"
    SUSPENDED = "SUSPENDED"
    ARCHIVED = "ARCHIVED"


P = Phase
FINISHED = {P.COMPLETED, P.ERROR, P.ABORTED}
#: From which phases each can be reached without force.
BEFORE: dict[Phase, set[Phase]] = {
    P.PENDING: {P.PENDING, P.UNKNOWN},
    P.QUEUED: {P.PENDING, P.HELD, P.QUEUED, P.UNKNOWN},
    P.EXECUTING: {P.HELD, P.SUSPENDED, P.QUEUED, P.EXECUTING, P.UNKNOWN},
    P.COMPLETED: {P.EXECUTING, P.COMPLETED, P.UNKNOWN},
    P.ABORTED: set(P) - {P.COMPLETED, P.ERROR},
    P.ERROR: set(P) - {P.COMPLETED, P.ABORTED},
    P.HELD: {P.PENDING, P.EXECUTING, P.HELD, P.UNKNOWN},
    P.SUSPENDED: {P.EXECUTING, P.SUSPENDED, P.UNKNOWN},
    P.ARCHIVED: {P.COMPLETED, P.ERROR, P.ABORTED, P.ARCHIVED, P.UNKNOWN},
    P.UNKNOWN: set(P),
}


class PhaseError(ValueError):
    pass


@dataclass
class Job:
    query: str
    maxrec: int | None = None
    format: str = "votable"
    owner: str | None = None
    duration: int | None = None
    destruction: datetime | None = None
    job_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    phase: Phase = Phase.PENDING
    created: datetime = field(default_factory=lambda: datetime.now(UTC))
    started: datetime | None = None
    ended: datetime | None = None
    error: str | None = None
    result: bytes | None = None
    overflow: bool = False
    changed: threading.Condition = field(default_factory=threading.Condition, repr=False)

    def move(self, to: Phase, force: bool = False) -> None:
        with self.changed:
            if not force and self.phase not in BEFORE[to]:
                raise PhaseError(f"Incorrect phase transition: from {self.phase.value} to {to.value}")
            self.phase = to
            self.changed.notify_all()

    def wait(self, seconds: float | None = None, phase: Phase | None = None) -> Phase:
        """Until the phase is another than ``phase`` (the present one), at most so long; finished jobs don't wait."""
        with self.changed:
            phase = phase or self.phase
            if self.phase == phase and phase not in FINISHED:
                self.changed.wait_for(lambda: self.phase != phase, seconds)
            return self.phase


class Jobs:
    """Runs jobs on an engine, so many at once; each is a Spark job group of its own."""

    def __init__(self, engine: Engine, run: Callable[[Job], None] | None = None):
        self.engine, self.jobs = engine, {}
        self._run = run or self._query
        self._pool = ThreadPoolExecutor(engine.config.workers)
        self._futures: dict[str, Future] = {}

    def add(self, query: str, start: bool = False, **options) -> Job:
        job = Job(query, **options)
        job.duration = self.engine.config.duration(job.duration)
        self.jobs[job.job_id] = job
        if start:
            self.start(job)
        return job

    def start(self, job: Job) -> None:
        job.move(Phase.QUEUED)
        self._futures[job.job_id] = self._pool.submit(self._execute, job)

    def _query(self, job: Job) -> None:
        out = BytesIO()
        job.overflow = self.engine.query(job.query, job.maxrec).write(out, job.format)
        job.result = out.getvalue()

    def _execute(self, job: Job) -> None:
        try:
            job.move(Phase.EXECUTING)
        except PhaseError:
            return  # aborted in the queue
        job.started = datetime.now(UTC)
        spark = self.engine.spark
        spark.addTag(job.job_id)
        timer = threading.Timer(job.duration, self.abort, (job, f"it took more than {job.duration} seconds")) if job.duration else None
        if timer:
            timer.daemon = True
            timer.start()
        try:
            self._run(job)
            end = Phase.COMPLETED
        except Exception as problem:
            job.error = job.error or str(problem)
            end = Phase.ERROR
        finally:
            spark.removeTag(job.job_id)
            if timer:
                timer.cancel()
        job.ended = datetime.now(UTC)
        try:
            job.move(end)
        except PhaseError:
            job.result = None  # aborted meanwhile

    def abort(self, job: Job, why: str | None = None) -> None:
        job.move(Phase.ABORTED)
        job.error = why
        job.ended = datetime.now(UTC)
        self.engine.spark.interruptTag(job.job_id)

    def destroy(self, job: Job) -> None:
        if job.phase not in FINISHED | {Phase.ARCHIVED}:
            self.abort(job, "destroyed")
        self.jobs.pop(job.job_id, None)

    def sweep(self, now: datetime | None = None) -> int:
        """Destroys what is due."""
        due = [j for j in self.jobs.values() if j.destruction and j.destruction <= (now or datetime.now(UTC))]
        for j in due:
            self.destroy(j)
        return len(due)

    def list(self, phases: Iterable[Phase] | None = None, after: datetime | None = None, last: int | None = None, owner: str | None = None) -> list[Job]:
        """Archived jobs only if asked for; with ``last`` the newest first, else the oldest."""
        wanted = set(phases) if phases is not None else set(Phase) - {Phase.ARCHIVED}
        out = [j for j in self.jobs.values() if j.phase in wanted and (after is None or j.created > after) and (owner is None or j.owner == owner)]
        out.sort(key=lambda j: j.created, reverse=last is not None)
        return out if last is None else out[: max(0, last)]

    def close(self) -> None:
        self._pool.shutdown(cancel_futures=True)


def destruction_time(asked: datetime | None, default: timedelta | None, most: timedelta | None, now: datetime | None = None) -> datetime | None:
    """What is asked for, the default else; never later than the most."""
    now = now or datetime.now(UTC)
    at = asked or (now + default if default else None)
    return min(x for x in (at, now + most) if x) if most else at
