"""Durable state of runs, tasks, deliveries and reports: rows by key, changed by compare-and-set.

A change is an entry of a manifest, made after the entry that its writer has read, so of two writers one
gets a conflict, reads again and finds its condition no longer met. The state of a key is its last row.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.manifest import Conflict, Manifest

ROWS = "key string, kind string, status string, body string, at timestamp"


class Immutable(ValueError):
    """A key exists with other content."""


def now() -> dt.datetime:
    return dt.datetime.now(dt.UTC)


def _plain(value: object) -> object:
    return value.isoformat() if isinstance(value, dt.date | dt.datetime) else str(value)


@dataclass
class StateTable:
    """Rows (key, kind, status, body as JSON); clock is a parameter for tests."""

    spark: SparkSession
    root: str
    clock: Callable[[], dt.datetime] = now

    @cached_property
    def manifest(self) -> Manifest:
        newest = Window.partitionBy("kind", "key").orderBy(F.desc("place"))
        return Manifest(self.spark, self.root, ROWS, keep=lambda rows: rows.withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n"))

    def rows(self, kind: str) -> DataFrame:
        """The last row of each key of a kind."""
        newest = Window.partitionBy("key").orderBy(F.desc("place"))
        return self.manifest.read().where(F.col("kind") == kind).withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n")

    def get(self, kind: str, key: str) -> dict | None:
        """The state of one key: status and the fields of its body."""
        found = [r for r in self.manifest.recent() if (r.kind, r.key) == (kind, key)][-1:]
        if not found and (older := self.manifest.older()) is not None:
            found = older.where((F.col("kind") == kind) & (F.col("key") == key)).orderBy(F.desc("place")).limit(1).collect()
        return {**json.loads(found[0].body), "status": found[0].status} if found else None

    def _put(self, kind: str, key: str, status: str, body: dict, after: int) -> None:
        said = json.dumps(body, sort_keys=True, ensure_ascii=False, default=_plain)
        self.manifest.append([(key, kind, status, said, self.clock().replace(tzinfo=None))], after)

    def insert(self, kind: str, key: str, status: str, body: dict) -> bool:
        """True if the key was new. The same key with the same body is fine and changes nothing; another body raises."""
        while True:
            after, held = self.manifest.place(), self.get(kind, key)
            if held is not None:
                first = held.get("_first", {k: v for k, v in held.items() if k != "status"})
                if first != json.loads(json.dumps(body, default=_plain)):
                    raise Immutable(f"{kind} {key} exists with other content")
                return False
            try:
                self._put(kind, key, status, body, after)
                return True
            except Conflict:
                continue

    def change(self, kind: str, key: str, when: Callable[[dict], bool], to: Callable[[dict], dict]) -> dict | None:
        """The new state if the key's state met the condition, else None. to() gives the fields that change, status among them."""
        while True:
            after, held = self.manifest.place(), self.get(kind, key)
            if held is None or not when(held):
                return None
            first = held.get("_first", {k: v for k, v in held.items() if k != "status"})
            new = {**held, **to(held), "_first": first}
            try:
                self._put(kind, key, new["status"], {k: v for k, v in new.items() if k != "status"}, after)
                return new
            except Conflict:
                continue


def request_hash(request: dict) -> str:
    """Hash of a request, whatever the order of its fields and sets."""
    plain = lambda v: sorted(map(plain, v), key=str) if isinstance(v, set | frozenset) else [plain(x) for x in v] if isinstance(v, list | tuple) else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v
    return hashlib.sha256(json.dumps(plain(request), sort_keys=True, default=_plain).encode()).hexdigest()


@dataclass
class Runs:
    """Runs of requests: started once, taken over when their lease ends, finished by the attempt that holds them."""

    state: StateTable
    lease: dt.timedelta = dt.timedelta(minutes=5)

    def _until(self) -> str:
        return (self.state.clock() + self.lease).isoformat()

    def acquire(self, request: dict) -> tuple[str, dict, bool]:
        """Run id, state and whether the caller owns it now: a new run, or one that has failed or whose lease has ended."""
        key = request_hash(request)
        try:
            if self.state.insert("run", key, "running", {"run_id": uuid.uuid5(uuid.NAMESPACE_OID, key).hex, "attempt": 1, "until": self._until(), "request": request}):
                held = self.state.get("run", key)
                return held["run_id"], held, True
        except Immutable:
            pass  # the same request, started at another time
        taken = self.claim(key)
        held = taken or self.state.get("run", key)
        return held["run_id"], held, taken is not None

    def claim(self, key: str) -> dict | None:
        """Take over a run that has failed or whose lease has ended; the attempt goes up."""
        moment = self.state.clock().isoformat()
        return self.state.change("run", key, lambda s: s["status"] == "failed" or (s["status"] == "running" and s["until"] < moment), lambda s: {"status": "running", "attempt": s["attempt"] + 1, "until": self._until(), "error": None})

    def _own(self, attempt: int):
        return lambda s: s["status"] == "running" and s["attempt"] == attempt

    def renew(self, key: str, attempt: int) -> bool:
        """A heartbeat; False if another attempt holds the run."""
        return self.state.change("run", key, self._own(attempt), lambda s: {"until": self._until()}) is not None

    def complete(self, key: str, attempt: int, result: dict) -> bool:
        return self.state.change("run", key, self._own(attempt), lambda s: {"status": "succeeded", "result": result}) is not None

    def fail(self, key: str, attempt: int, error: str) -> bool:
        return self.state.change("run", key, self._own(attempt), lambda s: {"status": "failed", "error": error}) is not None

    def result(self, key: str) -> dict | None:
        """The result of a finished run."""
        held = self.state.get("run", key)
        return held["result"] if held and held["status"] == "succeeded" else None

    def execute(self, request: dict, work: Callable[[str, Callable[[], bool]], dict], polls: int = 60, wait: Callable[[float], None] = time.sleep) -> dict:
        """The result of a request: replayed, waited for, or worked out here.

        work gets the run's id and a heartbeat. What it raises fails the run and goes on to the caller.
        """
        key = request_hash(request)
        for _ in range(polls):
            run_id, held, owned = self.acquire(request)
            if owned:
                try:
                    result = work(run_id, lambda: self.renew(key, held["attempt"]))  # noqa: B023
                except Exception as e:
                    self.fail(key, held["attempt"], getattr(e, "code", type(e).__name__))
                    raise
                if not self.complete(key, held["attempt"], result):
                    raise Conflict(f"run {run_id} was taken over")
                return result
            if (done := self.result(key)) is not None:
                return done
            wait(1.0)
        raise TimeoutError(f"run {held['run_id']} is still held by another")


@dataclass
class Tasks:
    """Task state by report date: fenced by an epoch, so an owner before can no longer write."""

    state: StateTable

    def begin(self, day: dt.date, task: str, identity: dict) -> dict:
        """Start or take over a task; another identity under the same name raises."""
        key = f"{day.isoformat()}|{task}"
        self.state.insert("task", key, "active", {"identity": identity, "epoch": 0, "accepted": 0, "rejected": 0, "run_ids": [], "cursor": None, "watermark": None})
        held = self.state.get("task", key)
        if held["identity"] != json.loads(json.dumps(identity, default=_plain)):
            raise Immutable(f"task {key} exists with another identity")
        return self.state.change("task", key, lambda s: s["status"] == "active", lambda s: {"epoch": s["epoch"] + 1}) or held

    def advance(self, day: dt.date, task: str, epoch: int, run_id: str, page: dict) -> bool:
        """Note a page: counters add, run ids stay distinct, and without a next cursor the task is done."""
        key = f"{day.isoformat()}|{task}"
        return self.state.change("task", key, lambda s: s["status"] == "active" and s["epoch"] == epoch, lambda s: {
            "accepted": s["accepted"] + page["accepted"], "rejected": s["rejected"] + page["rejected"], "run_ids": [*s["run_ids"], *[r for r in (run_id,) if r not in s["run_ids"]]],
            "cursor": page["next_cursor"], "watermark": page["watermark"], "status": "active" if page["next_cursor"] else "succeeded"}) is not None


@dataclass
class Task:
    """A task of the daily worker; run(day) gives its result, a dict with status and run_ids."""

    task_id: str
    run: Callable[[dt.date], dict]
    required: bool = True
    retries: int = 3


@dataclass
class Worker:
    """Runs all tasks of a day once, with retries, and folds their statuses; a day is run by one worker at a time."""

    state: StateTable
    tasks: list[Task] = field(default_factory=list)
    wait: Callable[[float], None] = time.sleep

    def _one(self, task: Task, day: dt.date) -> dict:
        from tidemark.operators.workflow import retry_delays

        delays = retry_delays(task.retries)
        for n in range(task.retries):
            try:
                found = task.run(day)
            except Exception as e:  # noqa: BLE001  a task's error is its result
                found = {"status": "retryable" if getattr(e, "retryable", False) else "failed", "error": getattr(e, "code", type(e).__name__), "run_ids": []}
            if found["status"] == "succeeded" and not found.get("run_ids"):
                found = {"status": "failed", "error": "NO_RUN_EVIDENCE", "run_ids": []}
            if found["status"] != "retryable" or n == task.retries - 1:
                return found | {"task_id": task.task_id, "required": task.required, "tries": n + 1}
            self.wait(delays[n])
        raise AssertionError("a task has no tries")

    def run_for_date(self, day: dt.date) -> dict:
        key, owner = day.isoformat(), uuid.uuid4().hex
        self.state.insert("day", key, "free", {})
        if self.state.change("day", key, lambda s: s["status"] == "free", lambda s: {"status": "locked", "owner": owner}) is None:
            return {"day": key, "status": "locked", "tasks": []}
        try:
            results = [self._one(t, day) for t in self.tasks]
        finally:
            self.state.change("day", key, lambda s: s.get("owner") == owner, lambda s: {"status": "free", "owner": None})
        need = [r["status"] for r in results if r["required"]]
        status = "blocked" if "failed" in need else "retryable" if "retryable" in need else "degraded" if any(r["status"] != "succeeded" for r in results) else "succeeded"
        return {"day": key, "status": status, "tasks": results}

    def backfill(self, first: dt.date, last: dt.date) -> list[dict]:
        """Each day from first to last, both included."""
        return [self.run_for_date(first + dt.timedelta(days=n)) for n in range((last - first).days + 1)]


@dataclass
class Deliveries:
    """Attempts to deliver a report: reserved once by their key, sent, retried; sending itself is the caller's."""

    state: StateTable

    def reserve(self, report_id: str, target: str, key: str, payload: dict) -> bool:
        """True if the attempt is new; another payload under the key raises."""
        return self.state.insert("delivery", f"{report_id}|{target}|{key}", "pending", {"attempt": 1, "payload": payload})

    def load(self, report_id: str, target: str, key: str) -> dict | None:
        return self.state.get("delivery", f"{report_id}|{target}|{key}")

    def update(self, report_id: str, target: str, key: str, attempt: int, status: str, **more) -> bool:
        """What became of a pending attempt: succeeded, failed, retry_wait or uncertain."""
        if status not in ("succeeded", "failed", "retry_wait", "uncertain"):
            raise ValueError(status)
        return self.state.change("delivery", f"{report_id}|{target}|{key}", lambda s: s["status"] == "pending" and s["attempt"] == attempt, lambda s: {"status": status, **more}) is not None

    def retry(self, report_id: str, target: str, key: str, attempt: int | None = None, confirmed: bool = False) -> bool:
        """Pending again, with the next number; an uncertain attempt only if it is confirmed that nothing arrived."""
        allowed = {"failed", "retry_wait"} | ({"uncertain"} if confirmed else set())
        return self.state.change("delivery", f"{report_id}|{target}|{key}", lambda s: s["status"] in allowed and attempt in (None, s["attempt"]), lambda s: {"status": "pending", "attempt": s["attempt"] + 1}) is not None

    def deliver(self, report_id: str, target: str, key: str, payload: dict, send: Callable[[dict], None], tries: int = 3, wait: Callable[[float], None] = time.sleep) -> dict:
        """Send once: a delivery that has succeeded or is uncertain is not sent again.

        An error with retryable = True is tried again; one without a known outcome (uncertain = True) stops.
        """
        self.reserve(report_id, target, key, payload)
        for n in range(tries):
            held = self.load(report_id, target, key)
            if held["status"] in ("failed", "retry_wait") and not self.retry(report_id, target, key, held["attempt"]):
                continue
            held = self.load(report_id, target, key)
            if held["status"] != "pending":
                return held
            try:
                send(payload)
                self.update(report_id, target, key, held["attempt"], "succeeded")
            except Exception as e:  # noqa: BLE001  what was raised decides the state
                status = "uncertain" if getattr(e, "uncertain", False) else "retry_wait" if getattr(e, "retryable", False) else "failed"
                self.update(report_id, target, key, held["attempt"], status, error=getattr(e, "code", type(e).__name__))
                if status != "retry_wait":
                    break
                wait(2.0**n)
        return self.load(report_id, target, key)


@dataclass
class Actions:
    """Operators' requests: each carried out once, with what came of it."""

    state: StateTable

    def reserve(self, request_id: str, body: dict) -> bool:
        return self.state.insert("action", request_id, "pending", body)

    def complete(self, request_id: str, status: str, **result) -> bool:
        if status not in ("succeeded", "rejected", "failed"):
            raise ValueError(status)
        return self.state.change("action", request_id, lambda s: s["status"] == "pending", lambda s: {"status": status, **result}) is not None

    def redeliver(self, request_id: str, deliveries: Deliveries, report_id: str, target: str, key: str, confirmed: bool, send: Callable[[dict], None]) -> dict:
        """An operator's retry of a delivery, noted before and after; a request that comes again gets its result."""
        if not self.reserve(request_id, {"report_id": report_id, "confirmed": confirmed}):
            return self.state.get("action", request_id)
        if not deliveries.retry(report_id, target, key, confirmed=confirmed):
            self.complete(request_id, "rejected")
        else:
            held = deliveries.load(report_id, target, key)
            done = deliveries.deliver(report_id, target, key, held["payload"], send, tries=1)
            self.complete(request_id, "succeeded" if done["status"] == "succeeded" else "failed", delivery=done["status"])
        return self.state.get("action", request_id)
