"""Reconciliation of a store with what its snapshots refer to: orphans are found page by page, wait, and are deleted."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeframe.operators.snapshot import SnapshotStore
from hazeframe.operators.staging import staged

PENDING = "path string, seen double"


@dataclass(frozen=True)
class Limits:
    """How long an orphan waits, in seconds; how many may wait; how many are listed and deleted in one go."""

    grace: float = 72 * 3600.0
    pending: int = 20_000
    page: int = 1_000
    delete: int = 100


@dataclass
class Progress:
    """Which prefix is listed next, where each listing stands (None: at its start), and when each ended last."""

    next: int = 0
    cursors: list[str | None] = field(default_factory=lambda: [None, None])
    sweeps: list[float | None] = field(default_factory=lambda: [None, None])


@dataclass
class Outcome:
    pending: DataFrame
    progress: Progress
    deleted: DataFrame
    counts: dict[str, int]


def step(objects: DataFrame, protected: DataFrame, pending: DataFrame, progress: Progress, prefixes: tuple[str, str], now: float, limits: Limits) -> Outcome:
    """One run. objects: path of everything stored; protected: path of what is referred to; pending: path, seen.

    1. What is referred to again leaves the waiting list, so its grace begins anew if it is dropped later.
    2. Of those that waited for the grace, the `delete` longest waiting ones (ties by path) are to be deleted.
    3. Two pages are listed, of the prefixes in turn, each behind its cursor; unreferenced paths begin to wait. A full
       list stops the listing and keeps the cursor. A page that reaches the end of its prefix puts the cursor back.
    Pages and deletions are bounded by limits, the joins are not: they go over whole tables.
    """
    protected = protected.select("path").distinct()
    waiting = pending.join(protected, "path", "left_anti").select("path", "seen")
    deleted = staged(waiting.where(F.lit(now) - F.col("seen") >= limits.grace).orderBy("seen", "path").limit(limits.delete))
    waiting = waiting.join(deleted, "path", "left_anti").select("path", "seen")
    left = objects.select("path").join(deleted.select("path"), "path", "left_anti")
    progress = Progress(progress.next, list(progress.cursors), list(progress.sweeps))
    counts = {"deleted": deleted.count(), "scanned": 0, "queued": 0, "sweeps": 0, "saturated": 0}
    for _ in range(2):
        waiting = staged(waiting)
        room = limits.pending - waiting.count()
        if room <= 0:
            counts["saturated"] += 1
            break
        k, size = progress.next, min(limits.page, room)
        cursor = progress.cursors[k]
        own = left.where(F.col("path").startswith(f"{prefixes[k]}/"))
        own = own if cursor is None else own.where(F.col("path") > cursor)
        listed = staged(own.orderBy("path").limit(size + 1))  # one more tells whether the prefix goes on
        page = listed.orderBy("path").limit(size)
        fresh = page.join(protected, "path", "left_anti").join(waiting.select("path"), "path", "left_anti")
        fresh = staged(fresh.select("path", F.lit(float(now)).alias("seen")))
        ends = page.agg(F.count(F.lit(1)).alias("n"), F.max("path").alias("last")).first()
        more = listed.count() > size
        progress.cursors[k], progress.next = ends["last"] if more else None, 1 - k
        if not more:
            progress.sweeps[k] = now
            counts["sweeps"] += 1
        counts["scanned"] += ends["n"]
        counts["queued"] += fresh.count()
        waiting = waiting.unionByName(fresh)
    return Outcome(waiting, progress, deleted, counts)


class Reconciler:
    """step() over a versioned state: a run starts from the newest state and publishes the next one, so a run that is cut
    off before leaves the old state, and of two runs at once one fails. `delete` removes objects before the state says so;
    a run that is repeated finds them gone and deletes nothing twice."""

    def __init__(self, spark: SparkSession, root: str, prefixes: tuple[str, str], limits: Limits | None = None):
        self.spark, self.prefixes, self.limits = spark, prefixes, limits or Limits()
        self.store = SnapshotStore(spark, root)

    def state(self, now: float) -> tuple[DataFrame, Progress]:
        """The newest state; a fresh one before the first run or if the last one makes no sense."""
        fresh = self.spark.createDataFrame([], PENDING), Progress()
        tables = self.store.current()
        if not tables:
            return fresh
        try:
            known = Progress(**json.loads(tables["progress"].first()["body"]))
            times = [t for t in known.sweeps if t is not None]
            if known.next not in (0, 1) or len(known.cursors) != 2 or len(known.sweeps) != 2 or any(not 0 <= t <= now for t in times):
                return fresh
        except (TypeError, ValueError):
            return fresh
        if tables["pending"].where(~F.col("seen").between(0, now) | F.col("path").isNull()).limit(1).count():
            return fresh
        return tables["pending"], known

    def run(self, objects: DataFrame, protected: DataFrame, now: float, delete=None) -> Outcome:
        pending, progress = self.state(now)
        number = self.store.latest() + 1
        out = step(objects, protected, pending, progress, self.prefixes, now, self.limits)
        if delete is not None:
            delete(out.deleted.select("path"))
        body = self.spark.createDataFrame([(json.dumps(asdict(out.progress)),)], "body string")
        self.store.publish({"pending": out.pending, "progress": body}, number)
        return out
