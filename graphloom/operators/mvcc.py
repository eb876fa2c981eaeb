"""Transactions, snapshots, version visibility, locks and deadlocks."""

from __future__ import annotations

import itertools
import time
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import Deadlock, TransactionError


@dataclass(frozen=True)
class Snapshot:
    """What a transaction sees: ids below ``timestamp`` that were not active when it began."""

    timestamp: int
    active: frozenset[int] = frozenset()

    def sees(self, xid: int) -> bool:
        return xid < self.timestamp and xid not in self.active


class TransactionManager:
    """Driver-side ids; the snapshot is read after the id is drawn and before the transaction counts as active, so it sees
    its own writes."""

    def __init__(self) -> None:
        self._next = itertools.count(1)
        self.last = 0
        self.state: dict[int, str] = {}
        self.snapshots: dict[int, Snapshot] = {}

    def begin_transaction(self) -> int:
        xid = self.last = next(self._next)
        self.snapshots[xid] = Snapshot(self.last + 1, frozenset(self.active()))
        self.state[xid] = "active"
        return xid

    def snapshot(self, xid: int) -> Snapshot:
        if xid not in self.snapshots:
            raise TransactionError(f"unknown transaction {xid}")
        return self.snapshots[xid]

    def _end(self, xid: int, state: str) -> None:
        if self.state.get(xid) != "active":
            raise TransactionError(f"transaction {xid} is not active")
        self.state[xid] = state

    def commit_transaction(self, xid: int) -> None:
        self._end(xid, "committed")

    def abort_transaction(self, xid: int) -> None:
        self._end(xid, "aborted")

    def active(self) -> list[int]:
        return [x for x, s in self.state.items() if s == "active"]


def sees(xid: Column, snapshot: Snapshot) -> Column:
    """Visibility of a transaction id."""
    return (xid < snapshot.timestamp) & ~xid.isin(*sorted(snapshot.active)) if snapshot.active else xid < snapshot.timestamp


def visible_to(versions: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Versions (xmin, xmax, ...) whose creator is seen and whose deleter is not."""
    return versions.where(sees(F.col("xmin"), snapshot) & ~F.coalesce(sees(F.col("xmax"), snapshot), F.lit(False)))


def visible_at(versions: DataFrame, ts: Column | object) -> DataFrame:
    """Versions (created_at, deleted_at, ...) that exist at a time."""
    ts = ts if isinstance(ts, Column) else F.lit(ts)
    return versions.where((F.col("created_at") <= ts) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > ts)))


def latest(versions: DataFrame, entity: str = "entity", order: str = "version") -> DataFrame:
    """The newest version of each entity: a map-side max_by, not a window, so a long chain is no hot task."""
    others = [c for c in versions.columns if c != entity]
    return versions.groupBy(entity).agg(F.max_by(F.struct(*others), F.col(order)).alias("_v")).select(entity, *[F.col(f"_v.`{c}`").alias(c) for c in others])


def mark_deleted(versions: DataFrame, entities: DataFrame, xid: int, at: object, entity: str = "entity") -> DataFrame:
    """Versions with xmax and deleted_at set on the live versions of the named entities."""
    gone = entities.toDF("_e").distinct().withColumn("_gone", F.lit(True))
    hit = F.col("_gone") & F.col("deleted_at").isNull()
    kinds = {f.name: f.dataType for f in versions.schema}
    out = versions.join(gone, F.col(entity) == F.col("_e"), "left")
    return out.withColumns({"xmax": F.when(hit, F.lit(xid).cast(kinds["xmax"])).otherwise(F.col("xmax")), "deleted_at": F.when(hit, F.lit(at).cast(kinds["deleted_at"])).otherwise(F.col("deleted_at"))}).drop("_e", "_gone")


def collect_garbage(versions: DataFrame, min_ts: object) -> DataFrame:
    """Versions that are live, or were deleted at or after ``min_ts``."""
    return versions.where(F.col("deleted_at").isNull() | (F.col("deleted_at") >= F.lit(min_ts)))


def current_timestamp() -> int:
    """Seconds since the epoch."""
    return int(time.time())


# Names of isolation levels.  Graphs are immutable, so every level behaves as the strictest for one writer.
ISOLATION_LEVELS = ("read_uncommitted", "read_committed", "repeatable_read", "serializable")


@dataclass
class Transaction:
    """A graph being changed: committing hands the new graph over, rolling back forgets it."""

    graph: object
    manager: TransactionManager = field(default_factory=TransactionManager)
    isolation: str = "serializable"

    def __post_init__(self) -> None:
        if self.isolation not in ISOLATION_LEVELS:
            raise TransactionError(f"unknown isolation level {self.isolation}")
        self.before, self.xid = self.graph, self.manager.begin_transaction()

    def apply(self, text: str, params: dict | None = None) -> None:
        if self.manager.state[self.xid] != "active":
            raise TransactionError("the transaction has ended")
        self.graph = self.graph.apply(text, params)

    def commit(self):
        self.manager.commit_transaction(self.xid)
        return self.graph

    def rollback(self):
        self.manager.abort_transaction(self.xid)
        self.graph = self.before
        return self.before


class DeadlockDetector:
    """Exclusive locks and the wait-for graph.  A request that closes a cycle raises; any other conflict is denied."""

    def __init__(self) -> None:
        self.holder: dict[object, int] = {}
        self.waits: dict[int, dict[int, None]] = {}

    def request_lock(self, xid: int, resource: object) -> bool:
        owner = self.holder.setdefault(resource, xid)
        if owner == xid:
            self.waits.pop(xid, None)
            return True
        self.waits.setdefault(xid, {})[owner] = None
        if xid in self.reachable(xid):
            del self.waits[xid][owner]
            raise Deadlock(f"Deadlock detected: transaction {xid} waits for itself")
        return False

    def release_lock(self, xid: int, resource: object) -> None:
        if self.holder.get(resource) == xid:
            del self.holder[resource]
        for w in self.waits.values():
            w.pop(xid, None)

    def release_all_locks(self, xid: int) -> None:
        for r in [r for r, x in self.holder.items() if x == xid]:
            del self.holder[r]
        self.waits.pop(xid, None)
        for w in self.waits.values():
            w.pop(xid, None)

    def reachable(self, start: int) -> list[int]:
        """Transactions that ``start`` waits for, directly or not; itself only through a cycle."""
        out: dict[int, None] = {}
        todo = deque(self.waits.get(start, ()))
        while todo:
            x = todo.popleft()
            if x not in out:
                out[x] = None
                todo.extend(self.waits.get(x, ()))
        return list(out)

    def get_deadlocked_txns(self, start: int) -> list[int]:
        """Breadth-first order over the wait-for graph, the start included."""
        return [start, *[x for x in self.reachable(start) if x != start]]

    def stats(self) -> dict:
        return {"locks_held": len(self.holder), "waiting_transactions": sum(bool(w) for w in self.waits.values()), "wait_edges": sum(map(len, self.waits.values()))}


def wait_cycles(waits: DataFrame) -> DataFrame:
    """(id) of the transactions on a cycle or behind none: what repeated removal of sinks and sources leaves.

    ``waits`` has (src, dst).  An edge stays while its source is waited for and its target waits; the edges that
    are left hold every cycle (and the paths between cycles)."""
    from ..session import stage

    edges = stage(waits.select("src", "dst").distinct(), "waits")
    n = edges.count()
    while n:
        kept = edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        kept = stage(kept.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"), "waits")
        m = kept.count()
        if m == n:
            break
        edges, n = kept, m
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def wait_edges(pairs: Iterable[tuple[int, int]], spark) -> DataFrame:
    return spark.createDataFrame(list(pairs), "src long, dst long")
