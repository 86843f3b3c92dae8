"""Plans kept in memory, the least recently used let go first."""

from __future__ import annotations

import threading
from collections import OrderedDict
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame


@dataclass
class Stats:
    hits: int = 0
    misses: int = 0
    evictions: int = 0

    @property
    def hit_rate(self) -> float:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0


class Held:
    """Persisted DataFrames by key: ``limit`` plans at most and, with ``max_bytes``, no more
    than that by Spark's estimates; what was used longest ago goes first. They spill to
    executors' disks."""

    def __init__(self, limit: int = 128, max_bytes: int = 0, enabled: bool = True):
        self.limit, self.max_bytes, self.enabled = limit, max_bytes, enabled
        self.stats = Stats()
        self._plans: OrderedDict[tuple, tuple[DataFrame, int]] = OrderedDict()
        self._lock = threading.RLock()

    def configure(self, enabled: bool | None = None, limit: int | None = None, max_bytes: int | None = None) -> None:
        with self._lock:
            self.enabled = self.enabled if enabled is None else enabled
            self.limit = self.limit if limit is None else limit
            self.max_bytes = self.max_bytes if max_bytes is None else max_bytes
            if not self.enabled:
                self.clear()
            self._evict()

    def _evict(self) -> None:
        while len(self._plans) > self.limit or (self.max_bytes and self.held_bytes > self.max_bytes):
            self._plans.popitem(last=False)[1][0].unpersist()
            self.stats.evictions += 1

    @property
    def held_bytes(self) -> int:
        return sum(n for _, n in self._plans.values())

    def get(self, key: tuple, make) -> DataFrame:
        with self._lock:
            if not self.enabled:
                return make()
            if key in self._plans:
                self.stats.hits += 1
                self._plans.move_to_end(key)
                return self._plans[key][0]
            self.stats.misses += 1
            plan = make()
            size = int(str(plan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            if self.max_bytes and size > self.max_bytes:
                return plan
            plan = plan.persist(StorageLevel.MEMORY_AND_DISK)
            self._plans[key] = plan, size
            self._evict()
            return plan

    def invalidate(self, first) -> int:
        """Let go of all keys that begin with ``first``."""
        with self._lock:
            gone = [k for k in self._plans if k[0] == first]
            for k in gone:
                self._plans.pop(k)[0].unpersist()
            return len(gone)

    def clear(self) -> int:
        with self._lock:
            n = len(self._plans)
            while self._plans:
                self._plans.popitem()[1][0].unpersist()
            return n

    def reset(self) -> None:
        self.clear()
        self.stats = Stats()

    def __len__(self) -> int:
        return len(self._plans)


#: Of the stores. Off until `configure` turns it on: what is worth keeping of a large store is
#: for its user to say.
HELD = Held(enabled=False)
