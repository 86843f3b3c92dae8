"""Running several actions at once."""

from __future__ import annotations

import contextvars
import operator
import tempfile
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import asynccontextmanager, contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.plans.keys import KEYS

_CURRENT: contextvars.ContextVar = contextvars.ContextVar("panelwright_batch", default=None)


def current():
    return _CURRENT.get()


def _place(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``, else a
    temporary one for a local session, else beside the warehouse, which a cluster shares."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.partition("[")[0] == "local":
        return tempfile.mkdtemp(prefix="panelwright-")
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/panelwright/{spark.sparkContext.applicationId}/batch-{uuid.uuid4().hex[:12]}"


class Kept:
    """The rows of a plan, computed once and written beside the data as Parquet; ``rows``
    reads them. They are deleted by ``drop``, or else when the session's JVM ends."""

    def __init__(self, plan: DataFrame):
        spark, kinds = plan.sparkSession, [f.dataType for f in plan.schema.fields]
        self.path = _place(spark)
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.deleteOnExit(place)
        self.drop = lambda: files.delete(place, True)
        # columns go by number, as names may occur twice; Parquet has no columns without a type
        void = [isinstance(k, T.NullType) for k in kinds]
        numbered = plan.toDF(*[f"_{i}" for i in range(len(kinds))])
        numbered = numbered.select(*[F.col(c).cast("string").alias(c) if v else F.col(c) for c, v in zip(numbered.columns, void, strict=True)])
        numbered.write.mode("overwrite").parquet(self.path)
        read = spark.read.schema(numbered.schema).parquet(self.path)
        self.rows = read.select(*[F.lit(None) if v else F.col(c) for c, v in zip(read.columns, void, strict=True)]).toDF(*plan.columns)


class Handle:
    """A result to come: ``plan`` is the DataFrame. When its batch ends the rows are computed
    and kept beside the data: ``table()`` is a table of them, ``pandas()`` brings them to the
    driver, in order of their keys. Used like the rows themselves - items, attributes,
    arithmetic, comparisons - it brings them, and computes them if the batch has not yet."""

    def __init__(self, plan: DataFrame):
        self.plan = plan
        self._kept: Kept | None = None
        self._given = False
        self._rows = None
        self._lock = threading.RLock()

    def compute(self) -> None:
        with self._lock:
            if self._kept is None and self._rows is None:
                self._kept = Kept(self.plan)

    def table(self) -> DataFrame:
        """The rows as a table, whatever their number: none come to the driver. It stays
        until the session's JVM ends."""
        with self._lock:
            self._kept, self._given = self._kept or Kept(self.plan), True
            return self._kept.rows

    def collect(self):
        with self._lock:
            if self._rows is None:
                found = self._kept.rows if self._kept else self.plan
                self._rows = found.orderBy(*[k for k in KEYS if k in found.columns]).toPandas()
                if self._kept and not self._given:
                    self._kept.drop()
                    self._kept = None
            return self._rows

    pandas = collect

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self.pandas(), name)

    def __repr__(self) -> str:
        done = self._rows is not None
        return repr(self._rows) if done else f"Handle({self.plan.columns}, waiting)"

    def __bool__(self) -> bool:
        return len(self.pandas()) > 0

    __hash__ = object.__hash__


def _forward(name: str):
    def call(self, *given):
        given = [x.pandas() if isinstance(x, Handle) else x for x in given]
        return getattr(operator, name)(self.pandas(), *given)

    return call


def _reflected(name: str):
    return lambda self, other: getattr(operator, name)(other, self.pandas())


for _name in ("add", "sub", "mul", "truediv", "pow"):
    setattr(Handle, f"__{_name}__", _forward(_name))
    setattr(Handle, f"__r{_name}__", _reflected(_name))
for _name in ("eq", "ne", "lt", "le", "gt", "ge", "neg", "pos", "abs", "getitem", "setitem", "contains"):
    setattr(Handle, f"__{_name}__", _forward(_name))
Handle.__len__ = lambda self: len(self.pandas())
Handle.__iter__ = lambda self: iter(self.pandas())


class Batch:
    def __init__(self) -> None:
        self.handles: list[Handle] = []

    def add(self, plan: DataFrame) -> Handle:
        self.handles.append(Handle(plan))
        return self.handles[-1]

    def run(self, workers: int | None = None) -> None:
        """Compute every plan, each in a thread: Spark schedules their jobs side by side. The
        rows stay beside the data until a handle is asked for them."""
        if not self.handles:
            return
        with ThreadPoolExecutor(workers or min(8, len(self.handles))) as pool:
            running = [pool.submit(inheritable_thread_target(h.plan.sparkSession)(h.compute)) for h in self.handles]
        for r in running:
            r.result()


@contextmanager
def batch(workers: int | None = None):
    """Reads inside the block become handles, and run together when it ends."""
    mine = Batch()
    token = _CURRENT.set(mine)
    try:
        yield mine
    finally:
        _CURRENT.reset(token)
    mine.run(workers)


@asynccontextmanager
async def async_batch(workers: int | None = None):
    import asyncio

    mine = Batch()
    token = _CURRENT.set(mine)
    try:
        yield mine
    finally:
        _CURRENT.reset(token)
    await asyncio.to_thread(mine.run, workers)
