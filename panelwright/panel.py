"""The panel: a lazy table keyed by date and id, and its fluent operators."""

from __future__ import annotations

import asyncio
import hashlib
from collections.abc import Callable, Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.calendars import Calendar, Weekdays, as_date
from panelwright.operators import align, cross, elementwise, resample, rows, timejoin, windows
from panelwright.plans import batches
from panelwright.plans.keys import DATE, ID, KEYS, normalize, validate

Scalar = (int, float)

#: Operators that look at one date at a time.
LOCAL = {rows.select, rows.where, rows.rename, rows.drop_missing, elementwise.with_scalar, elementwise.aligned, elementwise.absolute, elementwise.clip, elementwise.choose, cross.cs_rank}


class Panel:
    """Builds a DataFrame for a date range; nothing runs until an action on that.

    ``build(start, end)`` returns the rows of the range, both ends included. An operator
    makes a new panel whose build calls this one, so a whole chain is one Spark plan.
    Operators see the rows of the range asked for; ``lookback`` widens what they see.
    """

    def __init__(self, build: Callable[[date, date], DataFrame], calendar: Calendar | None = None, name: str | None = None, inputs: tuple[Panel, ...] = (), local: bool | None = None):
        self._build = build
        self.calendar = calendar or Weekdays()
        self.name = name or _label(build)
        self.inputs = inputs
        #: Whether a date's rows depend on nothing but that date, so that any range may be
        #: built in parts. Taken for granted of sources.
        self.local = not inputs if local is None else local

    # sources

    @classmethod
    def from_function(cls, func: Callable[..., DataFrame], kwargs: dict | None = None, calendar: Calendar | None = None) -> Panel:
        """``func(start, end, **kwargs)`` returns a DataFrame with both keys."""
        given = dict(kwargs or {})

        def build(start: date, end: date) -> DataFrame:
            return in_range(normalize(func(start, end, **given)), start, end)

        label = f"{_label(func)}({_said(sorted(given.items()))})"
        return cls(build, calendar, label)

    @classmethod
    def from_table(cls, df: DataFrame, calendar: Calendar | None = None, date_column: str = DATE, id_column: str = ID, name: str = "table") -> Panel:
        """A DataFrame whose keys may have other names."""
        named = df.withColumnsRenamed({date_column: DATE, id_column: ID})
        return cls(lambda start, end: in_range(normalize(named), start, end), calendar, f"{name}{_said(named)}")

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, calendar: Calendar | None = None, date_column: str = DATE, id_column: str = ID) -> Panel:
        return cls.from_table(spark.read.parquet(path), calendar, date_column, id_column, path)

    # reading

    def df(self, start, end, columns: list[str] | None = None, filters: list[tuple] | None = None) -> DataFrame:
        """The rows from ``start`` to ``end``; filters may name columns not selected."""
        out = self._build(as_date(start), as_date(end))
        out = rows.where(out, filters) if filters else out
        return rows.select(out, columns) if columns is not None else out

    def get_range(self, start, end, columns: list[str] | None = None, filters: list[tuple] | None = None):
        """``df``; inside ``batch()`` a handle that is collected when the block ends."""
        found = self.df(start, end, columns, filters)
        current = batches.current()
        return current.add(found) if current is not None else found

    def get(self, day, columns: list[str] | None = None, filters: list[tuple] | None = None):
        """One day, without its date."""
        found = self.df(day, day, columns, filters).drop(DATE)
        current = batches.current()
        return current.add(found) if current is not None else found

    async def aget_range(self, start, end, columns: list[str] | None = None, filters: list[tuple] | None = None):
        return await asyncio.to_thread(in_order(self.df(start, end, columns, filters)).toPandas)

    async def aget(self, day, columns: list[str] | None = None, filters: list[tuple] | None = None):
        return await asyncio.to_thread(in_order(self.df(day, day, columns, filters)).drop(DATE).toPandas)

    def to_pandas(self, start, end):
        """The rows in order of date and id, on the driver."""
        return in_order(self.df(start, end)).toPandas()

    def to_arrow(self, start, end):
        return in_order(self.df(start, end)).toArrow()

    def validated(self) -> Panel:
        """The same, with keys checked whenever rows are built."""
        return Panel(lambda s, e: validate(self._build(s, e)), self.calendar, f"validated({self.name})", (self,))

    @property
    def key(self) -> str:
        """A fingerprint of what the panel computes."""
        text = self.name + "".join(p.key for p in self.inputs) + repr(self.calendar)
        return hashlib.sha256(text.encode()).hexdigest()[:16]

    def __repr__(self) -> str:
        return f"Panel({self.name}, {self.calendar!r})"

    # building new panels

    def transform(self, func: Callable[..., DataFrame], *args, label: str | None = None, **kwargs) -> Panel:
        """``func(df, *args, **kwargs)`` on every range: how own operators are added."""
        name = f"{label or _label(func)}({_said(args)}, {_said(sorted(kwargs.items()))}, {self.name})"
        return Panel(lambda s, e: func(self._build(s, e), *args, **kwargs), self.calendar, name, (self,), self.local and func in LOCAL)

    def _with(self, other: Panel, func: Callable[..., DataFrame], *args, **kwargs) -> Panel:
        name = f"{_label(func)}({_said(args)}, {_said(sorted(kwargs.items()))}, {self.name}, {other.name})"
        return Panel(lambda s, e: func(self._build(s, e), other._build(s, e), *args, **kwargs), self.calendar, name, (self, other), self.local and other.local and func in LOCAL)

    def _per_date(self, func: Callable[..., DataFrame], **kwargs) -> Panel:
        name = f"{_label(func)}({sorted(kwargs.items())}, {self.name})"
        return Panel(lambda s, e: func(self._build(s, e), days=(e - s).days + 1, **kwargs), self.calendar, name, (self,), self.local)

    def lookback(self, periods: int) -> Panel:
        """Operators before this one also see ``periods`` calendar days before the range."""

        def build(start: date, end: date) -> DataFrame:
            return in_range(self._build(self.calendar.offset(start, -periods), end), start, end)

        return Panel(build, self.calendar, f"lookback({periods}, {self.name})", (self,))

    # rows

    def select(self, columns: list[str]) -> Panel:
        return self.transform(rows.select, columns)

    def filter(self, filters: list[tuple]) -> Panel:
        return self.transform(rows.where, filters)

    def rename(self, mapping: dict[str, str]) -> Panel:
        return self.transform(rows.rename, mapping)

    def dropna(self, how: str = "any") -> Panel:
        return self.transform(rows.drop_missing, how)

    def fillna(self, value=None, method: str | None = None) -> Panel:
        if (value is None) == (method is None):
            raise ValueError("fill with a value or in a direction, one of them")
        return self.transform(rows.fill_missing, value, method)

    @staticmethod
    def concat(panels: Iterable[Panel]) -> Panel:
        panels = tuple(panels)
        if not panels:
            raise ValueError("nothing to concatenate")
        return Panel(lambda s, e: rows.concat([p._build(s, e) for p in panels]), panels[0].calendar, f"concat({[p.name for p in panels]})", panels)

    def join(self, other: Panel, on=None, how: str = "left", suffix: tuple[str, str] = ("_left", "_right")) -> Panel:
        if how not in rows.HOWS:
            raise ValueError(f"no join of the kind {how!r}; there are {sorted(rows.HOWS)}")
        return self._with(other, rows.join, on, how, suffix)

    def asof_join(self, other: Panel, on: str = DATE, by: str | list[str] | None = ID, tolerance=None, lookback: int = 0) -> Panel:
        """The other panel is read over the same range, or from ``lookback`` days earlier."""
        timejoin.microseconds(tolerance)

        def build(start: date, end: date) -> DataFrame:
            facts = other._build(other.calendar.offset(start, -lookback), end)
            return timejoin.asof_join(self._build(start, end), facts, on, by, tolerance)

        return Panel(build, self.calendar, f"asof_join({on}, {by}, {tolerance}, {lookback}, {self.name}, {other.name})", (self, other))

    # element by element

    def _arithmetic(self, op: str, other) -> Panel:
        if isinstance(other, Panel):
            return self._with(other, elementwise.aligned, op)
        if isinstance(other, Scalar):
            return self.transform(elementwise.with_scalar, op, other)
        raise TypeError(f"cannot {op} {type(other).__name__} and a panel")

    def add(self, other) -> Panel:
        return self._arithmetic("add", other)

    def sub(self, other) -> Panel:
        return self._arithmetic("sub", other)

    def mul(self, other) -> Panel:
        return self._arithmetic("mul", other)

    def div(self, other) -> Panel:
        return self._arithmetic("div", other)

    def pow(self, other) -> Panel:
        return self._arithmetic("pow", other)

    __add__ = __radd__ = add
    __sub__ = sub
    __mul__ = __rmul__ = mul
    __truediv__ = div
    __pow__ = pow

    def __rsub__(self, other) -> Panel:
        return self.mul(-1).add(other)

    def __neg__(self) -> Panel:
        return self.mul(-1)

    def __rpow__(self, other):
        raise NotImplementedError("a scalar to the power of a panel")

    def abs(self) -> Panel:
        return self.transform(elementwise.absolute)

    def clip(self, lower: float | None = None, upper: float | None = None) -> Panel:
        return self.transform(elementwise.clip, lower, upper)

    def where(self, cond: Panel, other=None) -> Panel:
        return self._with(cond, elementwise.choose, other, True)

    def mask(self, cond: Panel, other=None) -> Panel:
        return self._with(cond, elementwise.choose, other, False)

    # along each id

    def rolling(self, window: int, func: str = "mean", min_periods: int | None = None) -> Panel:
        return self.transform(windows.rolling, window, func, min_periods)

    def expanding(self, func: str = "mean", min_periods: int = 1) -> Panel:
        return self.transform(windows.expanding, func, min_periods)

    def zscore(self, window: int, min_periods: int | None = None) -> Panel:
        return self.transform(windows.zscore, window, min_periods)

    def shift(self, periods: int = 1) -> Panel:
        return self.transform(windows.shift, periods)

    def diff(self, periods: int = 1) -> Panel:
        return self.transform(windows.diff, periods)

    def pct_change(self, periods: int = 1, fill: bool = True) -> Panel:
        return self.transform(windows.pct_change, periods, fill)

    def winsorize(self, lower: float = 0.01, upper: float = 0.99) -> Panel:
        windows.check_quantiles(lower, upper)
        return self.transform(windows.winsorize, lower, upper)

    def ewm(self, span: float, func: str = "mean") -> Panel:
        return self.transform(windows.ewm, span, func)

    def cumsum(self) -> Panel:
        return self.transform(windows.cumulative, "sum")

    def cumprod(self) -> Panel:
        return self.transform(windows.cumulative, "prod")

    def cummax(self) -> Panel:
        return self.transform(windows.cumulative, "max")

    def cummin(self) -> Panel:
        return self.transform(windows.cumulative, "min")

    def resample(self, freq: str, func: str = "last") -> Panel:
        return self.transform(resample.resample, freq, func)

    # across each date

    def cs_rank(self) -> Panel:
        return self.transform(cross.cs_rank)

    def cs_zscore(self) -> Panel:
        return self._per_date(cross.cs_zscore)

    def cs_demean(self) -> Panel:
        return self._per_date(cross.cs_demean)

    def cs_winsorize(self, lower: float = 0.01, upper: float = 0.99) -> Panel:
        windows.check_quantiles(lower, upper)
        return self._per_date(cross.cs_winsorize, lower=lower, upper=upper)

    # calendars

    def align_to_calendar(self, calendar: Calendar | None = None, fill_method="ffill") -> Panel:
        align.check_fill(fill_method)
        onto = calendar or self.calendar
        return Panel(lambda s, e: align.align_to_calendar(self._build(s, e), s, e, onto, fill_method), self.calendar, f"align_to_calendar({onto!r}, {fill_method!r}, {self.name})", (self,))

    def align_to(self, target: Panel, fill_method="ffill") -> Panel:
        align.check_fill(fill_method)
        return self._with(target, align.align_to, fill_method)

    def dt_shift(self, periods: int = 1) -> Panel:
        """Rows of ``periods`` calendar days ago under the dates asked for. The scan itself
        moves, wherever in a chain this stands."""
        calendar = self.calendar

        def build(start: date, end: date) -> DataFrame:
            low, high = calendar.offset(start, -periods), calendar.offset(end, -periods)
            return calendar.shift(self._build(low, high), periods, low, high)

        return Panel(build, calendar, f"dt_shift({periods}, {self.name})", (self,))

    # own functions

    def apply(self, func: Callable[[DataFrame], DataFrame]) -> Panel:
        """A function of the whole table, written with Spark."""
        return self.transform(func)

    def apply_pandas(self, func, schema: str, by: str = ID) -> Panel:
        """A pandas function of the rows of one id, or of one date with ``by``; the rows of
        a group have to fit a worker. A function across groups cannot be distributed."""
        return self.transform(lambda df: df.groupBy(by).applyInPandas(func, schema), label=f"apply_pandas.{_label(func)}")

    def cached(self, store=None, mode: str = "a", parents: tuple | None = None, chunk_by: str = "month") -> Panel:
        """Rows through a store that keeps what was computed: see ``sources.store``. Without
        a store or parents, those that ``configure`` names."""
        from panelwright.sources.store import default_parents, default_store, through_store

        def build(start: date, end: date) -> DataFrame:
            levels = default_parents(chunk_by) if parents is None else tuple(parents)
            return through_store(self, store or default_store(chunk_by), start, end, mode, levels)

        return Panel(build, self.calendar, f"cached({self.name})", (self,))


def _said(value) -> str:
    """Text that tells values apart: of tables their plans, of panels their keys."""
    if isinstance(value, DataFrame):
        return f"table({value.schema.simpleString()}, {value.semanticHash()})"
    if isinstance(value, Panel):
        return value.key
    if isinstance(value, list | tuple):
        return f"[{', '.join(map(_said, value))}]"
    return _label(value) if callable(value) else repr(value)


def _label(func) -> str:
    """Where a function is defined, what it does, and what it has taken along."""
    code = getattr(func, "__code__", None)
    where = ""
    if code and "<" in func.__qualname__:
        taken = [_said(c.cell_contents) for c in func.__closure__ or ()] + [_said(func.__defaults__ or ()), _said(sorted((func.__kwdefaults__ or {}).items()))]
        text = code.co_code + repr([c for c in code.co_consts if not hasattr(c, "co_code")]).encode() + repr(code.co_names).encode() + " ".join(taken).encode()
        where = f":{code.co_firstlineno}:{hashlib.sha256(text).hexdigest()[:16]}"
    return f"{getattr(func, '__module__', '')}.{getattr(func, '__qualname__', repr(func))}{where}"


def in_order(df: DataFrame) -> DataFrame:
    """Sorted by date and id, as rows leave for the driver."""
    return df.orderBy(*[k for k in KEYS if k in df.columns])


def in_range(df: DataFrame, start: date, end: date) -> DataFrame:
    """Rows from the first to the last day, whole days for time stamps."""
    after = F.date_add(F.lit(end), 1)
    kind = df.schema[DATE].dataType.typeName()
    if kind == "date":
        return df.where(F.col(DATE).between(F.lit(start), F.lit(end)))
    return df.where((F.col(DATE) >= F.lit(start).cast(kind)) & (F.col(DATE) < after.cast(kind)))
