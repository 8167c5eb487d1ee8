"""Grouped aggregation: by keys, by dynamic windows, and one rolling window per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import require
from ..functions import durations
from ..functions.compiler import RID, Context, quoted
from ..plans.expr import Expr, expand, is_aggregate, needs_order, output_name, walk

DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def _imploded(e: Expr) -> Expr:
    """What isn't an aggregate becomes the group's list."""
    return e if is_aggregate(e) else Expr("implode", (e,), {})


class GroupBy:
    """``agg`` gives one row per key; a null key is a group of its own."""

    def __init__(self, frame, keys: list[Expr], maintain_order: bool):
        self._frame, self._keys, self._keep = frame, [k for e in keys for k in expand(e, frame.schema)], maintain_order

    def agg(self, *values):
        from .frame import LazyFrame, _exprs, _unique

        exprs = [_imploded(x) for e in _exprs(values) for x in expand(e, self._frame.schema)]
        at = any(x.op in ("arg_min", "arg_max") for e in exprs for x in walk(e))
        ordered = self._keep or any(map(needs_order, exprs))
        df = (self._frame._with_order() if ordered or at else self._frame)._df
        names = [output_name(k) for k in self._keys]
        _unique(names + [output_name(e) for e in exprs])
        key_ctx = Context(df)
        keys = [key_ctx.compile(k).alias(f"__k{i}") for i, k in enumerate(self._keys)]
        df = df.select("*", *keys)
        keys = [f"__k{i}" for i in range(len(keys))]
        if at:  # positions inside the group
            df = df.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(RID)) - 1)
        ctx = Context(df)
        extra = [F.min(RID).alias("__first")] if self._keep else []
        out = df.groupBy(*keys).agg(*[ctx.compile(e).alias(output_name(e)) for e in exprs], *extra) if exprs or extra else df.select(*keys).distinct()
        if self._keep:
            out = out.orderBy("__first").drop("__first")
        return LazyFrame(out.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *[quoted(output_name(e)) for e in exprs]))


def _index(df: DataFrame, name: str) -> tuple[Column, bool]:
    """The index as a number (microseconds or integer), and whether it is a time."""
    t = df.schema[name].dataType
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), quoted(name).cast("timestamp_ntz")), True
    return quoted(name).cast("bigint"), False


def _time(c: Column, t: T.DataType) -> Column:
    return F.timestamp_micros(c).cast("timestamp_ntz").cast(t) if isinstance(t, (T.TimestampNTZType, T.DateType)) else F.timestamp_micros(c).cast(t)


class DynamicGroupBy:
    """Windows [start, start + period) that begin every ``every``; each row is put into the windows it
    belongs to (as many as period/every, whatever the data), then one aggregation."""

    def __init__(self, frame, index, every, period=None, offset="0i", closed="left", label="left", include_boundaries=False, start_by="window_bound", by=()):
        require(closed in ("left", "right", "both", "none"), f"no closed side {closed}")
        require(label in ("left", "right", "data_point"), f"no label {label}")
        require(start_by in ("window_bound", "data_point", *DAYS), f"no start {start_by}")
        self._frame, self._index, self._by = frame, index, [by] if isinstance(by, str) else list(by)
        self._every, self._period = durations.parse(every), durations.parse(period or every)
        self._offset = durations.parse(offset) if offset not in ("0i", None) else durations.Duration()
        require(self._every.positive and self._period.positive, "windows are positive")
        self._closed, self._label, self._bounds, self._start = closed, label, include_boundaries, start_by

    def _with_first(self, df: DataFrame) -> DataFrame:
        """With ``__o``: the first index of the row's group; a null key is a group of its own."""
        first = df.groupBy(*[quoted(k).alias(f"__f{i}") for i, k in enumerate(self._by)]).agg(F.min("__t").alias("__o"))
        if not self._by:
            return df.crossJoin(F.broadcast(first))  # exactly one row
        same = F.lit(True)
        for i, k in enumerate(self._by):
            same = same & quoted(k).eqNullSafe(F.col(f"__f{i}"))
        return df.join(first, same).drop(*[f"__f{i}" for i in range(len(self._by))])

    def agg(self, *values):
        from .frame import LazyFrame, _exprs

        exprs = [_imploded(x) for e in _exprs(values) for x in expand(e, self._frame.schema)]
        df = (self._frame._with_order() if any(map(needs_order, exprs)) else self._frame)._df
        t, is_time = _index(df, self._index)
        kind = df.schema[self._index].dataType
        df = df.withColumn("__t", t).filter(F.col("__t").isNotNull())
        lower = ">=" if self._closed in ("left", "both") else ">"
        upper = "<=" if self._closed in ("right", "both") else "<"
        if self._every.months or self._period.months:
            require(not self._every.micros and not self._period.micros and is_time, "calendar windows have calendar steps and periods")
            wall = F.timestamp_micros(F.col("__t") - self._offset.micros)
            i = F.year(wall) * 12 + F.month(wall) - 1 - self._offset.months
            last = F.floor(i / self._every.months)
            first = last - -(-self._period.months // self._every.months)
            require(self._start not in DAYS, "calendar windows start at their bound or at the first row")
            if self._start == "data_point":
                df = self._with_first(df)
                origin = F.timestamp_micros(F.col("__o") + self._offset.micros).cast("timestamp_ntz")
                i = (F.year(wall) - F.year(origin)) * 12 + F.month(wall) - F.month(origin) - self._offset.months
                last = F.floor(i / self._every.months)
                first = last - -(-self._period.months // self._every.months) - 1
                df = df.withColumn("__w", F.explode(F.sequence(first, last)))
                at = lambda m: F.unix_micros((origin + F.make_ym_interval(F.lit(0), (m + self._offset.months).cast("int"))).cast("timestamp"))
                df = df.withColumns({"__lo": at(F.col("__w") * self._every.months), "__hi": at(F.col("__w") * self._every.months + self._period.months)})
        if (self._every.months or self._period.months) and self._start != "data_point":
            df = df.withColumn("__w", F.explode(F.sequence(first, last)))
            month = lambda m: F.unix_micros(F.make_date(F.floor((m + self._offset.months) / 12).cast("int"), (F.pmod(m + self._offset.months, F.lit(12)) + 1).cast("int"), F.lit(1)).cast("timestamp_ntz").cast("timestamp")) + self._offset.micros  # noqa: E731, E501
            df = df.withColumns({"__lo": month(F.col("__w") * self._every.months), "__hi": month(F.col("__w") * self._every.months + self._period.months)})
        elif not self._every.months:
            step, size = (d.micros or d.index for d in (self._every, self._period))
            origin = F.lit(self._offset.micros or self._offset.index)
            if self._start in DAYS:
                origin = origin + F.lit((4 + DAYS.index(self._start)) * durations.MICROS["d"])
            elif self._start == "data_point":
                df = self._with_first(df)
                origin = origin + F.col("__o")
            elif is_time and step % durations.MICROS["w"] == 0:
                origin = origin + F.lit(4 * durations.MICROS["d"])  # weeks begin on Monday
            last = F.floor((F.col("__t") - origin) / step)
            df = df.withColumns({"__last": last, "__o2": origin}).withColumn("__w", F.explode(F.sequence(F.col("__last") - -(-size // step), F.col("__last"))))
            df = df.withColumns({"__lo": F.col("__o2") + F.col("__w") * step, "__hi": F.col("__o2") + F.col("__w") * step + size})
        df = df.filter(F.expr(f"__t {lower} __lo and __t {upper} __hi"))
        ctx = Context(df)
        out = df.groupBy(*map(quoted, self._by), "__lo", "__hi").agg(F.min("__t").alias("__point"), *[ctx.compile(e).alias(output_name(e)) for e in exprs])
        show = (lambda c: _time(c, kind)) if is_time else (lambda c: c.cast(kind))
        label = {"left": "__lo", "right": "__hi", "data_point": "__point"}[self._label]
        bounds = [show(F.col("__lo")).alias("_lower_boundary"), show(F.col("__hi")).alias("_upper_boundary")] if self._bounds else []
        return LazyFrame(out.select(*map(quoted, self._by), *bounds, show(F.col(label)).alias(self._index), *[quoted(output_name(e)) for e in exprs]))


class RollingGroupBy:
    """One window per row: (t - period, t] shifted by offset; a range frame in Spark."""

    def __init__(self, frame, index, period, offset=None, closed="right", by=()):
        require(closed in ("left", "right", "both", "none"), f"no closed side {closed}")
        self._frame, self._index, self._closed, self._by = frame, index, closed, [by] if isinstance(by, str) else list(by)
        self._period = durations.parse(period)
        require(self._period.positive and not self._period.months, "a rolling window has a fixed period")
        self._offset = durations.parse(offset) if offset else -self._period

    def agg(self, *values):
        from .frame import LazyFrame, _exprs

        exprs = [x for e in _exprs(values) for x in expand(e, self._frame.schema)]
        require(all(map(is_aggregate, exprs)), "rolling windows take aggregates")
        df = self._frame._with_order()._df
        t, _ = _index(df, self._index)
        df = df.withColumn("__t", t)
        if any(x.op in ("arg_min", "arg_max") for e in exprs for x in walk(e)):
            df = df.withColumn("__at", F.row_number().over(Window.partitionBy(*map(quoted, self._by)).orderBy("__t", RID)))
        lo = self._offset.micros or self._offset.index
        hi = lo + (self._period.micros or self._period.index)
        lo += self._closed in ("right", "none")
        hi -= self._closed in ("left", "none")
        by = tuple(map(quoted, self._by))
        frame = Window.partitionBy(*by).orderBy("__t").rangeBetween(lo, hi)

        class Rolling(Context):
            sliding = True

            def agg(self, c):
                return c.over(frame)

        ctx = Rolling(df, by, (), True)
        columns = [ctx.compile(e).alias(output_name(e)) for e in exprs]
        return LazyFrame(df.select(*by, quoted(self._index), *columns, RID))
