"""LazyFrame: a Spark plan with the API's row semantics.

Row order: Spark's rows have none, so a hidden column ``__rid`` stands for it. It
is added only where an operation looks at order (shifts, running and rolling
functions, first/last, slices from the end, ties of a stable sort ...) and never
leaves the frame; relational plans carry none, and push-down stays whole. It is
the partition number and the position in it (``monotonically_increasing_id``), so
adding it needs no shuffle.

Running sums, minima and maxima over a whole frame don't collapse to one task:
each partition is scanned by itself and then shifted by the totals of the
partitions before it (one row per partition, broadcast). Functions that look a bounded
number of rows away (shift, diff, pct_change, rolling) run in blocks of positions with
copies of the rows at their edges.
"""

from __future__ import annotations

from collections.abc import Iterable
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidRequest, require
from ..functions.compiler import RID, Context, quoted, smoothed, window_of
from ..plans.expr import Expr, as_expr, col, expand, is_aggregate, needs_order, output_name, walk
from . import grouping, joins

TOTALS = {"cum_sum": (F.sum, lambda a, b: a + b), "cum_min": (F.min, F.least), "cum_max": (F.max, F.greatest)}
#: Functions that look at most so many rows away, over a whole frame.
REACH = {"shift": lambda p: abs(p["n"]), "diff": lambda p: abs(p["n"]), "pct_change": lambda p: abs(p["n"]), "rolling": lambda p: p["size"]}
BLOCK_ROWS = 1 << 20


def _exprs(values) -> list[Expr]:
    flat: list = []
    for v in values:
        flat += list(v) if isinstance(v, (list, tuple)) else [v]
    return [col(v) if isinstance(v, str) else as_expr(v) for v in flat]


class LazyFrame:
    """An immutable plan; every operation returns a new one."""

    def __init__(self, df: DataFrame):
        self._df = df

    # ---- order

    @property
    def spark(self) -> SparkSession:
        return self._df.sparkSession

    @property
    def _plain(self) -> DataFrame:
        return self._df.drop(RID) if RID in self._df.columns else self._df

    def _with_order(self) -> "LazyFrame":
        return self if RID in self._df.columns else LazyFrame(self._df.withColumn(RID, F.monotonically_increasing_id()))

    def to_spark(self) -> DataFrame:
        """The Spark DataFrame (without the hidden order)."""
        return self._plain

    @property
    def schema(self) -> T.StructType:
        return self._plain.schema

    @property
    def columns(self) -> list[str]:
        return self._plain.columns

    # ---- projection

    def _outputs(self, values) -> list[Expr]:
        return [x for e in _exprs(values) for x in expand(e, self.schema)]

    def _compiled(self, exprs: list[Expr]) -> tuple[DataFrame, list[Column]]:
        """The frame to select from and a column per expression. Aggregates among row
        expressions are computed once, as one row that is joined to every row; running totals
        over the whole frame are scanned by partition."""
        frame = self._with_order() if any(map(needs_order, exprs)) else self
        df = frame._df
        lifted: dict[int, str] = {}
        aggregates: list[Expr] = []

        def lift(e: Expr) -> Expr:
            if e.op == "over":
                return e
            if e.op == "cat.physical" and e.params["categories"] is None and len(e.args) == 1:
                found = Expr("cat.categories", e.args, {"categories": None})
                aggregates.append(found)
                return Expr(e.op, (*e.args, col(lifted.setdefault(id(found), f"__agg{len(lifted)}"))), e.params)
            if is_aggregate(e) and not any(is_aggregate(a) for a in e.args):
                name = lifted.setdefault(id(e), f"__agg{len(lifted)}")
                if len(aggregates) < len(lifted):
                    aggregates.append(e)
                return col(name)
            return Expr(e.op, tuple(map(lift, e.args)), e.params)

        exprs = [lift(e) for e in exprs]
        if aggregates:
            source = _numbered(df) if any(e.op in ("arg_min", "arg_max") for e in aggregates) else df
            ctx = Context(source)
            row = source.agg(*[ctx.compile(e).alias(lifted[id(e)]) for e in aggregates])
            df = df.crossJoin(F.broadcast(row))  # exactly one row

        waiting: dict[str, Expr] = {}  # running totals and neighbours to compute, by the name of their column

        def flush() -> None:
            nonlocal df
            ctx = Context(df)
            runs = [(name, e.op, ctx.compile(e.args[0])) for name, e in waiting.items() if e.op in TOTALS]
            near = {name: e for name, e in waiting.items() if e.op not in TOTALS}
            waiting.clear()
            df = _scan(df, runs) if runs else df
            df = _neighbours(df, near) if near else df

        def totals(e: Expr) -> Expr:
            nonlocal df
            if e.op == "ewm" or e.op == "over" and e.args[0].op == "ewm":
                flush()
                return smooth(e)
            if e.op == "over":
                return e
            e = Expr(e.op, tuple(map(totals, e.args)), e.params)
            if e.op == "is_in_column" and not (isinstance(Context(df).kind(e.args[1]), T.ArrayType) and not isinstance(Context(df).kind(e.args[0]), T.ArrayType)):
                flush()
                name = f"__in{len(df.columns)}"
                df = _member(df, Context(df).compile(e.args[0]), Context(df).compile(e.args[1]), e.params["nulls_equal"], name)
                return col(name)
            if e.op in TOTALS and not e.params["reverse"] or e.op in REACH:
                if any(x.op == "col" and x.params["name"] in waiting for x in walk(e)):
                    flush()
                name = f"__run{len(df.columns)}_{len(waiting)}"
                waiting[name] = e
                return col(name)
            return e

        def smooth(e: Expr) -> Expr:
            nonlocal df
            name = f"__ewm{len(df.columns)}"
            inner = e.args[0] if e.op == "over" else e
            ctx = window_of(df, e) if e.op == "over" else Context(df)
            df = smoothed(ctx, ctx.compile(inner.args[0]), inner.params, name)
            return col(name)

        exprs = [totals(e) for e in exprs]
        flush()
        ctx = Context(df)
        return df, [ctx.compile(e) for e in exprs]

    def select(self, *values) -> "LazyFrame":
        """A projection; aggregates alone give one row, and beside row expressions are repeated."""
        exprs = self._outputs(values)
        names = _unique([output_name(e) for e in exprs])
        if any(x.op == "over" and x.params["mapping"] == "explode" for e in exprs for x in walk(e)):
            return self._exploded(exprs, names)
        if any(x.op == "diff" and x.params["null_behavior"] == "drop" for e in exprs for x in walk(e)):
            return self._shortened(exprs, names)
        if exprs and all(is_aggregate(e) and e.op != "over" or e.op == "lit" for e in exprs) and any(is_aggregate(e) for e in exprs):
            frame = self._with_order() if any(map(needs_order, exprs)) else self
            df = _numbered(frame._df) if any(x.op in ("arg_min", "arg_max") for e in exprs for x in walk(e)) else frame._df
            ctx = Context(df)
            return LazyFrame(df.agg(*[ctx.compile(e).alias(n) for e, n in zip(exprs, names, strict=True)]))
        df, columns = self._compiled(exprs)
        hidden = [F.col(RID)] if RID in df.columns else []
        return LazyFrame(df.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)], *hidden))

    def _exploded(self, exprs: list[Expr], names: list[str]) -> "LazyFrame":
        """Groups one after the other, in the order of their first rows, instead of in the order of the rows."""
        cores = [e.meta.undo_aliases() for e in exprs]
        require(all(e.op == "over" and e.params["mapping"] == "explode" for e in cores), "over(mapping='explode') stands only beside others of its kind")
        keys = [list(map(repr, e.params["keys"])) for e in cores]
        require(all(k == keys[0] for k in keys), "over(mapping='explode') takes the same partition in a select")
        plain = [Expr("over", e.args, {**e.params, "mapping": "groups_to_rows"}) for e in cores]
        frame = self._with_order()
        df, columns = frame._compiled(plain)
        group = list(map(Context(df).compile, cores[0].params["keys"]))
        places = [window_of(df, e).position() for e in cores]
        first = F.min(RID).over(Window.partitionBy(*group))
        at = [F.row_number().over(Window.partitionBy(*group).orderBy(*p)) for p in places]
        df = df.select(*[c.alias(f"__c{i}") for i, c in enumerate(columns)], first.alias("__first"), *[a.alias(f"__a{i}") for i, a in enumerate(at)])
        out = df.select("__first", F.col("__a0").alias("__place"), F.col("__c0").alias(names[0]))
        for i in range(1, len(names)):  # each column has its own order inside the group
            out = out.join(df.select("__first", F.col(f"__a{i}").alias("__place"), F.col(f"__c{i}").alias(names[i])), ["__first", "__place"])
        out = out.orderBy("__first", "__place").withColumn(RID, F.monotonically_increasing_id())
        return LazyFrame(out.select(*[quoted(n) for n in names], RID))

    def _shortened(self, exprs: list[Expr], names: list[str]) -> "LazyFrame":
        """Differences without the first n rows, which have none."""
        cores = [e.meta.undo_aliases() for e in exprs]
        require(all(e.op == "diff" and e.params["null_behavior"] == "drop" for e in cores), "diff(null_behavior='drop') changes the height: it stands only beside others of its kind")
        n = cores[0].params["n"]
        require(n >= 0 and all(e.params["n"] == n for e in cores), "diff(null_behavior='drop') takes the same n in a select")
        plain = [Expr("diff", e.args, {**e.params, "null_behavior": "ignore"}).alias(name) for e, name in zip(cores, names, strict=True)]
        rows = _numbered(self.select(*plain)._with_order()._df)
        return LazyFrame(rows.filter(F.col("__at") >= n).drop("__at"))

    def with_columns(self, *values, **named) -> "LazyFrame":
        """Adds or replaces columns; all are computed from the input."""
        exprs = self._outputs(values) + [as_expr(e).alias(n) for n, e in named.items()]
        names = _unique([output_name(e) for e in exprs])
        df, columns = self._compiled(exprs)
        new = dict(zip(names, columns, strict=True))
        kept = [new.pop(c).alias(c) if c in new else quoted(c) for c in self.columns]
        hidden = [F.col(RID)] if RID in df.columns else []
        return LazyFrame(df.select(*kept, *[c.alias(n) for n, c in new.items()], *hidden))

    def filter(self, *predicates) -> "LazyFrame":
        """Rows for which every predicate is true."""
        exprs = self._outputs(predicates)
        df, columns = self._compiled(exprs)
        test = columns[0]
        for c in columns[1:]:
            test = test & c
        keep = self.columns + [RID] * (RID in df.columns)
        return LazyFrame(df.filter(test).select(*[quoted(c) for c in keep]))

    def drop_nulls(self, *subset: str) -> "LazyFrame":
        """Rows without a null (NaN isn't one)."""
        names = [n for e in self._outputs(subset) for n in [output_name(e)]] if subset else self.columns
        df = self._df
        for n in names:
            df = df.filter(quoted(n).isNotNull())
        return LazyFrame(df)

    def drop(self, *names: str, strict: bool = True) -> "LazyFrame":
        missing = [n for n in names if n not in self.columns]
        require(not (strict and missing), f"no columns {missing}")
        return LazyFrame(self._df.drop(*[n for n in names if n in self.columns]))

    def rename(self, mapping: dict[str, str], strict: bool = True) -> "LazyFrame":
        missing = [n for n in mapping if n not in self.columns]
        require(not (strict and missing), f"no columns {missing}")
        return LazyFrame(self._df.select(*[quoted(c).alias(mapping.get(c, c)) for c in self._df.columns]))

    def diff_drop(self, column: str, n: int = 1) -> "LazyFrame":
        """``diff`` of one column without its first n rows."""
        return self.select(col(column).diff(n, "drop"))

    # ---- order and slices

    def sort(self, *by, descending: bool | Iterable[bool] = False, nulls_last: bool | Iterable[bool] = False, maintain_order: bool = False) -> "LazyFrame":
        exprs = self._outputs(by)
        require(bool(exprs), "sort needs a key")
        down, last = (list(v) if isinstance(v, (list, tuple)) else [v] * len(exprs) for v in (descending, nulls_last))
        require(len(down) == len(last) == len(exprs), "one flag for each key, or one for all")
        frame = self._with_order() if maintain_order else self
        df, columns = frame._compiled(exprs)
        pick = {(False, False): "asc_nulls_first", (False, True): "asc_nulls_last", (True, False): "desc_nulls_first", (True, True): "desc_nulls_last"}
        keys = [getattr(c, pick[bool(d), bool(n)])() for c, d, n in zip(columns, down, last, strict=True)]
        keys += [F.col(RID)] if maintain_order else []
        return LazyFrame(df.orderBy(*keys).select(*[quoted(c) for c in self.columns]))

    def head(self, n: int = 5) -> "LazyFrame":
        return LazyFrame(self._df.limit(n))

    def tail(self, n: int = 5) -> "LazyFrame":
        frame = self._with_order()
        return LazyFrame(frame._df.orderBy(F.col(RID).desc()).limit(n).orderBy(RID))

    def slice(self, offset: int, length: int | None = None) -> "LazyFrame":
        if offset >= 0:
            df = self._df.offset(offset)
            return LazyFrame(df if length is None else df.limit(length))
        last = self.tail(-offset)
        return last if length is None else LazyFrame(last._df.limit(length))

    def reverse(self) -> "LazyFrame":
        return LazyFrame(self._with_order()._df.orderBy(F.col(RID).desc()).drop(RID))

    def with_row_number(self, name: str) -> "LazyFrame":
        """Gapless positions from 0: counts of the partitions before, plus the place in its own."""
        return LazyFrame(_numbered(self._with_order()._df).withColumnRenamed("__at", name))

    # ---- grouping, joins

    def group_by(self, *keys, maintain_order: bool = False) -> "grouping.GroupBy":
        return grouping.GroupBy(self, _exprs(keys), maintain_order)

    def group_by_dynamic(self, index: str, every: str, **options) -> "grouping.DynamicGroupBy":
        return grouping.DynamicGroupBy(self, index, every, **options)

    def group_by_rolling(self, index: str, period: str, **options) -> "grouping.RollingGroupBy":
        return grouping.RollingGroupBy(self, index, period, **options)

    def join(self, other: "LazyFrame", **options) -> "LazyFrame":
        return joins.join(self, other, **options)

    def join_asof(self, other: "LazyFrame", **options) -> "LazyFrame":
        return joins.join_asof(self, other, **options)

    def join_where(self, other: "LazyFrame", *predicates: Expr, suffix: str = "_right") -> "LazyFrame":
        return joins.join_where(self, other, *predicates, suffix=suffix)

    # ---- distinct and shape

    def distinct(self, *subset: str, keep: str = "first", maintain_order: bool = False) -> "LazyFrame":
        require(keep in ("first", "last", "any", "none"), f"keep is first, last, any or none, not {keep}")
        names = list(subset) or self.columns
        if keep == "any" and not maintain_order:
            return LazyFrame(self._plain.dropDuplicates(names))
        if keep == "none":
            frame = self._with_order() if maintain_order else self
            df = frame._df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*map(quoted, names)))).filter("__n = 1").drop("__n")
        else:
            # One aggregation with map-side combining instead of a window over each group.
            frame = self._with_order()
            others = [c for c in frame._df.columns if c not in names]
            pick = F.max_by if keep == "last" else F.min_by
            row = pick(F.struct(*[quoted(c) for c in others]), F.col(RID)).alias("__row")
            df = frame._df.groupBy(*map(quoted, names)).agg(row).select(*[quoted(n) for n in names], "__row.*").select(*[quoted(c) for c in frame._df.columns])
        return LazyFrame(df.orderBy(RID)) if maintain_order else LazyFrame(df)

    def explode(self, *columns) -> "LazyFrame":
        """Rows per element; several columns in step. Empty and null lists give one null row."""
        names = [output_name(e) for e in self._outputs(columns)]
        require(bool(names), "explode needs a column")
        df = self._df
        if len(names) == 1:
            new = {names[0]: F.explode_outer(quoted(names[0]))}
            return LazyFrame(df.select(*[new[c].alias(c) if c in new else quoted(c) for c in df.columns]))
        sizes = [F.coalesce(F.size(quoted(n)), F.lit(-1)) for n in names]
        same = sizes[0] == sizes[1]
        for s in sizes[2:]:
            same = same & (sizes[0] == s)
        zipped = F.when(same, F.arrays_zip(*[quoted(n) for n in names])).otherwise(F.raise_error(F.lit("lists to explode differ in length")))
        kept = [c for c in df.columns if c not in names]
        out = df.select(*[quoted(c) for c in kept], F.inline_outer(zipped).alias(*names))
        return LazyFrame(out.select(*[quoted(c) for c in df.columns]))

    def unnest(self, *columns: str) -> "LazyFrame":
        out: list[Column] = []
        for f in self._df.schema.fields:
            out += [quoted(f.name).getField(n).alias(n) for n in f.dataType.names] if f.name in columns else [quoted(f.name)]
        return LazyFrame(self._df.select(*out))

    def unpivot(self, on: list[str] | None = None, index: list[str] | None = None, variable_name: str = "variable", value_name: str = "value") -> "LazyFrame":
        index = index or []
        on = on or [c for c in self.columns if c not in index]
        return LazyFrame(self._plain.unpivot([quoted(c) for c in index], [quoted(c) for c in on], variable_name, value_name))

    # ---- running

    def collect(self, **options):
        from .eager import DataFrame as Eager

        from ..streaming.jobs import guarded

        check_options(options)
        off = [OPTIMIZER_FLAGS[k] for k, v in options.items() if v is False and OPTIMIZER_FLAGS.get(k)]
        with _without(self.spark, off):
            return guarded(lambda: Eager.materialised(self))

    def submit(self):
        from ..streaming.jobs import Job

        return Job(self)

    def batches(self, batch_rows: int = 65_536, capacity: int = 2):
        from ..streaming.batches import BatchStream

        return BatchStream(self, batch_rows, capacity)

    def profile(self):
        from ..streaming.jobs import profile

        return profile(self)

    def explain(self, optimized: bool = True, format: str = "plain") -> str:
        require(format in ("plain", "tree", "dot"), f"no plan format {format}")
        plan = self._plain._jdf.queryExecution()
        node = plan.optimizedPlan() if optimized else plan.analyzed()
        if format != "dot":
            return node.treeString() if format == "tree" else node.toString()
        lines, stack = ["digraph plan {"], []
        for i, line in enumerate(node.treeString().splitlines()):
            depth = len(line) - len(line.lstrip(" :+-"))
            while stack and stack[-1][0] >= depth:
                stack.pop()
            lines.append(f'  n{i} [label="{line.strip(" :+-")[:80].replace(chr(34), chr(39))}"];')
            if stack:
                lines.append(f"  n{stack[-1][1]} -> n{i};")
            stack.append((depth, i))
        return "\n".join([*lines, "}"])

    def sink_parquet(self, path: str, **o): return _sink(self, "parquet", path, o)  # noqa: E704
    def sink_csv(self, path: str, **o): return _sink(self, "csv", path, o)  # noqa: E704
    def sink_ndjson(self, path: str, **o): return _sink(self, "ndjson", path, o)  # noqa: E704
    def sink_ipc(self, path: str, **o): return _sink(self, "ipc", path, {"parts": True, **o})  # noqa: E704


OPTIMIZER_FLAGS = {
    "projection_pushdown": "org.apache.spark.sql.catalyst.optimizer.ColumnPruning", "predicate_pushdown": "org.apache.spark.sql.catalyst.optimizer.PushDownPredicates",
    "cluster_with_columns": "org.apache.spark.sql.catalyst.optimizer.CollapseProject", "simplify_expression": "org.apache.spark.sql.catalyst.optimizer.ConstantFolding",
    "slice_pushdown": "org.apache.spark.sql.catalyst.optimizer.LimitPushDown", "fast_projection": "org.apache.spark.sql.catalyst.optimizer.RemoveNoopOperators",
    "sort_collapse": "org.apache.spark.sql.catalyst.optimizer.EliminateSorts", "type_coercion": "", "type_check": "", "common_subplan_elimination": "",
    "common_subexpression_elimination": "", "row_estimate": "", "check_order_observe": "", "partition_hive": "",
}


@contextmanager
def _without(spark: SparkSession, rules: list[str]):
    """Without some of the optimizer's rules. The setting is the session's, so it holds for other work of the session meanwhile."""
    name = "spark.sql.optimizer.excludedRules"
    before = spark.conf.get(name, None)
    if rules:
        spark.conf.set(name, ",".join([before, *rules] if before else rules))
    try:
        yield
    finally:
        if rules:
            spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def check_options(options: dict) -> None:
    """Flags that name a rule of Spark's optimizer turn it off where they are False (Spark keeps those it can't do
    without); the others, and engine names, are accepted only."""
    require(options.get("engine", "auto") in ("auto", "in_memory", "streaming"), "engine is auto, in_memory or streaming")
    unknown = set(options) - {"engine"} - set(OPTIMIZER_FLAGS)
    require(not unknown, f"no options {sorted(unknown)}")


def _sink(frame: LazyFrame, kind: str, path: str, options: dict):
    from ..sources import writers

    return getattr(writers, f"write_{kind}")(frame, path, **options)


def _unique(names: list[str]) -> list[str]:
    again = {n for n in names if names.count(n) > 1}
    if again:
        raise InvalidRequest(f"columns given twice: {sorted(again)}")
    return names


def _scan(df: DataFrame, runs: list[tuple[str, str, Column]]) -> DataFrame:
    """Running totals (name, operation, value) over the whole frame, all in one pass: every partition by itself, and the totals
    of the partitions before it, one row each. A row's partition is in its order number, so both sides agree on it."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        # Both uses of the frame must see the same partitions; adaptive execution may deal a shuffle out anew for each.
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    part = F.shiftright(F.col(RID), 33).alias("__part")
    value = {name: f"__x_{name}" for name, _, _ in runs}
    df = df.withColumns({value[name]: v for name, _, v in runs}).withColumn("__part", part)
    carry = df.groupBy("__part").agg(*[TOTALS[op][0](value[name]).alias(f"__t_{name}") for name, op, _ in runs])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select("__part", *[TOTALS[op][0](f"__t_{name}").over(before).alias(f"__c_{name}") for name, op, _ in runs])
    inside = Window.partitionBy("__part").orderBy(RID).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({f"__l_{name}": TOTALS[op][0](value[name]).over(inside) for name, op, _ in runs}).join(F.broadcast(carry), "__part", "left")
    made = {}
    for name, op, _ in runs:
        own, past = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        made[name] = F.when(F.col(value[name]).isNotNull(), F.when(past.isNull(), own).otherwise(TOTALS[op][1](past, own)))
    df = df.withColumns(made)
    return df.drop("__part", *[f"{k}{name}" for name, _, _ in runs for k in ("__x_", "__l_", "__c_")])


def _neighbours(df: DataFrame, made: dict[str, Expr]) -> DataFrame:
    """With columns of functions that look a bounded number of rows away over the whole frame. Rows are dealt into
    blocks of their positions; rows within reach of an edge are also put into the block beyond it, as ghosts, so
    every block is a window of its own."""
    reach = max(REACH[e.op](e.params) for e in made.values())
    size = max(BLOCK_ROWS, reach)
    own = F.expr(f"__at div {size}")
    inside = F.col("__at") % size
    to = F.array(own, F.when(inside >= size - reach, own + 1), F.when((inside < reach) & (own > 0), own - 1))
    rows = _numbered(df).withColumn("__block", F.explode(F.array_compact(to)))
    ctx = Context(rows, (F.col("__block"),))
    rows = rows.withColumns({name: ctx.compile(e) for name, e in made.items()})
    return rows.filter(F.col("__block") == F.expr(f"__at div {size}")).drop("__at", "__block")


def _member(df: DataFrame, x: Column, values: Column, nulls_equal: bool, name: str) -> DataFrame:
    """With the column ``name``: whether x is among all rows' values. The distinct values are joined: broadcast while
    small, else shuffled."""
    found = df.select(values.alias("__v")).distinct().withColumn("__found", F.lit(True))
    df = df.withColumn("__m", x)
    same = F.col("__m").eqNullSafe(F.col("__v")) if nulls_equal else F.col("__m") == F.col("__v")
    seen = F.coalesce(F.col("__found"), F.lit(False))
    out = df.join(found, same, "left").withColumn(name, seen if nulls_equal else F.when(F.col("__m").isNotNull(), seen))
    return out.drop("__v", "__found", "__m")


def _numbered(df: DataFrame) -> DataFrame:
    """With ``__at``: gapless positions from 0 in row order."""
    if RID not in df.columns:
        df = df.withColumn(RID, F.monotonically_increasing_id())
    df = _scan(df, [("__at", "cum_sum", F.lit(1).cast("bigint"))])
    return df.withColumn("__at", F.col("__at") - 1)
