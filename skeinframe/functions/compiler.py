"""Rules that turn expression nodes into Spark columns.

``Context`` knows the frame, the row-order column and, inside ``over``, the
window. Everything here is built-in Spark functions except exponentially
weighted and UTC-offset functions, which say so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Unsupported, require
from ..plans.expr import MATH, Expr, output_name

RID = "__rid"
INF, NAN = float("inf"), float("nan")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Context:
    """Where an expression is compiled: the frame, and the window if there is one. ``order`` holds pairs:
    a sort key and the same key reversed."""

    sliding = False  # whether each row has its own range of rows, in the order of (__t, row order)

    def __init__(self, df: DataFrame, partition: tuple = (), order: tuple = (), inside: bool = False):
        self.df, self.partition, self.order, self.inside = df, partition, order, inside

    def kind(self, e: Expr) -> T.DataType:
        """The Spark type of an expression, by analysis only."""
        plain = Context(self.df, self.partition, self.order, True)
        return self.df.select(plain.compile(e).alias("x")).schema[0].dataType

    def position(self, reverse: bool = False) -> list[Column]:
        return [k[reverse] for k in self.order or (ROW_ORDER(),)]

    def ordered(self, reverse: bool = False):
        """The window in row order (or in the order that ``over`` gave)."""
        return Window.partitionBy(*self.partition).orderBy(*self.position(reverse))

    def whole(self):
        w = Window.partitionBy(*self.partition)
        return w

    def agg(self, c: Column) -> Column:
        """An aggregate as such, or over the whole partition inside ``over``."""
        return c.over(self.whole()) if self.inside else c

    def compile(self, e: Expr) -> Column:
        rule = RULES.get(e.op)
        require(rule is not None, f"no operation {e.op}")
        return rule(self, e)


def ROW_ORDER() -> tuple[Column, Column]:
    return F.col(RID).asc(), F.col(RID).desc()


RULES: dict[str, Callable[[Context, Expr], Column]] = {}
#: namespace operation -> (names of expression arguments, defaults of plain parameters)
SIGNATURES: dict[str, tuple[list[str], dict]] = {}


def rule(*names: str):
    def put(f):
        for n in names:
            RULES[n] = f
        return f

    return put


def plain(name: str, f: Callable[..., Column]) -> None:
    """A rule whose children become columns that are passed to ``f``."""
    RULES[name] = lambda ctx, e: f(*[ctx.compile(a) for a in e.args])


def space(op: str, exprs: list[str] | None = None, /, **defaults):
    """A namespace rule: ``f(ctx, e, *columns, **parameters)``."""
    SIGNATURES[op] = (exprs or [], defaults)

    def put(f):
        RULES[op] = lambda ctx, e: f(ctx, e, *[ctx.compile(a) for a in e.args], **e.params)
        return f

    return put


def _floating(t: T.DataType) -> bool:
    return isinstance(t, (T.FloatType, T.DoubleType))


def _has(x: Column, c: Column) -> Column:
    return F.when(x.isNotNull(), c)


# ---------------------------------------------------------------- nodes


@rule("col")
def _(ctx, e):
    return quoted(e.params["name"])


@rule("lit")
def _(ctx, e):
    d = e.params["dtype"]
    c = F.lit(e.params["value"])
    if d is None:
        return c.cast("bigint") if isinstance(e.params["value"], int) and not isinstance(e.params["value"], bool) else c
    return c.cast(d.spark)


@rule("alias", "rename", "name_keep")
def _(ctx, e):
    return ctx.compile(e.args[0])


@rule("cast")
def _(ctx, e):
    d, x = e.params["dtype"], ctx.compile(e.args[0])
    c = x.cast(d.spark) if e.params["strict"] else x.try_cast(d.spark)
    bounds = {"uint8": 8, "uint16": 16, "uint32": 32, "uint64": 64}.get(d.kind)
    bad = None
    if bounds:
        bad = (c < 0) | (c > F.lit(str(2**bounds - 1)).cast("decimal(20,0)"))
    if d.kind == "enum":
        bad = ~c.isin(*d.get("categories"))
    if bad is None:
        return c
    return F.when(bad, F.raise_error(F.lit(f"value outside {d.kind}")).cast(d.spark) if e.params["strict"] else F.lit(None)).otherwise(c)


@rule("when")
def _(ctx, e):
    p, a, b = map(ctx.compile, e.args)
    return F.when(p, a).otherwise(b)


def window_of(df: DataFrame, e: Expr) -> Context:
    """The context inside an ``over`` node."""
    ctx, p = Context(df), e.params
    pick = {(False, False): ("asc_nulls_first", "desc_nulls_last"), (False, True): ("asc_nulls_last", "desc_nulls_first"), (True, False): ("desc_nulls_first", "asc_nulls_last"), (True, True): ("desc_nulls_last", "asc_nulls_first")}
    ways = pick[p["descending"], p["nulls_last"]]
    order = tuple(tuple(getattr(k, way)() for way in ways) for k in map(ctx.compile, p["order"]))
    return Context(df, tuple(map(ctx.compile, p["keys"])), (*order, ROW_ORDER()) if order and RID in df.columns else order, True)


@rule("over")
def _(ctx, e):
    require(e.params["mapping"] != "explode", "over(mapping='explode') stands alone in a select")
    inner = window_of(ctx.df, e)
    if e.params["mapping"] == "join":
        return F.collect_list(inner.compile(e.args[0])).over(inner.whole())
    return inner.compile(e.args[0])


# ---------------------------------------------------------------- operators

plain("not", lambda x: ~x)
plain("negate", lambda x: -x)
plain("is_null", lambda x: x.isNull())
plain("is_not_null", lambda x: x.isNotNull())
plain("is_nan", lambda x: _has(x, F.isnan(x)))
plain("is_not_nan", lambda x: _has(x, ~F.isnan(x)))
plain("eq", lambda a, b: a == b)
plain("eq_validity", lambda a, b: a.eqNullSafe(b))
plain("not_eq", lambda a, b: a != b)
plain("not_eq_validity", lambda a, b: ~a.eqNullSafe(b))
plain("lt", lambda a, b: a < b)
plain("lt_eq", lambda a, b: a <= b)
plain("gt", lambda a, b: a > b)
plain("gt_eq", lambda a, b: a >= b)
plain("subtract", lambda a, b: a - b)
plain("multiply", lambda a, b: a * b)
plain("and", lambda a, b: a & b)
plain("or", lambda a, b: a | b)
plain("pow", F.pow)
plain("atan2", F.atan2)
plain("coalesce", F.coalesce)
plain("fill_null", F.coalesce)
plain("fill_nan", lambda x, v: F.when(F.isnan(x), v).otherwise(x))
plain("abs", F.abs)
plain("is_finite", lambda x: _has(x, ~F.isnan(x) & (F.abs(x) != F.lit(INF))))
plain("is_infinite", lambda x: F.abs(x) == F.lit(INF))
plain("clip", lambda x, lo, hi: F.when(_odd(x), x).when(x.isNotNull(), F.greatest(F.least(x, hi), lo)))
plain("clip_min", lambda x, lo: _has(x, F.greatest(x, lo)))
plain("clip_max", lambda x, hi: F.when(_odd(x), x).when(x.isNotNull(), F.least(x, hi)))


@rule("struct")
def _(ctx, e):
    return F.struct(*[ctx.compile(a).alias(output_name(a)) for a in e.args])


def _odd(x: Column) -> Column:
    """NaN, for any numeric column."""
    return F.isnan(x.cast("double"))


@rule("add")
def _(ctx, e):
    a, b = map(ctx.compile, e.args)
    return F.concat(a, b) if isinstance(ctx.kind(e.args[0]), T.StringType) else a + b


@rule("true_divide")
def _(ctx, e):
    a, b = (ctx.compile(x).cast("double") for x in e.args)
    return F.when(b == 0, F.when((a == 0) | F.isnan(a), NAN).when(a.isNotNull(), F.signum(a) * INF)).otherwise(a / F.nullif(b, F.lit(0.0)))


def _floor_div(ctx, e):
    a, b = map(ctx.compile, e.args)
    if _floating(ctx.kind(e.args[0])) or _floating(ctx.kind(e.args[1])):
        q = a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
        return F.when(b == 0, F.when(a == 0, NAN).otherwise(F.signum(a.cast("double")) * INF)).otherwise(_keep_float(F.floor, q))
    return _int_floor(a, F.nullif(b, F.lit(0)))  # integers: by zero is null


def _int_floor(a: Column, b: Column) -> Column:
    r = a % b
    q = F.call_function("div", a, b)
    return F.when((r != 0) & ((r < 0) != (b < 0)), q - 1).otherwise(q)


@rule("floor_divide")
def _(ctx, e):
    return _floor_div(ctx, e)


@rule("modulo")
def _(ctx, e):
    a, b = map(ctx.compile, e.args)
    safe = F.nullif(b, F.lit(0).cast(ctx.kind(e.args[1])))
    r = a % safe
    return F.when((r != 0) & ((r < 0) != (safe < 0)), r + safe).otherwise(r)  # the sign of the divisor


def _bits(name, on_int, on_bool):
    def f(ctx, e):
        a, b = map(ctx.compile, e.args)
        return on_bool(a, b) if isinstance(ctx.kind(e.args[0]), T.BooleanType) else on_int(a, b)

    RULES[name] = f


_bits("bit_and", lambda a, b: a.bitwiseAND(b), lambda a, b: a & b)
_bits("bit_or", lambda a, b: a.bitwiseOR(b), lambda a, b: a | b)
_bits("bit_xor", lambda a, b: a.bitwiseXOR(b), lambda a, b: a != b)


@rule("is_in")
def _(ctx, e):
    x, *values = map(ctx.compile, e.args)
    found = x.isin(*values)
    return F.coalesce(found, F.array_contains(F.transform(F.array(*values), lambda v: v.isNull()), F.lit(True))) if e.params["nulls_equal"] else found


@rule("is_in_column")
def _(ctx, e):
    # Frames join a column's values beforehand; here the values are a list of the row itself.
    x, values = map(ctx.compile, e.args)
    found = F.exists(values, lambda v: v.eqNullSafe(x))
    return found if e.params["nulls_equal"] else _has(x, found)


# ---------------------------------------------------------------- numbers


def _keep_float(f, x: Column) -> Column:
    """Floor or ceiling of a double: NaN, infinities and values without fraction stay."""
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(f(x).cast("double"))


def _edge(f):
    def g(ctx, e):
        x, t = ctx.compile(e.args[0]), ctx.kind(e.args[0])
        return _keep_float(f, x.cast("double")).cast(t) if _floating(t) else f(x).cast(t)

    return g


RULES["floor"], RULES["ceil"] = _edge(F.floor), _edge(F.ceil)


@rule("round")
def _(ctx, e):
    x, t, d = ctx.compile(e.args[0]), ctx.kind(e.args[0]), e.params["decimals"]
    if not _floating(t):
        return F.bround(x, d).cast(t)
    y = x.cast("double")
    if e.params["mode"] == "to_zero":
        scaled = F.abs(y) * F.lit(10.0**d)
        out = F.signum(y) * _keep_float(F.floor, scaled) / F.lit(10.0**d)
    else:
        out = F.bround(y, d) if e.params["mode"] == "half_to_even" else F.round(y, d)
    top = F.abs(y)
    if e.params["mode"] == "half_away_from_zero" and 0 < d <= 308:
        # scaled, rounded and scaled back (if that overflows, y stays): F.round to digits goes by the shortest decimal and rounds floats just below a half up
        top = top * F.lit(10.0**d)
        out = F.signum(y) * F.round(top, 0) / F.lit(10.0**d)
    return F.when(top < INF, out).otherwise(y).cast(t)  # NaN is above INF


for _name in MATH - {"log1p"}:
    plain(_name, lambda x, f=getattr(F, _name): f(x.cast("double")))
plain("log1p", lambda x: F.when(x == -1, -INF).when(x < -1, NAN).otherwise(F.log1p(x)))
plain("log", lambda x, b: F.when(x == 0, -INF).when(x < 0, NAN).otherwise(F.ln(x) / F.ln(b)))


# ---------------------------------------------------------------- aggregates


def _aggregate(name):
    def put(f):
        def g(ctx, e):
            x = ctx.compile(e.args[0]) if e.args else None
            return f(ctx, e, x)

        RULES[name] = g
        return f

    return put


def _real(ctx, e, x):
    """Without NaN, which sorts above all in Spark."""
    return F.when(~F.isnan(x), x) if _floating(ctx.kind(e.args[0])) else x


_aggregate("len")(lambda ctx, e, x: ctx.agg(F.count(F.lit(1))))
_aggregate("count")(lambda ctx, e, x: ctx.agg(F.count(x)))
_aggregate("null_count")(lambda ctx, e, x: ctx.agg(F.count_if(x.isNull())))
_aggregate("mean")(lambda ctx, e, x: ctx.agg(F.avg(x)))
_aggregate("median")(lambda ctx, e, x: ctx.agg(F.percentile(x.cast("double"), F.lit(0.5)) if ctx.sliding else F.median(x)))
_aggregate("approx_n_unique")(lambda ctx, e, x: ctx.agg(F.approx_count_distinct(x)))
_aggregate("nan_max")(lambda ctx, e, x: ctx.agg(F.max(x)))
_aggregate("nan_min")(lambda ctx, e, x: F.when(ctx.agg(F.bool_or(F.isnan(x))), NAN).otherwise(ctx.agg(F.min(x))))
_aggregate("implode")(lambda ctx, e, x: _in_order(ctx, x))


def _in_order(ctx, x):
    """All values as a list, nulls kept, in row order where the frame has one."""
    if RID in ctx.df.columns:
        return F.transform(F.array_sort(ctx.agg(F.collect_list(F.struct(F.col(RID), x.alias("v"))))), lambda s: s["v"])
    return F.transform(ctx.agg(F.collect_list(F.struct(x.alias("v")))), lambda s: s["v"])


@_aggregate("sum")
def _(ctx, e, x):
    t = ctx.kind(e.args[0])
    if isinstance(t, T.BooleanType):
        x, t = x.cast("bigint"), T.LongType()
    zero = F.lit(0).cast("double" if _floating(t) else "bigint") if not isinstance(t, T.DecimalType) else F.lit(0)
    return F.coalesce(ctx.agg(F.sum(x)), zero)  # of nothing: zero


@_aggregate("min")
def _(ctx, e, x):
    return F.coalesce(ctx.agg(F.min(_real(ctx, e, x))), ctx.agg(F.min(x)))


@_aggregate("max")
def _(ctx, e, x):
    return F.coalesce(ctx.agg(F.max(_real(ctx, e, x))), ctx.agg(F.max(x)))


def _outermost(ctx, x, pick):
    """The first or last value of each row's own range of rows."""
    return ctx.agg(pick(F.struct(x.alias("v")), F.struct("__t", RID)))["v"]


@_aggregate("first")
def _(ctx, e, x):
    if ctx.sliding:
        return _outermost(ctx, x, F.min_by)
    return F.first(x).over(ctx.ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) if ctx.inside else F.min_by(F.struct(x.alias("v")), F.col(RID))["v"]


@_aggregate("last")
def _(ctx, e, x):
    if ctx.sliding:
        return _outermost(ctx, x, F.max_by)
    return F.last(x).over(ctx.ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) if ctx.inside else F.max_by(F.struct(x.alias("v")), F.col(RID))["v"]


@_aggregate("n_unique")
def _(ctx, e, x):
    # a null counts as one value
    nulls = F.coalesce(ctx.agg(F.max(F.when(x.isNull(), 1).otherwise(0))), F.lit(0))
    some = F.size(ctx.agg(F.collect_set(x))) if ctx.inside else F.count_distinct(x)
    return (some + nulls).cast("bigint")


@_aggregate("product")
def _(ctx, e, x):
    if _floating(ctx.kind(e.args[0])):
        return F.coalesce(ctx.agg(F.product(x)), F.lit(1.0))
    return F.aggregate(ctx.agg(F.collect_list(x)), F.lit(1).cast("bigint"), lambda a, v: a * v.cast("bigint"))


def _spread(ctx, x, ddof: int, root: bool) -> Column:
    n = ctx.agg(F.count(x))
    if ddof == 1:
        v = ctx.agg(F.var_samp(x))
    else:
        v = F.when(n > ddof, ctx.agg(F.var_pop(x)) * n / F.nullif((n - ddof).cast("double"), F.lit(0.0)))
    return F.sqrt(v) if root else v


_aggregate("std")(lambda ctx, e, x: _spread(ctx, x, e.params["ddof"], True))
_aggregate("variance")(lambda ctx, e, x: _spread(ctx, x, e.params["ddof"], False))


@_aggregate("quantile")
def _(ctx, e, x):
    q, how = e.params["q"], e.params["interpolation"]
    if how == "linear":
        return ctx.agg(F.percentile(x.cast("double"), F.lit(q)))
    values = F.sort_array(ctx.agg(F.collect_list(x.cast("double"))))
    at = F.lit(float(q)) * (F.size(values) - 1)
    lo, hi = (F.get(values, f(at).cast("int")) for f in (F.floor, F.ceil))
    pick = {"lower": lo, "higher": hi, "midpoint": (lo + hi) / 2, "nearest": F.get(values, F.round(at).cast("int"))}[how]
    return F.when(F.size(values) > 0, pick)


def _arg(ctx, x, largest: bool) -> Column:
    at = F.row_number().over(ctx.ordered()) - 1 if ctx.inside and not ctx.sliding else F.col("__at")
    best = F.min(F.when(x.isNotNull(), F.struct((-x if largest else x).alias("v"), at.alias("at"))))
    found = ctx.agg(best)["at"]
    return (found - ctx.agg(F.min(at)) if ctx.sliding else found).cast("bigint")  # from the range's own first row


_aggregate("arg_min")(lambda ctx, e, x: _arg(ctx, x, False))
_aggregate("arg_max")(lambda ctx, e, x: _arg(ctx, x, True))


@_aggregate("mode")
def _(ctx, e, x):
    """The most frequent values as a list, sorted, or in the order of their first rows."""
    all_ = F.filter(F.sort_array(ctx.agg(F.collect_list(x))), lambda v: v.isNotNull())
    runs = F.aggregate(
        all_,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("best"), F.slice(all_, 1, 0).alias("modes"), F.slice(all_, 1, 1).alias("now")),
        lambda s, v: _run(s, v),
    )
    if not e.params["maintain_order"]:
        return runs["modes"]
    values = _in_order(ctx, x)
    placed = F.transform(runs["modes"], lambda v: F.struct(F.array_position(values, v).alias("at"), v.alias("v")))
    return F.transform(F.array_sort(placed), lambda s: s["v"])


def _run(s: Column, v: Column) -> Column:
    n = F.when(F.get(s["now"], F.lit(0)) == v, s["n"] + 1).otherwise(1)
    modes = F.when(n > s["best"], F.array(v)).when(n == s["best"], F.array_append(s["modes"], v)).otherwise(s["modes"])
    return F.struct(n.alias("n"), F.greatest(n, s["best"]).alias("best"), modes.alias("modes"), F.array(v).alias("now"))


@_aggregate("skew")
def _(ctx, e, x):
    g, n = ctx.agg(F.skewness(x)), ctx.agg(F.count(x)).cast("double")
    return g if e.params["bias"] else F.when(n > 2, g * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


@_aggregate("kurtosis")
def _(ctx, e, x):
    g, n = ctx.agg(F.kurtosis(x)), ctx.agg(F.count(x)).cast("double")
    if not e.params["bias"]:
        g = F.when(n > 3, ((n + 1) * g + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)))
    return g if e.params["fisher"] else g + 3


def _kleene(ctx, e, x, f, decided: bool) -> Column:
    got = ctx.agg(f(x))
    if e.params["ignore_nulls"]:
        return F.coalesce(got, F.lit(not decided))
    return F.when(got == decided, decided).when(ctx.agg(F.bool_or(x.isNull())), F.lit(None)).otherwise(not decided)


_aggregate("any")(lambda ctx, e, x: _kleene(ctx, e, x, F.bool_or, True))
_aggregate("all")(lambda ctx, e, x: _kleene(ctx, e, x, F.bool_and, False))


# ---------------------------------------------------------------- ordered functions


def _sliding(name):
    def put(f):
        def g(ctx, e):
            return f(ctx, e, *map(ctx.compile, e.args))

        RULES[name] = g
        return f

    return put


@_sliding("shift")
def _(ctx, e, x):
    n = e.params["n"]
    return F.lag(x, n).over(ctx.ordered()) if n >= 0 else F.lead(x, -n).over(ctx.ordered())


def _running(name, f):
    def g(ctx, e, x):
        w = ctx.ordered(e.params["reverse"]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return _has(x, f(x).over(w))

    _sliding(name)(g)


_running("cum_sum", F.sum)
_running("cum_min", F.min)
_running("cum_max", F.max)


@_sliding("diff")
def _(ctx, e, x):
    if e.params["null_behavior"] == "drop":
        raise Unsupported("diff(null_behavior='drop') changes the height: use LazyFrame.diff_drop")
    return x - F.lag(x, e.params["n"]).over(ctx.ordered())


@_sliding("pct_change")
def _(ctx, e, x):
    before = F.lag(x.cast("double"), e.params["n"]).over(ctx.ordered())
    return F.when(before == 0, F.when(x == 0, NAN).otherwise(F.signum(x.cast("double")) * INF)).otherwise(x / F.nullif(before, F.lit(0.0)) - 1)


@_sliding("rank")
def _(ctx, e, x):
    p = e.params
    by = x.desc_nulls_last() if p["descending"] else x.asc_nulls_last()
    w = Window.partitionBy(*ctx.partition).orderBy(by)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*ctx.partition, x))
    out = {
        "dense": lambda: F.dense_rank().over(w), "min": lambda: F.rank().over(w), "max": lambda: F.rank().over(w) + ties - 1,
        "average": lambda: F.rank().over(w) + (ties - 1) / 2, "ordinal": lambda: F.row_number().over(Window.partitionBy(*ctx.partition).orderBy(by, *ctx.position())),
    }[p["method"]]()
    return _has(x, out.cast("double" if p["method"] == "average" else "bigint"))


def _between(ctx, x, t, w):
    before, after = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    known = F.when(x.isNotNull(), F.struct(t.alias("t"), x.cast("double").alias("x")))
    return F.last(known, ignorenulls=True).over(before), F.first(known, ignorenulls=True).over(after)


@_sliding("interpolate")
def _(ctx, e, x):
    w = ctx.ordered()
    at = F.row_number().over(w)
    a, b = _between(ctx, x, at, w)
    if e.params["method"] == "nearest":
        return F.coalesce(x.cast("double"), F.when(a.isNotNull() & b.isNotNull(), F.when(at - a["t"] < b["t"] - at, a["x"]).otherwise(b["x"])))
    return F.coalesce(x.cast("double"), a["x"] + (b["x"] - a["x"]) * (at - a["t"]) / (b["t"] - a["t"]))


@_sliding("interpolate_by")
def _(ctx, e, x, by):
    t = by.cast("double")
    a, b = _between(ctx, x, t, Window.partitionBy(*ctx.partition).orderBy(by))
    return F.coalesce(x.cast("double"), a["x"] + (b["x"] - a["x"]) * (t - a["t"]) / (b["t"] - a["t"]))


@_sliding("rolling")
def _(ctx, e, x):
    p = e.params
    ahead = (p["size"] - 1) // 2 if p["center"] else 0
    behind = p["size"] - 1 - ahead
    order = ctx.ordered()
    w = order.rowsBetween(-behind, ahead)
    if p["weights"]:
        terms = [F.coalesce((F.lag(x, behind - i) if i <= behind else F.lead(x, i - behind)).over(order).cast("double"), F.lit(0.0)) * k for i, k in enumerate(p["weights"])]
        total = sum(terms[1:], terms[0])
        out = total if p["kind"] == "sum" else total / float(sum(p["weights"]))
    else:
        out = {"min": F.min, "max": F.max, "mean": F.avg, "sum": F.sum, "median": lambda y: F.percentile(y.cast("double"), F.lit(0.5)), "variance": F.var_samp, "std": F.stddev_samp}[p["kind"]](x).over(w)
    return F.when(F.count(x).over(w) >= max(1, p["least"]), out)


@_sliding("ewm")
def _(ctx, e, x):
    raise Unsupported("exponentially weighted functions stand in a projection: alone, or directly inside over()")


class Smoother:
    """The recursion of the exponentially weighted functions; ``next`` takes the values in order."""

    def __init__(self, kind: str, alpha: float, adjust: bool, bias: bool, least: int, ignore_nulls: bool):
        self.kind, self.alpha, self.adjust, self.bias, self.least, self.skip = kind, alpha, adjust, bias, max(1, least), ignore_nulls
        self.reset()

    def reset(self) -> None:
        self.n, self.mean, self.cov, self.old, self.w1, self.w2 = 0, 0.0, 0.0, 0.0, 0.0, 0.0

    def next(self, v: float | None) -> float | None:
        keep = 1.0 - self.alpha
        if v is None:
            if not self.skip:  # a null still ages the past
                self.old, self.w1, self.w2 = self.old * keep, self.w1 * keep, self.w2 * keep * keep
                if self.kind == "sum":
                    self.mean *= keep
            return None
        new = 1.0 if self.adjust else self.alpha
        if self.kind == "sum":
            self.mean = self.mean * keep + v
        elif self.n == 0:
            self.mean, self.old, self.w1, self.w2 = v, 1.0, 1.0, 1.0
        else:
            old = self.old * keep
            mean = (old * self.mean + new * v) / (old + new)
            self.cov = (old * (self.cov + (self.mean - mean) ** 2) + new * (v - mean) ** 2) / (old + new)
            self.mean, self.old = mean, old + new if self.adjust else 1.0
            self.w1, self.w2 = self.w1 * keep + new, self.w2 * keep * keep + new * new
        self.n += 1
        if self.n < self.least:
            return None
        if self.kind in ("mean", "sum"):
            return self.mean
        out = self.cov
        if not self.bias:
            rest = self.w1 * self.w1 - self.w2
            out = 0.0 if self.n < 2 else self.cov * self.w1 * self.w1 / rest if rest else None
        return out if out is None or self.kind == "variance" else out**0.5


def smoothed(ctx: Context, x: Column, params: dict, name: str) -> DataFrame:
    """The frame with the exponentially weighted column ``name``: rows are sorted by partition and order, and
    each partition is run through once, with a few numbers held. Without partition keys that is one task."""
    import pyarrow as pa

    key = F.to_json(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(ctx.partition)]), {"ignoreNullFields": "false"}) if ctx.partition else F.lit("")
    rows = ctx.df.select("*", key.alias("__key"), x.cast("double").alias("__x"))
    rows = (rows.repartition("__key") if ctx.partition else rows.repartition(1)).sortWithinPartitions("__key", *ctx.position())
    step = Smoother(*[params[k] for k in ("kind", "alpha", "adjust", "bias", "least", "ignore_nulls")])
    n = len(ctx.df.columns)

    def run(batches):
        now = None
        for batch in batches:
            out = []
            for k, v in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                if k != now:
                    now = k
                    step.reset()
                out.append(step.next(v))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, pa.float64())], names=[*batch.schema.names[:n], name])

    return rows.mapInArrow(run, T.StructType([*ctx.df.schema.fields, T.StructField(name, T.DoubleType())]))


from . import namespaces  # noqa: E402, F401  (registers the namespace rules)
