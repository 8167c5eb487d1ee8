"""Expressions: immutable trees that become Spark columns when a schema is known."""

from __future__ import annotations

import datetime as _dt
import decimal as _decimal
import re
from collections.abc import Callable, Iterable

from pyspark.sql import types as T

from ..errors import InvalidRequest, require
from . import dtypes

AGGREGATES = {
    "count", "null_count", "sum", "mean", "min", "max", "first", "last", "median", "n_unique", "product", "std", "variance", "quantile", "arg_min", "arg_max",
    "approx_n_unique", "nan_min", "nan_max", "mode", "skew", "kurtosis", "any", "all", "len", "implode",
}
ORDERED = {
    "shift", "cum_sum", "cum_min", "cum_max", "diff", "pct_change", "rank", "interpolate", "interpolate_by", "rolling", "ewm",
}


def as_expr(value) -> "Expr":
    """An expression of its own, or a literal."""
    if isinstance(value, Expr):
        return value
    if hasattr(value, "as_expr"):
        return value.as_expr()
    return lit(value)


def col(name: str) -> "Expr":
    """A column, or with ``^...$`` all columns whose name matches."""
    return Expr("col", (), {"name": name})


def lit(value, dtype: dtypes.DType | None = None) -> "Expr":
    require(value is not None or dtype is not None, "a null literal needs a datatype")
    ok = (bool, int, float, str, bytes, _decimal.Decimal, _dt.date, _dt.datetime, _dt.timedelta, _dt.time, type(None))
    require(isinstance(value, ok), f"no literal for {type(value).__name__}")
    return Expr("lit", (), {"value": value, "dtype": dtype})


def len_() -> "Expr":
    """The number of rows, nulls included."""
    return Expr("len", (), {})


def coalesce(*values) -> "Expr":
    return Expr("coalesce", tuple(map(as_expr, values)), {})


def struct(*values) -> "Expr":
    return Expr("struct", tuple(map(as_expr, values)), {})


class When:
    """``when(p).then(a).otherwise(b)``."""

    def __init__(self, predicate: "Expr", value: "Expr | None" = None):
        self.predicate, self.value = predicate, value

    def then(self, value) -> "When":
        return When(self.predicate, as_expr(value))

    def otherwise(self, value) -> "Expr":
        require(self.value is not None, "when() needs then()")
        return Expr("when", (self.predicate, self.value, as_expr(value)), {})


def when(predicate: "Expr") -> When:
    return When(as_expr(predicate))


class Expr:
    """A node: operation, children, and parameters that aren't expressions."""

    __slots__ = ("op", "args", "params")
    __iter__ = None

    def __init__(self, op: str, args: tuple["Expr", ...], params: dict):
        self.op, self.args, self.params = op, args, params

    def __repr__(self) -> str:
        if self.op == "col":
            return f"col({self.params['name']!r})"
        inner = [repr(a) for a in self.args] + [f"{k}={v!r}" for k, v in self.params.items() if not isinstance(v, Expr)]
        return f"{self.op}({', '.join(inner)})"

    def __bool__(self):
        raise InvalidRequest("an expression has no truth value; use & | ~")

    __hash__ = None

    # ---- building blocks

    def _f(self, op: str, *args, **params) -> "Expr":
        return Expr(op, (self, *map(as_expr, args)), params)

    def unary(self, op: str) -> "Expr":
        require(op in UNARY, f"no unary operation {op}")
        return self._f(op)

    def binary(self, op: str, other) -> "Expr":
        require(op in BINARY, f"no binary operation {op}")
        return self._f(op, other)

    def aggregate(self, op: str, **params) -> "Expr":
        require(op in AGGREGATES, f"no aggregate {op}")
        return self._f(op, **params)

    def function(self, name: str, *args, **params) -> "Expr":
        from ..functions.compiler import RULES

        require(name in RULES, f"no function {name}")
        return self._f(name, *args, **params)

    def alias(self, name: str) -> "Expr":
        return self._f("alias", name=name)

    def cast(self, dtype: dtypes.DType | str, strict: bool = True) -> "Expr":
        return self._f("cast", dtype=dtypes.flat(dtype) if isinstance(dtype, str) else dtype, strict=strict)

    # ---- operators

    def __invert__(self): return self._f("not")  # noqa: E704
    def __neg__(self): return self._f("negate")  # noqa: E704
    def __eq__(self, o): return self._f("eq", o)  # noqa: E704
    def __ne__(self, o): return self._f("not_eq", o)  # noqa: E704
    def __lt__(self, o): return self._f("lt", o)  # noqa: E704
    def __le__(self, o): return self._f("lt_eq", o)  # noqa: E704
    def __gt__(self, o): return self._f("gt", o)  # noqa: E704
    def __ge__(self, o): return self._f("gt_eq", o)  # noqa: E704
    def __add__(self, o): return self._f("add", o)  # noqa: E704
    def __sub__(self, o): return self._f("subtract", o)  # noqa: E704
    def __mul__(self, o): return self._f("multiply", o)  # noqa: E704
    def __truediv__(self, o): return self._f("true_divide", o)  # noqa: E704
    def __floordiv__(self, o): return self._f("floor_divide", o)  # noqa: E704
    def __mod__(self, o): return self._f("modulo", o)  # noqa: E704
    def __and__(self, o): return self._f("bit_and", o)  # noqa: E704
    def __or__(self, o): return self._f("bit_or", o)  # noqa: E704
    def __xor__(self, o): return self._f("bit_xor", o)  # noqa: E704
    def __radd__(self, o): return as_expr(o) + self  # noqa: E704
    def __rsub__(self, o): return as_expr(o) - self  # noqa: E704
    def __rmul__(self, o): return as_expr(o) * self  # noqa: E704
    def __rtruediv__(self, o): return as_expr(o) / self  # noqa: E704
    def and_(self, o): return self._f("and", o)  # noqa: E704
    def or_(self, o): return self._f("or", o)  # noqa: E704
    def not_(self): return self._f("not")  # noqa: E704
    def eq_missing(self, o): return self._f("eq_validity", o)  # noqa: E704
    def ne_missing(self, o): return self._f("not_eq_validity", o)  # noqa: E704

    # ---- nulls, NaN, numbers

    def is_null(self): return self._f("is_null")  # noqa: E704
    def is_not_null(self): return self._f("is_not_null")  # noqa: E704
    def is_nan(self): return self._f("is_nan")  # noqa: E704
    def is_not_nan(self): return self._f("is_not_nan")  # noqa: E704
    def is_finite(self): return self._f("is_finite")  # noqa: E704
    def is_infinite(self): return self._f("is_infinite")  # noqa: E704
    def fill_null(self, v): return self._f("fill_null", v)  # noqa: E704
    def fill_nan(self, v): return self._f("fill_nan", v)  # noqa: E704
    def coalesce(self, *v): return coalesce(self, *v)  # noqa: E704
    def abs(self): return self._f("abs")  # noqa: E704
    def floor(self): return self._f("floor")  # noqa: E704
    def ceil(self): return self._f("ceil")  # noqa: E704

    def round(self, decimals: int = 0, mode: str = "half_to_even"):
        require(mode in ("half_to_even", "half_away_from_zero", "to_zero"), f"no rounding mode {mode}")
        return self._f("round", decimals=decimals, mode=mode)

    def clip(self, lower=None, upper=None):
        require(lower is not None or upper is not None, "clip needs a bound")
        if lower is None:
            return self._f("clip_max", upper)
        return self._f("clip_min", lower) if upper is None else self._f("clip", lower, upper)

    def pow(self, e): return self._f("pow", e)  # noqa: E704
    def log(self, base): return self._f("log", base)  # noqa: E704
    def atan2(self, x): return self._f("atan2", x)  # noqa: E704

    def is_in(self, values, nulls_equal: bool = False):
        """Membership in literals, in all the values of an expression, or in the row's own list if the
        expression is a list and this one isn't."""
        if isinstance(values, Expr):
            return Expr("is_in_column", (self, values), {"nulls_equal": nulls_equal})
        return self._f("is_in", *values, nulls_equal=nulls_equal)

    # ---- aggregates

    def count(self): return self._f("count")  # noqa: E704
    def null_count(self): return self._f("null_count")  # noqa: E704
    def sum(self): return self._f("sum")  # noqa: E704
    def mean(self): return self._f("mean")  # noqa: E704
    def min(self): return self._f("min")  # noqa: E704
    def max(self): return self._f("max")  # noqa: E704
    def first(self): return self._f("first")  # noqa: E704
    def last(self): return self._f("last")  # noqa: E704
    def median(self): return self._f("median")  # noqa: E704
    def n_unique(self): return self._f("n_unique")  # noqa: E704
    def product(self): return self._f("product")  # noqa: E704
    def arg_min(self): return self._f("arg_min")  # noqa: E704
    def arg_max(self): return self._f("arg_max")  # noqa: E704
    def approx_n_unique(self): return self._f("approx_n_unique")  # noqa: E704
    def nan_min(self): return self._f("nan_min")  # noqa: E704
    def nan_max(self): return self._f("nan_max")  # noqa: E704
    def implode(self): return self._f("implode")  # noqa: E704
    def mode(self, maintain_order: bool = False): return self._f("mode", maintain_order=maintain_order)  # noqa: E704
    def skew(self, bias: bool = True): return self._f("skew", bias=bias)  # noqa: E704
    def kurtosis(self, fisher: bool = True, bias: bool = True): return self._f("kurtosis", fisher=fisher, bias=bias)  # noqa: E704
    def any(self, ignore_nulls: bool = True): return self._f("any", ignore_nulls=ignore_nulls)  # noqa: E704
    def all(self, ignore_nulls: bool = True): return self._f("all", ignore_nulls=ignore_nulls)  # noqa: E704

    def std(self, ddof: int = 1):
        require(0 <= ddof <= 255, "ddof is 0 to 255")
        return self._f("std", ddof=ddof)

    def variance(self, ddof: int = 1):
        require(0 <= ddof <= 255, "ddof is 0 to 255")
        return self._f("variance", ddof=ddof)

    def quantile(self, q: float, interpolation: str = "linear"):
        require(0 <= q <= 1, "a quantile is 0 to 1")
        require(interpolation in ("nearest", "lower", "higher", "midpoint", "linear"), f"no interpolation {interpolation}")
        return self._f("quantile", q=q, interpolation=interpolation)

    # ---- windows and ordered functions

    def over(self, partition_by=(), order_by=(), descending: bool = False, nulls_last: bool = False, mapping: str = "groups_to_rows"):
        keys = [partition_by] if isinstance(partition_by, (str, Expr)) else list(partition_by)
        order = [order_by] if isinstance(order_by, (str, Expr)) else list(order_by)
        require(bool(keys or order), "over() needs a partition or an order")
        require(mapping in ("groups_to_rows", "join", "explode"), f"no mapping {mapping}")
        named = lambda xs: tuple(col(x) if isinstance(x, str) else x for x in xs)
        return Expr("over", (self,), {"keys": named(keys), "order": named(order), "descending": descending, "nulls_last": nulls_last, "mapping": mapping})

    def shift(self, n: int = 1): return self._f("shift", n=n)  # noqa: E704
    def cum_sum(self, reverse: bool = False): return self._f("cum_sum", reverse=reverse)  # noqa: E704
    def cum_min(self, reverse: bool = False): return self._f("cum_min", reverse=reverse)  # noqa: E704
    def cum_max(self, reverse: bool = False): return self._f("cum_max", reverse=reverse)  # noqa: E704
    def pct_change(self, n: int = 1): return self._f("pct_change", n=n)  # noqa: E704
    def interpolate_by(self, by): return self._f("interpolate_by", by)  # noqa: E704

    def diff(self, n: int = 1, null_behavior: str = "ignore"):
        require(null_behavior in ("ignore", "drop"), "null_behavior is ignore or drop")
        return self._f("diff", n=n, null_behavior=null_behavior)

    def rank(self, method: str = "dense", descending: bool = False):
        require(method in ("average", "min", "max", "dense", "ordinal"), f"no rank method {method}")
        return self._f("rank", method=method, descending=descending)

    def interpolate(self, method: str = "linear"):
        require(method in ("linear", "nearest"), f"no interpolation {method}")
        return self._f("interpolate", method=method)

    def _rolling(self, kind: str, window_size: int, min_periods: int = 1, weights=None, center: bool = False):
        require(window_size >= 1 and 0 <= min_periods <= window_size, "window_size >= 1, min_periods <= window_size")
        require(weights is None or len(weights) == window_size, "one weight per row of the window")
        require(weights is None or kind in ("sum", "mean"), "weights are for sum and mean")
        return self._f("rolling", kind=kind, size=window_size, least=min_periods, weights=weights, center=center)

    def rolling_min(self, n, **o): return self._rolling("min", n, **o)  # noqa: E704
    def rolling_max(self, n, **o): return self._rolling("max", n, **o)  # noqa: E704
    def rolling_mean(self, n, **o): return self._rolling("mean", n, **o)  # noqa: E704
    def rolling_sum(self, n, **o): return self._rolling("sum", n, **o)  # noqa: E704
    def rolling_median(self, n, **o): return self._rolling("median", n, **o)  # noqa: E704
    def rolling_variance(self, n, **o): return self._rolling("variance", n, **o)  # noqa: E704
    def rolling_std(self, n, **o): return self._rolling("std", n, **o)  # noqa: E704

    def _ewm(self, kind: str, alpha: float, adjust: bool = True, bias: bool = False, min_periods: int = 1, ignore_nulls: bool = True):
        require(0 < alpha <= 1, "alpha is over 0, at most 1")
        return self._f("ewm", kind=kind, alpha=alpha, adjust=adjust, bias=bias, least=min_periods, ignore_nulls=ignore_nulls)

    def ewm_mean(self, alpha, **o):
        require("bias" not in o, "bias is for std and variance")
        return self._ewm("mean", alpha, **o)

    def ewm_sum(self, alpha, **o):
        require("bias" not in o and "adjust" not in o, "a sum has neither bias nor adjust")
        return self._ewm("sum", alpha, **o)

    def ewm_std(self, alpha, **o): return self._ewm("std", alpha, **o)  # noqa: E704
    def ewm_variance(self, alpha, **o): return self._ewm("variance", alpha, **o)  # noqa: E704

    # ---- namespaces

    @property
    def str(self): return Namespace(self, "str")  # noqa: E704
    @property
    def dt(self): return Namespace(self, "dt")  # noqa: E704
    @property
    def list(self): return Namespace(self, "list")  # noqa: E704
    @property
    def arr(self): return Namespace(self, "arr")  # noqa: E704
    @property
    def struct(self): return Namespace(self, "struct")  # noqa: E704
    @property
    def bin(self): return Namespace(self, "bin")  # noqa: E704
    @property
    def cat(self): return Namespace(self, "cat")  # noqa: E704
    @property
    def name(self): return Names(self)  # noqa: E704
    @property
    def meta(self): return Meta(self)  # noqa: E704

    def __getattr__(self, name: str):
        if name in MATH:
            return lambda: self._f(name)
        raise AttributeError(name)


UNARY = {"not", "negate", "is_null", "is_not_null", "is_nan", "is_not_nan"}
BINARY = {
    "eq", "eq_validity", "not_eq", "not_eq_validity", "lt", "lt_eq", "gt", "gt_eq", "add", "subtract", "multiply", "true_divide", "floor_divide", "modulo",
    "bit_and", "bit_or", "bit_xor", "and", "or",
}
MATH = {
    "sqrt", "cbrt", "log1p", "exp", "sin", "cos", "tan", "cot", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh", "degrees", "radians",
}


class Namespace:
    """``expr.str.len_chars()`` builds the node ``str.len_chars``; the rule's signature says what it takes."""

    def __init__(self, root: Expr, space: str):
        self._root, self._space = root, space

    def __getattr__(self, name: str) -> Callable[..., Expr]:
        from ..functions.compiler import SIGNATURES

        op = f"{self._space}.{name}"
        if op not in SIGNATURES:
            raise AttributeError(op)
        exprs, defaults = SIGNATURES[op]

        def call(*args, **kwargs):
            names = [*exprs, *defaults]
            require(len(args) <= len(names), f"{op} takes {names}")
            given = dict(zip(names, args, strict=False)) | kwargs
            require(set(given) <= set(names) and all(e in given for e in exprs), f"{op} takes {names}")
            return Expr(op, (self._root, *[as_expr(given[e]) for e in exprs]), {n: given.get(n, d) for n, d in defaults.items()})

        return call


class Names:
    """Output names."""

    def __init__(self, root: Expr):
        self._root = root

    def _map(self, change) -> Expr:
        return Expr("rename", (self._root,), {"change": change})

    def keep(self): return Expr("name_keep", (self._root,), {})  # noqa: E704
    def prefix(self, p): return self._map(lambda n: p + n)  # noqa: E704
    def suffix(self, s): return self._map(lambda n: n + s)  # noqa: E704
    def to_lowercase(self): return self._map(str.lower)  # noqa: E704
    def to_uppercase(self): return self._map(str.upper)  # noqa: E704


def walk(e: Expr) -> Iterable[Expr]:
    yield e
    for a in e.args:
        yield from walk(a)
    for group in ("keys", "order"):
        for a in e.params.get(group, ()) or ():
            if isinstance(a, Expr):
                yield from walk(a)


_NAMING = ("alias", "rename", "name_keep")
_is_pattern = lambda n: n.startswith("^") and n.endswith("$")


class Meta:
    """What can be told about an expression without running it."""

    def __init__(self, root: Expr):
        self._root = root

    def undo_aliases(self) -> Expr:
        def strip(e: Expr) -> Expr:
            while e.op in _NAMING:
                e = e.args[0]
            return Expr(e.op, tuple(map(strip, e.args)), e.params)

        return strip(self._root)

    def root_names(self) -> list[str]:
        return list(dict.fromkeys(e.params["name"] for e in walk(self._root) if e.op == "col"))

    def output_name(self) -> str:
        return output_name(self._root)

    def is_column(self) -> bool:
        return self._root.op == "col" and not _is_pattern(self._root.params["name"])

    def is_column_selection(self, allow_aliasing: bool = False) -> bool:
        e = self._root
        while allow_aliasing and e.op in _NAMING:
            e = e.args[0]
        return e.op in ("col", "selector")

    def is_literal(self, allow_aliasing: bool = False) -> bool:
        e = self._root
        while allow_aliasing and e.op in _NAMING:
            e = e.args[0]
        return e.op == "lit"

    def has_multiple_outputs(self) -> bool:
        return any(e.op == "selector" or e.op == "col" and _is_pattern(e.params["name"]) for e in walk(self._root))

    def is_regex_projection(self) -> bool:
        return self._root.op == "col" and _is_pattern(self._root.params["name"])


def output_name(e: Expr) -> str:
    """The name of the leftmost column unless an alias or name function says otherwise."""
    if e.op == "col":
        return e.params["name"]
    if e.op == "alias":
        return e.params["name"]
    if e.op == "rename":
        return e.params["change"](root_name(e.args[0]))
    if e.op == "name_keep":
        return root_name(e.args[0])
    if e.op == "lit":
        return "literal"
    if e.op == "len":
        return "len"
    if e.op == "struct.field":
        return e.params["name"]
    if e.op == "when":
        return output_name(e.args[1])
    return output_name(e.args[0]) if e.args else e.op


def root_name(e: Expr) -> str:
    for x in walk(e):
        if x.op == "col":
            return x.params["name"]
    return output_name(e)


def expand(e: Expr, schema: T.StructType) -> list[Expr]:
    """One expression per output: selectors and name patterns are replaced by each column in turn."""
    multi = next((x for x in walk(e) if x.op == "selector" or x.op == "col" and _is_pattern(x.params["name"])), None)
    if multi is None:
        return [e]
    names = multi.params["selector"].names(schema) if multi.op == "selector" else [n for n in schema.names if re.search(multi.params["name"], n)]

    def put(x: Expr, name: str) -> Expr:
        if x is multi:
            return col(name)
        params = {k: tuple(put(y, name) for y in v) if k in ("keys", "order") and isinstance(v, tuple) else v for k, v in x.params.items()}
        return Expr(x.op, tuple(put(y, name) for y in x.args), params)

    return [done for n in names for done in expand(put(e, n), schema)]


def is_aggregate(e: Expr) -> bool:
    """Whether the expression reduces rows to one value."""
    if e.op == "over":
        return False
    return e.op in AGGREGATES or any(is_aggregate(a) for a in e.args)


def needs_order(e: Expr) -> bool:
    """Whether the result depends on the order of rows."""
    return any(x.op in ORDERED or x.op in ("first", "last", "arg_min", "arg_max", "implode") or x.op == "mode" and x.params["maintain_order"] for x in walk(e))
