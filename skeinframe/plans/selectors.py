"""Column selectors and datatype selectors: predicates over a schema, with set operations."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import types as T

from ..errors import require
from .dtypes import DType, of_field, tag_of

UNSIGNED = {"uint8", "uint16", "uint32", "uint64", "uint128"}


class _Algebra:
    def __or__(self, other):
        return self._pair(other, lambda a, b: a or b)

    def __and__(self, other):
        return self._pair(other, lambda a, b: a and b)

    def __xor__(self, other):
        return self._pair(other, lambda a, b: a != b)

    def __sub__(self, other):
        return self._pair(other, lambda a, b: a and not b)


class DTypeSelector(_Algebra):
    """A predicate over one field."""

    def __init__(self, test: Callable[[T.StructField], bool]):
        self._test = test

    def _pair(self, other: "DTypeSelector", op) -> "DTypeSelector":
        return DTypeSelector(lambda f: op(self._test(f), other._test(f)))

    def __invert__(self) -> "DTypeSelector":
        return DTypeSelector(lambda f: not self._test(f))

    def matches(self, dtype: DType) -> bool:
        return self._test(dtype.field("x"))

    def as_selector(self) -> "Selector":
        return Selector(lambda schema: {f.name for f in schema.fields if self._test(f)})


class Selector(_Algebra):
    """A set of columns that depends on the schema; keeps the schema's order unless names or positions were listed."""

    def __init__(self, pick: Callable[[T.StructType], Iterable[str]], listed: bool = False):
        self._pick, self._listed = pick, listed

    def names(self, schema: T.StructType) -> list[str]:
        got = self._pick(schema)
        return list(got) if self._listed else [n for n in schema.names if n in set(got)]

    def _pair(self, other: "Selector", op) -> "Selector":
        def pick(schema):
            a, b = set(self.names(schema)), set(other.names(schema))
            return {n for n in schema.names if op(n in a, n in b)}

        return Selector(pick)

    def __invert__(self) -> "Selector":
        return Selector(lambda schema: set(schema.names) - set(self.names(schema)))

    def as_expr(self):
        from .expr import Expr

        return Expr("selector", (), {"selector": self})


def all_() -> Selector:
    return Selector(lambda s: s.names)


def empty() -> Selector:
    return Selector(lambda s: [])


def by_name(*names: str, strict: bool = True, expand_patterns: bool = False) -> Selector:
    def pick(schema):
        out = []
        for n in names:
            if expand_patterns and n.startswith("^") and n.endswith("$"):
                out += [c for c in schema.names if re.search(n, c) and c not in out]
            else:
                require(n in schema.names or not strict, f"no column {n}")
                out += [n] if n in schema.names and n not in out else []
        return out

    return Selector(pick, listed=True)


def by_index(*indices: int, strict: bool = True) -> Selector:
    def pick(schema):
        n = len(schema.names)
        require(not strict or all(-n <= i < n for i in indices), "column position out of range")
        return list(dict.fromkeys(schema.names[i] for i in indices if -n <= i < n))

    return Selector(pick, listed=True)


def matches(pattern: str) -> Selector:
    return Selector(lambda s: {n for n in s.names if re.search(pattern, n)})


def _kind(*types) -> Callable[[], DTypeSelector]:
    return lambda: DTypeSelector(lambda f: isinstance(f.dataType, types))


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_tag = lambda f: tag_of(f).get("kind")
integer = lambda: DTypeSelector(lambda f: isinstance(f.dataType, _INTEGRAL) or _tag(f) in UNSIGNED | {"int128"})
unsigned_integer = lambda: DTypeSelector(lambda f: _tag(f) in UNSIGNED)
signed_integer = lambda: integer() - unsigned_integer()
floating = _kind(T.FloatType, T.DoubleType)
numeric = _kind(T.NumericType)
decimal = lambda: DTypeSelector(lambda f: isinstance(f.dataType, T.DecimalType) and _tag(f) is None)
temporal = _kind(T.DateType, T.TimestampType, T.TimestampNTZType, T.TimeType, T.DayTimeIntervalType)
nested = _kind(T.ArrayType, T.StructType, T.MapType)
struct = _kind(T.StructType)
enum = lambda: DTypeSelector(lambda f: _tag(f) == "enum")
categorical = lambda: DTypeSelector(lambda f: _tag(f) == "categorical")
any_dtype = lambda: DTypeSelector(lambda f: True)
no_dtype = lambda: DTypeSelector(lambda f: False)
object_ = no_dtype


def any_of(dtypes: Iterable[DType]) -> DTypeSelector:
    wanted = set(dtypes)
    return DTypeSelector(lambda f: of_field(f) in wanted)


def list_(inner: DTypeSelector | None = None) -> DTypeSelector:
    return DTypeSelector(lambda f: isinstance(f.dataType, T.ArrayType) and _tag(f) != "array" and (inner is None or inner._test(T.StructField("i", f.dataType.elementType))))


def array(inner: DTypeSelector | None = None, width: int | None = None) -> DTypeSelector:
    return DTypeSelector(lambda f: _tag(f) == "array" and (width is None or tag_of(f)["width"] == width) and (inner is None or inner._test(T.StructField("i", f.dataType.elementType))))


def datetime(units: Iterable[str] | None = None, zones: str | Iterable[str] = "any") -> DTypeSelector:
    """``zones``: any, any_set, unset, or names (with None for unset)."""

    def test(f):
        if not isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return False
        d = of_field(f)
        zone = d.get("zone")
        ok = {"any": True, "any_set": zone is not None, "unset": zone is None}.get(zones) if isinstance(zones, str) else zone in set(zones)
        return bool(ok) and (units is None or d.get("unit") in set(units))

    return DTypeSelector(test)


def duration(units: Iterable[str] | None = None) -> DTypeSelector:
    return DTypeSelector(lambda f: isinstance(f.dataType, T.DayTimeIntervalType) and (units is None or of_field(f).get("unit") in set(units)))
