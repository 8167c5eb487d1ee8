"""Datatype descriptors and their Spark types.

Unsigned integers, 128-bit integers, float16, fixed-width arrays, enums, zones
and time units have no Spark type of their own: they take the nearest wider one,
and the descriptor's tag is kept in the field's metadata (key ``skein``).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import types as T

from ..errors import InvalidRequest, Unsupported

# Names of the flat types and the Spark types that hold them.
FLAT = {
    "null": T.NullType(), "boolean": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "int128": T.DecimalType(38, 0), "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "uint128": T.DecimalType(38, 0), "float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType(), "string": T.StringType(),
    "binary": T.BinaryType(), "binaryOffset": T.BinaryType(), "date": T.DateType(), "time": T.TimeType(6), "categorical": T.StringType(),
}
TAGGED = {"int128", "uint8", "uint16", "uint32", "uint64", "uint128", "float16", "binaryOffset", "categorical"}
UNITS = ("ns", "us", "ms")


@dataclass(frozen=True)
class DType:
    """A datatype: ``kind`` and its parameters as (name, value) pairs."""

    kind: str
    params: tuple = ()

    def get(self, name: str, default=None):
        return dict(self.params).get(name, default)

    @property
    def spark(self) -> T.DataType:
        k = self.kind
        if k in FLAT:
            return FLAT[k]
        if k == "decimal":
            return T.DecimalType(self.get("precision"), self.get("scale"))
        if k == "datetime":
            return T.TimestampType() if self.get("zone") else T.TimestampNTZType()
        if k == "duration":
            return T.DayTimeIntervalType()
        if k in ("list", "array"):
            return T.ArrayType(self.get("inner").spark, True)
        if k == "struct":
            return T.StructType([T.StructField(n, d.spark, True) for n, d in self.get("fields")])
        if k == "enum":
            return T.StringType()
        if k == "extension":
            return self.get("storage").spark
        raise Unsupported(f"{k} has no values")

    @property
    def tag(self) -> dict:
        """Metadata that tells this type from others with the same Spark type."""
        if self.kind in TAGGED:
            return {"skein": json.dumps({"kind": self.kind})}
        keep = {n: v for n, v in self.params if n in ("width", "zone", "unit", "categories", "name")}
        if self.kind in ("array", "enum", "extension", "datetime", "duration") and keep:
            return {"skein": json.dumps({"kind": self.kind, **{n: list(v) if isinstance(v, tuple) else v for n, v in keep.items()}})}
        return {}

    def field(self, name: str) -> T.StructField:
        return T.StructField(name, self.spark, True, self.tag)


def flat(kind: str) -> DType:
    if kind not in FLAT:
        raise InvalidRequest(f"unknown datatype {kind}")
    return DType(kind)


def decimal(precision: int, scale: int) -> DType:
    if not (1 <= precision <= 38 and 0 <= scale <= precision):
        raise InvalidRequest("decimal needs 1 <= precision <= 38 and 0 <= scale <= precision")
    return DType("decimal", (("precision", precision), ("scale", scale)))


def datetime(unit: str = "us", zone: str | None = None) -> DType:
    if unit not in UNITS:
        raise InvalidRequest(f"unknown time unit {unit}")
    return DType("datetime", (("unit", unit), ("zone", zone)))


def duration(unit: str = "us") -> DType:
    if unit not in UNITS:
        raise InvalidRequest(f"unknown time unit {unit}")
    return DType("duration", (("unit", unit),))


def list_(inner: DType) -> DType:
    return DType("list", (("inner", inner),))


def array(inner: DType, width: int) -> DType:
    if width <= 0:
        raise InvalidRequest("an array's width is positive")
    return DType("array", (("inner", inner), ("width", width)))


def struct(fields: dict[str, DType]) -> DType:
    return DType("struct", (("fields", tuple(fields.items())),))


def enum(categories: list[str]) -> DType:
    if len(set(categories)) != len(categories):
        raise InvalidRequest("an enum's categories are unique")
    return DType("enum", (("categories", tuple(categories)),))


def extension(name: str, storage: DType) -> DType:
    return DType("extension", (("name", name), ("storage", storage)))


def tag_of(field: T.StructField) -> dict:
    raw = (field.metadata or {}).get("skein")
    return json.loads(raw) if raw else {}


def of_field(field: T.StructField) -> DType:
    """The descriptor of a Spark field (its tag, if it has one)."""
    tag = tag_of(field)
    kind, t = tag.get("kind"), field.dataType
    if kind in TAGGED:
        return DType(kind)
    if kind == "enum":
        return enum(tag["categories"])
    if isinstance(t, T.ArrayType):
        inner = of_field(T.StructField("item", t.elementType))
        return array(inner, tag["width"]) if kind == "array" else list_(inner)
    if isinstance(t, T.StructType):
        return struct({f.name: of_field(f) for f in t.fields})
    if isinstance(t, T.DecimalType):
        return decimal(t.precision, t.scale)
    if isinstance(t, T.TimestampNTZType):
        return datetime(tag.get("unit", "us"))
    if isinstance(t, T.TimestampType):
        return datetime(tag.get("unit", "us"), tag.get("zone") or "UTC")
    if isinstance(t, T.DayTimeIntervalType):
        return duration(tag.get("unit", "us"))
    for name, spark in FLAT.items():
        if name not in TAGGED and type(spark) is type(t):
            return DType(name)
    raise Unsupported(f"no descriptor for {t.simpleString()}")
