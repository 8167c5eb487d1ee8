"""String, datetime, list, array, struct, binary and categorical functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Unsupported, require
from . import durations
from .compiler import _has, space

# ---------------------------------------------------------------- patterns


def java_regex(pattern: str) -> str:
    """The pattern in Java's dialect; look-around and back-references, which the API doesn't have, are refused."""
    require(not re.search(r"\(\?(?:[=!]|<[=!])", pattern) and not re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern), "look-around and back-references aren't supported")
    return pattern.replace("(?P<", "(?<").replace(r"\z", r"\z")


def literal_regex(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


# Strftime directives and Java's date-pattern letters.
STRFTIME = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "j": "DDD", "p": "a", "I": "hh",
    "f": "SSSSSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "e": "d", "Z": "z", "z": "xx", "%": "%",
}


def java_format(fmt: str) -> str:
    out, quoted, i = [], "", 0
    while i < len(fmt):
        if fmt[i] == "%":
            step = 3 if fmt[i + 1 : i + 3] in (".f", "3f", "6f", "9f") else 2
            key = fmt[i + 1 : i + step]
            letters = {".f": ".SSSSSS", "3f": "SSS", "6f": "SSSSSS", "9f": "SSSSSSSSS"}.get(key) or STRFTIME.get(key)
            require(letters is not None, f"no directive %{key}")
            out += [f"'{quoted}'"] * bool(quoted) + [letters]
            quoted, i = "", i + step
        elif fmt[i].isalpha() or fmt[i] in "[]{}#":
            quoted += fmt[i]
            i += 1
        else:
            out += [f"'{quoted}'"] * bool(quoted) + ["''" if fmt[i] == "'" else fmt[i]]
            quoted, i = "", i + 1
    return "".join(out + [f"'{quoted}'"] * bool(quoted))


# ---------------------------------------------------------------- strings

for _name, _f in {
    "len_bytes": lambda x: F.octet_length(x), "len_chars": lambda x: F.char_length(x), "to_lowercase": F.lower, "to_uppercase": F.upper,
}.items():
    space(f"str.{_name}")(lambda ctx, e, x, f=_f: f(x))


@space("str.contains", pattern=None, literal=False, strict=True)
def _(ctx, e, x, pattern, literal, strict):
    return x.contains(pattern) if literal else x.rlike(java_regex(pattern))


@space("str.starts_with", ["prefix"])
def _(ctx, e, x, p):
    return F.startswith(x, p)


@space("str.ends_with", ["suffix"])
def _(ctx, e, x, p):
    return F.endswith(x, p)


@space("str.find", pattern=None, literal=False, strict=True)
def _(ctx, e, x, pattern, literal, strict):
    """Offset of the first match in bytes, or null."""
    at = F.nullif(F.regexp_instr(x, F.lit(literal_regex(pattern) if literal else java_regex(pattern))), F.lit(0))
    return F.octet_length(F.substring(x, F.lit(1), at - 1)).cast("bigint")


@space("str.extract", pattern=None, group_index=1)
def _(ctx, e, x, pattern, group_index):
    return F.when(x.rlike(java_regex(pattern)), F.regexp_extract(x, java_regex(pattern), group_index))


@space("str.extract_all", pattern=None)
def _(ctx, e, x, pattern):
    return F.regexp_extract_all(x, F.lit(java_regex(pattern)), F.lit(0))


@space("str.split", by=None, inclusive=False, regex=False, strict=True)
def _(ctx, e, x, by, inclusive, regex, strict):
    p = java_regex(by) if regex else literal_regex(by)
    if not inclusive:
        return F.split(x, p, -1)
    parts = F.split(x, f"(?<={p})", -1)
    return F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


@space("str.replace", pattern=None, value="", literal=False, replace_all=False)
def _(ctx, e, x, pattern, value, literal, replace_all):
    p = literal_regex(pattern) if literal else java_regex(pattern)
    by = re.sub(r"([\\$])", r"\\\1", value) if literal else re.sub(r"\$\{(\w+)\}", r"$\1", value)
    if replace_all:
        return F.replace(x, F.lit(pattern), F.lit(value)) if literal else F.regexp_replace(x, p, by)
    if literal:
        return F.when(x.contains(pattern), F.concat(F.substring_index(x, pattern, 1), F.lit(value), F.substring(x, F.instr(x, F.lit(pattern)) + len(pattern), F.char_length(x)))).otherwise(x)
    # First match only: the shortest lead, the match, the rest.
    return F.regexp_replace(x, f"\\A((?s:.*?))(?:{p})", "$1" + re.sub(r"\$(\d+)", lambda m: f"${int(m[1]) + 1}", by))


def _strip(side: str):
    def f(ctx, e, x, characters):
        if characters is not None:
            return {"both": F.btrim, "start": F.ltrim, "end": F.rtrim}[side](x, F.lit(characters))
        parts = {"both": r"^\s+|\s+$", "start": r"^\s+", "end": r"\s+$"}[side]
        return F.regexp_replace(x, "(?U)" + parts, "")

    return f


space("str.strip_chars", characters=None)(_strip("both"))
space("str.strip_chars_start", characters=None)(_strip("start"))
space("str.strip_chars_end", characters=None)(_strip("end"))


@space("str.strip_prefix", prefix="")
def _(ctx, e, x, prefix):
    return F.when(F.startswith(x, F.lit(prefix)), F.substring(x, F.lit(len(prefix) + 1), F.char_length(x))).otherwise(x)


@space("str.strip_suffix", suffix="")
def _(ctx, e, x, suffix):
    return F.when(F.endswith(x, F.lit(suffix)), F.left(x, F.char_length(x) - len(suffix))).otherwise(x)


@space("str.slice", offset=0, length=None)
def _(ctx, e, x, offset, length):
    n = F.char_length(x)
    start = F.lit(offset) if offset >= 0 else n + offset
    stop = n if length is None else start + length
    first = F.greatest(start, F.lit(0))
    return F.substring(x, (first + 1).cast("int"), F.greatest(stop - first, F.lit(0)).cast("int"))


@space("str.head", n=5)
def _(ctx, e, x, n):
    return F.left(x, F.lit(n) if n >= 0 else F.greatest(F.char_length(x) + n, F.lit(0)))


@space("str.tail", n=5)
def _(ctx, e, x, n):
    return F.right(x, F.lit(n) if n >= 0 else F.greatest(F.char_length(x) + n, F.lit(0)))


@space("str.pad_start", length=0, fill_char=" ")
def _(ctx, e, x, length, fill_char):
    require(len(fill_char) == 1, "one fill character")
    return F.when(F.char_length(x) < length, F.lpad(x, length, fill_char)).otherwise(x)


@space("str.pad_end", length=0, fill_char=" ")
def _(ctx, e, x, length, fill_char):
    require(len(fill_char) == 1, "one fill character")
    return F.when(F.char_length(x) < length, F.rpad(x, length, fill_char)).otherwise(x)


@space("str.zfill", length=0)
def _(ctx, e, x, length):
    sign = F.regexp_extract(x, r"^[+-]?", 0)
    rest = F.substring(x, F.char_length(sign) + 1, F.char_length(x))
    return F.when(F.char_length(x) < length, F.concat(sign, F.lpad(rest, F.lit(length) - F.char_length(sign), F.lit("0")))).otherwise(x)


@space("str.to_date", format=None, strict=True)
def _(ctx, e, x, format, strict):
    f = java_format(format or "%Y-%m-%d")
    got = F.try_to_timestamp(x, F.lit(f)).cast("date")
    return F.when(x.isNotNull() & got.isNull(), F.raise_error(F.lit("not a date")).cast("date")).otherwise(got) if strict else got


@space("str.to_datetime", format=None, time_unit="us", time_zone=None, strict=True)
def _(ctx, e, x, format, time_unit, time_zone, strict):
    got = F.try_to_timestamp(x, F.lit(java_format(format))) if format else F.try_to_timestamp(x)
    bad = x.isNotNull() & got.isNull()
    out = got.cast("timestamp_ntz") if time_zone is None else F.to_utc_timestamp(got, time_zone)
    kind = "timestamp_ntz" if time_zone is None else "timestamp"
    return F.when(bad, F.raise_error(F.lit("not a datetime")).cast(kind)).otherwise(out) if strict else out


@space("str.to_time", format=None, strict=True)
def _(ctx, e, x, format, strict):
    f = F.lit(java_format(format or "%H:%M:%S"))
    return F.to_time(x, f) if strict else F.try_to_time(x, f)


# ---------------------------------------------------------------- datetimes

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def micros(ctx, e, x: Column) -> Column:
    """Microseconds since the epoch, by the wall clock for naive times."""
    t = ctx.kind(e.args[0])
    if isinstance(t, T.TimestampType):
        return F.unix_micros(x)
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), x.cast("timestamp_ntz"))


def from_micros(ctx, e, us: Column) -> Column:
    t = ctx.kind(e.args[0])
    out = F.timestamp_micros(us)
    return out if isinstance(t, T.TimestampType) else out.cast("timestamp_ntz").cast(t)


for _name, _f in {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "ordinal_day": F.dayofyear, "week": F.weekofyear, "quarter": F.quarter, "hour": F.hour, "minute": F.minute,
    "second": F.second, "iso_year": lambda x: F.extract(F.lit("YEAROFWEEK"), x), "weekday": lambda x: F.weekday(x) + 1, "date": F.to_date,
}.items():
    space(f"dt.{_name}")(lambda ctx, e, x, f=_f: f(x))

for _name, _f in {
    "millisecond": lambda us: F.floor(F.pmod(us, F.lit(1_000_000)) / 1000), "microsecond": lambda us: F.pmod(us, F.lit(1_000_000)), "nanosecond": lambda us: F.pmod(us, F.lit(1_000_000)) * 1000,
}.items():
    space(f"dt.{_name}")(lambda ctx, e, x, f=_f: f(micros(ctx, e, x)).cast("int"))


@space("dt.time")
def _(ctx, e, x):
    part = F.pmod(micros(ctx, e, x), F.lit(1_000_000))
    return F.make_time(F.hour(x), F.minute(x), (F.second(x) + part / F.lit(1_000_000)).cast("decimal(16,6)"))


@space("dt.timestamp", time_unit="us")
def _(ctx, e, x, time_unit):
    us = micros(ctx, e, x)
    return {"us": us, "ms": F.floor(us / 1000), "ns": us * 1000}[time_unit].cast("bigint")


@space("dt.format", format="%Y-%m-%d")
def _(ctx, e, x, format):
    return F.date_format(x, java_format(format))


def _month_index(x: Column) -> Column:
    return F.year(x) * 12 + F.month(x) - 1


def _from_month(i: Column) -> Column:
    return F.make_date(F.floor(i / 12).cast("int"), (F.pmod(i, F.lit(12)) + 1).cast("int"), F.lit(1))


def truncated(ctx, e, x: Column, d: durations.Duration) -> Column:
    require(d.positive and not d.index and not (d.months and d.micros), "truncate by a positive calendar or fixed duration")
    t = ctx.kind(e.args[0])
    if d.months:
        i = _month_index(x)
        return _from_month(i - F.pmod(i, F.lit(d.months))).cast(t)
    us = micros(ctx, e, x)
    # weeks begin on Monday; the epoch is a Thursday
    shift = 4 * durations.MICROS["d"] if d.micros % durations.MICROS["w"] == 0 else 0
    return from_micros(ctx, e, us - F.pmod(us - shift, F.lit(d.micros)))


@space("dt.truncate", every="1d")
def _(ctx, e, x, every):
    return truncated(ctx, e, x, durations.parse(every))


@space("dt.round", every="1d")
def _(ctx, e, x, every):
    d = durations.parse(every)
    if d.months and not d.micros:  # to the nearer of the calendar steps around it, half up
        low = truncated(ctx, e, x, d)
        high = F.add_months(low, F.lit(d.months)).cast(ctx.kind(e.args[0]))
        at, lo, hi = (F.timestamp_diff("MICROSECOND", F.expr(EPOCH), y.cast("timestamp_ntz")) for y in (x, low, high))
        return F.when(at - lo >= hi - at, high).otherwise(low)
    require(bool(d.micros) and not d.months, "round by calendar steps or by a fixed duration")
    us = micros(ctx, e, x) + d.micros // 2
    shift = 4 * durations.MICROS["d"] if d.micros % durations.MICROS["w"] == 0 else 0
    return from_micros(ctx, e, us - F.pmod(us - shift, F.lit(d.micros)))


@space("dt.offset_by", by="1d")
def _(ctx, e, x, by):
    d, t = durations.parse(by), ctx.kind(e.args[0])
    moved = F.add_months(x, F.lit(d.months)) if d.months else None
    if moved is not None:  # the clock time stays, the day is clamped to the month's end
        x = moved.cast(t) if isinstance(t, T.DateType) else (x + F.make_ym_interval(F.lit(0), F.lit(d.months)))
    return x + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(d.micros / 1e6).cast("decimal(18,6)")) if d.micros else x


@space("dt.convert_time_zone", time_zone="UTC")
def _(ctx, e, x, time_zone):
    """Naive times are taken as UTC and shown on the zone's clock; zoned ones keep their instant."""
    return x if isinstance(ctx.kind(e.args[0]), T.TimestampType) else F.convert_timezone(F.lit("UTC"), F.lit(time_zone), x)


def _offsets(part: str):
    @space(f"dt.{part}", time_zone="UTC")
    def _(ctx, e, x, time_zone):
        import datetime
        import zoneinfo

        import pandas as pd

        def seconds(values):
            zone = zoneinfo.ZoneInfo(time_zone)

            def one(us):
                at = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(microseconds=int(us))
                local = at.astimezone(zone)
                dst = local.dst() or datetime.timedelta(0)
                return int((dst if part == "dst_offset" else local.utcoffset() - dst).total_seconds())

            return values.map(one, na_action="ignore").astype("Int64")

        seconds.__annotations__ = {"values": pd.Series, "return": pd.Series}
        # no built-in splits an offset into its parts: Arrow batches through zoneinfo
        return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.pandas_udf(seconds, "long")(micros(ctx, e, x)).cast("decimal(18,6)"))


_offsets("base_utc_offset")
_offsets("dst_offset")


# ---------------------------------------------------------------- lists and fixed-size arrays


def _get(x: Column, i: Column, null_on_oob: bool) -> Column:
    at = F.when(i >= 0, i + 1).otherwise(i).cast("int")
    return F.try_element_at(x, at) if null_on_oob else F.element_at(x, at)


def _sum(ctx, e, x: Column) -> Column:
    t = ctx.kind(e.args[0]).elementType
    zero = F.lit(0.0) if isinstance(t, (T.FloatType, T.DoubleType)) else F.lit(0).cast("bigint")
    kind = "double" if isinstance(t, (T.FloatType, T.DoubleType)) else "bigint"
    return F.aggregate(F.filter(x, lambda v: v.isNotNull()), zero, lambda a, v: a + v.cast(kind))


def _mean(ctx, e, x: Column) -> Column:
    some = F.filter(x, lambda v: v.isNotNull())
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, v: a + v.cast("double")) / F.size(some))


def _sorted(x: Column, descending: bool, nulls_last: bool) -> Column:
    some = F.sort_array(F.filter(x, lambda v: v.isNotNull()), asc=not descending)
    nulls = F.filter(x, lambda v: v.isNull())
    return F.concat(some, nulls) if nulls_last else F.concat(nulls, some)


for _space in ("list", "arr"):
    space(f"{_space}.len")(lambda ctx, e, x: F.array_size(x))
    space(f"{_space}.first")(lambda ctx, e, x: F.try_element_at(x, F.lit(1)))
    space(f"{_space}.last")(lambda ctx, e, x: F.try_element_at(x, F.lit(-1)))
    space(f"{_space}.sum")(_sum)
    space(f"{_space}.min")(lambda ctx, e, x: F.array_min(x))
    space(f"{_space}.max")(lambda ctx, e, x: F.array_max(x))
    space(f"{_space}.mean")(_mean)
    space(f"{_space}.get", ["index"], null_on_oob=False)(lambda ctx, e, x, i, null_on_oob: _get(x, i, null_on_oob))
    space(f"{_space}.contains", ["item"], nulls_equal=False)(
        lambda ctx, e, x, v, nulls_equal: _has(x, F.exists(x, lambda y: y.eqNullSafe(v)) if nulls_equal else F.coalesce(F.array_contains(x, v), F.lit(False)))
    )
    space(f"{_space}.sort", descending=False, nulls_last=False)(lambda ctx, e, x, descending, nulls_last: _sorted(x, descending, nulls_last))


@space("list.slice", offset=0, length=None)
def _(ctx, e, x, offset, length):
    n = F.size(x)
    start = F.lit(offset) if offset >= 0 else n + offset
    stop = n if length is None else F.least(start + length, n)
    first = F.greatest(start, F.lit(0))
    return _has(x, F.slice(x, (first + 1).cast("int"), F.greatest(stop - first, F.lit(0)).cast("int")))


space("arr.to_list")(lambda ctx, e, x: x)


@space("arr.explode", empty_as_null=True, keep_nulls=True)
def _(ctx, e, x, empty_as_null, keep_nulls):
    """One row per element; alone in a select."""
    one = F.array(F.lit(None).cast(ctx.kind(e.args[0]).elementType))
    if empty_as_null:
        x = F.when(F.size(x) == 0, one).otherwise(x)
    return F.explode(F.coalesce(x, one) if keep_nulls else x)


# ---------------------------------------------------------------- structs, binary, categories


@space("struct.field", name=None)
def _(ctx, e, x, name):
    return x.getField(name)


@space("struct.field_at", index=0)
def _(ctx, e, x, index):
    return x.getField(ctx.kind(e.args[0]).names[index])


@space("struct.rename_fields", names=())
def _(ctx, e, x, names):
    t = ctx.kind(e.args[0])
    return x.cast(T.StructType([T.StructField(n, f.dataType, True) for n, f in zip(names, t.fields, strict=True)]))


@space("struct.json_encode")
def _(ctx, e, x):
    return F.to_json(x, {"ignoreNullFields": "false"})


space("bin.size_bytes")(lambda ctx, e, x: F.octet_length(x))
space("bin.contains", ["part"])(lambda ctx, e, x, p: F.contains(x, p))
space("bin.starts_with", ["prefix"])(lambda ctx, e, x, p: F.startswith(x, p))
space("bin.ends_with", ["suffix"])(lambda ctx, e, x, p: F.endswith(x, p))
space("bin.hex_encode")(lambda ctx, e, x: F.lower(F.hex(x)))
space("bin.base64_encode")(lambda ctx, e, x: F.replace(F.base64(x), F.lit("\r\n"), F.lit("")))


@space("cat.physical", categories=None)
def _(ctx, e, x, found=None, *, categories):
    """Codes: the position of each value in the listed categories, or in those found, in order of value.
    Frames compute the categories found once, as one row."""
    cats = F.array(*[F.lit(c) for c in categories]) if categories else found if found is not None else F.array_sort(ctx.agg(F.collect_set(x)))
    return F.nullif(F.array_position(cats, x), F.lit(0)) - 1


@space("cat.categories", categories=None)
def _(ctx, e, x, categories):
    return F.array(*[F.lit(c) for c in categories]) if categories else F.array_sort(F.collect_set(x))


