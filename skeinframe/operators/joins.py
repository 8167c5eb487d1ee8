"""Joins: equi (with validation and coalescing), as-of, and by predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import require
from ..functions import durations
from ..functions.compiler import RID, Context, quoted

HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full", "outer": "full", "semi": "left_semi", "anti": "left_anti", "cross": "cross"}
ORDERS = {"none": (), "left": ("l",), "right": ("r",), "left_right": ("l", "r"), "right_left": ("r", "l")}


def _names(value) -> list[str]:
    return [value] if isinstance(value, str) else list(value or [])


def _side(df: DataFrame, tag: str) -> DataFrame:
    return df.select(*[quoted(c).alias(f"__{tag}_{c}") for c in df.columns])


def _unique_keys(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Fails at run time if a key with a value repeats."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*map(quoted, keys)))
    known = quoted(keys[0]).isNotNull()
    for k in keys[1:]:
        known = known & quoted(k).isNotNull()
    checked = F.when(known & (n > 1), F.raise_error(F.lit(f"join validation: {side} keys repeat")).cast("int"))
    return df.withColumn("__check", checked).filter(F.col("__check").isNull()).drop("__check")


def join(left, right, on=None, left_on=None, right_on=None, how="inner", suffix="_right", coalesce=None, nulls_equal=False, validate="m:m", maintain_order="none", allow_parallel=True, force_parallel=False):
    """The equi-join family. ``coalesce``: None as the kind of join has it (one key column, both for
    full), True one, False both."""
    from .frame import LazyFrame

    require(how in HOW, f"no join {how}")
    require(validate in ("m:m", "m:1", "1:m", "1:1"), f"no validation {validate}")
    require(maintain_order in ORDERS, f"no order {maintain_order}")
    require(allow_parallel or not force_parallel, "force_parallel needs allow_parallel")
    lk, rk = _names(left_on or on), _names(right_on or on)
    require(bool(lk) == (how != "cross") and len(lk) == len(rk), "keys for both sides, and none for a cross join")
    order = ORDERS[maintain_order]
    ldf = left._with_order()._df if "l" in order else left._plain
    rdf = right._with_order()._df if "r" in order else right._plain
    if validate[0] == "1":
        ldf = _unique_keys(ldf, lk, "left")
    if validate[-1] == "1":
        rdf = _unique_keys(rdf, rk, "right")
    a, b = _side(ldf, "l"), _side(rdf, "r")
    if how == "cross":
        out = a.crossJoin(b)
    else:
        test = None
        for x, y in zip(lk, rk, strict=True):
            p, q = a[f"`__l_{x}`"], b[f"`__r_{y}`"]
            one = p.eqNullSafe(q) if nulls_equal else p == q
            test = one if test is None else test & one
        out = a.join(b, test, HOW[how])
    if order:
        out = out.orderBy(*[F.col(f"__{t}_{RID}").asc_nulls_last() for t in order])
    if how in ("semi", "anti"):
        return LazyFrame(out.select(*[quoted(f"__l_{c}").alias(c) for c in left.columns]))
    merge = (how != "full" and how != "outer") if coalesce is None else coalesce
    pairs = dict(zip(lk, rk, strict=True)) if how != "cross" else {}
    columns: list[Column] = []
    for c in left.columns:
        x = quoted(f"__l_{c}")
        if merge and c in pairs:
            x = {"right": quoted(f"__r_{pairs[c]}"), "full": F.coalesce(x, quoted(f"__r_{pairs[c]}"))}.get(HOW[how], x)
        columns.append(x.alias(c))
    for c in right.columns:
        if merge and c in pairs.values():
            continue
        columns.append(quoted(f"__r_{c}").alias(c + suffix if c in left.columns else c))
    return LazyFrame(out.select(*columns))


def join_where(left, right, *predicates, suffix="_right"):
    """Inner join on any predicates. Columns of the right side go by their suffixed names where both
    sides have one. An equality among the predicates makes it a hash or sort-merge join."""
    from .frame import LazyFrame

    require(bool(predicates), "join_where needs a predicate")
    renamed = right._plain.select(*[quoted(c).alias(c + suffix if c in left.columns else c) for c in right.columns])
    pair = left._plain.limit(0).crossJoin(renamed.limit(0))
    ctx = Context(pair)
    test = None
    for p in predicates:
        c = ctx.compile(p)
        test = c if test is None else test & c
    return LazyFrame(left._plain.join(renamed, test, "inner"))


def range_join(left, right, point: str, low: str, high: str, width: float, suffix="_right"):
    """``low <= point < high`` by buckets of ``width``: each interval goes to the buckets it
    touches, points to their own, and an equi-join meets them; the condition is checked again."""
    from .frame import LazyFrame

    renamed = right._plain.select(*[quoted(c).alias(c + suffix if c in left.columns else c) for c in right.columns])
    lo, hi = (quoted(c + suffix if c in left.columns else c) for c in (low, high))
    cell = lambda c: F.floor(c.cast("double") / width)
    spread = renamed.filter(lo < hi).withColumn("__cell", F.explode(F.sequence(cell(lo), cell(hi))))
    rows = left._plain.withColumn("__cell", cell(quoted(point))).join(spread, "__cell")
    return LazyFrame(rows.filter((quoted(point) >= lo) & (quoted(point) < hi)).drop("__cell"))


def _number(df: DataFrame, name: str) -> Column:
    t = df.schema[name].dataType
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), quoted(name).cast("timestamp_ntz"))
    return quoted(name)


def join_asof(left, right, on=None, left_on=None, right_on=None, by=None, left_by=None, right_by=None, strategy="backward", tolerance=None, allow_equal=True, suffix="_right", check_sortedness=False, coalesce=True):
    """Each left row with the nearest right row by key: one shuffle of the union of both sides by the
    ``by`` columns, one sort, and the last (or next) right row seen; no pairs are made."""
    from .frame import LazyFrame

    require(strategy in ("backward", "forward", "nearest"), f"no strategy {strategy}")
    lo, ro = left_on or on, right_on or on
    lb, rb = _names(left_by or by), _names(right_by or by)
    require(bool(lo and ro) and len(lb) == len(rb), "one key for each side, and as many by columns")
    ldf, rdf = left._with_order()._df, right._plain
    bys = [f"__by{i}" for i in range(len(lb))]
    a = ldf.select(*[quoted(x).alias(n) for x, n in zip(lb, bys, strict=True)], _number(ldf, lo).alias("__t"), F.struct(*[quoted(c) for c in ldf.columns]).alias("__l"))
    b = rdf.select(*[quoted(x).alias(n) for x, n in zip(rb, bys, strict=True)], _number(rdf, ro).alias("__t"), F.struct(*[quoted(c) for c in rdf.columns]).alias("__r"))
    both = a.withColumn("__side", F.lit(1)).unionByName(b.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    hit = F.when(F.col("__r").isNotNull() & F.col("__t").isNotNull(), F.struct(F.col("__t").alias("t"), F.col("__r").alias("r")))

    def seen(back: bool) -> Column:
        # Rows of equal key: the right ones come first (on the way back, last) if equal keys match.
        tie = F.col("__side").asc() if back == allow_equal else F.col("__side").desc()
        w = Window.partitionBy(*bys).orderBy(F.col("__t").asc_nulls_first(), tie)
        if back:
            return F.last(hit, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return F.first(hit, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))

    rows = both
    for name, back in (("__b", True), ("__f", False)):
        if strategy in ("nearest", "backward" if back else "forward"):
            rows = rows.withColumn(name, seen(back))
    rows = rows.filter("__side = 1")
    if strategy == "nearest":
        nearer = F.coalesce(F.col("__f.t") - F.col("__t") < F.col("__t") - F.col("__b.t"), F.col("__b").isNull())
        found = F.when(nearer, F.col("__f")).otherwise(F.col("__b"))
    else:
        found = F.col("__b" if strategy == "backward" else "__f")
    found = F.when(F.col("__t").isNotNull(), found)
    rows = rows.withColumn("__m", found)
    if tolerance is not None:
        limit = durations.parse(tolerance).micros if isinstance(tolerance, str) else tolerance
        rows = rows.withColumn("__m", F.when(F.abs(F.col("__t") - F.col("__m.t")) <= F.lit(limit), F.col("__m")))
    skip = set(rb) | ({ro} if coalesce and ro == lo else set())
    right_columns = [F.col("__m.r")[c].alias(c + suffix if c in left.columns else c) for c in right.columns if c not in skip]
    return LazyFrame(rows.select(*[F.col("__l")[c].alias(c) for c in left.columns], *right_columns))
