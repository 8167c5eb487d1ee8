"""More of the catalogue: functions, windows, selectors, eager frames, columns, sources and sinks, each with its SQL."""

from __future__ import annotations

import tempfile
import uuid

from . import DataFrame, SqlContext, concat, dtypes, len_, lit, read_ipc_stream, read_json, scan_csv, scan_ipc, scan_ndjson, scan_parquet, selectors, struct, when
from . import col as c
from .catalog import _EV, _gaps, big, query, real
from .operators.frame import LazyFrame

F64 = dtypes.flat("float64")
NAN, INF = float("nan"), float("inf")

# ---------------------------------------------------------------- operators and numbers


@query(f"SELECT event_id, v > 50 AND user_id < 50 AS a, v > 50 OR user_id < 50 AS o, NOT (v > 50) AS n, v IS DISTINCT FROM 10.0 AS d, v IS NOT NULL AS p, v <> 10 AS ne, v < 20 AS lt, (v >= 50) <> (user_id < 50) AS x FROM {_EV}")
def booleans(t):
    v, u = c("v"), c("user_id")
    high, low = v > 50, u < 50
    return _gaps(t).select("event_id", high.and_(low).alias("a"), high.or_(low).alias("o"), high.not_().alias("n"), v.ne_missing(lit(10.0)).alias("d"), v.is_not_null().alias("p"), (v != 10).alias("ne"), (v < 20).alias("lt"), ((v >= 50) ^ low).alias("x"))


_ODD = "(SELECT event_id, event_type, value, CASE event_id % 5 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN NULL ELSE value END AS x FROM events)"


def _odd(t):
    x = when(c("event_id") % 5 == 0).then(lit(NAN)).otherwise(when(c("event_id") % 5 == 1).then(lit(INF)).otherwise(when(c("event_id") % 5 == 2).then(lit(None, F64)).otherwise(c("value"))))
    return t.events.select("event_id", "event_type", "value", x.alias("x"))


@query(f"SELECT event_id, isnan(x) AS na, NOT isnan(x) AS nn, NOT isnan(x) AND NOT isinf(x) AS fi, isinf(x) AS nf, CASE WHEN isnan(x) THEN -1 WHEN x IS NOT NULL THEN least(x, 1000) END AS fl, greatest(value, 10) AS lo, least(value, 50) AS hi FROM {_ODD}")
def float_states(t):
    x, v = c("x"), c("value")
    rows = _odd(t).select("event_id", x.is_nan().alias("na"), x.is_not_nan().alias("nn"), x.is_finite().alias("fi"), x.is_infinite().alias("nf"), x.fill_nan(lit(-1.0)).clip(upper=lit(1000.0)).alias("fl"), v.clip(lower=lit(10.0)).alias("lo"), v.clip(upper=lit(50.0)).alias("hi"))
    return rows


@query("SELECT p_partkey, " + ", ".join(f"round({f}, 6) AS m{i}" for i, f in enumerate(["acos(p_size / 100.0)", "asin(p_size / 100.0)", "sinh(p_size / 100.0)", "cosh(p_size / 100.0)", "atanh(p_size / 100.0)", "acosh(1 + p_size / 100.0)", "cot(0.5 + p_size / 100.0)"])) + " FROM part")
def math_more(t):
    x = c("p_size").cast("float64") / lit(100.0)
    made = [x.acos(), x.asin(), x.sinh(), x.cosh(), x.atanh(), (x + lit(1.0)).acosh(), (x + lit(0.5)).cot()]
    return t.part.select("p_partkey", *[real(e, f"m{i}") for i, e in enumerate(made)])


@query("SELECT event_id, -value AS a, value + 1 AS b, abs(value - 50) AS c, value IS NULL AS d, value * 2 AS e FROM events")
def expression_builders(t):
    v = c("value")
    made = (v * lit(2.0)).alias("e")
    assert made.meta.root_names() == ["value"] and made.meta.output_name() == "e" and not made.meta.is_column() and v.meta.is_column() and lit(1).meta.is_literal()
    assert c("^a$").meta.is_regex_projection() and c("^a$").meta.has_multiple_outputs() and made.meta.undo_aliases().meta.output_name() == "value" and v.meta.is_column_selection()
    return t.events.select("event_id", v.unary("negate").alias("a"), v.binary("add", lit(1.0)).alias("b"), (v - lit(50.0)).function("abs").alias("c"), v.unary("is_null").alias("d"), made)


@query("SELECT event_type, sum(user_id)::BIGINT AS s FROM events GROUP BY 1")
def aggregate_builder(t):
    return t.events.group_by("event_type").agg(big(c("user_id").aggregate("sum"), "s"))


@query('SELECT n_nationkey, n_nationkey AS p_n_nationkey, n_nationkey AS n_nationkey_s, n_name AS "N_NAME", n_regionkey FROM nation')
def output_names(t):
    k = c("n_nationkey")
    return t.nation.select(k.alias("zz").name.keep(), k.name.prefix("p_"), k.name.suffix("_s"), c("n_name").name.to_uppercase(), c("n_regionkey").name.to_lowercase())


@query("SELECT l_orderkey, l_linenumber, l_suppkey IN (SELECT l_linenumber FROM lineitem) AS m FROM lineitem")
def is_in_column(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", c("l_suppkey").is_in(c("l_linenumber").cast("int64")).alias("m"))


@query("SELECT n_nationkey, CASE WHEN k IS NOT NULL THEN coalesce(k IN (SELECT k2 FROM (SELECT nullif(n_nationkey, 3) % 4 AS k2 FROM nation) WHERE k2 IS NOT NULL), FALSE) END AS m, k IS NULL OR k IN (SELECT nullif(n_nationkey, 3) % 4 FROM nation WHERE n_nationkey <> 3) AS e FROM (SELECT n_nationkey, nullif(n_regionkey, 1) AS k FROM nation)")
def is_in_column_nulls(t):
    none = lit(None, dtypes.flat("int64"))
    n, r = c("n_nationkey").cast("int64"), c("n_regionkey").cast("int64")
    rows = t.nation.select("n_nationkey", when(r == 1).then(none).otherwise(r).alias("k"), when(n == 3).then(none).otherwise(n % 4).alias("k2"))
    return rows.select("n_nationkey", c("k").is_in(c("k2")).alias("m"), c("k").is_in(c("k2"), nulls_equal=True).alias("e"))


@query("SELECT p_partkey, list_contains(string_split(p_name, ' '), 'ring') AS m FROM part")
def is_in_own_list(t):
    return t.part.select("p_partkey", lit("ring").is_in(c("p_name").str.split(" ")).alias("m"))


# ---------------------------------------------------------------- aggregates


@query(f"SELECT event_type, bool_or(isnan(y)) AS lo, CASE WHEN bool_or(isnan(y)) THEN -1 ELSE max(y) END AS hi, count(*) AS n, sum(event_id)::BIGINT AS s FROM (SELECT event_id, event_type, CASE WHEN event_type = 'click' THEN x ELSE value END AS y FROM {_ODD} WHERE event_id % 5 <> 1) GROUP BY 1")
def agg_nan_and_lists(t):
    y = when(c("event_type") == "click").then(c("x")).otherwise(c("value")).alias("y")
    rows = _odd(t).filter(c("event_id") % 5 != 1).select("event_id", "event_type", y)
    ids = c("event_id").implode().list
    return rows.group_by("event_type").agg(c("y").nan_min().is_nan().alias("lo"), c("y").nan_max().fill_nan(lit(-1.0)).alias("hi"), big(ids.len(), "n"), big(ids.sum(), "s"))


@query("SELECT user_id, min(event_type) AS m, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY n DESC) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE r = 1 GROUP BY 1")
def agg_mode(t):
    m = c("event_type").mode().list
    return t.events.group_by("user_id").agg(m.first().alias("m"), big(m.len(), "n"))


@query("SELECT event_type, TRUE AS near FROM events GROUP BY 1")
def agg_approx_error(t):
    """The estimate lies within a tenth of the exact count (its standard error is a twentieth)."""
    rows = t.events.group_by("event_type").agg(c("event_id").approx_n_unique().alias("a"), c("event_id").n_unique().alias("n"))
    return rows.select("event_type", ((c("a") - c("n")).abs().cast("float64") <= c("n").cast("float64") * lit(0.1)).alias("near"))


_Q = "list_sort(list(l_extendedprice))"
_AT = "0.3::DOUBLE * (count(*) - 1)"


@query(f"SELECT l_returnflag, {_Q}[1 + floor({_AT})::BIGINT] AS lo, {_Q}[1 + ceil({_AT})::BIGINT] AS hi, round(({_Q}[1 + floor({_AT})::BIGINT] + {_Q}[1 + ceil({_AT})::BIGINT]) / 2, 6) AS mi, {_Q}[1 + round({_AT})::BIGINT] AS ne FROM lineitem GROUP BY 1")
def agg_quantile_kinds(t):
    q = lambda how: c("l_extendedprice").quantile(0.3, how)
    return t.lineitem.group_by("l_returnflag").agg(q("lower").alias("lo"), q("higher").alias("hi"), real(q("midpoint"), "mi"), q("nearest").alias("ne"))


@query("SELECT user_id, bool_or(v > 90) AS an, CASE WHEN bool_or(v <= 1) THEN FALSE WHEN count(*) > count(v) THEN NULL ELSE TRUE END AS al FROM " + _EV + " GROUP BY 1")
def agg_kleene(t):
    v = c("v")
    return _gaps(t).group_by("user_id").agg((v > 90).any().alias("an"), (v > 1).all(ignore_nulls=False).alias("al"))


# ---------------------------------------------------------------- windows


@query(
    f"SELECT event_id, CASE WHEN v IS NOT NULL THEN min(v) OVER w END AS mi, CASE WHEN v IS NOT NULL THEN max(v) OVER w END AS ma, CASE WHEN v IS NOT NULL THEN round(sum(v) OVER r, 6) END AS back, round(var_samp(v) OVER (w ROWS 4 PRECEDING), 8) AS va FROM {_EV} "
    "WINDOW w AS (PARTITION BY user_id ORDER BY event_id), r AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
)
def cumulative_windows(t):
    o = lambda e: e.over("user_id", "my key")
    v = c("v")
    rows = _gaps(t).with_columns(c("event_id").alias("my key"))
    return rows.select("event_id", o(v.cum_min()).alias("mi"), o(v.cum_max()).alias("ma"), real(o(v.cum_sum(reverse=True)), "back"), real(o(v.rolling_variance(5)), "va", 8))


@query(f"SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n, count(DISTINCT event_type) OVER (PARTITION BY user_id) AS k, first_value(value) OVER (PARTITION BY user_id ORDER BY event_id) AS f, last_value(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM events")
def over_more(t):
    v = c("value")
    o = lambda e: e.over("user_id", "event_id")
    return t.events.select("event_id", big(v.over("user_id", mapping="join").list.len(), "n"), c("event_type").n_unique().over("user_id").alias("k"), o(v.first()).alias("f"), o(v.last()).alias("l"))


@query("SELECT event_id, value, row_number() OVER (ORDER BY f, event_id) - 1 AS i FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id) AS f FROM events)")
def over_explode(t):
    g = lambda e: e.over("user_id", "event_id", mapping="explode")
    return t.events.sort("event_id").select(g(c("event_id")), g(c("value"))).with_row_number("i")


@query("SELECT round(d, 6) AS d FROM (SELECT value - lag(value, 2) OVER (ORDER BY event_id) AS d, row_number() OVER (ORDER BY event_id) AS i FROM events) WHERE i > 2")
def diff_drop(t):
    return t.events.sort("event_id").select(c("value").diff(2, "drop").alias("d")).select(real(c("d"), "d"))


@query(
    "SELECT event_id, round(coalesce(v, a.v0 + (b.v1 - a.v0) * (event_id - a.i0) / (b.i1 - a.i0)), 6) AS x FROM (SELECT event_id, v, "
    "last_value(CASE WHEN v IS NOT NULL THEN struct_pack(v0 := v, i0 := event_id) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS a, "
    f"first_value(CASE WHEN v IS NOT NULL THEN struct_pack(v1 := v, i1 := event_id) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM {_EV})"
)
def interpolate_by(t):
    return _gaps(t).select("event_id", real(c("v").interpolate_by(c("event_id")).over("user_id"), "x"))


_K = f"(SELECT event_id, user_id, v, count(v) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM {_EV})"
_W = "power(0.7::DOUBLE, a.k - b.k)"


@query(
    "SELECT event_id, CASE WHEN v IS NOT NULL THEN round(m, 6) END AS m, CASE WHEN v IS NOT NULL THEN round(s / 3.14159265::DOUBLE, 6) END AS s, CASE WHEN v IS NOT NULL THEN round(CASE WHEN k > 1 THEN cov * w * w / (w * w - w2) ELSE 0 END, 6) END AS va, CASE WHEN v IS NOT NULL THEN round(sqrt(CASE WHEN k > 1 THEN cov * w * w / (w * w - w2) ELSE 0 END), 6) END AS sd FROM ("
    f"SELECT a.event_id, any_value(a.v) AS v, any_value(a.k) AS k, sum({_W} * b.v) / sum({_W}) AS m, sum({_W} * b.v) AS s, sum({_W}) AS w, sum({_W} * {_W}) AS w2, greatest(sum({_W} * b.v * b.v) / sum({_W}) - power(sum({_W} * b.v) / sum({_W}), 2), 0) AS cov FROM {_K} a LEFT JOIN (SELECT * FROM {_K} WHERE v IS NOT NULL) b ON a.user_id = b.user_id AND b.event_id <= a.event_id GROUP BY a.event_id)"
)
def ewm_closed_form(t):
    o = lambda e: e.over("user_id", "event_id")
    v = c("v")
    return _gaps(t).select("event_id", real(o(v.ewm_mean(0.3)), "m"), real(o(v.ewm_sum(0.3)) / lit(3.14159265), "s"), real(o(v.ewm_variance(0.3)), "va"), real(o(v.ewm_std(0.3)), "sd"))


# ---------------------------------------------------------------- dynamic and rolling groups


def _rolling_sql(closed: str) -> str:
    low = ">=" if closed in ("left", "both") else ">"
    high = "<=" if closed in ("right", "both") else "<"
    return (
        "SELECT a.user_id, a.ts, count(b.event_id) AS n, count(DISTINCT b.event_type) AS k, round(coalesce(sum(b.value), 0), 5) AS s, arg_min(b.value, b.ts) AS f, arg_max(b.value, b.ts) AS l, "
        "list_position(list(b.value ORDER BY b.ts) FILTER (b.event_id IS NOT NULL), min(b.value))::BIGINT - 1 AS lo, list_position(list(b.value ORDER BY b.ts) FILTER (b.event_id IS NOT NULL), max(b.value))::BIGINT - 1 AS hi "
        f"FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.ts {low} a.ts - INTERVAL 36 HOUR AND b.ts {high} a.ts GROUP BY a.user_id, a.ts, a.event_id"
    )


def _rolling(t, closed: str):
    v = c("value")
    made = [len_().alias("n"), c("event_type").n_unique().alias("k"), real(v.sum(), "s", 5), v.first().alias("f"), v.last().alias("l"), v.arg_min().alias("lo"), v.arg_max().alias("hi")]
    return t.events.group_by_rolling("ts", "36h", by="user_id", closed=closed).agg(*made)


@query(_rolling_sql("right"))
def group_rolling_right(t):
    return _rolling(t, "right")


@query(_rolling_sql("left"))
def group_rolling_left(t):
    return _rolling(t, "left")


@query(_rolling_sql("both"))
def group_rolling_both(t):
    return _rolling(t, "both")


@query(_rolling_sql("none"))
def group_rolling_none(t):
    return _rolling(t, "none")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts - INTERVAL 1 MICROSECOND) + INTERVAL 6 HOUR AS ts, time_bucket(INTERVAL 6 HOUR, ts - INTERVAL 1 MICROSECOND) AS lo, time_bucket(INTERVAL 6 HOUR, ts - INTERVAL 1 MICROSECOND) + INTERVAL 6 HOUR AS hi, count(*) AS n, arg_min(value, event_id) AS f, arg_max(value, event_id) AS l, count(DISTINCT user_id) AS u FROM events GROUP BY ALL")
def group_dynamic_right(t):
    v = c("value")
    rows = t.events.sort("event_id").group_by_dynamic("ts", "6h", closed="right", label="right", include_boundaries=True).agg(len_().alias("n"), v.first().alias("f"), v.last().alias("l"), c("user_id").n_unique().alias("u"))
    return rows.rename({"_lower_boundary": "lo", "_upper_boundary": "hi"})


_KEYED = "(SELECT *, CASE WHEN user_id % 5 <> 0 THEN event_type END AS k FROM events)"


def _keyed(t):
    return t.events.with_columns(when(c("user_id") % 5 != 0).then(c("event_type")).otherwise(lit(None, dtypes.flat("string"))).alias("k"))


@query(f"SELECT k, min(ts) AS ts, count(*) AS n FROM (SELECT k, ts, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY k))) // 36000000000 AS w FROM {_KEYED}) GROUP BY k, w")
def group_dynamic_data_point(t):
    return _keyed(t).group_by_dynamic("ts", "10h", by="k", start_by="data_point", label="data_point").agg(len_().alias("n"))


@query(f"SELECT k, o + to_months(m::INTEGER) AS ts, count(*) AS n FROM (SELECT k, ts, o, datediff('month', o, ts) - CASE WHEN o + to_months(datediff('month', o, ts)::INTEGER) > ts THEN 1 ELSE 0 END AS m FROM (SELECT *, min(ts) OVER (PARTITION BY k) AS o FROM {_KEYED})) GROUP BY ALL")
def group_dynamic_month_point(t):
    return _keyed(t).group_by_dynamic("ts", "1mo", by="k", start_by="data_point").agg(len_().alias("n"))


@query("SELECT date_trunc('week', ts - INTERVAL 2 DAY) + INTERVAL 2 DAY AS ts, count(*) AS n FROM events GROUP BY 1")
def group_dynamic_wednesday(t):
    return t.events.group_by_dynamic("ts", "1w", start_by="wednesday").agg(len_().alias("n"))


@query("SELECT to_timestamp(w * 3600)::TIMESTAMP AS ts, count(*) AS n FROM (SELECT epoch_us(ts) AS t, unnest([epoch_us(ts) // 3600000000, epoch_us(ts) // 3600000000 - 1]) AS w FROM events) WHERE t >= w * 3600000000 AND t <= (w + 1) * 3600000000 GROUP BY 1")
def group_dynamic_both(t):
    return t.events.group_by_dynamic("ts", "1h", closed="both").agg(len_().alias("n"))


# ---------------------------------------------------------------- namespaces


@query("SELECT vec_id, len(e) AS n, round(list_sum(e), 4) AS s, list_min(e) AS mi, list_max(e) AS ma, round(list_avg(e), 5) AS av, e[1] AS g, list_contains(e, e[3]) AS co, list_sort(e)[1] AS so, list_sort(e)[-1] AS de, len(e) AS tl FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def arrays(t):
    x = c("embedding").cast(dtypes.list_(F64)).arr
    return t.embeddings.select(
        "vec_id", big(x.len(), "n"), real(x.sum(), "s", 4), x.min().alias("mi"), x.max().alias("ma"), real(x.mean(), "av", 5), x.get(0).alias("g"), x.contains(x.get(2)).alias("co"), x.sort().arr.get(0).alias("so"),
        x.sort(descending=True).arr.get(0).alias("de"), big(x.to_list().list.len(), "tl"),
    )


@query("SELECT unnest(embedding)::DOUBLE AS e FROM embeddings")
def array_explode(t):
    return t.embeddings.select(c("embedding").arr.explode().alias("e")).select(c("e").cast("float64"))


@query("SELECT vec_id, list_contains(e, e[5]) AS co, round(list_avg(e), 5) AS av, round(list_sum(e), 4) AS s FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def lists_more(t):
    x = c("embedding").cast(dtypes.list_(F64)).list
    return t.embeddings.select("vec_id", x.contains(x.get(4)).alias("co"), real(x.mean(), "av", 5), real(x.sum(), "s", 4))


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code, list_position(['5-LOW', '1-URGENT'], o_orderpriority)::BIGINT - 1 AS given FROM orders")
def categories(t):
    p = c("o_orderpriority").cast("categorical").cat
    return t.orders.select("o_orderkey", big(p.physical(), "code"), big(p.physical(categories=["5-LOW", "1-URGENT"]), "given"))


@query("SELECT count(DISTINCT o_orderpriority) AS n, min(o_orderpriority) AS f FROM orders")
def category_names(t):
    p = c("o_orderpriority").cat.categories().list
    return t.orders.select(big(p.len(), "n"), p.first().alias("f"))


@query("SELECT p_partkey, contains(p_name, 'ri') AS c, starts_with(p_name, 'small') AS s, ends_with(p_name, 'ring') AS e FROM part")
def binary_parts(t):
    b = c("p_name").cast("binary").bin
    return t.part.select("p_partkey", b.contains(lit(b"ri")).alias("c"), b.starts_with(lit(b"small")).alias("s"), b.ends_with(lit(b"ring")).alias("e"))


@query(
    "SELECT event_id, (epoch_us(ts) % 1000000) // 1000 AS ms, epoch_us(ts) % 1000000 AS us, epoch_us(ts) % 1000000 * 1000 AS ns, date_trunc('hour', ts + INTERVAL 30 MINUTE) AS r, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ny, "
    "ts + INTERVAL 10 HOUR AS base, ts + INTERVAL 1 HOUR AS dst, strftime(ts, '%H:%M:%S.%f') AS tm FROM events"
)
def datetimes_more(t):
    d, ts = c("ts").dt, c("ts")
    return t.events.select(
        "event_id", big(d.millisecond(), "ms"), big(d.microsecond(), "us"), big(d.nanosecond(), "ns"), d.round("1h").alias("r"), d.convert_time_zone("America/New_York").alias("ny"),
        (ts + d.base_utc_offset("Australia/Sydney")).alias("base"), (ts + d.dst_offset("Australia/Sydney")).alias("dst"), d.format("%H:%M:%S.%f").alias("tm"),
    )


@query(
    "SELECT p_partkey, len(regexp_extract_all(p_name, '[aeiou]')) AS xa, nullif(instr(p_name, 'l'), 0) - 1 AS fi, lpad(p_brand, 10, '.') AS ps, trim(p_name, 'gbs') AS st, ltrim(p_name, 'gbs') AS ss, rtrim(p_name, 'gbs') AS se, "
    "CASE WHEN starts_with(p_name, 'small ') THEN p_name[7:] ELSE p_name END AS sp, CASE WHEN ends_with(p_name, ' ring') THEN p_name[:-6] ELSE p_name END AS su, regexp_replace(p_name, 'l+', '_') AS re, regexp_replace(p_name, '([aeiou])', '<\\1>', 'g') AS rg, "
    "p_name AS ws, len(string_split(p_name, ' ')) AS sr FROM part"
)
def strings_more(t):
    n = c("p_name").str
    return t.part.select(
        "p_partkey", big(n.extract_all("[aeiou]").list.len(), "xa"), n.find("l", literal=True).alias("fi"), c("p_brand").str.pad_start(10, ".").alias("ps"), n.strip_chars("gbs").alias("st"), n.strip_chars_start("gbs").alias("ss"), n.strip_chars_end("gbs").alias("se"),
        n.strip_prefix("small ").alias("sp"), n.strip_suffix(" ring").alias("su"), n.replace("l+", "_").alias("re"), n.replace("([aeiou])", "<$1>", replace_all=True).alias("rg"),
        (lit(" \t") + c("p_name") + lit("\n ")).str.strip_chars().alias("ws"), big(n.split("\\s", regex=True).list.len(), "sr"),
    )


@query("SELECT o_orderkey, o_orderdate::DATE AS d, o_orderdate AS t, NULL::DATE AS bad FROM orders")
def string_times(t):
    d = c("o_orderdate").dt
    return t.orders.select("o_orderkey", d.format("%Y-%m-%d").str.to_date().alias("d"), d.format("%Y/%m/%d %H:%M:%S").str.to_datetime("%Y/%m/%d %H:%M:%S").alias("t"), c("o_orderpriority").str.to_date(strict=False).alias("bad"))


@query("SELECT event_id, strftime(ts, '%H:%M:%S') AS a, strftime(ts, '%H:%M') || ':00' AS b FROM events")
def times_of_day(t):
    t.spark.conf.set("spark.sql.timeType.enabled", "true")  # Spark has the type behind a setting
    d = c("ts").dt
    return t.events.select("event_id", d.truncate("1s").dt.time().cast("string").alias("a"), d.format("%H:%M").str.to_time("%H:%M").cast("string").alias("b"))


@query('SELECT n_nationkey, n_name AS f, n_nationkey AS a, n_name AS r, \'{"n_nationkey":\' || n_nationkey || \',"n_name":"\' || n_name || \'"}\' AS j FROM nation')
def structs(t):
    s = struct(c("n_nationkey"), c("n_name")).struct
    return t.nation.select("n_nationkey", s.field("n_name").alias("f"), s.field_at(0).alias("a"), s.rename_fields(["x", "y"]).struct.field("y").alias("r"), s.json_encode().alias("j"))


# ---------------------------------------------------------------- selectors


@query("SELECT p_partkey, p_name, p_size FROM part")
def selector_names(t):
    picked = (selectors.matches("^p_(size|name)$") | selectors.by_index(0)) - selectors.empty()
    return t.part.select((picked & selectors.all_()).as_expr())


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def selector_numeric(t):
    return t.customer.select((~(~selectors.numeric().as_selector() | selectors.by_name("c_name"))).as_expr())


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders")
def selector_kinds(t):
    s = selectors
    none = s.unsigned_integer() | s.enum() | s.categorical() | s.decimal() | s.nested() | s.struct() | s.list_() | s.array() | s.duration() | s.object_() | s.no_dtype()
    picked = (s.signed_integer() | s.datetime() | none | (s.temporal() & s.any_dtype())) - s.floating()
    return t.orders.select((picked & ~s.any_of([dtypes.flat("string")])).as_selector().as_expr())


@query("SELECT vec_id, label, len(embedding) AS n FROM embeddings")
def selector_lists(t):
    s = selectors
    rows = t.embeddings.select(s.integer().as_selector().as_expr(), (s.list_(s.floating()) | s.array(width=3)).as_selector().as_expr())
    return rows.select("vec_id", "label", big(c("embedding").list.len(), "n"))


# ---------------------------------------------------------------- joins and sets


@query("SELECT o_orderkey, c_name, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders JOIN customer ON o_custkey = c_custkey")
def join_checked_and_ordered(t):
    rows = t.orders.sort("o_orderkey").join(t.customer, left_on="o_custkey", right_on="c_custkey", validate="m:1", maintain_order="left", allow_parallel=True)
    return rows.select("o_orderkey", "c_name").with_row_number("i")


@query("SELECT n_nationkey::DOUBLE AS k, n_name AS s FROM nation UNION ALL SELECT s_acctbal, s_name FROM supplier")
def concat_relaxed(t):
    return concat([t.nation.select(c("n_nationkey").alias("k"), c("n_name").alias("s")), t.supplier.select(c("s_acctbal").alias("k"), c("s_name").alias("s"))], "vertical_relaxed")


@query("SELECT n_nationkey::DOUBLE AS k, n_name, NULL AS s_name FROM nation UNION ALL SELECT s_acctbal, NULL, s_name FROM supplier")
def concat_diagonal_relaxed(t):
    return concat([t.nation.select(c("n_nationkey").alias("k"), "n_name"), t.supplier.select(c("s_acctbal").alias("k"), "s_name")], "diagonal_relaxed")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation")
def sql_sets(t):
    ctx = SqlContext(t.spark).register_all({"cust": t.customer, "supp": t.supplier, "nat": t.nation, "other": t.region}).unregister("other")
    assert ctx.tables() == ["cust", "nat", "supp"]
    return ctx.execute("SELECT c_nationkey AS k FROM cust INTERSECT SELECT s_nationkey FROM supp UNION SELECT n_nationkey FROM nat")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7")
def tail_rows(t):
    rows = t.customer.sort("c_acctbal", "c_custkey", descending=[False, True])
    return rows.tail(7).select("c_custkey", "c_acctbal")


# ---------------------------------------------------------------- eager frames and columns


@query("SELECT n_nationkey AS k, upper(n_name) AS name FROM nation WHERE n_nationkey BETWEEN 5 AND 20 ORDER BY n_nationkey DESC LIMIT 6 OFFSET 2")
def eager_frame(t):
    e = t.nation.collect(engine="auto", predicate_pushdown=True)
    assert e.shape == (e.height, e.width) and e.columns == ["n_nationkey", "n_name", "n_regionkey"]
    e = e.sort("n_nationkey").reverse().filter(c("n_nationkey") >= 5, c("n_nationkey") <= 20).slice(2, 6)
    return e.with_columns(c("n_name").str.to_uppercase().alias("name")).drop("n_regionkey", "n_name").rename({"n_nationkey": "k"}).select("k", "name").drop_nulls().distinct().lazy()


@query("SELECT n_name FROM nation WHERE n_regionkey > 1")
def eager_mask(t):
    e = t.nation.collect()
    return e.filter_mask(e.column("n_regionkey") > 1).select_columns("n_name").lazy()


@query("SELECT n_nationkey, w, name, value FROM (SELECT n_nationkey, unnest(string_split(n_name, '_')) AS w, n_regionkey AS a, n_nationkey AS b FROM nation) UNPIVOT (value FOR name IN (a, b))")
def eager_shapes(t):
    e = t.nation.select("n_nationkey", c("n_name").str.split("_").alias("w"), struct(c("n_regionkey").alias("a"), c("n_nationkey").alias("b")).alias("s")).collect()
    return e.explode("w").unnest("s").unpivot(on=["a", "b"], index=["n_nationkey", "w"], variable_name="name").lazy()


@query("SELECT 'n_nationkey' AS name, 0::DOUBLE AS column_0, 1::DOUBLE AS column_1, 2::DOUBLE AS column_2 UNION ALL SELECT 'half', 0, 0.5, 1")
def eager_transpose(t):
    e = t.nation.sort("n_nationkey").head(3).select("n_nationkey", (c("n_nationkey") / lit(2.0)).alias("half")).collect()
    return e.transpose(include_header=True, header_name="name").lazy()


@query("SELECT x FROM (SELECT n_nationkey::BIGINT * 2 + 1 AS x FROM nation) WHERE x > 9 UNION ALL SELECT 0 UNION ALL SELECT 24 UNION ALL SELECT 23")
def columns_of_values(t):
    e = t.nation.sort("n_nationkey").collect()
    s = e.column("n_nationkey").rename("x").cast("int64")
    made = (s * 2 + 1).drop_nulls()
    made = made.filter(made > 9).sort(descending=True).reverse()
    return made.append(s.gather([0, -1])).append(s.reverse().slice(1, 1)).to_frame().lazy()


@query("SELECT count(*)::DOUBLE AS v, 'count' AS k FROM nation UNION ALL SELECT count(DISTINCT n_regionkey), 'n_unique' FROM nation UNION ALL SELECT sum(n_regionkey), 'sum' FROM nation UNION ALL SELECT avg(n_regionkey), 'mean' FROM nation UNION ALL SELECT min(n_regionkey), 'min' FROM nation UNION ALL SELECT max(n_regionkey), 'max' FROM nation UNION ALL SELECT count(DISTINCT n_regionkey), 'unique' FROM nation")
def column_aggregates(t):
    s = t.nation.collect().column("n_regionkey")
    made = [(float(getattr(s, k)()), k) for k in ("count", "n_unique", "sum", "mean", "min", "max")] + [(float(len(s.unique())), "unique")]
    assert s.info()["length"] == s.count() and s.null_count == 0
    return LazyFrame(t.spark.createDataFrame(made, "v double, k string"))


# ---------------------------------------------------------------- running


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def background_job(t):
    rows = t.orders.filter(c("o_totalprice") > 100000).select("o_orderkey", "o_totalprice")
    assert "Filter" in rows.explain() and rows.schema.names == ["o_orderkey", "o_totalprice"]
    job = rows.submit()
    job.wait()
    assert job.poll() == "complete"
    return job.take().lazy()


@query("SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderdate FROM orders")
def pulled_batches(t):
    import pyarrow as pa

    got = list(t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate").batches(batch_rows=1000, capacity=2))
    assert all(b.num_rows == 1000 for b in got[:-1])
    return DataFrame.from_arrow(t.spark, pa.Table.from_batches(got)).lazy()


# ---------------------------------------------------------------- sources and sinks


def _folder(t) -> str:
    """A new folder that the driver and all executors share."""
    root = t.spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="skein-io-")
    return f"{root.rstrip('/')}/skein-io-{uuid.uuid4().hex[:12]}"


def _local(path: str) -> str:
    return path.removeprefix("file://")


_ROWS = "SELECT o_orderkey, o_totalprice, nullif(o_orderpriority, '5-LOW') AS p FROM orders"


def _rows(t):
    p = when(c("o_orderpriority") != "5-LOW").then(c("o_orderpriority")).otherwise(lit(None, dtypes.flat("string")))
    return t.orders.select("o_orderkey", "o_totalprice", p.alias("p"))


@query(_ROWS)
def parquet_files(t):
    path = _folder(t)
    _rows(t).sink_parquet(path, compression="zstd", statistics=True)
    return scan_parquet(t.spark, path)


@query(_ROWS)
def csv_files(t):
    path = _folder(t)
    _rows(t).sink_csv(path, separator=";")
    return scan_csv(t.spark, path, separator=";")


@query("SELECT o_orderkey, 'a' || chr(10) || '\"b\", ' || o_orderpriority AS s FROM orders")
def csv_quoted_lines(t):
    path = _folder(t)
    t.orders.select("o_orderkey", (lit('a\n"b", ') + c("o_orderpriority")).alias("s")).sink_csv(path)
    return scan_csv(t.spark, path)


@query("SELECT o_orderkey AS column_1, o_totalprice AS column_2 FROM orders")
def csv_without_header(t):
    path = _folder(t)
    t.orders.select("o_orderkey", "o_totalprice").sink_csv(path, include_header=False)
    return scan_csv(t.spark, path, has_header=False)


@query(_ROWS)
def ndjson_files(t):
    path = _folder(t)
    _rows(t).sink_ndjson(path)
    return scan_ndjson(t.spark, path).select("o_orderkey", "o_totalprice", "p")


@query(_ROWS)
def ipc_files(t):
    path = _folder(t)
    _rows(t).sink_ipc(path, compression="zstd")
    return scan_ipc(t.spark, path)


@query("SELECT n_nationkey, n_name FROM nation")
def ipc_stream_and_json(t):
    path = _local(_folder(t))
    e = t.nation.select("n_nationkey", "n_name").collect()
    e.write_ipc_stream(path + ".arrows")
    again = read_ipc_stream(t.spark, path + ".arrows")
    again.write_json(path + ".json")
    return read_json(t.spark, "file://" + path + ".json").lazy().select(c("n_nationkey").cast("int32"), "n_name")
