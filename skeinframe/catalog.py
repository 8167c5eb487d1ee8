"""The query catalogue: each query with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


from . import SqlContext, coalesce, concat, dtypes, lit, scan_parquet, selectors, when
from . import col as c
from .operators.frame import LazyFrame
from .operators.joins import range_join

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """``t.orders`` scans a table of the folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> LazyFrame:
        return scan_parquet(self.spark, f"{self._dir}/{name}.parquet")


def query(sql: str | None):
    """Registers ``f(tables) -> LazyFrame`` under its name, with its SQL if there is one."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir)).to_spark()
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


def big(e, name: str):
    return e.cast("int64").alias(name)


def real(e, name: str, digits: int = 6):
    return (e.cast("float64") * lit(1.0)).round(digits, "half_away_from_zero").alias(name)


_EV = "(SELECT event_id, user_id, event_type, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events)"


def _gaps(t: Tables) -> LazyFrame:
    """events with nulls in v."""
    return t.events.select("event_id", "user_id", "event_type", "ts", when(c("event_id") % 7 != 0).then(c("value")).otherwise(lit(None, dtypes.flat("float64"))).alias("v"))


# ---------------------------------------------------------------- projection and filter


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'R'")
def filter_project(t):
    return t.lineitem.filter(c("l_quantity") > 25, c("l_returnflag") == "R").select("l_orderkey", "l_linenumber", (c("l_extendedprice") * (lit(1.0) - c("l_discount"))).alias("net"))


@query("SELECT o_orderkey, o_totalprice AS price, CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'low' END AS band, o_totalprice + 1 AS next FROM orders")
def with_columns_parallel(t):
    new = t.orders.with_columns(c("o_totalprice").alias("price"), band=when(c("o_totalprice") > 100000).then(lit("high")).otherwise(lit("low")), next=c("o_totalprice") + lit(1.0))
    return new.select("o_orderkey", "price", "band", "next")


@query("SELECT n_name AS nation, n_regionkey FROM nation")
def drop_rename(t):
    return t.nation.drop("n_nationkey").rename({"n_name": "nation"})


@query(f"SELECT event_id, v FROM {_EV} WHERE v IS NOT NULL")
def drop_nulls(t):
    return _gaps(t).drop_nulls("v").select("event_id", "v")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def is_in_literals(t):
    return t.orders.filter(c("o_orderpriority").is_in(["1-URGENT", "2-HIGH"])).select("o_orderkey")


@query("SELECT CAST(l_quantity AS BIGINT) AS q, TRY_CAST(l_returnflag AS BIGINT) AS flag, CAST(l_linenumber AS VARCHAR) AS n FROM lineitem")
def casts(t):
    return t.lineitem.select(c("l_quantity").cast("int64").alias("q"), c("l_returnflag").cast("int64", strict=False).alias("flag"), c("l_linenumber").cast("string").alias("n"))


@query("SELECT p_partkey, p_size, (SELECT avg(p_size) FROM part) AS mean_size FROM part")
def select_mixed_aggregate(t):
    return t.part.select("p_partkey", "p_size", c("p_size").mean().alias("mean_size"))


@query("SELECT p_partkey, CAST(floor(p_size / 7.0) AS BIGINT) AS fl, p_size - 7 * CAST(floor(p_size / 7.0) AS INTEGER) AS md, p_size / 7.0::DOUBLE AS dv, p_size & 5 AS ba, p_size | 5 AS bo, xor(p_size, 5) AS bx FROM part")
def arithmetic(t):
    i = lambda n: lit(n, dtypes.flat("int32"))
    p = c("p_size")
    return t.part.select("p_partkey", (p // i(7)).cast("int64").alias("fl"), (p % i(7)).alias("md"), (p / i(7)).alias("dv"), (p & i(5)).alias("ba"), (p | i(5)).alias("bo"), (p ^ i(5)).alias("bx"))


@query(f"SELECT event_id, coalesce(v, -1) AS filled, v IS NULL AS missing, v IS NOT DISTINCT FROM NULL AS same, coalesce(v, user_id::DOUBLE) AS either FROM {_EV}")
def nulls(t):
    v = c("v")
    return _gaps(t).select("event_id", v.fill_null(lit(-1.0)).alias("filled"), v.is_null().alias("missing"), v.eq_missing(lit(None, dtypes.flat("float64"))).alias("same"), coalesce(v, c("user_id").cast("float64")).alias("either"))


@query("SELECT event_id, floor(value) AS fl, ceil(value) AS ce, abs(-value) AS ab, trunc(value) AS tz, greatest(least(value, 50.0), 10.0) AS cl FROM events")
def rounding(t):
    v = c("value")
    return t.events.select("event_id", v.floor().alias("fl"), v.ceil().alias("ce"), (-v).abs().alias("ab"), v.round(0, "to_zero").alias("tz"), v.clip(lit(10.0), lit(50.0)).alias("cl"))


@query(
    "SELECT p_partkey, round(sqrt(p_size), 6) AS a1, round(cbrt(p_size), 6) AS a2, round(ln(1 + p_size), 6) AS a3, round(exp(p_size / 50.0), 6) AS a4, round(sin(p_size), 6) AS a5, round(cos(p_size), 6) AS a6, "
    "round(tan(p_size), 6) AS a7, round(atan(p_size), 6) AS a8, round(degrees(p_size), 6) AS a9, round(radians(p_size), 6) AS b1, round(ln(p_size) / ln(3), 6) AS b2, round(power(p_size, 1.5), 6) AS b3, "
    "round(atan2(p_size, 3), 6) AS b4, round(tanh(p_size / 50.0), 6) AS b5, round(asinh(p_size), 6) AS b6 FROM part"
)
def math_functions(t):
    x = c("p_size").cast("float64")
    small = x / lit(50.0)
    made = [x.sqrt(), x.cbrt(), x.log1p(), small.exp(), x.sin(), x.cos(), x.tan(), x.atan(), x.degrees(), x.radians(), x.log(lit(3.0)), x.pow(lit(1.5)), x.atan2(lit(3.0)), small.tanh(), x.asinh()]
    names = ["a1", "a2", "a3", "a4", "a5", "a6", "a7", "a8", "a9", "b1", "b2", "b3", "b4", "b5", "b6"]
    return t.part.select("p_partkey", *[real(e, n) for e, n in zip(made, names, strict=True)])


# ---------------------------------------------------------------- joins


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(t):
    return t.orders.join(t.customer, left_on="o_custkey", right_on="c_custkey").select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def join_left(t):
    return t.customer.join(t.orders, left_on="c_custkey", right_on="o_custkey", how="left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
def join_right(t):
    return t.orders.join(t.customer, left_on="o_custkey", right_on="c_custkey", how="right", coalesce=False).select("c_custkey", "o_orderkey")


@query("SELECT coalesce(n_regionkey, r_regionkey) AS n_regionkey, n_name, r_name FROM nation FULL JOIN (SELECT * FROM region WHERE r_regionkey > 1) ON n_regionkey = r_regionkey")
def join_full_coalesce(t):
    return t.nation.join(t.region.filter(c("r_regionkey") > 1), left_on="n_regionkey", right_on="r_regionkey", how="full", coalesce=True).select("n_regionkey", "n_name", "r_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def join_semi(t):
    return t.customer.join(t.orders, left_on="c_custkey", right_on="o_custkey", how="semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_anti(t):
    return t.customer.join(t.orders, left_on="c_custkey", right_on="o_custkey", how="anti").select("c_custkey")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(t):
    return t.nation.join(t.region, how="cross").select("n_name", "r_name")


@query("SELECT a.n_nationkey, b.n_nationkey AS n_nationkey_right FROM (SELECT n_nationkey, nullif(n_regionkey, 1) AS k FROM nation) a JOIN (SELECT n_nationkey, nullif(n_regionkey, 1) AS k FROM nation) b ON a.k IS NOT DISTINCT FROM b.k")
def join_nulls_equal(t):
    one = t.nation.select("n_nationkey", when(c("n_regionkey") == 1).then(lit(None, dtypes.flat("int32"))).otherwise(c("n_regionkey")).alias("k"))
    return one.join(one, on="k", nulls_equal=True, validate="m:m").select("n_nationkey", "n_nationkey_right")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal")
def join_where(t):
    return t.customer.join_where(t.supplier, c("c_nationkey") == c("s_nationkey"), c("c_acctbal") < c("s_acctbal")).select("c_custkey", "s_suppkey")


@query("SELECT o_orderkey, lo FROM orders JOIN (SELECT c_custkey * 100.0::DOUBLE AS lo, c_custkey * 100.0::DOUBLE + 250.0 AS hi FROM customer) ON o_totalprice >= lo AND o_totalprice < hi")
def join_range_buckets(t):
    spans = t.customer.select((c("c_custkey") * lit(100.0)).alias("lo"), (c("c_custkey") * lit(100.0) + lit(250.0)).alias("hi"))
    return range_join(t.orders, spans, "o_totalprice", "lo", "hi", 250.0).select("o_orderkey", "lo")


_ASOF_R = "(SELECT ts, max(value) AS rv, user_id FROM events WHERE event_type = 'click' GROUP BY user_id, ts)"


def _clicks(t):
    return t.events.filter(c("event_type") == "click").group_by("user_id", "ts").agg(c("value").max().alias("rv"))


@query(f"SELECT e.event_id, r.rv FROM events e ASOF LEFT JOIN {_ASOF_R} r ON e.user_id = r.user_id AND e.ts >= r.ts")
def join_asof_backward(t):
    return t.events.join_asof(_clicks(t), on="ts", by="user_id").select("event_id", "rv")


@query(f"SELECT e.event_id, r.rv FROM events e ASOF LEFT JOIN {_ASOF_R} r ON e.user_id = r.user_id AND e.ts <= r.ts")
def join_asof_forward(t):
    return t.events.join_asof(_clicks(t), on="ts", by="user_id", strategy="forward").select("event_id", "rv")


@query(
    f"SELECT event_id, arg_min(rv, d) AS rv FROM (SELECT e.event_id, r.rv, abs(epoch_us(e.ts) - epoch_us(r.ts)) * 2 + CASE WHEN r.ts > e.ts THEN 1 ELSE 0 END AS d FROM events e JOIN {_ASOF_R} r USING (user_id) WHERE abs(epoch_us(e.ts) - epoch_us(r.ts)) <= 7200000000) GROUP BY event_id"
)
def join_asof_nearest(t):
    return t.events.join_asof(_clicks(t), on="ts", by="user_id", strategy="nearest", tolerance="2h").select("event_id", "rv").drop_nulls("rv")


# ---------------------------------------------------------------- aggregation


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS lo, max(l_discount) AS hi, count(*) AS n, count(l_tax) AS n_tax FROM lineitem GROUP BY ALL")
def agg_basic(t):
    from . import len_

    return t.lineitem.group_by("l_returnflag", "l_linestatus").agg(
        real(c("l_quantity").sum(), "sum_qty", 4), real(c("l_extendedprice").mean(), "avg_price", 4), c("l_discount").min().alias("lo"), c("l_discount").max().alias("hi"), len_().alias("n"), c("l_tax").count().alias("n_tax")
    )


@query("SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 6) AS va, round(stddev_pop(l_quantity), 6) AS sd0, round(median(l_quantity), 6) AS md FROM lineitem GROUP BY 1")
def agg_spread(t):
    q = c("l_quantity")
    return t.lineitem.group_by("l_returnflag").agg(real(q.std(), "sd"), real(q.variance(), "va"), real(q.std(ddof=0), "sd0"), real(q.median(), "md"))


@query("SELECT l_returnflag, quantile_cont(l_extendedprice, 0.3) AS q FROM lineitem GROUP BY 1")
def agg_quantile(t):
    return t.lineitem.group_by("l_returnflag").agg(c("l_extendedprice").quantile(0.3).alias("q"))


@query(f"SELECT event_type, count(DISTINCT user_id) AS users, count(*) FILTER (v IS NULL) AS missing, count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS values FROM {_EV} GROUP BY 1")
def agg_distinct(t):
    return _gaps(t).group_by("event_type").agg(c("user_id").n_unique().alias("users"), c("v").null_count().alias("missing"), c("v").n_unique().alias("values"))


@query("SELECT user_id, arg_min(value, event_id) AS f, arg_max(value, event_id) AS l, bool_or(value > 90) AS an, bool_and(value > 1) AS al FROM events GROUP BY 1")
def agg_first_last(t):
    rows = t.events.sort("event_id")
    v = c("value")
    return rows.group_by("user_id").agg(v.first().alias("f"), v.last().alias("l"), (v > 90).any().alias("an"), (v > 1).all().alias("al"))


@query("SELECT event_type, round(skewness(value) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)), 5) AS sk, round(kurtosis_pop(value), 5) AS ku FROM events GROUP BY 1")
def agg_moments(t):
    return t.events.group_by("event_type").agg(real(c("value").skew(), "sk", 5), real(c("value").kurtosis(), "ku", 5))


@query("SELECT user_id, arg_min(i, struct_pack(v := value, i := i)) AS lo, arg_max(i, struct_pack(v := value, i := -i)) AS hi FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) GROUP BY 1")
def agg_arg_min_max(t):
    return t.events.sort("event_id").group_by("user_id").agg(c("value").arg_min().alias("lo"), c("value").arg_max().alias("hi"))


@query("SELECT n_regionkey, product(n_nationkey + 1)::BIGINT AS pr FROM nation GROUP BY 1")
def agg_product(t):
    return t.nation.group_by("n_regionkey").agg((c("n_nationkey") + 1).product().alias("pr"))


# ---------------------------------------------------------------- windows and ordered functions


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id), 6) AS s, count(*) OVER (PARTITION BY user_id) AS n FROM events")
def over_partition(t):
    from . import len_

    return t.events.select("event_id", real(c("value").sum().over("user_id"), "s"), len_().over("user_id").alias("n"))


@query(
    "SELECT p_partkey, dense_rank() OVER w AS rd, rank() OVER w AS rmin, rank() OVER w + count(*) OVER (PARTITION BY p_brand, p_size) - 1 AS rmax, rank() OVER w + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS ravg, "
    "row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS ro FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)"
)
def rank_methods(t):
    r = lambda m: c("p_size").rank(m).over("p_brand", "p_partkey")
    return t.part.select("p_partkey", r("dense").alias("rd"), r("min").alias("rmin"), r("max").alias("rmax"), r("average").alias("ravg"), r("ordinal").alias("ro"))


@query("SELECT event_id, lag(value, 1) OVER w AS s1, lead(value, 2) OVER w AS s2, value - lag(value, 1) OVER w AS d, round(value / nullif(lag(value, 1) OVER w, 0) - 1, 6) AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def shift_diff_pct(t):
    o = lambda e: e.over("user_id", "event_id")
    v = c("value")
    rows = t.events.select("event_id", o(v.shift(1)).alias("s1"), o(v.shift(-2)).alias("s2"), o(v.diff()).alias("d"), o(v.pct_change()).alias("p"))
    change = when(c("s1") != 0).then(c("p")).otherwise(lit(None, dtypes.flat("float64")))  # from zero the SQL has none
    return rows.select("event_id", "s1", "s2", "d", real(change, "p"))


@query(f"SELECT event_id, CASE WHEN v IS NOT NULL THEN round(sum(v) OVER w, 6) END AS cs, CASE WHEN v IS NOT NULL THEN min(v) OVER w END AS mi, CASE WHEN v IS NOT NULL THEN max(v) OVER w END AS ma FROM {_EV} WINDOW w AS (ORDER BY event_id)")
def cumulative_whole_frame(t):
    v = c("v")
    return _gaps(t).sort("event_id").select("event_id", real(v.cum_sum(), "cs"), v.cum_min().alias("mi"), v.cum_max().alias("ma"))


@query(f"SELECT event_id, CASE WHEN v IS NOT NULL THEN round(sum(v) OVER (PARTITION BY user_id ORDER BY event_id DESC), 6) END AS cs FROM {_EV}")
def cumulative_reverse(t):
    return _gaps(t).select("event_id", real(c("v").cum_sum().over("user_id", "event_id", descending=True), "cs"))


@query(
    "SELECT event_id, CASE WHEN n >= 2 THEN round(sm, 6) END AS sm, CASE WHEN n >= 2 THEN round(av, 6) END AS av, CASE WHEN n >= 2 THEN mi END AS mi, CASE WHEN n >= 2 THEN ma END AS ma, CASE WHEN n >= 2 THEN round(md, 6) END AS md, CASE WHEN n >= 2 THEN round(sd, 6) END AS sd "
    f"FROM (SELECT event_id, count(v) OVER w AS n, sum(v) OVER w AS sm, avg(v) OVER w AS av, min(v) OVER w AS mi, max(v) OVER w AS ma, median(v) OVER w AS md, stddev_samp(v) OVER w AS sd FROM {_EV} WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"
)
def rolling_rows(t):
    o = lambda e: e.over("user_id", "event_id")
    v, k = c("v"), {"min_periods": 2}
    return _gaps(t).select(
        "event_id", real(o(v.rolling_sum(4, **k)), "sm"), real(o(v.rolling_mean(4, **k)), "av"), o(v.rolling_min(4, **k)).alias("mi"), o(v.rolling_max(4, **k)).alias("ma"), real(o(v.rolling_median(4, **k)), "md"), real(o(v.rolling_std(4, **k)), "sd")
    )


@query(
    "SELECT event_id, round(coalesce(v, a.v0 + (b.v1 - a.v0) * (i - a.i0) / (b.i1 - a.i0)), 6) AS x FROM (SELECT event_id, v, i, "
    "last_value(CASE WHEN v IS NOT NULL THEN struct_pack(v0 := v, i0 := i) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i) AS a, first_value(CASE WHEN v IS NOT NULL THEN struct_pack(v1 := v, i1 := i) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b "
    f"FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM {_EV}))"
)
def interpolate_linear(t):
    return _gaps(t).select("event_id", real(c("v").interpolate().over("user_id", "event_id"), "x"))


@query("SELECT date_trunc('day', ts) AS ts, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY 1")
def group_dynamic_day(t):
    from . import len_

    return t.events.group_by_dynamic("ts", "1d").agg(len_().alias("n"), real(c("value").sum(), "s", 4))


@query("SELECT date_trunc('week', ts) AS ts, event_type, count(*) AS n FROM events GROUP BY ALL")
def group_dynamic_week(t):
    from . import len_

    return t.events.group_by_dynamic("ts", "1w", by="event_type").agg(len_().alias("n")).select("ts", "event_type", "n")


@query("SELECT date_trunc('month', ts) AS ts, count(*) AS n FROM events GROUP BY 1")
def group_dynamic_month(t):
    from . import len_

    return t.events.group_by_dynamic("ts", "1mo").agg(len_().alias("n"))


@query("SELECT to_timestamp(w * 3600)::TIMESTAMP AS ts, count(*) AS n FROM (SELECT epoch_us(ts) AS t, unnest(range(floor(epoch_us(ts) / 3600000000.0)::BIGINT - 2, floor(epoch_us(ts) / 3600000000.0)::BIGINT + 1)) AS w FROM events) WHERE t >= w * 3600000000 AND t < (w + 2) * 3600000000 GROUP BY 1")
def group_dynamic_hopping(t):
    from . import len_

    return t.events.group_by_dynamic("ts", "1h", period="2h").agg(len_().alias("n"))


@query("SELECT event_id, round(s, 6) AS s, n FROM (SELECT event_id, sum(value) OVER w AS s, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7199999999 MICROSECONDS PRECEDING AND CURRENT ROW))")
def group_rolling(t):
    from . import len_

    rows = t.events.group_by_rolling("ts", "2h", by="user_id").agg(real(c("value").sum(), "s"), len_().alias("n"), c("event_id").last().alias("e"))
    return LazyFrame(t.events._plain.join(rows._plain.select("user_id", "ts", "s", "n").distinct(), ["user_id", "ts"]).select("event_id", "s", "n"))


# ---------------------------------------------------------------- order, distinct, sets, shape


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(t):
    return t.orders.sort("o_totalprice", "o_orderkey", descending=[True, False]).head(20).select("o_orderkey", "o_totalprice")


@query("SELECT v, row_number() OVER (ORDER BY v ASC NULLS LAST, event_id) - 1 AS i FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events)")
def sort_nulls_last(t):
    return _gaps(t).sort("v", "event_id", nulls_last=True).select("v").with_row_number("i")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 3 OFFSET 20")
def slice_negative(t):
    return t.nation.sort("n_nationkey").slice(-5, 3).select("n_nationkey", "n_name")


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def distinct_last(t):
    return t.events.sort("event_id").distinct("user_id", keep="last").select("user_id", "event_id")


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1 HAVING count(*) = 1")
def distinct_none(t):
    return t.events.distinct("user_id", keep="none").select("user_id", "event_id")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_any(t):
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct(keep="any")


@query("SELECT s_suppkey AS k, s_nationkey AS n FROM supplier UNION ALL SELECT c_custkey, c_nationkey FROM customer")
def concat_vertical(t):
    return concat([t.supplier.select(c("s_suppkey").alias("k"), c("s_nationkey").alias("n")), t.customer.select(c("c_custkey").alias("k"), c("c_nationkey").alias("n"))])


@query("SELECT n_nationkey, n_name, NULL::VARCHAR AS r_name FROM nation UNION ALL SELECT NULL, NULL, r_name FROM region")
def concat_diagonal(t):
    return concat([t.nation.select("n_nationkey", "n_name"), t.region.select("r_name")], "diagonal")


@query("SELECT a.n_name, b.r_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) a LEFT JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) b USING (i)")
def concat_horizontal(t):
    return concat([t.nation.sort("n_nationkey").select("n_name"), t.region.sort("r_regionkey").select("r_name")], "horizontal")


@query("SELECT vec_id, unnest(embedding)::DOUBLE AS e FROM embeddings")
def explode_list(t):
    return t.embeddings.select("vec_id", c("embedding").alias("e")).explode("e").select("vec_id", c("e").cast("float64"))


@query("UNPIVOT (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) ON l_discount, l_tax INTO NAME variable VALUE value")
def unpivot(t):
    return t.lineitem.unpivot(on=["l_discount", "l_tax"], index=["l_orderkey", "l_linenumber"])


@query("SELECT n_nationkey, n_name FROM nation")
def unnest_struct(t):
    from . import struct

    return t.nation.select(struct(c("n_nationkey"), c("n_name")).alias("s")).unnest("s")


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 EXCEPT SELECT s_nationkey, count(*) FROM supplier GROUP BY 1")
def sql_context(t):
    ctx = SqlContext(t.spark).register_all({"cust": t.customer, "supp": t.supplier})
    return ctx.execute("SELECT c_nationkey, count(*) AS n FROM cust GROUP BY 1 EXCEPT SELECT s_nationkey, count(*) FROM supp GROUP BY 1")


@query("SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def selector_floats(t):
    return t.lineitem.select(selectors.floating().as_selector().as_expr())


# ---------------------------------------------------------------- namespaces


@query(
    "SELECT p_partkey, strlen(p_name) AS lb, length(p_name) AS lc, upper(p_name) AS u, lower(p_brand) AS l, contains(p_type, 'A') AS ct, starts_with(p_brand, 'Brand') AS sw, ends_with(p_name, 'e') AS ew, nullif(regexp_extract(p_brand, '([0-9]+)', 1), '') AS ex, "
    "replace(p_name, 'a', '_') AS ra, left(p_name, 3) AS hd, right(p_name, 2) AS tl, lpad(p_size::VARCHAR, 4, '0') AS zf, rpad(left(p_brand, 3), 5, '*') AS pe, substring(p_name, 2, 3) AS sl, len(string_split(p_name, ' ')) AS sp FROM part"
)
def strings(t):
    n, b = c("p_name").str, c("p_brand").str
    return t.part.select(
        "p_partkey", big(n.len_bytes(), "lb"), big(n.len_chars(), "lc"), n.to_uppercase().alias("u"), b.to_lowercase().alias("l"), c("p_type").str.contains("A", literal=True).alias("ct"), b.starts_with("Brand").alias("sw"), n.ends_with("e").alias("ew"), b.extract("([0-9]+)").alias("ex"),
        n.replace("a", "_", literal=True, replace_all=True).alias("ra"), n.head(3).alias("hd"), n.tail(2).alias("tl"), c("p_size").cast("string").str.zfill(4).alias("zf"), b.head(3).str.pad_end(5, "*").alias("pe"), n.slice(1, 3).alias("sl"), n.split(" ").list.len().cast("int64").alias("sp"),
    )


@query(
    "SELECT event_id, year(ts) AS y, isoyear(ts) AS iy, month(ts) AS m, day(ts) AS d, dayofyear(ts) AS doy, isodow(ts) AS wd, weekofyear(ts) AS w, quarter(ts) AS q, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, epoch_us(ts) AS us, "
    "ts::DATE AS dt, strftime(ts, '%Y/%m/%d %H') AS f, date_trunc('hour', ts) AS th, date_trunc('month', ts)::TIMESTAMP AS tm, ts + INTERVAL 36 HOUR AS ob FROM events"
)
def datetimes(t):
    d = c("ts").dt
    return t.events.select(
        "event_id", *[big(getattr(d, f)(), n) for f, n in (("year", "y"), ("iso_year", "iy"), ("month", "m"), ("day", "d"), ("ordinal_day", "doy"), ("weekday", "wd"), ("week", "w"), ("quarter", "q"), ("hour", "h"), ("minute", "mi"), ("second", "s"), ("timestamp", "us"))],
        d.date().alias("dt"), d.format("%Y/%m/%d %H").alias("f"), d.truncate("1h").alias("th"), d.truncate("1mo").alias("tm"), d.offset_by("36h").alias("ob"),
    )


@query("SELECT vec_id, len(embedding) AS n, embedding[1]::DOUBLE AS f, embedding[-1]::DOUBLE AS l, list_min(embedding)::DOUBLE AS mi, list_max(embedding)::DOUBLE AS ma, len(embedding[2:4]) AS sl, list_sort(embedding)[1]::DOUBLE AS so FROM embeddings")
def lists(t):
    x = c("embedding").list
    return t.embeddings.select(
        "vec_id", big(x.len(), "n"), x.first().cast("float64").alias("f"), x.last().cast("float64").alias("l"), x.min().cast("float64").alias("mi"), x.max().cast("float64").alias("ma"), big(x.slice(1, 3).list.len(), "sl"), x.sort().list.get(0).cast("float64").alias("so")
    )


@query("SELECT p_partkey, octet_length(encode(p_name)) AS n, lower(hex(encode(p_name))) AS hx, base64(encode(p_name)) AS b64 FROM part")
def binary(t):
    b = c("p_name").cast("binary").bin
    return t.part.select("p_partkey", big(b.size_bytes(), "n"), b.hex_encode().alias("hx"), b.base64_encode().alias("b64"))


# ---------------------------------------------------------------- composites


@query(
    "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey "
    "WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1996-03-15' AND l_shipdate > TIMESTAMP '1996-03-15' GROUP BY l_orderkey, o_orderdate"
)
def shipping_priority(t):
    import datetime

    day = lit(datetime.datetime(1996, 3, 15), dtypes.datetime())
    rows = t.customer.filter(c("c_mktsegment") == "BUILDING").join(t.orders.filter(c("o_orderdate") < day), left_on="c_custkey", right_on="o_custkey")
    rows = rows.join(t.lineitem.filter(c("l_shipdate") > day), left_on="o_orderkey", right_on="l_orderkey")
    revenue = (c("l_extendedprice") * (lit(1.0) - c("l_discount"))).sum()
    return rows.group_by(c("o_orderkey").alias("l_orderkey"), "o_orderdate").agg(real(revenue, "revenue", 4)).select("l_orderkey", "revenue", "o_orderdate")


@query(
    "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 3) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey "
    "JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name"
)
def local_supplier_volume(t):
    nations = t.nation.join(t.region.filter(c("r_name") == "ASIA"), left_on="n_regionkey", right_on="r_regionkey")
    supplied = t.supplier.join(nations, left_on="s_nationkey", right_on="n_nationkey")
    rows = t.customer.join(t.orders, left_on="c_custkey", right_on="o_custkey").join(t.lineitem, left_on="o_orderkey", right_on="l_orderkey")
    rows = rows.join(supplied, left_on=["l_suppkey", "c_nationkey"], right_on=["s_suppkey", "s_nationkey"])
    return rows.group_by("n_name").agg(real((c("l_extendedprice") * (lit(1.0) - c("l_discount"))).sum(), "revenue", 3))


@query("SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.06 AND l_quantity < 24")
def forecast_revenue(t):
    rows = t.lineitem.filter(c("l_discount") >= 0.02, c("l_discount") <= 0.06, c("l_quantity") < 24)
    return rows.select(real((c("l_extendedprice") * c("l_discount")).sum(), "revenue", 4))




from . import catalog_more  # noqa: E402, F401  (registers the rest)
