"""Semantic goldens, and the catalogue against DuckDB."""

import math

import duckdb
import pyarrow as pa
import pytest

import skeinframe as sk
from skeinframe import catalog, col, dtypes, lit, selectors, when
from skeinframe.errors import InvalidRequest

DATA = "/root/testdata/sf0.001"
I32 = dtypes.flat("int32")


@pytest.fixture
def make(spark):
    return lambda **columns: sk.DataFrame.from_arrow(spark, pa.table({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()}))


def i32(*v):
    return pa.array(v, pa.int32())


def values(frame, name):
    return [r[name] for r in frame.to_dicts()] if hasattr(frame, "to_dicts") else [r[name] for r in frame.collect().to_dicts()]


def test_filter_double_sort(make):
    f = make(group=["a", "a", "b", None], value=i32(1, 2, 3, 4)).lazy()
    out = f.filter(col("value") > 1).with_columns(col("value") * 2).sort("value", descending=True)
    assert values(out, "value") == [8, 6, 4]
    assert f.group_by("group").agg(col("value").sum()).collect().height == 3
    assert f.drop_nulls("group").join(f.drop_nulls("group").select("group", col("value").alias("v")), on="group").collect().height == 5


def test_true_division(make):
    out = make(value=i32(3, 4)).lazy().select(col("value") / lit(2, I32))
    assert values(out, "value") == [1.5, 2.0]


def test_cleaning(make):
    f = make(group=["a", "a", "b"], value=i32(1, None, 3), fallback=i32(9, 2, 3), members=i32(1, 2, 8), text=[" Ab.c ", "abc", None]).lazy()
    v = col("value")
    out = f.select(
        v.fill_null(lit(0, I32)).alias("filled"), v.coalesce(col("fallback")).alias("either"), v.is_in(col("members")).alias("member"), col("text").str.strip_chars().str.to_lowercase().alias("low"),
        col("text").str.contains(".", literal=True).alias("dot"), v.sum().over("group").alias("total"), v.shift(1).alias("before"), v.cum_sum().alias("run"),
    )
    rows = out.collect().to_arrow().to_pydict()
    assert rows["filled"] == [1, 0, 3] and rows["either"] == [1, 2, 3] and rows["member"] == [True, None, False]
    assert rows["low"] == ["ab.c", "abc", None] and rows["dot"] == [True, False, None]
    assert rows["total"] == [1, 1, 3] and rows["before"] == [None, 1, None] and rows["run"] == [1, None, 4]


def test_join_where_inequality_only(make):
    left, right = make(a=i32(1, 5, 9, None)).lazy(), make(b=i32(0, 5, 7, None)).lazy()
    rows = left.join_where(right, col("a") < col("b")).collect().to_dicts()
    assert sorted((r["a"], r["b"]) for r in rows) == [(1, 5), (1, 7), (5, 7)]


def test_explode_whole_table(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").selectExpr("sum(size(embedding)) AS n").first()
    assert catalog.QUERIES["explode_list"](spark, DATA).count() == rows["n"]


def test_distinct_join_concat(make):
    f = make(key=i32(1, 1, 2), value=i32(10, 20, 30))
    assert sorted(values(f.distinct("key", keep="last"), "value")) == [20, 30]
    out = f.lazy().join(f.lazy(), on="key", suffix="_lookup", coalesce=True)
    assert out.columns == ["key", "value", "value_lookup"]
    with pytest.raises(Exception, match="keys repeat"):
        f.lazy().join(f.lazy(), on="key", validate="1:1").collect()
    assert sk.concat([f, f]).collect().height == 6
    with pytest.raises(InvalidRequest):
        sk.concat([f, f.rename({"key": "k"})])


def test_float_edges(make):
    f = make(x=pa.array([-2.5, 2.5, math.nan, math.inf, -math.inf, None])).lazy()
    x = col("x")
    rows = f.select(x.floor().alias("f"), x.round().alias("e"), x.round(0, "half_away_from_zero").alias("a"), x.round(0, "to_zero").alias("z"), x.is_finite().alias("fin"), x.is_infinite().alias("inf"), x.is_nan().alias("nan")).collect().to_arrow().to_pydict()
    assert rows["f"][:2] == [-3.0, 2.0] and math.isnan(rows["f"][2]) and rows["f"][3:] == [math.inf, -math.inf, None]
    assert rows["e"][:2] == [-2.0, 2.0] and rows["a"][:2] == [-3.0, 3.0] and rows["z"][:2] == [-2.0, 2.0]
    assert rows["fin"] == [True, True, False, False, False, None]
    assert rows["inf"] == [False, False, False, True, True, None]
    assert rows["nan"] == [False, False, True, False, False, None]


def test_casts(make):
    f = make(text=["1", "bad", None]).lazy()
    assert values(f.select(col("text").cast("int64", strict=False)), "text") == [1, None, None]
    with pytest.raises(Exception):
        f.select(col("text").cast("int64")).collect()


@pytest.mark.parametrize(("how", "expected"), [("nearest", 10), ("lower", 0), ("higher", 10), ("midpoint", 5), ("linear", 7.5)])
def test_quantile(make, how, expected):
    f = make(x=pa.array([0.0, 10.0, 20.0, 30.0])).lazy()
    assert values(f.select(col("x").quantile(0.25, how)), "x") == [expected]


def test_series(make):
    s = make(x=i32(1, 2, None, 4)).column("x")
    kept = (s + lit(1, I32)).filter(s + lit(1, I32) > 2)
    assert kept.to_list() == [3, 5] and kept.sum() == 8 and kept.count() == 2
    assert s.reverse().to_list() == [4, None, 2, 1] and s.gather([3, 0]).to_list() == [4, 1] and s.null_count == 1
    assert s.append(s).slice(3, 2).to_list() == [4, 1]


def test_reshape(make):
    f = make(items=pa.array([[1, 2], [3]]), record=pa.array([{"name": "a", "score": 10}, {"name": "b", "score": 20}]))
    out = f.explode("items").unnest("record")
    assert out.columns == ["items", "name", "score"] and out.height == 3
    g = make(key=i32(1, 2), a=i32(3, 4), b=i32(5, 6))
    assert g.unpivot(index=["key"], variable_name="metric", value_name="reading").columns == ["key", "metric", "reading"]
    assert make(key=i32(1, 1), value=i32(10, 20), x=i32(0, 0), y=i32(1, 1)).transpose().shape == (4, 2)


def test_zero_width(spark):
    assert sk.DataFrame.from_arrow(spark, pa.table({"x": [1, 2, 3, 4, 5]})).drop("x").height == 5


def test_selectors_and_meta(make):
    f = make(a=i32(1), b=["x"], c=[1.0]).lazy()
    assert f.select(selectors.numeric().as_selector().as_expr()).columns == ["a", "c"]
    assert f.select((selectors.all_() - selectors.by_name("b")).as_expr()).columns == ["a", "c"]
    assert f.select(col("^[ab]$").name.prefix("p_")).columns == ["p_a", "p_b"]
    e = (col("a") + col("c")).alias("z")
    assert e.meta.root_names() == ["a", "c"] and e.meta.output_name() == "z" and e.meta.undo_aliases().meta.output_name() == "a"
    with pytest.raises(InvalidRequest):
        col("a").quantile(2)


def test_when_and_plan(make):
    f = make(a=i32(1, 2)).lazy()
    assert values(f.select(when(col("a") > 1).then(lit("hi")).otherwise(lit("lo")).alias("x")), "x") == ["lo", "hi"]
    assert "digraph" in f.explain(format="dot")


def test_jobs_and_batches(make):
    f = make(x=i32(1, 2)).lazy()
    job = f.submit()
    assert job.take().height == 2 and job.poll() == "taken"
    with pytest.raises(InvalidRequest):
        job.take()
    assert [b.num_rows for b in f.batches(batch_rows=1)] == [1, 1]


def test_io_round_trips(make, tmp_path, spark):
    f = make(a=i32(1, 2), b=["x", None])
    for kind, scan in (("parquet", sk.scan_parquet), ("ndjson", sk.scan_ndjson), ("ipc", sk.scan_ipc)):
        path = str(tmp_path / kind)
        getattr(f, f"write_{kind}")(path)
        got = sorted(scan(spark, path).collect().to_dicts(), key=lambda r: r["a"])
        assert [r["a"] for r in got] == [1, 2] and got[0]["b"] == "x" and got[1]["b"] is None
    f.write_csv(str(tmp_path / "csv"))
    assert sk.scan_csv(spark, str(tmp_path / "csv")).collect().height == 2


def test_lists_of_the_row_and_of_the_column(make):
    f = make(x=i32(1, 2, None), l=pa.array([[1], [3, None], [1]]), y=i32(2, 9, None)).lazy()
    rows = f.select(col("x").is_in(col("l")).alias("own"), col("x").is_in(col("y")).alias("all"), col("x").is_in(col("y"), nulls_equal=True).alias("nulls")).collect().to_arrow().to_pydict()
    assert rows == {"own": [True, False, None], "all": [False, True, None], "nulls": [False, True, True]}


def test_replace_keeps_the_pattern_of_the_caller(make):
    f = make(t=["a\nb", "xx a-b a+b"]).lazy()
    t = col("t").str
    assert values(f.select(t.replace("a.b", "!")), "t") == ["a\nb", "xx ! a+b"]
    assert values(f.select(t.replace("(a).(b)", "$2$1")), "t") == ["a\nb", "xx ba a+b"]
    assert values(f.select(t.replace("(?s)a.b", "!")), "t") == ["!", "xx ! a+b"]


def test_rolling_groups_answer_for_their_range(make):
    f = make(t=pa.array([1, 2, 10, 11]), x=["a", "a", "b", "c"], v=i32(3, 1, 5, 4)).lazy()
    v = col("v")
    out = f.group_by_rolling("t", "2i").agg(col("x").n_unique().alias("n"), col("x").first().alias("f"), col("x").last().alias("l"), v.arg_min().alias("lo"), v.arg_max().alias("hi"), v.median().alias("m")).collect().to_arrow().to_pydict()
    assert out["n"] == [1, 1, 1, 2] and out["f"] == ["a", "a", "b", "b"] and out["l"] == ["a", "a", "b", "c"]
    assert out["lo"] == [0, 1, 0, 1] and out["hi"] == [0, 0, 0, 0] and out["m"] == [3.0, 2.0, 5.0, 4.5]


def test_whole_group_functions_refuse_company(make):
    f = make(g=["a", "b", "a"], v=i32(1, 2, 3)).lazy()
    assert values(f.select(col("v").over("g", mapping="explode")), "v") == [1, 3, 2]
    assert values(f.select(col("v").diff(1, "drop")), "v") == [1, 1]
    for bad in ((col("v").over("g", mapping="explode"), col("g")), (col("v").diff(1, "drop").alias("d"), col("g"))):
        with pytest.raises(InvalidRequest):
            f.select(*bad)


@pytest.mark.parametrize("options", [{}, {"adjust": False}, {"ignore_nulls": False}, {"ignore_nulls": False, "adjust": False}])
def test_smoothing_against_weights(make, options):
    xs = [1.0, None, 4.0, 2.5, None, None, 7.0]
    adjust, skip = options.get("adjust", True), options.get("ignore_nulls", True)
    f = make(g=["a"] * len(xs) + ["b"], x=pa.array([*xs, 9.0])).lazy()
    got = values(f.select(col("x").ewm_mean(0.4, **options).over("g")), "x")
    whole = values(f.filter(col("g") == "a").select(col("x").ewm_mean(0.4, **options)), "x")
    want, seen = [], []
    for i, x in enumerate(xs):
        if x is None:
            want.append(None)
            continue
        at = len(seen) if skip else i
        seen.append((at, x))
        w = [0.6 ** (at - a) * (1 if adjust or not k else 0.4) for k, (a, _) in enumerate(seen)]
        if adjust or skip:
            want.append(sum(p * y for p, (_, y) in zip(w, seen, strict=True)) / sum(w))
        else:
            want.append(None)
    near = lambda a, b: b is None or abs(a - b) < 1e-9
    assert all(near(a, b) for a, b in zip(got[:-1], want, strict=True)) and got[-1] == 9.0 and whole == got[:-1]
    assert [a is None for a in got[:-1]] == [x is None for x in xs]


def test_neighbours_across_blocks(make, monkeypatch):
    from skeinframe.operators import frame

    xs = [float((7 * k) % 23) for k in range(50)]
    f = make(x=pa.array(xs)).lazy()
    x = col("x")
    made = [x.shift(2).alias("s"), x.shift(-3).alias("l"), x.diff().alias("d"), x.rolling_sum(4).alias("r"), x.rolling_mean(5, center=True).alias("m"), x.cum_sum().shift(1).alias("c"), x.pct_change().is_null().alias("p"), x.shift(1).rolling_max(2).alias("x")]
    whole = f.select(*made).collect().to_dicts()
    monkeypatch.setattr(frame, "BLOCK_ROWS", 5)
    assert f.select(*made).collect().to_dicts() == whole
    assert [r["s"] for r in whole] == [None, None, *xs[:-2]] and [r["l"] for r in whole] == [*xs[3:], None, None, None]
    assert [r["r"] for r in whole] == [sum(xs[max(0, k - 3) : k + 1]) for k in range(50)]
    assert [r["c"] for r in whole][1:] == [sum(xs[: k + 1]) for k in range(49)]


def test_list_explode_modes_and_calendar_rounding(make):
    import datetime

    f = make(a=pa.array([[1, 2], [], None], pa.list_(pa.int64()))).lazy()
    got = {(e, k): sorted(values(f.select(col("a").arr.explode(e, k).alias("a")), "a"), key=str) for e in (True, False) for k in (True, False)}
    assert got == {(True, True): [1, 2, None, None], (True, False): [1, 2, None], (False, True): [1, 2, None], (False, False): [1, 2]}
    g = make(x=["c", "b", "a", "b", "c"]).lazy()
    assert values(g.select(col("x").mode()), "x") == [["b", "c"]] and values(g.select(col("x").mode(maintain_order=True)), "x") == [["c", "b"]]
    d = make(t=pa.array([datetime.datetime(2024, 1, 16), datetime.datetime(2024, 1, 16, 12), datetime.datetime(2024, 12, 30)])).lazy()
    assert [v.strftime("%Y-%m") for v in values(d.select(col("t").dt.round("1mo")), "t")] == ["2024-01", "2024-02", "2025-01"]


def test_optimizer_flags(make, spark):
    name = "spark.sql.optimizer.excludedRules"
    f = make(a=i32(1, 2, 3)).lazy().filter(col("a") > 1)
    seen = []
    from skeinframe.operators import eager

    plain = eager.DataFrame.materialised.__func__
    try:
        eager.DataFrame.materialised = classmethod(lambda cls, lazy: (seen.append(spark.conf.get(name, None)), plain(cls, lazy))[1])
        assert f.collect(predicate_pushdown=False, type_check=False).height == 2
    finally:
        eager.DataFrame.materialised = classmethod(plain)
    assert "PushDownPredicates" in seen[0] and spark.conf.get(name, None) is None
    with pytest.raises(InvalidRequest):
        f.collect(no_such_flag=True)


def test_arrow_files_in_parts(make, spark, tmp_path):
    f = sk.DataFrame.from_arrow(spark, pa.table({"a": list(range(100)), "b": [None, "x"] * 50})).lazy()
    path = str(tmp_path / "parts")
    LazyFrame = type(f)
    LazyFrame(f._plain.repartition(5)).sink_ipc(path)
    assert not list((tmp_path / "parts").glob("*.tmp")) and len(list((tmp_path / "parts").glob("*.arrow"))) == 5
    rows = sorted(sk.scan_ipc(spark, path).collect().to_dicts(), key=lambda r: r["a"])
    assert rows == f.collect().to_dicts()
    assert pa.chunked_array(f.collect().column("a")).to_pylist() == list(range(100))
    assert [b.num_rows for b in f.batches(batch_rows=30)] == [30, 30, 30, 10]
    d = sk.diagnostics(spark)
    assert d["cached_frames"] >= 1 and d["background_jobs"] == 0 and "fill_null" in sk.capabilities()["functions"]


def test_csv_line_ends_in_quotes(make, spark, tmp_path):
    f = make(a=i32(1, 2), b=['x\n"y"', "z"])
    f.write_csv(str(tmp_path / "c"))
    assert sorted(values(sk.scan_csv(spark, str(tmp_path / "c")), "b")) == ['x\n"y"', "z"]


def _key(row):
    return tuple((0, "") if v is None else (1, repr(round(v, 9) if isinstance(v, float) else v)) for v in row)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_catalogue(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, DATA)
    want = con.sql(catalog.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(_key(r) for r in df.collect()) == sorted(_key([r[i] for i in order]) for r in want.fetchall())


def test_shift_diff_pct_from_zero_and_ties(spark, tmp_path):
    import pyarrow.parquet as pq

    value = [6.4, 57.63, 0.0, 5.0, 0.0, 0.0, -0.0, -3.5, None, 2.0, math.nan, 1.0, 1.0 - 1e-8, math.inf, 7.0]
    rows = pa.table({"event_id": range(len(value)), "user_id": [1] * len(value), "value": value})
    pq.write_table(rows, tmp_path / "events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = catalog.QUERIES["shift_diff_pct"](spark, str(tmp_path))
    want = con.sql(catalog.ORACLE["shift_diff_pct"])
    order = [want.columns.index(c) for c in df.columns]
    got = {r["event_id"]: r for r in df.collect()}
    assert sorted(map(_key, got.values())) == sorted(_key([r[i] for i in order]) for r in want.fetchall())
    assert got[1]["p"] == 8.004687 and [got[i]["p"] for i in (3, 5, 6, 7)] == [None] * 4


def test_round_half_away_scales(make):
    f = make(x=pa.array([57.63 / 6.4 - 1, 1 - 57.63 / 6.4, 0.0000005, 0.5, 1e305, -1e-7, math.nan, -math.inf, None])).lazy()
    got = values(f.select(col("x").round(6, "half_away_from_zero")), "x")
    assert got[:5] == [8.004687, -8.004687, 0.000001, 0.5, 1e305] and math.copysign(1, got[5]) == -1 and got[5] == 0
    assert math.isnan(got[6]) and got[7:] == [-math.inf, None]
    assert values(f.select(col("x").round(0, "half_away_from_zero")), "x")[:5] == [8.0, -8.0, 0.0, 1.0, 1e305]
