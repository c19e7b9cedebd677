"""Literal fixtures, edge cases, sources and plans."""

import dataclasses
import math

import pytest
from pyspark.sql import functions as F

from tessera import display, session, types
from tessera.functions import aggregates as A
from tessera.functions import nested as N
from tessera.functions import semantics as S
from tessera.operators import quantiles
from tessera.operators import windows as W
from tessera.operators.frame import Frame
from tessera.operators.joins import join
from tessera.operators.reshape import explode, melt, pivot
from tessera.plans import inspect
from tessera.sources import construct, files
from tessera.streaming import events as stream

SF = "/root/testdata/sf0.001"


def col(df, c, order=None):
    return [r[0] for r in (df.orderBy(order) if order else df).select(c).collect()]


def test_group_fixtures(spark):
    f = Frame(construct.from_columns(spark, {"key": [1, 1, 2, 2, 3], "value": [10.0, 20.0, 30.0, 40.0, 50.0]}))
    assert dict(map(tuple, f.group_by("key").sum("value").collect())) == {1: 30, 2: 70, 3: 50}
    assert dict(map(tuple, f.group_by("key").mean("value").collect())) == {1: 15, 2: 35, 3: 50}
    assert f.group_by("key").sum("value").columns == ["key", "value_sum"]
    with pytest.raises(KeyError):
        f.group_by("none")


def test_many_groups(spark):
    f = Frame(spark.range(1000).select((F.col("id") % 100).alias("key"), F.col("id").cast("double").alias("value")))
    got = dict(map(tuple, f.group_by("key").sum("value").collect()))
    assert got == {k: 10 * k + 4500 for k in range(100)}


def test_joins(spark):
    left = construct.from_columns(spark, {"emp_id": [1, 2, 3, 4, 5], "name_id": [101, 102, 103, 104, 105]})
    right = construct.from_columns(spark, {"emp_id": [1, 3, 5, 7], "dept_id": [10, 20, 30, 40]})
    both = join(left, right, left_on="emp_id", right_on="emp_id")
    assert both.columns == ["emp_id", "name_id", "emp_id_right", "dept_id"]
    assert sorted(col(both, "dept_id")) == [10, 20, 30]
    assert join(left, right, "emp_id").columns == ["emp_id", "name_id", "dept_id"]
    assert {r["emp_id"] for r in join(left, right, "emp_id", "left").collect() if r["dept_id"] is None} == {2, 4}
    none = join(left, right.withColumn("emp_id", F.col("emp_id") * 100), "emp_id")
    assert none.count() == 0 and none.columns == ["emp_id", "name_id", "dept_id"]
    dup = construct.from_columns(spark, {"id": [1, 1, 2, 2], "v": [100, 101, 200, 201]})
    assert join(dup, construct.from_columns(spark, {"id": [1, 2, 2], "v": [10, 20, 21]}), "id").count() == 6
    for how in ("inner", "left", "right", "outer", "semi", "anti"):
        assert join(left, right, "emp_id", how, strategy="broadcast").columns[0] == "emp_id"


def test_null_semantics(spark):
    df = construct.from_columns(spark, {"a": [1.0, None, 3.0, 4.0], "b": [10.0, 20.0, None, 40.0], "m": [True, True, False, True]}, order="ord")
    assert col(df.select((F.col("a") + F.col("b")).alias("s"), "ord"), "s", "ord") == [11, None, None, 44]
    assert Frame(df, "ord").filter_by_mask("m").values("a") == [1, None, 4]
    q = construct.from_columns(spark, {"a": [1.0, 2.0, 3.0, 0.0], "b": [1.0, 0.0, 2.0, 0.0]}, order="ord")
    got = col(q.select(S.ieee_div("a", "b").alias("q"), "ord"), "q", "ord")
    assert got[:3] == [1.0, math.inf, 1.5] and math.isnan(got[3])
    assert df.agg(A.total("a")).first()[0] == 8
    assert construct.empty(spark, {"x": "Float64"}).agg(F.min("x"), A.total("x"), A.mean("x")).first()[:] == (None, 0.0, None)


def test_statistics_edges(spark):
    same = construct.from_columns(spark, {"x": [2.0] * 5, "y": [1.0, 2.0, 3.0, 4.0, 5.0]})
    r = same.agg(A.skewness("x"), A.kurtosis("x"), A.correlation("x", "y"), A.median("y"), A.quantile("y", 0.3), A.quantile("y", 2.0)).first()
    assert tuple(r) == (0.0, 0.0, None, 3.0, pytest.approx(2.2), None)
    v = construct.from_columns(spark, {"x": [1.0, 2.0, 3.0, 4.0, 10.0]})
    r = v.agg(A.skewness("x"), A.skewness("x", "population"), A.skewness("x", "kernel")).first()
    assert tuple(r) == (pytest.approx(1.69706, abs=1e-4), pytest.approx(1.13842, abs=1e-4), pytest.approx(1.21431, abs=1e-4))
    assert spark.range(1).agg(A.variance("id"), A.std("id")).first()[:] == (None, None)


def test_blocked_windows_equal_plain_ones(spark, monkeypatch):
    df = spark.range(500).select((F.col("id") * 37 % 1009).alias("k"), F.when(F.col("id") % 3 != 0, F.col("id") % 17).alias("v"))
    specs = {"s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "n": ("row_number", None), "f": ("ffill", "v")}
    plain = W.cumulative(df, "k", specs)
    shift = {"a": lambda w: W.lag("v", w, 3), "b": lambda w: W.lead("v", w, 2), "r": lambda w: W.rolling_sum("v", w, 4)}
    plain_shift = W.shifted(df, "k", shift, 3, 2)
    assert sorted(plain.collect(), key=str) == sorted(W.cumulative(df, "k", specs, rows=60).collect(), key=str)
    assert sorted(plain_shift.collect(), key=str) == sorted(W.shifted(df, "k", shift, 3, 2, rows=60).collect(), key=str)
    monkeypatch.setattr(W, "BLOCK_ROWS", 60)
    assert not inspect.gathers_all_rows(W.shifted(df, "k", shift, 3, 2))


def test_blocks_take_keys_of_any_type(spark):
    """Over several blocks as in one window: text, decimal, time, binary, and nulls at the end."""
    n = F.col("id") * 37 % 1009
    kinds = {"text": F.lpad(n.cast("string"), 5, "0"), "decimal": n.cast("decimal(20,3)"), "time": F.timestamp_micros(n * 1_700_000_000), "bytes": F.encode(F.lpad(n.cast("string"), 5, "0"), "utf-8"), "double": n / 7, "day": F.date_add(F.lit("2020-01-01"), n.cast("int"))}
    for kind, key in kinds.items():
        df = spark.range(300).select("id", F.when(F.col("id") != 11, key).alias("k"), (F.col("id") % 7).alias("v"))
        specs, shift = {"s": ("sum", "v"), "n": ("row_number", None)}, {"a": lambda w: W.lag("v", w, 3), "b": lambda w: W.lead("v", w, 2)}
        for plain, many in ((W.cumulative(df, "k", specs), W.cumulative(df, "k", specs, rows=40)), (W.shifted(df, "k", shift, 3, 2), W.shifted(df, "k", shift, 3, 2, rows=40))):
            assert sorted(map(str, plain.drop("k").collect())) == sorted(map(str, many.drop("k").collect())), kind
        assert W.cumulative(df, "k", specs, rows=40).where("k is null").first()["n"] == 300


def test_windows_wider_than_a_block(spark):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 9).alias("v"))
    shift = {"r": lambda w: W.rolling_sum("v", w, 50), "b": lambda w: W.lead("v", w, 30)}
    assert sorted(W.shifted(df, "k", shift, 49, 30).collect()) == sorted(W.shifted(df, "k", shift, 49, 30, rows=10).collect())


def test_whole_frame_ranks(spark):
    rows = [(i, None if i % 11 == 0 else i % 6) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, v int")
    w = W.over("v")
    want = df.select("*", W.rank(w).alias("rank"), W.dense_rank(w).alias("dense_rank")).collect()
    for size in (None, 2):
        assert sorted(map(str, W.ranked(df, "v", rows=size).collect())) == sorted(map(str, want))


def test_quantiles_and_modes(spark):
    rows = [(i % 3, None if i % 10 == 0 else float(i * i % 17)) for i in range(120)] + [(7, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    named = {"a": 0.0, "b": 0.3, "c": 0.5, "d": 1.0, "e": 1.5}
    want = df.agg(*[A.quantile("v", q).alias(n) for n, q in named.items()]).first()
    assert [x and round(x, 9) for x in quantiles.quantiles(df, "v", named).first()] == [x and round(x, 9) for x in want]
    grouped = {r["g"]: r[1:] for r in quantiles.quantiles(df, "v", named, ["g"]).collect()}
    for r in df.groupBy("g").agg(*[A.quantile("v", q).alias(n) for n, q in named.items()]).collect():
        assert grouped[r["g"]] == pytest.approx(r[1:])
    assert quantiles.mode(df, "v").first()[0] == df.agg(A.mode("v")).first()[0]
    assert sorted(map(str, quantiles.mode(df, "v", "m", ["g"]).collect())) == sorted(map(str, df.groupBy("g").agg(A.mode("v").alias("m")).collect()))
    assert quantiles.quantiles(df.where("false"), "v", {"c": 0.5}).first()[0] is None


def test_signed_zero_and_wrapping(spark):
    df = spark.createDataFrame([(1.0, -0.0), (-1.0, -0.0), (1.0, 0.0), (6.0, 3.0)], "a double, b double")
    assert [r[0] for r in df.select(S.ieee_div("a", "b")).collect()] == [-math.inf, math.inf, math.inf, 2]
    top = (1 << 63) - 1
    w = spark.createDataFrame([(top, 2), (-top - 1, -1), (None, 1)], "a bigint, b bigint")
    got = w.select(*[S.wrapping(o, "a", "b") for o in ("add", "sub", "mul")]).collect()
    assert [tuple(r) for r in got] == [(-top, top - 2, -2), (top, -top, -top - 1), (None, None, None)]


def test_rolling_options(spark):
    df = construct.from_columns(spark, {"x": [10.0, None, 30.0, 40.0, 50.0]}, order="o")
    w = W.over("o")
    one = lambda c: col(df.select(c.alias("c"), "o"), "c", "o")
    assert one(W.rolling_sum("x", w, 3)) == [10, 10, 40, 70, 120]
    assert one(W.rolling_sum("x", w, 3, 3)) == [None, None, 40, 70, 120]
    assert one(W.rolling_sum("x", w, 3, 3, count_nulls=False)) == [None, None, None, None, 120]
    assert one(W.rolling_sum("x", w, 2, 3)) == [None] * 5
    assert math.isnan(one(W.rolling_sum("x", w, 3, 2, nan_prefix=True))[0])
    assert one(W.lag("x", w, 2, 0.0)) == [0, 0, 10, None, 30]
    assert one(W.forward_fill("x", w)) == [10, 10, 30, 40, 50] and one(W.backward_fill("x", w)) == [10, 30, 30, 40, 50]


def test_frame_places(spark):
    f = Frame(construct.from_columns(spark, {"v": [5.0, 3.0, None, 1.0]}, order="o"), "o")
    assert f.head(0).columns == ["v", "o"] and f.head(0).height() == 0
    assert f.head(2).values("v") == [5, 3] and f.tail(2).values("v") == [None, 1] and f.slice(1, 3).values("v") == [3, None]
    assert f.at("v", 0) == 5 and f.at("v", 9) is None and f.sort("v").df.collect()[-1]["v"] is None
    assert col(f.argsort("v"), "place") == [3, 1, 0, 2]
    assert f.n_unique("v") == 3 and f.has_column("v") and f.width == 2 and not f.is_empty()
    with pytest.raises(ValueError):
        Frame(f.df).head(1)


def test_reshape(spark):
    df = construct.from_columns(spark, {"date": ["1", "1", "2", "2"], "metric": ["sales", "cost"] * 2, "value": [100.0, 60.0, 150.0, 80.0]})
    wide = pivot(df, "date", "metric", "value", names=["sales", "cost"])
    assert sorted(map(tuple, wide.collect())) == [("1", 100, 60), ("2", 150, 80)]
    assert melt(wide, ["date"]).count() == 4
    lists = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id int, tags array<string>")
    assert explode(lists, "tags").count() == 2 and explode(lists, "tags", outer=True).count() == 4


def test_lists_and_structs(spark):
    df = spark.createDataFrame([(1, [90.0, 85.0, 88.0]), (2, [75.0, None])], "id int, s array<double>")
    v = N.List("s")
    got = df.select(v.sum(), v.min(), v.max(), v.get(0), v.get(7), v.len(), F.round(v.mean(), 2)).collect()
    assert [tuple(r) for r in got] == [(263, 85, 90, 90, None, 3, 87.67), (75, 75, 75, 75, None, 2, 75)]
    assert N.unnest(df.select(N.struct(a="id", b="s").alias("x")), "x", "p_").columns == ["p_a", "p_b"]
    assert col(spark.range(1).select(N.Str(F.lit("\t a b \n")).trim().alias("t")), "t") == ["a b"]


def test_constructors(spark):
    @dataclasses.dataclass
    class Row:
        a: int
        b: float | None
        c: str = dataclasses.field(metadata={"name": "renamed"})
        d: int = dataclasses.field(default=0, metadata={"name": "-"})

    df = construct.from_structs(spark, [Row(1, None, "x"), Row(2, 2.5, "y")])
    assert df.columns == ["a", "b", "renamed"] and col(df, "b", "a") == [None, 2.5]
    assert col(construct.series(spark, "x", [1, 2, 3], valid=[True, False, True]), "x") == [1, None, 3]
    with pytest.raises(ValueError):
        construct.from_columns(spark, {"a": [1], "b": [1, 2]})
    with pytest.raises(ValueError):
        types.struct_type([("a", "Int64"), ("a", "Int64")])


def test_types():
    t = types.DTYPES
    assert types.promote(t["Int32"], t["Int64"]) == t["Int64"] and types.promote(t["Int64"], t["Float64"]) == t["Float64"]
    assert types.is_float(t["Float32"]) and types.is_integer(t["UInt64"]) and types.is_nested(types.list_type("Int64"))
    assert types.byte_size("Int32") == 4 and types.byte_size("String") == -1 and types.dtype_name(t["Bool"]) == "Bool"
    with pytest.raises(TypeError):
        types.promote(t["String"], t["Int64"])


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("junk\na;b;c;d\n#no\n1;1e10;true;x\n2;NA;false;\n")
    df = files.read_csv(spark, str(path), delimiter=";", null_values=("", "NA"), skip_rows=1, comment="#")
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "boolean", "string"]
    assert [tuple(r) for r in df.collect()] == [(1, 1e10, True, "x"), (2, None, False, None)]
    files.write_csv(df, str(tmp_path / "out"), delimiter="|", null_value="?")
    again = files.read_csv(spark, str(tmp_path / "out"), delimiter="|", null_values=("?",))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))
    assert files.read_csv(spark, str(tmp_path / "out"), delimiter="|", types={"a": "String"}, max_rows=1).count() == 1


def test_json_and_parquet(spark, tmp_path):
    df = construct.from_columns(spark, {"a": [1, 2, 3], "b": ["x", None, "z"]})
    for write, read, name in ((files.write_json, files.read_json, "j"), (files.write_jsonl, files.read_jsonl, "l"), (files.write_parquet, files.read_parquet, "p")):
        write(df, str(tmp_path / name))
        assert sorted(map(tuple, read(spark, str(tmp_path / name)).select("a", "b").collect())) == [(1, "x"), (2, None), (3, "z")]
    (tmp_path / "c.json").write_text('{"a": [1, 2], "b": ["x", "y"]}')
    assert sorted(map(tuple, files.read_json(spark, str(tmp_path / "c.json")).collect())) == [(1, "x"), (2, "y")]


def test_display(spark):
    f = Frame(construct.from_columns(spark, {"v": [float(i) for i in range(30)]}, order="o"), "o")
    for style in display.STYLES:
        out = display.render(f, display.set_display_config(style=style, max_rows=4, float_precision=1))
        assert "29.0" in out and "…" in out and "15.0" not in out
    with pytest.raises(ValueError):
        display.set_display_config(style="none")
    display.set_display_config(display.DisplayConfig())


def test_plans(spark):
    df = Frame(files.scan_parquet(spark, f"{SF}/lineitem.parquet")).filter(F.col("l_quantity") > 10).group_by("l_returnflag").sum("l_tax")
    assert "GreaterThan(l_quantity,10.0)" in inspect.pushed_filters(df)[0]
    assert "l_shipdate" not in inspect.read_columns(df)[0]
    assert session.runtime_info(spark)["codegen"] == "true" and session.is_running(spark)


def test_stream_equals_batch(spark, tmp_path):
    events = files.read_parquet(spark, f"{SF}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    s = stream.windowed(stream.read_stream(spark, str(tmp_path / "in"), events), "ts", "1 day", late="3650 days")
    q = s.writeStream.format("memory").queryName("t_stream").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = stream.windowed(events, "ts", "1 day")
    pick = lambda df: sorted((str(r["start"]), r["n"]) for r in df.collect())
    assert pick(spark.table("t_stream")) == pick(batch)
    assert stream.sessions(events, "ts", "5 minutes", ("user_id",)).agg(F.sum("n")).first()[0] == events.count()


def test_division_of_zero_by_zero_has_the_bits_of_sql(spark, tmp_path):
    import duckdb
    import numpy as np

    from tessera.queries import ORACLE_SQL, QUERIES

    rows = "SELECT i AS event_id, CASE i // 15 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN -0.0::DOUBLE WHEN 2 THEN -2.5 WHEN 3 THEN 'nan'::DOUBLE ELSE 2.5 END AS value FROM range(75) t(i)"
    duckdb.sql(f"COPY ({rows}) TO '{tmp_path}/events.parquet'")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    bits = lambda pdf: pdf[pdf["event_id"] % 5 != 0].sort_values("event_id")["q"].to_numpy().view(np.uint64).tolist()
    assert bits(QUERIES["e2_divide"](spark, str(tmp_path)).toPandas()) == bits(con.sql(ORACLE_SQL["e2_divide"]).df())
