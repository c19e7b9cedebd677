"""Registered queries of the engine's own operators, each with its oracle SQL.

A key starts with the id of the operator family it shows. Fractions are rounded
where the order of summation shows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import types
from tessera.functions import aggregates as A
from tessera.functions import nested as N
from tessera.functions import semantics as S
from tessera.operators import windows as W
from tessera.operators.frame import Frame
from tessera.operators.groups import GroupBy, group_ids
from tessera.operators.joins import join
from tessera.sources import construct, files, scratch
from tessera.streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return files.scan_parquet(spark, f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str, order: str | None = None) -> Frame:
    return Frame(table(spark, sf_dir, name), order)


r2 = lambda c: F.round(c, 2)
r4 = lambda c: F.round(c, 4)


# flagship
@query("SELECT l_returnflag, round(sum(l_extendedprice), 2) AS l_extendedprice_sum, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1")
def revenue_by_flag(spark, sf_dir):
    f = frame(spark, sf_dir, "lineitem").filter(F.col("l_quantity") > 10)
    return f.group_by("l_returnflag").agg(r2(A.total("l_extendedprice")).alias("l_extendedprice_sum"), F.count(F.lit(1)).alias("n")).orderBy("l_returnflag")


# projection, places, shape
@query("SELECT o_orderkey, o_totalprice FROM orders")
def p1_select(spark, sf_dir):
    return frame(spark, sf_dir, "orders").select("o_orderkey", "no_such_column", "o_totalprice", strict=False).df


@query("SELECT * EXCLUDE (o_orderpriority, o_orderdate) FROM orders")
def p2_drop(spark, sf_dir):
    return frame(spark, sf_dir, "orders").drop("o_orderpriority", "o_orderdate", "no_such_column").df


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey FROM nation")
def p3_rename(spark, sf_dir):
    return frame(spark, sf_dir, "nation").rename({"n_nationkey": "id", "n_name": "name", "missing": "x"}).df


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size * 2 AS p_size, p_retailprice, p_retailprice / 2 AS half FROM part")
def p4_with_column(spark, sf_dir):
    f = frame(spark, sf_dir, "part")
    return f.with_column("p_size", F.col("p_size") * 2).with_column("half", F.col("p_retailprice") / 2).df


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25")
def p5_head(spark, sf_dir):
    return frame(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", "o_custkey").head(25).df


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 25")
def p6_tail(spark, sf_dir):
    return frame(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", "o_custkey").tail(25).df


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 30 OFFSET 100")
def p7_slice(spark, sf_dir):
    return frame(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", "o_custkey").slice(100, 130).df


@query("SELECT * FROM region")
def p8_clone(spark, sf_dir):
    return frame(spark, sf_dir, "region").clone().df


@query("SELECT count(*) AS height, CAST(6 AS BIGINT) AS width FROM orders")
def p9_dimensions(spark, sf_dir):
    f = frame(spark, sf_dir, "orders")
    return f.agg(F.count(F.lit(1)).alias("height")).withColumn("width", F.lit(f.width).cast("long"))


@query("SELECT count(*) - count(nullif(o_orderstatus, 'O')) AS null_count, count(*) AS n FROM orders")
def p12_series_metadata(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(S.count_null(F.nullif("o_orderstatus", F.lit("O"))).alias("null_count"), F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders),
i AS (SELECT event_id AS position, CASE WHEN event_id % 7 = 0 THEN -1 ELSE event_id * 3 % 20000 END AS place FROM events)
SELECT position, coalesce(o_orderkey, 0) AS o_orderkey, coalesce(o_totalprice, 0) AS o_totalprice FROM i LEFT JOIN p ON i.place = p.place""")
def p13_take(spark, sf_dir):
    places = F.when(F.col("event_id") % 7 == 0, F.lit(-1)).otherwise(F.col("event_id") * 3 % 20000)
    indices = table(spark, sf_dir, "events").select(F.col("event_id").alias("position"), places.alias("place"))
    return frame(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", "o_totalprice").take(indices).df


@query("""SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS DOUBLE) AS fraction, CAST(o_custkey AS VARCHAR) AS text,
o_totalprice > 0 AS from_float, o_custkey <> 0 AS from_int, TRY_CAST(o_orderstatus AS BIGINT) AS none FROM orders""")
def p19_cast(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    kind = lambda c: df.schema[c].dataType
    return df.select(
        "o_orderkey",
        types.cast(F.col("o_totalprice"), "Int64").alias("whole"),
        types.cast(F.col("o_orderkey"), "Float64").alias("fraction"),
        types.cast(F.col("o_custkey"), "String").alias("text"),
        types.cast(F.col("o_totalprice"), "Bool", kind("o_totalprice")).alias("from_float"),
        types.cast(F.col("o_custkey"), "Bool", kind("o_custkey")).alias("from_int"),
        types.cast(F.col("o_orderstatus"), "Int64").alias("none"),
    )


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def p21_distinct(spark, sf_dir):
    return frame(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct().df


@query("SELECT count(DISTINCT l_suppkey) AS n FROM lineitem")
def p21_nunique(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(A.n_unique("l_suppkey").alias("n"))


@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def p22_concat(spark, sf_dir):
    a = Frame(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")))
    return a.concat(Frame(table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k")))).df


# filters and masks
_OPS = {"gt": ">", "ge": ">=", "lt": "<", "le": "<=", "eq": "=", "ne": "<>"}


@query("SELECT event_id, " + ", ".join(f"coalesce(nullif(value, 0) {o} 50, false) AS {n}" for n, o in _OPS.items()) + " FROM events")
def f3_compare_scalar(spark, sf_dir):
    v = F.nullif("value", F.lit(0.0))
    return table(spark, sf_dir, "events").select("event_id", *[S.compare(v, 50.0, n).alias(n) for n in _OPS])


_NAN = "CASE WHEN l_linenumber = 3 THEN CAST('NaN' AS DOUBLE) ELSE l_quantity END"


def _ieee(o: str) -> str:
    nan = f"(isnan({_NAN}))"
    return f"coalesce(({_NAN}) {o} l_tax * 300 {'OR' if o == '<>' else 'AND NOT'} {nan}, false)"


@query("SELECT " + ", ".join(f"count(*) FILTER (WHERE {_ieee(o)}) AS {n}" for n, o in _OPS.items()) + " FROM lineitem")
def f9_compare_vectors(spark, sf_dir):
    x = F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").agg(*[A.count_true(S.compare(x, F.col("l_tax") * 300, n)).alias(n) for n in _OPS])


@query("SELECT * FROM orders WHERE o_totalprice > 200000")
def f1_filter(spark, sf_dir):
    return frame(spark, sf_dir, "orders").filter(F.col("o_totalprice") > 200000).df


@query("SELECT * FROM orders WHERE CAST(o_custkey % 3 AS BOOLEAN)")
def f21_filter_by_mask(spark, sf_dir):
    return frame(spark, sf_dir, "orders").filter_by_mask(F.col("o_custkey") % 3).df


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders QUALIFY o_totalprice > 300000")
def f15_filter_indices(spark, sf_dir):
    return frame(spark, sf_dir, "orders", "o_orderkey").indices_where(F.col("o_totalprice") > 300000)


@query("SELECT o_orderkey, o_totalprice > 100000 AS mask FROM orders")
def f16_filter_mask(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.compare("o_totalprice", 100000.0, "gt").alias("mask"))


@query("SELECT count(*) FILTER (WHERE o_totalprice > 100000) AS n_true, count(*) FILTER (WHERE NOT o_totalprice > 100000) AS n_false FROM orders")
def f18_count_mask(spark, sf_dir):
    m = F.col("o_totalprice") > 100000
    return table(spark, sf_dir, "orders").agg(A.count_true(m).alias("n_true"), A.count_false(m).alias("n_false"))


@query("SELECT c_custkey FROM customer WHERE (c_acctbal > 0 AND NOT c_mktsegment = 'BUILDING') OR c_nationkey IN (1, 2, 3)")
def f23_logical(spark, sf_dir):
    e = ((F.col("c_acctbal") > 0) & ~N.Str("c_mktsegment").eq("BUILDING")) | F.col("c_nationkey").isin(1, 2, 3)
    return frame(spark, sf_dir, "customer").filter(e).select("c_custkey").df


# arithmetic, conditionals, folds
@query("SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS a, l_quantity - l_tax AS s, l_quantity * l_discount AS m, l_quantity * 2 + 1 AS scalars, l_orderkey % 7 AS r, abs(l_tax - 0.05) AS d FROM lineitem")
def e1_arithmetic(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (c("l_quantity") + c("l_tax")).alias("a"), (c("l_quantity") - c("l_tax")).alias("s"), (c("l_quantity") * c("l_discount")).alias("m"), (c("l_quantity") * 2 + 1).alias("scalars"), (c("l_orderkey") % 7).alias("r"), F.abs(c("l_tax") - 0.05).alias("d"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END / (event_id % 3) AS q FROM events")
def e2_divide(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.ieee_div(F.when(F.col("event_id") % 5 != 0, F.col("value")), F.col("event_id") % 3).alias("q"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN value ELSE -1 END AS v, CASE WHEN value > 50 THEN 'high' ELSE event_type END AS w FROM events")
def e8_select(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return df.select("event_id", S.select(F.col("event_type") == "click", "value", -1.0).alias("v"), S.select(F.col("value") > 50, F.lit("high"), "event_type").alias("w"))


_GAPPY = "CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN CAST('NaN' AS DOUBLE) ELSE value END"


def _gappy():
    k = F.col("event_id") % 4
    return F.when(k == 0, F.lit(None).cast("double")).when(k == 1, F.lit(float("nan"))).otherwise(F.col("value"))


@query(f"""SELECT event_id, x IS NULL AS missing, x IS NULL OR isnan(x) AS missing_nan, coalesce(x, 7) IS NOT NULL AS filled, CASE WHEN x IS NULL OR isnan(x) THEN 7 ELSE x END AS filled_nan,
coalesce(CASE WHEN isnan(x) THEN NULL ELSE x END, CAST(user_id AS DOUBLE)) AS first FROM (SELECT *, {_GAPPY} AS x FROM events)""")
def e10_nulls(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("x", _gappy())
    return df.select("event_id", S.is_null("x").alias("missing"), S.is_null("x", True).alias("missing_nan"), S.fill_null("x", 7.0).isNotNull().alias("filled"), S.fill_null("x", 7.0, True).alias("filled_nan"), S.coalesce("x", F.col("user_id").cast("double"), nan_as_null=True).alias("first"))


@query(f"SELECT count(*) FILTER (WHERE x IS NULL) AS nulls, count(*) FILTER (WHERE x IS NULL OR isnan(x)) AS with_nan, count(x) FILTER (WHERE NOT isnan(x)) AS others FROM (SELECT {_GAPPY} AS x FROM events)")
def e16_count_nulls(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("x", _gappy())
    return df.agg(S.count_null("x").alias("nulls"), S.count_null("x", True).alias("with_nan"), S.count_not_null("x", True).alias("others"))


@query("""SELECT event_id, last_value(x IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS forward,
first_value(x IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward FROM (SELECT event_id, CASE WHEN value > 60 THEN value END AS x FROM events)""")
def e12_fills(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") > 60, F.col("value")).alias("x"), (-F.col("event_id")).alias("back"))
    out = W.cumulative(df, "event_id", {"forward": ("ffill", "x")})
    return W.cumulative(out, "back", {"backward": ("ffill", "x")}).select("event_id", "forward", "backward")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax + l_discount AS s2, l_tax + l_discount + l_quantity AS s3, least(l_tax, l_discount) AS mn, greatest(l_tax, l_discount, l_quantity) AS mx,
l_tax * l_discount * l_quantity AS p3, (l_tax + l_discount) / 2 AS me, l_tax > 0.04 OR l_discount > 0.04 AS an, l_tax > 0.04 AND l_discount > 0.04 AS al, 2 - CAST(l_tax = 0 AS INTEGER) AS n FROM lineitem""")
def e17_horizontal(spark, sf_dir):
    tax, discount = F.col("l_tax") > 0.04, F.col("l_discount") > 0.04
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.sum_horizontal("l_tax", "l_discount").alias("s2"), S.sum_horizontal("l_tax", "l_discount", "l_quantity").alias("s3"), S.min_horizontal("l_tax", "l_discount").alias("mn"), S.max_horizontal("l_tax", "l_discount", "l_quantity").alias("mx"), S.product_horizontal("l_tax", "l_discount", "l_quantity").alias("p3"), S.mean_horizontal("l_tax", "l_discount").alias("me"), S.any_horizontal(tax, discount).alias("an"), S.all_horizontal(tax, discount).alias("al"), S.count_non_null_horizontal("l_quantity", F.nullif("l_tax", F.lit(0.0))).alias("n"))


# aggregates and statistics
@query("SELECT round(sum(l_quantity), 2) AS s, min(l_extendedprice) AS mn, max(l_extendedprice) AS mx, round(avg(l_discount), 6) AS me, count(l_tax) AS n, CAST(sum(l_linenumber) AS BIGINT) AS si FROM lineitem")
def a1_aggregates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(r2(A.total("l_quantity")).alias("s"), F.min("l_extendedprice").alias("mn"), F.max("l_extendedprice").alias("mx"), F.round(A.mean("l_discount"), 6).alias("me"), F.count("l_tax").alias("n"), A.total("l_linenumber").alias("si"))


@query("SELECT round(var_samp(value), 4) AS v, round(stddev_samp(value), 4) AS s FROM events")
def a5_variance(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(r4(A.variance("value")).alias("v"), r4(A.std("value")).alias("s"))


@query("SELECT round(median(value), 6) AS m, round(quantile_cont(value, 0.1), 6) AS q10, round(quantile_cont(value, 0.99), 6) AS q99, round(quantile_cont(value, 0), 6) AS q0 FROM events")
def a7_quantiles(spark, sf_dir):
    out = frame(spark, sf_dir, "events").quantiles("value", m=0.5, q10=0.1, q99=0.99, q0=0.0)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("SELECT event_type, round(median(value), 6) AS m, round(quantile_cont(value, 0.25), 6) AS q25, mode() WITHIN GROUP (ORDER BY CAST(user_id AS BIGINT)) IS NOT NULL AS has_mode FROM events GROUP BY 1")
def a8_group_quantiles(spark, sf_dir):
    g = frame(spark, sf_dir, "events").group_by("event_type")
    both = join(g.quantiles("value", {"m": 0.5, "q25": 0.25}), g.mode("user_id"), "event_type")
    return both.select("event_type", F.round("m", 6).alias("m"), F.round("q25", 6).alias("q25"), F.col("user_id_mode").isNotNull().alias("has_mode"))


@query("SELECT round(skewness(value), 4) AS sk, round(kurtosis(value), 4) AS ku FROM events")
def a9_moments(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(r4(A.skewness("value")).alias("sk"), r4(A.kurtosis("value")).alias("ku"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def a11_correlation(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.round(A.correlation("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("SELECT p_size AS m FROM part GROUP BY p_size ORDER BY count(*) DESC, p_size LIMIT 1")
def a12_mode(spark, sf_dir):
    return frame(spark, sf_dir, "part").mode("p_size", "m")


@query("SELECT arg_min(o_totalprice, o_orderkey) AS f, arg_max(o_totalprice, o_orderkey) AS l, count(DISTINCT o_custkey) AS u FROM orders")
def a13_first_last(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(A.first("o_totalprice", "o_orderkey").alias("f"), A.last("o_totalprice", "o_orderkey").alias("l"), A.n_unique("o_custkey").alias("u"))


def _described(c: str) -> str:
    q = "".join(f", round(quantile_cont({c}, {p}), 4) AS q{n}" for n, p in ((25, 0.25), (50, 0.5), (75, 0.75)))
    return f"SELECT '{c}' AS \"column\", CAST(count({c}) AS DOUBLE) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min{q}, CAST(max({c}) AS DOUBLE) AS max FROM part"


@query(_described("p_size") + " UNION ALL " + _described("p_retailprice"))
def a17_describe(spark, sf_dir):
    out = frame(spark, sf_dir, "part").describe("p_size", "p_retailprice")
    return out.select(*[r4(F.col(c)).alias(c) if c in ("mean", "std", "q25", "q50", "q75") else F.col(c) for c in out.columns])


# groups
@query("SELECT l_suppkey, round(sum(l_quantity), 2) AS l_quantity_sum FROM lineitem GROUP BY 1")
def g2_group_sum(spark, sf_dir):
    return frame(spark, sf_dir, "lineitem").group_by("l_suppkey").sum("l_quantity").withColumn("l_quantity_sum", r2(F.col("l_quantity_sum")))


@query("SELECT l_suppkey, round(avg(l_quantity), 6) AS l_quantity_mean FROM lineitem GROUP BY 1")
def g3_group_mean(spark, sf_dir):
    return frame(spark, sf_dir, "lineitem").group_by("l_suppkey").mean("l_quantity").withColumn("l_quantity_mean", F.round("l_quantity_mean", 6))


@query("SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")
def g4_group_count(spark, sf_dir):
    return frame(spark, sf_dir, "orders").group_by("o_orderpriority").count()


@query("SELECT l_returnflag, round(sum(l_quantity), 2) AS l_quantity_sum, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max, count(l_tax) AS l_tax_count FROM lineitem GROUP BY 1")
def g5_group_agg(spark, sf_dir):
    out = frame(spark, sf_dir, "lineitem").group_by("l_returnflag").agg({"l_quantity": ["sum", "min", "max"], "l_tax": "count"})
    return out.withColumn("l_quantity_sum", r2(F.col("l_quantity_sum")))


@query("SELECT user_id, min(event_id) AS first, count(*) AS count, row_number() OVER (ORDER BY min(event_id)) - 1 AS group_id FROM events GROUP BY 1")
def g8_group_ids(spark, sf_dir):
    return group_ids(table(spark, sf_dir, "events"), ["user_id"], "event_id")


@query("SELECT l_returnflag, l_linestatus, year(l_shipdate) AS y, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(stddev_samp(l_quantity), 4) AS sd, round(var_samp(l_tax), 6) AS va, round(median(l_quantity), 4) AS med FROM lineitem GROUP BY 1, 2, 3")
def g19_multi_key(spark, sf_dir):
    g = frame(spark, sf_dir, "lineitem").group_by("l_returnflag", "l_linestatus", F.year("l_shipdate").cast("long").alias("y"))
    sums = g.agg(r2(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("revenue"), r4(A.std("l_quantity")).alias("sd"), F.round(A.variance("l_tax"), 6).alias("va"))
    return join(sums, g.quantiles("l_quantity", {"med": 0.5}), ["l_returnflag", "l_linestatus", "y"]).withColumn("med", r4(F.col("med")))


@query("SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice_first, arg_max(o_totalprice, o_orderkey) AS o_totalprice_last FROM orders GROUP BY 1")
def g20_group_first_last(spark, sf_dir):
    return frame(spark, sf_dir, "orders", "o_orderkey").group_by("o_custkey").agg({"o_totalprice": ["first", "last"]})


@query("SELECT nullif(o_orderstatus, 'O') AS k, count(*) AS count FROM orders GROUP BY 1")
def g19_null_key(spark, sf_dir):
    return GroupBy(table(spark, sf_dir, "orders"), F.nullif("o_orderstatus", F.lit("O")).alias("k")).count()


# joins
@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderkey, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def j1_inner(spark, sf_dir):
    left = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return join(left, table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), left_on="l_orderkey", right_on="o_orderkey")


@query("SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def j2_left(spark, sf_dir):
    return frame(spark, sf_dir, "documents").select("doc_id", "lang").left_join(table(spark, sf_dir, "labels"), "doc_id").df


@query("SELECT doc_id, quality, lang FROM labels RIGHT JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)")
def j3_right(spark, sf_dir):
    left = frame(spark, sf_dir, "labels").select("doc_id", "quality")
    return left.right_join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").df


@query("SELECT a.n_nationkey AS id, a.n_name AS name, b.n_name AS name_other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey = b.n_nationkey")
def j7_composite_suffix(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("r"), F.col("n_name").alias("name"))
    return join(df, df, on=["id", "r"], suffix="_other").drop("r")


@query("SELECT a.n_name AS n_name, b.n_name AS n_name_right FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def j8_self(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select("n_name", "n_regionkey")
    return join(df, df, on="n_regionkey").drop("n_regionkey")


@query("SELECT k, x, y FROM (SELECT o_orderkey AS k, o_totalprice AS x FROM orders) FULL JOIN (SELECT l_orderkey AS k, count(*) AS y FROM lineitem GROUP BY 1) USING (k)")
def j10_outer(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("x"))
    return join(a, table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("y")), "k", "outer")


@query("SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_custkey END AS k FROM customer) JOIN (SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS k2 FROM orders) ON k = k2")
def j1_null_keys(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, F.col("c_custkey")).alias("k"))
    b = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("k"))
    return join(a, b, "k").drop("k")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def j_anti(spark, sf_dir):
    return join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), how="anti", left_on="o_orderkey", right_on="l_orderkey").select("o_orderkey")


# windows
@query("""SELECT event_id, lag(value, 2, 0) OVER w AS lg, lead(value, 3, -1) OVER w AS ld, CASE WHEN row_number() OVER w > 1 THEN value - lag(value) OVER w END AS d, round((value - lag(value) OVER w) / nullif(lag(value) OVER w, 0), 6) AS pc FROM events WINDOW w AS (ORDER BY event_id)""")
def w1_shifted(spark, sf_dir):
    f = frame(spark, sf_dir, "events", "event_id")
    out = f.with_shifted(before=2, after=3, lg=lambda w: W.lag("value", w, 2, 0.0), ld=lambda w: W.lead("value", w, 3, -1.0), d=lambda w: F.col("value") - W.lag("value", w), pc=lambda w: F.round(W.pct_change("value", w), 6))
    return out.df.select("event_id", "lg", "ld", "d", "pc")


@query("SELECT event_id, row_number() OVER w AS rn, round(sum(value) OVER w, 4) AS cs, min(value) OVER w AS cmin, max(value) OVER w AS cmax FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def w7_cumulative(spark, sf_dir):
    out = frame(spark, sf_dir, "events", "event_id").with_cumulative(rn=("row_number", None), cs=("sum", "value"), cmin=("min", "value"), cmax=("max", "value"))
    return out.df.select("event_id", "rn", r4(F.col("cs")).alias("cs"), "cmin", "cmax")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS cs FROM events")
def w4_partitioned(spark, sf_dir):
    w = W.over("event_id", ["user_id"])
    return table(spark, sf_dir, "events").select("event_id", W.row_number(w).alias("rn"), r4(W.cum_sum("value", w)).alias("cs"))


@query("SELECT p_partkey, rank() OVER w AS r, dense_rank() OVER w AS d FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
def w5_ranks(spark, sf_dir):
    w = W.over("p_size", ["p_brand"])
    return table(spark, sf_dir, "part").select("p_partkey", W.rank(w).alias("r"), W.dense_rank(w).alias("d"))


@query("""SELECT event_id, CASE WHEN n >= 3 THEN round(s, 4) END AS rs, round(a, 4) AS ra, mn AS rmn, mx AS rmx, CASE WHEN n >= 2 THEN round(sd, 4) END AS rsd FROM (
SELECT event_id, count(*) OVER w AS n, sum(value) OVER w AS s, avg(value) OVER w AS a, min(value) OVER w AS mn, max(value) OVER w AS mx, stddev_samp(value) OVER w AS sd FROM events WINDOW w AS (ORDER BY event_id ROWS 6 PRECEDING))""")
def w10_rolling(spark, sf_dir):
    f = frame(spark, sf_dir, "events", "event_id")
    out = f.with_shifted(before=6, rs=lambda w: r4(W.rolling_sum("value", w, 7, 3)), ra=lambda w: r4(W.rolling_mean("value", w, 7)), rmn=lambda w: W.rolling_min("value", w, 7), rmx=lambda w: W.rolling_max("value", w, 7), rsd=lambda w: r4(W.rolling_std("value", w, 7)))
    return out.df.select("event_id", "rs", "ra", "rmn", "rmx", "rsd")


@query("SELECT event_id, CASE WHEN row_number() OVER w <= 4 THEN -1.0 ELSE value - lag(value, 4) OVER w END AS d FROM events WINDOW w AS (ORDER BY event_id)")
def w14_diff_n(spark, sf_dir):
    # the place of a row is its own column: a block of rows does not know it
    out = frame(spark, sf_dir, "events", "event_id").numbered("place").with_shifted(before=4, l=lambda w: W.lag("value", w, 4))
    return out.df.select("event_id", F.when(F.col("place") < 4, F.lit(-1.0)).otherwise(F.col("value") - F.col("l")).alias("d"))


@query("SELECT event_id, first_value(value) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events")
def w18_over(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.first("value").over(W.over("event_id", ["user_id"])).alias("f"))


@query("SELECT event_id, sum(c) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM (SELECT event_id, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) AND event_id > (SELECT min(event_id) FROM events) THEN 0 ELSE 1 END AS c FROM events)")
def w4_runs(spark, sf_dir):
    return W.run_ids(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id").select("event_id", F.col("run").cast("long").alias("run"))


# sorts
@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST")
def o1_sort(spark, sf_dir):
    return frame(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").sort("c_acctbal", ascending=False, then=["c_custkey"]).df


@query("SELECT place FROM (SELECT c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer) ORDER BY c_acctbal, place")
def o3_argsort(spark, sf_dir):
    return frame(spark, sf_dir, "customer", "c_custkey").argsort("c_acctbal")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey")
def o6_sort_by(spark, sf_dir):
    return frame(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").sort_by(("o_orderstatus", False), ("o_totalprice", True), ("o_orderkey", False)).df


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def o8_top(spark, sf_dir):
    return frame(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").top(10, ("o_totalprice", True), ("o_orderkey", False)).df


# reshape and sets
@query("SELECT o_orderpriority, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS F, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS O, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 2) AS P FROM orders GROUP BY 1")
def r1_pivot(spark, sf_dir):
    out = frame(spark, sf_dir, "orders").pivot("o_orderpriority", "o_orderstatus", "o_totalprice", "sum", ["F", "O", "P"]).df
    return out.select("o_orderpriority", *[r2(F.col(c)).alias(c) for c in ("F", "O", "P")])


@query("SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def r2_melt(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return Frame(df).melt(["p_partkey"]).df


@query("SELECT item_id, unnest(string_split(text, ' ')) AS word FROM benchmark")
def r3_explode(spark, sf_dir):
    return Frame(table(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ").alias("word"))).explode("word").df


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def r4_intersect(spark, sf_dir):
    a, b = (Frame(table(spark, sf_dir, t).select(F.col(c).alias("k"))) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    return a.intersect(b).df


@query("SELECT o_orderkey AS k FROM orders EXCEPT ALL SELECT l_orderkey FROM lineitem")
def r4_difference(spark, sf_dir):
    a, b = (Frame(table(spark, sf_dir, t).select(F.col(c).alias("k"))) for t, c in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")))
    return a.difference(b).df


@query("SELECT p_partkey, p_retailprice * 1.5 + 2 AS p_retailprice FROM part")
def r5_apply(spark, sf_dir):
    return frame(spark, sf_dir, "part").select("p_partkey", "p_retailprice").apply("p_retailprice", lambda s: s * 1.5 + 2, "double").df


@query("SELECT n_nationkey, n_nationkey - (SELECT min(n_nationkey) FROM nation) AS d FROM nation")
def r5_apply_gathered(spark, sf_dir):
    return frame(spark, sf_dir, "nation").select("n_nationkey").apply_gathered(lambda df: df.assign(d=df["n_nationkey"] - df["n_nationkey"].min()), "n_nationkey int, d int").df


# strings, structs, lists
@query(r"""SELECT doc_id, upper(source) AS up, lower(lang) AS lo, length(text) AS n, contains(text, 'the') AS c, starts_with(text, 'A') AS s, ends_with(text, '.') AS e, replace(source, 'src', 'S-') AS r, source FROM documents""")
def x1_strings(spark, sf_dir):
    t = N.Str("text")
    return table(spark, sf_dir, "documents").select("doc_id", N.Str("source").upper().alias("up"), N.Str("lang").lower().alias("lo"), t.len().cast("long").alias("n"), t.contains("the").alias("c"), t.starts_with("A").alias("s"), t.ends_with(".").alias("e"), N.Str("source").replace("src", "S-").alias("r"), N.Str(F.concat(F.lit("\t "), "source", F.lit(" \n"))).trim().alias("source"))


@query("SELECT p_partkey, p_name AS name, p_size + 1 AS size FROM part")
def x9_structs(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", N.struct(name="p_name", size="p_size").alias("s"))
    return Frame(df).unnest("s").with_column("size", F.col("size") + 1).df


@query("SELECT vec_id, embedding[4] AS third, embedding[1000] AS none, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(embedding::DOUBLE[]), 6) AS s, round(list_avg(embedding::DOUBLE[]), 6) AS a, list_min(embedding) AS mn, list_max(embedding) AS mx FROM embeddings")
def x13_lists(spark, sf_dir):
    v = N.List("embedding")
    r = lambda c: F.round(c, 6)
    return table(spark, sf_dir, "embeddings").select("vec_id", v.get(3).alias("third"), v.get(999).alias("none"), v.len().alias("n"), r(v.sum()).alias("s"), r(v.mean()).alias("a"), v.min().alias("mn"), v.max().alias("mx"))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, embedding[1] AS first, embedding[64] AS last, round(list_sum(embedding::DOUBLE[]), 6) AS s FROM embeddings")
def x16_fixed_arrays(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings").select("vec_id", types.fixed_array(F.col("embedding"), 64).alias("a"))
    v = N.List("a")
    return a.select("vec_id", v.len().alias("n"), v.get(0).alias("first"), v.get(63).alias("last"), F.round(v.sum(), 6).alias("s"))


@query("SELECT o_orderkey, o_custkey AS k, o_totalprice AS x, '{\"k\":' || o_custkey || ',\"s\":' || CASE WHEN o_orderstatus = 'O' THEN 'null' ELSE '\"' || o_orderstatus || '\"' END || '}' AS row FROM orders")
def x10_struct_fields(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", N.struct(k="o_custkey", x="o_totalprice").alias("s"), N.struct(k="o_custkey", s=F.nullif("o_orderstatus", F.lit("O"))).alias("t"))
    return df.select("o_orderkey", N.field("s", "k").alias("k"), N.field("s", "x").alias("x"), N.row("t").alias("row"))


@query("SELECT user_id, list(event_id ORDER BY event_id) AS items, count(*) AS n FROM events GROUP BY 1")
def x12_list_build(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("items"), F.count(F.lit(1)).alias("n"))


# constructors
@query("SELECT * FROM (VALUES (1, 'a', CAST(1.5 AS DOUBLE), 0), (2, NULL, 2.0, 1), (3, 'c', NULL, 2)) t(k, name, x, place)")
def s2_from_columns(spark, sf_dir):
    df = construct.from_columns(spark, {"k": [1, 2, 3], "name": ["a", None, "c"], "x": [1.5, 2, None]}, order="place")
    return df.select(F.col("k").cast("int").alias("k"), "name", "x", F.col("place").cast("int").alias("place"))


@query("SELECT CAST(n AS BIGINT) AS n, age FROM (VALUES (1, CAST(30 AS BIGINT)), (2, NULL)) t(n, age)")
def s13_from_records(spark, sf_dir):
    return construct.from_records(spark, [{"n": 1, "age": 30}, {"n": 2}])


@query("""SELECT * FROM (VALUES ('Float64', CAST(3 AS BIGINT), CAST(1 AS BIGINT), CAST(4 AS DOUBLE)), ('Float32', 3, 1, 4), ('Int64', 3, 1, 4), ('Int32', 3, 1, 4), ('UInt64', 3, 1, 4), ('UInt32', 3, 1, 4),
('Bool', 3, 1, 2), ('String', 3, 1, NULL)) t(kind, n, nulls, total)""")
def s7_nullable_series(spark, sf_dir):
    """A series of each type with a mask of what is valid."""
    data = {"Bool": [True, False, True], "String": ["a", "b", "c"]}
    out = []
    for kind in ("Float64", "Float32", "Int64", "Int32", "UInt64", "UInt32", "Bool", "String"):
        df = construct.series(spark, "v", data.get(kind, [1, 2, 3]), kind, valid=[True, False, True])
        v = F.col("v").cast("int").cast("double") if kind == "Bool" else F.col("v").try_cast("double")
        out.append(df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), S.count_null("v").alias("nulls"), F.sum(v).alias("total")))
    return reduce(DataFrame.unionByName, out)


@query("""SELECT * FROM (VALUES ('Float64', true, true, false, true, false, false, 8), ('Float32', true, true, false, true, false, false, 4), ('Int64', true, false, true, true, false, false, 8), ('Int32', true, false, true, true, false, false, 4),
('UInt64', true, false, true, false, false, false, 8), ('Bool', false, false, false, false, false, false, 1), ('String', false, false, false, false, false, false, -1), ('DateTime', false, false, false, false, true, false, 8))
t(kind, is_numeric, is_float, is_integer, is_signed, is_temporal, is_nested, bytes)""")
def y1_types(spark, sf_dir):
    names = ("Float64", "Float32", "Int64", "Int32", "UInt64", "Bool", "String", "DateTime")
    tests = (types.is_numeric, types.is_float, types.is_integer, types.is_signed, types.is_temporal, types.is_nested)
    rows = [(k, *[t(types.DTYPES[k]) for t in tests], types.byte_size(k)) for k in names]
    return spark.createDataFrame(rows, "kind string, " + ", ".join(f"{t.__name__} boolean" for t in tests) + ", bytes int")


# files: written, and read again
def _round_trip(spark: SparkSession, df: DataFrame, write: Callable, read: Callable, label: str) -> DataFrame:
    path = scratch.new_folder(spark, label)
    write(df, path)
    return read(spark, path)


@query("SELECT c_custkey, c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS segment, c_acctbal > 0 AS owed FROM customer")
def s15_csv(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_acctbal", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), (F.col("c_acctbal") > 0).alias("owed"))
    return _round_trip(spark, df, lambda d, p: files.write_csv(d, p, delimiter=";", null_value="NA"), lambda s, p: files.read_csv(s, p, delimiter=";", null_values=("NA",)), "csv")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def s18_json(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return _round_trip(spark, df, files.write_json, lambda s, p: files.read_json(s, p, df.schema), "json")


@query("SELECT event_id, user_id, CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS event_type, value FROM events")
def s20_jsonl(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "user_id", F.nullif("event_type", F.lit("click")).alias("event_type"), "value")
    return _round_trip(spark, df, files.write_jsonl, lambda s, p: files.read_jsonl(s, p, df.schema), "jsonl")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def s22_parquet(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    write = lambda d, p: files.write_parquet(d, p, partition_by=["o_orderstatus"])
    return _round_trip(spark, df, write, lambda s, p: files.read_parquet(s, p, ["o_orderkey", "o_totalprice", "o_orderstatus"]), "parquet")


# integers, hashes and what else needs an entry of its own
@query("""SELECT event_id, CAST(CASE WHEN s > 9223372036854775807 THEN s - 18446744073709551616 ELSE s END AS BIGINT) AS a, -(event_id + 5) AS d, event_id * 3 AS m FROM
(SELECT event_id, CAST(event_id AS HUGEINT) + 9223372036854775000 AS s FROM events)""")
def e6_integers(spark, sf_dir):
    """64-bit integers wrap around at the ends."""
    big = F.lit(9223372036854775000)
    return table(spark, sf_dir, "events").select("event_id", S.wrapping("add", "event_id", big).alias("a"), S.wrapping("sub", F.lit(-5), "event_id").alias("d"), S.wrapping("mul", "event_id", F.lit(3)).alias("m"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN value END, CASE WHEN event_id % 3 = 0 THEN -value END, CAST(user_id AS DOUBLE)) AS v FROM events")
def e15_coalesce(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", S.coalesce(F.when(k % 2 == 0, F.col("value")), F.when(k % 3 == 0, -F.col("value")), F.col("user_id").cast("double")).alias("v"))


@query("SELECT event_id, CASE WHEN x IS NOT NULL THEN least(x, 50) END AS lo, CASE WHEN x IS NOT NULL THEN greatest(x, 50) END AS hi, abs(x - 50) AS d FROM (SELECT event_id, CASE WHEN event_id % 4 > 0 THEN value END AS x FROM events)")
def e25_literal_bounds(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 > 0, F.col("value")).alias("x"))
    return df.select("event_id", S.min_with("x", 50.0).alias("lo"), S.max_with("x", 50.0).alias("hi"), F.abs(F.col("x") - 50.0).alias("d"))


@query("SELECT o_orderkey, coalesce(s = 'F', false) AS same, coalesce(s <> 'F', false) AS other FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders)")
def f24_string_equality(spark, sf_dir):
    s = N.Str(F.nullif("o_orderstatus", F.lit("P")))
    return table(spark, sf_dir, "orders").select("o_orderkey", s.eq("F").alias("same"), s.ne("F").alias("other"))


@query("SELECT count(*) AS n, count(DISTINCT (o_custkey)) AS hashes, count(DISTINCT (o_custkey, o_orderstatus)) AS pairs, true AS ordered FROM orders")
def g17_hashes(spark, sf_dir):
    """Equal values have equal hashes, and different ones different hashes here."""
    h = lambda c: S.hash64(F.col(c))
    both, turned = S.combine_hashes(h("o_custkey"), h("o_orderstatus")), S.combine_hashes(h("o_orderstatus"), h("o_custkey"))
    return table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(h("o_custkey")).alias("hashes"), F.count_distinct(both).alias("pairs"), F.bool_and(both != turned).alias("ordered"))


@query("SELECT p_partkey, rank() OVER (ORDER BY p_size) AS r, dense_rank() OVER (ORDER BY p_size) AS d FROM part")
def w5_whole_ranks(spark, sf_dir):
    return frame(spark, sf_dir, "part").select("p_partkey", "p_size").with_rank("p_size", "r", "d").df.select("p_partkey", "r", "d")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events")
def w4_row_number_by_time(spark, sf_dir):
    """A key of time, made unique by the id."""
    df = table(spark, sf_dir, "events").select("event_id", F.struct("ts", "event_id").alias("k"))
    return W.cumulative(df, "k", {"rn": ("row_number", None)}).select("event_id", "rn")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 12")
def p20_limit(spark, sf_dir):
    return frame(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey").sort("o_orderkey").limit(12).df


# event time; the same functions take streams
@query("SELECT CAST(s AS TIMESTAMP) AS start, CAST(s AS TIMESTAMP) + INTERVAL '1 hour' AS \"end\", count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS s FROM events) GROUP BY 1, 2")
def t2_sliding(spark, sf_dir):
    out = stream.windowed(table(spark, sf_dir, "events"), "ts", "1 hour", "30 minutes")
    return out.withColumn("total", r4(F.col("total")))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '6 hours' THEN 0 ELSE 1 END AS b, event_id FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o)
SELECT min(ts) AS start, max(ts) + INTERVAL '6 hours' AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def t3_sessions(spark, sf_dir):
    return stream.sessions(table(spark, sf_dir, "events"), "ts", "6 hours", ("user_id",))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def t1_tumbling(spark, sf_dir):
    out = stream.windowed(table(spark, sf_dir, "events"), "ts", "1 hour", keys=("event_type",))
    return out.withColumn("total", r4(F.col("total")))
