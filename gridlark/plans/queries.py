"""The registered queries over arrays held as table columns, and the SQL each must agree with.

Computed doubles are rounded alike on both sides, as sums depend on the order in which partitions are added up."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlark.functions import cells, dates, distributions, special
from gridlark.functions import ufuncs as U
from gridlark.operators import graph, images, scan, sets, signal, solve, spatial, stats
from gridlark.operators import reduce as R
from gridlark.operators.nd import NDFrame, einsum
from gridlark.plans import families
from gridlark.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, digits: int = 6):
    return U.round_away(F.col(c) if isinstance(c, str) else c, digits)


# Element-wise

def _map(name: str, columns: dict[str, tuple[Callable, str]], source: str = "lineitem", keys: tuple[str, ...] = ("l_orderkey", "l_linenumber", "l_partkey")) -> None:
    """A query that maps each row of a table; columns: name -> (function of a column getter, SQL), both rounded alike."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return families.rounded(table(spark, sf_dir, source), keys, {n: c if isinstance(c := f(F.col), tuple) else (c, None) for n, (f, _) in columns.items()})

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT {', '.join(keys)}, {', '.join(f'{s} AS {n}' for n, (_, s) in columns.items())} FROM {source}"


def _r6(c, digits: int = 6) -> tuple:
    """A column of _map and what it is rounded to."""
    return c, digits


_map("ufunc_arithmetic", {
    "total": (lambda c: _r6(U.BINARY["multiply"](c("l_extendedprice"), 1 - c("l_discount")), 4), "round(l_extendedprice * (1 - l_discount), 4)"),
    "ratio": (lambda c: _r6(U.divide(c("l_extendedprice"), c("l_quantity"))), "round(l_extendedprice / l_quantity, 6)"),
    "by_zero": (lambda c: U.divide(c("l_quantity"), c("l_tax") * 0), "CASE WHEN l_quantity > 0 THEN 'inf'::DOUBLE END"),
    "floored": (lambda c: U.floor_divide(-c("l_quantity"), F.lit(4.0)), "floor(-l_quantity / 4.0)"),
    "rest": (lambda c: U.mod(-c("l_quantity"), F.lit(4.0)) + 0.0, "-l_quantity - floor(-l_quantity / 4.0) * 4.0"),
    "fmod": (lambda c: U.fmod(-c("l_quantity"), F.lit(4.0)) + 0.0, "(floor(l_quantity / 4.0) * 4.0 - l_quantity) + 0.0"),
    "clipped": (lambda c: U.clip(c("l_quantity"), 10, 40), "least(greatest(l_quantity, 10.0), 40.0)"),
    "sign": (lambda c: U.sign(c("l_quantity") - 25), "sign(l_quantity - 25)::DOUBLE"),
    "half_even": (lambda c: U.rint(c("l_quantity") / 2), "round_even(l_quantity / 2, 0)"),
})
_map("ufunc_exponential", {
    "exp": (lambda c: _r6(U.UNARY["exp"](c("l_quantity") / 10)), "round(exp(l_quantity / 10), 6)"),
    "log": (lambda c: _r6(U.log(c("l_extendedprice"))), "round(ln(l_extendedprice), 6)"),
    "log2": (lambda c: _r6(U.log2(c("l_extendedprice"))), "round(log2(l_extendedprice), 6)"),
    "log10": (lambda c: _r6(U.log10(c("l_extendedprice"))), "round(log10(l_extendedprice), 6)"),
    "log_zero": (lambda c: U.log(c("l_quantity") * 0), "'-inf'::DOUBLE"),
    "log1p": (lambda c: _r6(U.log1p(c("l_discount"))), "round(ln(1 + l_discount), 6)"),
    "sqrt": (lambda c: _r6(U.sqrt(c("l_extendedprice"))), "round(sqrt(l_extendedprice), 6)"),
    "cbrt": (lambda c: _r6(U.UNARY["cbrt"](c("l_quantity"))), "round(cbrt(l_quantity), 6)"),
    "power": (lambda c: _r6(U.power(c("l_quantity"), F.lit(1.5))), "round(pow(l_quantity, 1.5), 6)"),
})
_map("ufunc_trigonometric", {
    "sin": (lambda c: _r6(U.UNARY["sin"](c("l_quantity"))), "round(sin(l_quantity), 6)"),
    "cos": (lambda c: _r6(U.UNARY["cos"](c("l_quantity"))), "round(cos(l_quantity), 6)"),
    "arctan2": (lambda c: _r6(U.arctan2(c("l_quantity"), c("l_tax") + 1)), "round(atan2(l_quantity, l_tax + 1), 6)"),
    "hypot": (lambda c: _r6(U.BINARY["hypot"](c("l_quantity"), c("l_tax"))), "round(sqrt(l_quantity * l_quantity + l_tax * l_tax), 6)"),
    "radians": (lambda c: _r6(U.UNARY["radians"](c("l_quantity"))), "round(radians(l_quantity), 6)"),
    "tanh": (lambda c: _r6(U.UNARY["tanh"](c("l_discount"))), "round(tanh(l_discount), 6)"),
})
_map("ufunc_learning", {
    "sigmoid": (lambda c: _r6(U.sigmoid(c("l_quantity") - 25)), "round(1 / (1 + exp(-(l_quantity - 25))), 6)"),
    "relu": (lambda c: U.relu(c("l_quantity") - 25), "greatest(l_quantity - 25, 0.0)"),
    "gelu_tanh": (lambda c: _r6(U.gelu_tanh(c("l_quantity") / 25 - 1)), "round(0.5 * (l_quantity / 25 - 1) * (1 + tanh(sqrt(2 / pi()) * ((l_quantity / 25 - 1) + 0.044715 * pow(l_quantity / 25 - 1, 3)))), 6)"),
    "softplus": (lambda c: _r6(U.softplus(c("l_quantity") / 10)), "round(ln(1 + exp(l_quantity / 10)), 6)"),
    "entr": (lambda c: _r6(U.entr(c("l_discount"))), "round(CASE WHEN l_discount = 0 THEN 0.0 ELSE -l_discount * ln(l_discount) END, 6)"),
})
_map("ufunc_bits", {
    "conj": (lambda c: U.BINARY["bitwise_and"](c("l_partkey"), F.lit(255)), "l_partkey & 255"),
    "disj": (lambda c: U.BINARY["bitwise_or"](c("l_partkey"), F.lit(256)), "l_partkey | 256"),
    "excl": (lambda c: U.BINARY["bitwise_xor"](c("l_partkey"), F.lit(85)), "xor(l_partkey, 85)"),
    "shifted": (lambda c: U.left_shift(c("l_partkey"), 33), "l_partkey << 33"),
    "ones": (lambda c: U.UNARY["bitwise_count"](c("l_partkey")).cast("long"), "bit_count(l_partkey)::BIGINT"),
    "gcd": (lambda c: U.gcd(c("l_partkey"), c("l_suppkey")), "gcd(l_partkey, l_suppkey)"),
    "lcm": (lambda c: U.lcm(c("l_partkey"), c("l_suppkey")), "lcm(l_partkey, l_suppkey)"),
})
_map("where_select_choose", {
    "chosen": (lambda c: U.where(c("l_quantity") > 30, c("l_extendedprice"), c("l_tax")), "CASE WHEN l_quantity > 30 THEN l_extendedprice ELSE l_tax END"),
    "selected": (lambda c: U.select([c("l_quantity") < 10, c("l_quantity") < 20], [F.lit(1), F.lit(2)], F.lit(0)).cast("long"), "(CASE WHEN l_quantity < 10 THEN 1 WHEN l_quantity < 20 THEN 2 ELSE 0 END)::BIGINT"),
    "picked": (lambda c: U.choose(c("l_linenumber"), [c("l_quantity"), c("l_tax"), c("l_discount")], "wrap"), "list_extract([l_quantity, l_tax, l_discount], l_linenumber % 3 + 1)"),
})
_map("digitize", {"bin": (lambda c: sets.digitize(c("l_discount"), [0.02, 0.05, 0.08]), "((l_discount >= 0.02)::INT + (l_discount >= 0.05)::INT + (l_discount >= 0.08)::INT)::BIGINT")})

# Reductions


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS total, round(avg(l_extendedprice), 6) AS mean, min(l_extendedprice) AS low, max(l_extendedprice) AS high, max(l_extendedprice) - min(l_extendedprice) AS ptp, count(*) FILTER (WHERE l_tax <> 0) AS nonzero FROM lineitem GROUP BY ALL")
def reduce_by_axis(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus")
    p = "l_extendedprice"
    return df.agg(R.sum_("l_quantity").alias("total"), r6(R.mean(p)).alias("mean"), R.min_(p).alias("low"), R.max_(p).alias("high"), R.ptp(p).alias("ptp"), R.count_nonzero(F.col("l_tax")).alias("nonzero"))


@query("SELECT l_suppkey, round(var_pop(l_quantity), 6) AS var, round(stddev_pop(l_quantity), 6) AS std, round(var_samp(l_quantity), 6) AS var1 FROM lineitem GROUP BY ALL")
def var_std(spark, sf_dir):
    q = "l_quantity"
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(r6(R.var(q)).alias("var"), r6(R.std(q)).alias("std"), r6(R.var(q, 1)).alias("var1"))


@query("SELECT o_custkey, round(product(1 + ln(o_totalprice) / 100), 6) AS prod, bool_or(o_totalprice > 300000) AS any, bool_and(o_totalprice > 1000) AS all FROM orders GROUP BY ALL")
def prod_any_all(spark, sf_dir):
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(r6(R.prod(1 + F.log(p) / 100)).alias("prod"), R.any_((p > 300000).cast("int")).alias("any"), R.all_((p > 1000).cast("int")).alias("all"))


@query("SELECT l_suppkey, first(l_orderkey * 10 + l_linenumber ORDER BY l_extendedprice, l_orderkey * 10 + l_linenumber) AS lowest, first(l_orderkey * 10 + l_linenumber ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS highest FROM lineitem GROUP BY ALL")
def argmin_argmax(spark, sf_dir):
    at = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(R.argmin("l_extendedprice", at).alias("lowest"), R.argmax("l_extendedprice", at).alias("highest"))


_NAN = "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END"


@query(f"SELECT l_suppkey, round(sum({_NAN}), 2) AS nansum, round(avg({_NAN}), 6) AS nanmean, min({_NAN}) AS nanmin, max({_NAN}) AS nanmax, round(median({_NAN}), 6) AS nanmedian, round(stddev_pop({_NAN}), 5) AS nanstd, 'nan'::DOUBLE AS spread FROM lineitem GROUP BY ALL")
def nan_reductions(spark, sf_dir):
    v = F.when(F.col("l_linenumber") == 3, float("nan")).otherwise(F.col("l_extendedprice"))
    n = R.NAN_AWARE
    digits = {"nansum": 2, "nanmean": 6, "nanmin": 6, "nanmax": 6, "nanmedian": 6, "nanstd": 5}
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*(r6(n[k](v), d).alias(k) for k, d in digits.items()), R.min_(v).alias("spread"))


@query("SELECT l_returnflag, median(l_extendedprice) AS median, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY ALL")
def median_percentile(spark, sf_dir):
    out = scan.quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_extendedprice"), {"median": 0.5, "p10": 0.1, "p95": 0.95})
    return out.select("l_returnflag", "median", r6("p10").alias("p10"), r6("p95").alias("p95"))


@query(f"""WITH v AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS i, {_NAN} AS x FROM lineitem)
SELECT l_suppkey, first(i ORDER BY x, i) FILTER (WHERE x IS NOT NULL) AS nanargmin, first(i ORDER BY x DESC, i) FILTER (WHERE x IS NOT NULL) AS nanargmax, first(i ORDER BY x IS NOT NULL, x, i) AS argmin FROM v GROUP BY ALL""")
def nan_argmin(spark, sf_dir):
    v = F.when(F.col("l_linenumber") == 3, float("nan")).otherwise(F.col("l_extendedprice"))
    at = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    df = table(spark, sf_dir, "lineitem").groupBy("l_suppkey")
    return df.agg(R.NAN_AWARE["nanargmin"](v, at).alias("nanargmin"), R.NAN_AWARE["nanargmax"](v, at).alias("nanargmax"), R.argmin(v, at).alias("argmin"))


@query("SELECT l_suppkey, sum(l_orderkey * 1000000007 + 4503599627370497)::BIGINT AS total, min(l_orderkey * 9007199254740993) AS low, max(l_orderkey * 9007199254740993) AS high, sum((l_quantity > 25)::INT)::BIGINT AS large FROM lineitem GROUP BY ALL")
def sum_integers(spark, sf_dir):
    """Whole numbers beyond 2**53 stay exact; the products, which go beyond 64 bits from the key 1024 on, as decimals."""
    k, big = F.col("l_orderkey"), F.lit(Decimal(9007199254740993))
    df = table(spark, sf_dir, "lineitem").groupBy("l_suppkey")
    return df.agg(R.sum_(k * 1000000007 + F.lit(4503599627370497)).alias("total"), R.min_(k * big, whole=True).alias("low"), R.max_(k * big).alias("high"), R.sum_((F.col("l_quantity") > 25).cast("long")).alias("large"))


@query("SELECT l_suppkey, quantile_disc(l_quantity, 0.3) AS inverted FROM lineitem GROUP BY ALL")
def quantile_methods(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(R.quantile("l_quantity", 0.3, "inverted_cdf").alias("inverted"))


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS average FROM lineitem GROUP BY ALL")
def average_weighted(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(r6(R.average("l_extendedprice", "l_quantity")).alias("average"))


@query("""WITH d AS (SELECT l_returnflag, l_quantity AS x, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem)
SELECT l_returnflag, round(avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5), 6) AS skew, round(avg(pow(x - m, 4)) / pow(avg(pow(x - m, 2)), 2) - 3, 6) AS kurtosis, round(avg(pow(x - m, 2)), 6) AS var FROM d GROUP BY ALL""")
def moments(spark, sf_dir):
    m = R.moments("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*(r6(m[k]).alias(k) for k in ("skew", "kurtosis", "var")))


_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_pairs = lambda f: " UNION ALL ".join(f"SELECT {i}::INT AS i, {j}::INT AS j, round({f}({a}::DOUBLE, {b}::DOUBLE), 5) AS v FROM lineitem" for i, a in enumerate(_COLUMNS) for j, b in enumerate(_COLUMNS))


@query(_pairs("covar_samp").replace("round(covar_samp(l_extendedprice::DOUBLE, l_extendedprice::DOUBLE), 5)", "round(covar_samp(l_extendedprice::DOUBLE, l_extendedprice::DOUBLE) / 1e6, 5) * 1e6"))
def cov_matrix(spark, sf_dir):
    out = R.cov_matrix(table(spark, sf_dir, "lineitem"), _COLUMNS)
    large = (F.col("i") == 1) & (F.col("j") == 1)
    return out.select("i", "j", F.when(large, r6(F.col("v") / 1e6, 5) * 1e6).otherwise(r6("v", 5)).alias("v"))


@query(_pairs("corr"))
def corr_matrix(spark, sf_dir):
    return R.cov_matrix(table(spark, sf_dir, "lineitem"), _COLUMNS, correlation=True).select("i", "j", r6("v", 5).alias("v"))


# Sets, counting, histograms


@query("""WITH l AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem),
x AS (SELECT least(floor((l_extendedprice - a) / (b - a) * 10), 9)::BIGINT AS bin FROM lineitem, l)
SELECT r.bin, coalesce(n, 0) AS counts FROM range(10) r(bin) LEFT JOIN (SELECT bin, count(*) AS n FROM x GROUP BY bin) USING (bin)""")
def histogram_price(spark, sf_dir):
    return sets.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice").select("bin", F.col("counts").cast("long").alias("counts"))


@query("""WITH l AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem)
SELECT least(floor((l_quantity - a) / (b - a) * 7), 6)::BIGINT AS x_bin, least(floor((l_extendedprice - c) / (d - c) * 5), 4)::BIGINT AS y_bin, count(*) AS counts FROM lineitem, l GROUP BY ALL""")
def histogram2d(spark, sf_dir):
    return sets.histogram2d(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", (7, 5))


@query("SELECT r.bin, coalesce(n, 0) AS counts FROM range((SELECT max(l_linenumber) + 1 FROM lineitem)) r(bin) LEFT JOIN (SELECT l_linenumber::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1) USING (bin)")
def bincount(spark, sf_dir):
    return sets.bincount(table(spark, sf_dir, "lineitem"), "l_linenumber")


@query("SELECT r.bin, round(coalesce(n, 0.0), 2) AS counts FROM range((SELECT max(p_size) + 1 FROM part)) r(bin) LEFT JOIN (SELECT p_size::BIGINT AS bin, sum(p_retailprice) AS n FROM part GROUP BY 1) USING (bin)")
def bincount_weights(spark, sf_dir):
    return sets.bincount(table(spark, sf_dir, "part"), "p_size", weights="p_retailprice").select("bin", r6("counts", 2).alias("counts"))


@query("SELECT l_shipdate, count(*) AS counts FROM lineitem GROUP BY ALL")
def unique_counts(spark, sf_dir):
    return sets.unique(table(spark, sf_dir, "lineitem"), "l_shipdate")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def isin(spark, sf_dir):
    return sets.isin(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer").where("c_acctbal < 0"), "c_custkey").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def isin_inverted(spark, sf_dir):
    return sets.isin(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer").where("c_acctbal < 0"), "c_custkey", invert=True).select("o_orderkey")


def _set_query(name: str, sql: str) -> None:
    def run(spark, sf_dir):
        a, b = table(spark, sf_dir, "lineitem").where("l_quantity > 40"), table(spark, sf_dir, "lineitem").where("l_discount > 0.05")
        return getattr(sets, name)(a, "l_partkey", b, "l_partkey")

    QUERIES[name] = run
    a, b = "SELECT l_partkey AS value FROM lineitem WHERE l_quantity > 40", "SELECT l_partkey AS value FROM lineitem WHERE l_discount > 0.05"
    ORACLE_SQL[name] = sql.format(a=f"({a})", b=f"({b})")


_set_query("union1d", "{a} UNION {b}")
_set_query("intersect1d", "{a} INTERSECT {b}")
_set_query("setdiff1d", "{a} EXCEPT {b}")
_set_query("setxor1d", "({a} EXCEPT {b}) UNION ({b} EXCEPT {a})")


def _binned(statistic: str, sql: str) -> None:
    def run(spark, sf_dir):
        return sets.binned_statistic(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", statistic, 8).select("bin", r6(F.col("statistic").cast("double"), 4).alias("statistic"))

    QUERIES[f"binned_statistic_{statistic}"] = run
    ORACLE_SQL[f"binned_statistic_{statistic}"] = f"""WITH l AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem)
SELECT least(floor((l_quantity - a) / (b - a) * 8), 7)::BIGINT AS bin, round({sql}::DOUBLE, 4) AS statistic FROM lineitem, l GROUP BY 1"""


for _name, _sql in {"mean": "avg(l_extendedprice)", "sum": "sum(l_extendedprice)", "count": "count(*)", "std": "stddev_pop(l_extendedprice)", "min": "min(l_extendedprice)", "max": "max(l_extendedprice)", "median": "median(l_extendedprice)"}.items():
    _binned(_name, _sql)

# Order, scans and windows


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderkey), 2) AS cumsum FROM orders")
def cumsum(spark, sf_dir):
    return scan.cumsum(table(spark, sf_dir, "orders"), [F.col("o_orderkey")], F.col("o_totalprice")).select("o_orderkey", r6("cumsum", 2).alias("cumsum"))


@query("SELECT p_partkey, round(exp(sum(ln(1 + p_size / 1e6)) OVER (ORDER BY p_partkey)), 5) AS cumprod FROM part")
def cumprod(spark, sf_dir):
    return scan.cumprod(table(spark, sf_dir, "part"), [F.col("p_partkey")], 1 + F.col("p_size") / 1e6).select("p_partkey", r6("cumprod", 5).alias("cumprod"))


@query("SELECT o_orderkey, max(o_totalprice) OVER (ORDER BY o_orderkey) AS cummax FROM orders")
def cummax(spark, sf_dir):
    return scan.cummax(table(spark, sf_dir, "orders"), [F.col("o_orderkey")], F.col("o_totalprice")).select("o_orderkey", "cummax")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i FROM orders")
def argsort(spark, sf_dir):
    return scan.with_index(table(spark, sf_dir, "orders"), [F.col("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", "i")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_custkey DESC, o_orderkey) - 1 AS i FROM orders")
def lexsort(spark, sf_dir):
    return scan.with_index(table(spark, sf_dir, "orders"), [F.col("o_orderpriority"), F.col("o_custkey").desc(), F.col("o_orderkey")]).select("o_orderkey", "i")


_RANKS = {"average": "(rank() OVER w + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0)::DOUBLE", "min": "rank() OVER w", "max": "rank() OVER w + count(*) OVER (PARTITION BY l_quantity) - 1", "dense": "dense_rank() OVER w"}


def _rank(method: str, sql: str) -> None:
    def run(spark, sf_dir):
        return scan.rankdata(table(spark, sf_dir, "lineitem"), "l_quantity", "rank", method).select("l_orderkey", "l_linenumber", "l_partkey", "rank")

    QUERIES[f"rankdata_{method}"] = run
    ORACLE_SQL[f"rankdata_{method}"] = f"SELECT l_orderkey, l_linenumber, l_partkey, {sql} AS rank FROM lineitem WINDOW w AS (ORDER BY l_quantity)"


for _name, _sql in _RANKS.items():
    _rank(_name, _sql)


@query("SELECT DISTINCT l_quantity, round(cume_dist() OVER (ORDER BY l_quantity), 9) AS ecdf FROM lineitem")
def ecdf(spark, sf_dir):
    return scan.ecdf(table(spark, sf_dir, "lineitem"), "l_quantity").select("l_quantity", r6("ecdf", 9).alias("ecdf"))


@query("SELECT o_orderkey, (SELECT count(*) FROM (SELECT DISTINCT c_acctbal * 40 AS e FROM customer) WHERE e < o_totalprice) AS i FROM orders")
def searchsorted(spark, sf_dir):
    edges = table(spark, sf_dir, "customer").select((F.col("c_acctbal") * 40).alias("e")).distinct()
    return scan.searchsorted(edges, "e", table(spark, sf_dir, "orders"), "o_totalprice").select("o_orderkey", "i")


def seconds(ts: str):
    """Seconds since 1970 of a time without a zone, whatever the session's zone is."""
    return F.expr(f"cast(cast({ts} - TIMESTAMP_NTZ '1970-01-01 00:00:00' as interval second) as decimal(18, 6))").cast("double")


def _by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("SELECT event_id, round(value - lag(value) OVER w, 6) AS diff, round(value - 2 * lag(value) OVER w + lag(value, 2) OVER w, 6) AS diff2, round(sum(value) OVER w, 4) AS running FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def diff_by_user(spark, sf_dir):
    w, v = _by_user(), F.col("value")
    first = table(spark, sf_dir, "events").withColumn("d1", scan.diff(v, w))
    return first.select("event_id", r6("d1").alias("diff"), r6(F.col("d1") - F.lag("d1").over(w)).alias("diff2"), r6(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"))


@query("""WITH d AS (SELECT *, epoch_us(ts) / 1e6 AS x FROM events), e AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b, x - lag(x) OVER w AS h, lead(x) OVER w - x AS k FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(CASE WHEN a IS NULL THEN (b - value) / k WHEN b IS NULL THEN (value - a) / h ELSE (h * h * b + (k * k - h * h) * value - k * k * a) / (h * k * (h + k)) END, 4) AS gradient FROM e""")
def gradient(spark, sf_dir):
    x = seconds("ts")
    return table(spark, sf_dir, "events").withColumn("x", x).select("event_id", r6(scan.gradient(F.col("value"), F.col("x"), _by_user()), 4).alias("gradient"))


@query("SELECT user_id, round(sum((x - px) * (value + pv) / 2), 3) AS area FROM (SELECT user_id, value, epoch_us(ts) / 1e6 AS x, lag(value) OVER w AS pv, lag(epoch_us(ts) / 1e6) OVER w AS px FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY ALL")
def trapezoid(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("user_id", scan.trapezoid_parts(F.col("value"), seconds("ts"), _by_user()).alias("a"))
    return df.groupBy("user_id").agg(r6(F.sum("a"), 3).alias("area"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS uniform, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS minimum, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS maximum, median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS median FROM events")
def moving_filters(spark, sf_dir):
    w, names = _by_user(), {"uniform": "mean", "minimum": "min", "maximum": "max", "median": "median"}
    moving = {n: signal.moving("value", w, 2, 2, f) for n, f in names.items()}
    return table(spark, sf_dir, "events").select("event_id", r6(moving["uniform"]).alias("uniform"), *(moving[n].alias(n) for n in ("minimum", "maximum", "median")))


@query("SELECT event_id, round(0.5 * value + 0.3 * coalesce(lag(value) OVER w, 0) + 0.2 * coalesce(lag(value, 2) OVER w, 0), 6) AS y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def convolve_fir(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", r6(signal.fir("value", _by_user(), (0.5, 0.3, 0.2))).alias("y"))


@query("SELECT e.event_id, p.value AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def asof_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_purchase"))
    return scan.asof(e.select("event_id", "user_id", "ts"), right, "ts", ["user_id"], ["last_purchase"]).select("event_id", "last_purchase")


@query("""WITH k AS (SELECT p_partkey * 3.0::DOUBLE AS x, p_retailprice AS y FROM part), q AS (SELECT DISTINCT (l_partkey + l_suppkey)::DOUBLE AS x FROM lineitem)
SELECT q.x, round(CASE WHEN a.x IS NULL THEN b.y WHEN b.x IS NULL OR a.x = q.x THEN a.y ELSE a.y + (b.y - a.y) * (q.x - a.x) / (b.x - a.x) END, 6) AS y FROM q ASOF LEFT JOIN k a ON q.x >= a.x ASOF LEFT JOIN k b ON q.x <= b.x""")
def interp(spark, sf_dir):
    knots = table(spark, sf_dir, "part").select((F.col("p_partkey") * 3.0).alias("k"), "p_retailprice")
    points = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") + F.col("l_suppkey")).cast("double").alias("x")).distinct()
    return scan.interp(points, knots, "x", "k", "p_retailprice").select("x", r6("y").alias("y"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def partition_topk(spark, sf_dir):
    return sets.first_k(table(spark, sf_dir, "orders"), [F.desc("o_totalprice"), F.col("o_orderkey")], 100).select("o_orderkey", "o_totalprice")


# Arrays in long form

def _matrix(spark: SparkSession, sf_dir: str) -> NDFrame:
    """Embeddings as a matrix in long form."""
    df = table(spark, sf_dir, "embeddings")
    n, w = df.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    return NDFrame.from_cells(df, "vec_id", "embedding", w, n)


_LONG = "m AS (SELECT vec_id AS i0, unnest(range(len(embedding))) AS i1, unnest(embedding)::DOUBLE AS v FROM embeddings)"


@query(f"WITH {_LONG} SELECT (i0 - 10) // 3 AS i0, i1, v FROM m WHERE i0 >= 10 AND i0 < 100 AND (i0 - 10) % 3 = 0 AND i1 < 8")
def nd_slice(spark, sf_dir):
    return _matrix(spark, sf_dir)[10:100:3, :8].df


@query(f"WITH {_LONG} SELECT i1 AS i0, i0 AS i1, v FROM m")
def nd_transpose(spark, sf_dir):
    return _matrix(spark, sf_dir).transpose().df


@query(f"WITH {_LONG}, w AS (SELECT max(i1) + 1 AS w FROM m) SELECT (i0 * w + i1) // 16 AS i0, (i0 * w + i1) % 16 AS i1, v FROM m, w")
def nd_reshape(spark, sf_dir):
    return _matrix(spark, sf_dir).reshape(-1, 16).df


@query(f"WITH {_LONG}, c AS (SELECT i1, avg(v) AS a FROM m GROUP BY i1) SELECT i0, i1, round(v - a, 6) AS v FROM m JOIN c USING (i1)")
def nd_broadcast_subtract(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return (m - m.reduce(F.avg, 0)).map(r6).df


@query(f"WITH {_LONG} SELECT i1 AS i0, round(sqrt(sum(v * v)), 6) AS v FROM m GROUP BY i1")
def nd_axis_norm(spark, sf_dir):
    return _matrix(spark, sf_dir).map("square").reduce(F.sum, 0).map("sqrt").map(r6).df


@query(f"WITH {_LONG} SELECT a.i1 AS i0, b.i1, round(sum(a.v * b.v), 5) AS v FROM m a JOIN m b USING (i0) GROUP BY a.i1, b.i1")
def nd_gram_matmul(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return m.transpose().matmul(m).map(lambda v: r6(v, 5)).df


@query(f"WITH {_LONG} SELECT round(sum(v * v), 5) AS v FROM m")
def nd_einsum_full(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return einsum("ij,ij->", m, m).map(lambda v: r6(v, 5)).df


@query(f"WITH {_LONG} SELECT i0, (i1 + 3) % (SELECT max(i1) + 1 FROM m) AS i1, v FROM m")
def nd_roll(spark, sf_dir):
    return _matrix(spark, sf_dir).roll(3).df


@query(f"WITH {_LONG} SELECT i0, i1, v FROM m UNION ALL SELECT i0 + (SELECT max(i0) + 1 FROM m), i1, v FROM m")
def nd_concatenate(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return NDFrame.concatenate([m, m]).df


@query(f"WITH {_LONG} SELECT row_number() OVER (ORDER BY i0, i1) - 1 AS i0, v FROM m WHERE v > 0.3")
def nd_mask(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return m[m.map(lambda v: v > 0.3)].df


@query("SELECT i AS i0, j AS i1, (CASE WHEN i + 1 = j THEN 1 ELSE 0 END)::DOUBLE AS v FROM range(30) a(i), range(40) b(j)")
def nd_eye(spark, sf_dir):
    return NDFrame.eye(spark, 30, 40, 1).df


@query("SELECT i AS i0, round(2 + i * 0.25::DOUBLE, 9) AS v FROM range(41) a(i)")
def nd_linspace(spark, sf_dir):
    return NDFrame.linspace(spark, 2, 12, 41).map(lambda v: r6(v, 9)).df


# Statistics


def _row(spark: SparkSession, values: dict[str, float], digits: int = 6) -> DataFrame:
    return spark.createDataFrame([tuple(round(float(v), digits) for v in values.values())], ", ".join(f"{k} double" for k in values))


@query("SELECT count(l_quantity) AS nobs, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS variance FROM lineitem")
def describe(spark, sf_dir):
    return stats.describe(table(spark, sf_dir, "lineitem"), "l_quantity").select("nobs", "min", "max", r6("mean").alias("mean"), r6("variance").alias("variance"))


@query("SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS z FROM orders")
def zscore(spark, sf_dir):
    return stats.standardise(table(spark, sf_dir, "orders"), "o_totalprice").select("o_orderkey", r6("z").alias("z"))


_AGG = {"gmean": "exp(avg(ln(l_extendedprice)))", "hmean": "count(*) / sum(1 / l_extendedprice)", "sem": "stddev_samp(l_extendedprice) / sqrt(count(*))", "variation": "stddev_pop(l_extendedprice) / avg(l_extendedprice)", "iqr": "quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)", "gstd": "exp(stddev_samp(ln(l_extendedprice)))"}


@query(f"SELECT l_returnflag, {', '.join(f'round({s}, 5) AS {k}' for k, s in _AGG.items())} FROM lineitem GROUP BY ALL")
def summary_statistics(spark, sf_dir):
    return stats.summarise(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", list(_AGG)).select("l_returnflag", *(r6(k, 5).alias(k) for k in _AGG))


@query("WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY n DESC) AS r FROM c) SELECT p_brand, min(p_size) AS mode FROM r WHERE r = 1 GROUP BY p_brand")
def mode(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(stats.AGGREGATES["mode"](F.col("p_size")).alias("mode"))


@query("WITH m AS (SELECT l_returnflag, median(l_extendedprice) AS md FROM lineitem GROUP BY ALL) SELECT l_returnflag, round(median(abs(l_extendedprice - md)), 5) AS mad FROM lineitem JOIN m USING (l_returnflag) GROUP BY ALL")
def median_abs_deviation(spark, sf_dir):
    return stats.median_abs_deviation(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"]).select("l_returnflag", r6("mad", 5).alias("mad"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(corr(l_extendedprice, l_quantity), 6) AS rvalue FROM lineitem")
def linregress(spark, sf_dir):
    fit = stats.linregress(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return spark.createDataFrame([(round(fit["slope"], 5), round(fit["intercept"], 4), round(fit["rvalue"], 6))], "slope double, intercept double, rvalue double")


@query("SELECT round(corr(l_extendedprice, l_discount), 6) AS r FROM lineitem")
def pearsonr(spark, sf_dir):
    return _row(spark, {"r": stats.pearsonr(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_discount")[0]})


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT round(corr(a, b), 6) AS rho FROM r")
def spearmanr(spark, sf_dir):
    return _row(spark, {"rho": stats.spearmanr(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")[0]})


_PART = "(SELECT count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = '{}')"


@query(f"SELECT round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t FROM {_PART.format('A')} a, {_PART.format('R')} b")
def ttest_welch(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return _row(spark, {"t": stats.ttest_ind(df.where("l_returnflag = 'A'"), "l_extendedprice", df.where("l_returnflag = 'R'"), "l_extendedprice", equal_var=False)[0]})


@query("SELECT round((avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))), 6) AS t FROM lineitem")
def ttest_1samp(spark, sf_dir):
    return _row(spark, {"t": stats.ttest_1samp(table(spark, sf_dir, "lineitem"), "l_quantity", 25.0)[0]})


@query("""WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS v FROM lineitem GROUP BY 1)
SELECT round(((sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 5) AS f FROM g""")
def f_oneway(spark, sf_dir):
    return _row(spark, {"f": stats.f_oneway(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")[0]}, 5)


@query("""WITH r AS (SELECT l_returnflag AS g, l_quantity AS x, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r FROM lineitem),
g AS (SELECT sum(r) AS s, count(*) AS n FROM r GROUP BY g), t AS (SELECT sum(c * c * c - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY x)), n AS (SELECT sum(n)::DOUBLE AS n FROM g)
SELECT round((12 / (n.n * (n.n + 1)) * sum(s * s / g.n) - 3 * (n.n + 1)) / (1 - t / (n.n * n.n * n.n - n.n)), 5) AS h FROM g, t, n GROUP BY n.n, t""")
def kruskal(spark, sf_dir):
    return _row(spark, {"h": stats.kruskal(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")[0]}, 5)


@query("""WITH r AS (SELECT l_returnflag AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r FROM lineitem WHERE l_returnflag IN ('A', 'R'))
SELECT round(sum(r) - count(*) * (count(*) + 1) / 2.0, 3) AS u FROM r WHERE g = 'A'""")
def mannwhitneyu(spark, sf_dir):
    return _row(spark, {"u": stats.mannwhitneyu(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "A", "R")[0]}, 3)


@query("""WITH o AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL), e AS (SELECT a, b, n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS e FROM o)
SELECT round(sum((n - e) * (n - e) / e), 5) AS chi2, ((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1))::BIGINT AS dof FROM e""")
def chi2_contingency(spark, sf_dir):
    t, _, free = stats.chi2_contingency(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")
    return spark.createDataFrame([(round(t, 5), free)], "chi2 double, dof long")


_STEPS = """WITH v AS (SELECT l_quantity AS v, l_returnflag AS g FROM lineitem WHERE l_returnflag IN ('A', 'R')), c AS (SELECT v, count(*) FILTER (WHERE g = 'A') AS a, count(*) FILTER (WHERE g = 'R') AS r FROM v GROUP BY v),
f AS (SELECT v, sum(a) OVER (ORDER BY v) / (SELECT sum(a) FROM c) AS fa, sum(r) OVER (ORDER BY v) / (SELECT sum(r) FROM c) AS fr, lead(v) OVER (ORDER BY v) - v AS w FROM c)"""


def _two(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.where("l_returnflag = 'A'"), "l_quantity", df.where("l_returnflag = 'R'"), "l_quantity"


@query(f"{_STEPS} SELECT round(max(abs(fa - fr)), 9) AS d FROM f")
def ks_2samp(spark, sf_dir):
    return _row(spark, {"d": stats.ks_2samp(*_two(spark, sf_dir))[0]}, 9)


@query(f"{_STEPS} SELECT round(sum(abs(fa - fr) * w), 9) AS d FROM f")
def wasserstein_distance(spark, sf_dir):
    return _row(spark, {"d": stats.wasserstein_distance(*_two(spark, sf_dir))}, 9)


@query(f"{_STEPS} SELECT round(sqrt(2 * sum((fa - fr) * (fa - fr) * w)), 9) AS d FROM f")
def energy_distance(spark, sf_dir):
    return _row(spark, {"d": stats.energy_distance(*_two(spark, sf_dir))}, 9)


@query("WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT n / sum(n) OVER () AS p FROM c) SELECT round(-sum(p * ln(p)), 9) AS entropy FROM p")
def entropy(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return _row(spark, {"entropy": stats.entropy(counts, "n")}, 9)


@query("SELECT round(avg(l_quantity), 6) AS m FROM (SELECT l_quantity, row_number() OVER (ORDER BY l_quantity) AS r, count(*) OVER () AS n FROM lineitem) WHERE r > floor(n * 0.1) AND r <= n - floor(n * 0.1)")
def trim_mean(spark, sf_dir):
    return _row(spark, {"m": stats.trim_mean(table(spark, sf_dir, "lineitem"), "l_quantity", 0.1)})


_L = "(SELECT l_returnflag AS g, l_quantity AS q, l_discount AS d, l_tax AS t, l_discount - l_tax AS e FROM lineitem)"


@query(f"""WITH g AS (SELECT g, count(*)::DOUBLE AS n, var_samp(q) AS v FROM {_L} GROUP BY g),
b AS (SELECT ((sum(n) - count(*)) * ln(sum((n - 1) * v) / (sum(n) - count(*))) - sum((n - 1) * ln(v))) / (1 + (sum(1 / (n - 1)) - 1 / (sum(n) - count(*))) / (3 * (count(*) - 1))) AS bartlett FROM g),
m AS (SELECT avg(q) AS m, var_pop(q) AS v, count(*)::DOUBLE AS n FROM {_L}), k AS (SELECT avg(pow(q - m, 3)) / any_value(pow(v, 1.5)) AS s, avg(pow(q - m, 4)) / any_value(v * v) - 3 AS k, avg(pow(q - m, 3)) AS m3, any_value(n) AS n FROM {_L}, m),
z AS (SELECT g, abs(q - avg(q) OVER (PARTITION BY g)) AS z FROM {_L}), zg AS (SELECT count(*)::DOUBLE AS n, avg(z) AS m, var_pop(z) AS v FROM z GROUP BY g),
r AS (SELECT e, rank() OVER (ORDER BY abs(e)) + (count(*) OVER (PARTITION BY abs(e)) - 1) / 2.0 AS r FROM {_L} WHERE e <> 0),
u AS (SELECT q, (sum(count(*)) OVER (ORDER BY q))::DOUBLE AS upto, count(*) AS c, sum(count(*)) OVER () AS n FROM {_L} GROUP BY q),
w AS (SELECT g, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0 AS r, count(*) OVER () AS n FROM {_L} WHERE g IN ('A', 'R')), wa AS (SELECT sum(r) AS s, count(*)::DOUBLE AS a, any_value(n)::DOUBLE AS n FROM w WHERE g = 'A')
SELECT round(bartlett, 5) AS bartlett, round(k.n / 6 * (s * s + k * k / 4), 4) AS jarque_bera, round(m3, 4) AS moment3,
(SELECT round(((sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 5) FROM zg) AS levene,
(SELECT round(avg(e) / (stddev_samp(e) / sqrt(count(*))), 6) FROM {_L}) AS ttest_rel,
(SELECT least(sum(r) FILTER (WHERE e > 0), sum(r) FILTER (WHERE e < 0)) FROM r) AS wilcoxon,
(SELECT round(max(greatest(upto / n - q / 51, q / 51 - (upto - c) / n)), 9) FROM u) AS ks_1samp,
(SELECT round((s - a * (n + 1) / 2) / sqrt(a * (n - a) * (n + 1) / 12), 6) FROM wa) AS ranksums,
(SELECT round(100e0 * (count(*) FILTER (WHERE q < 25) + count(*) FILTER (WHERE q <= 25) + (count(*) FILTER (WHERE q = 25) > 0)::INT) / 2 / count(*), 6) FROM {_L}) AS percentileofscore,
(SELECT round(corr((q > 25)::INT::DOUBLE, d), 6) FROM {_L}) AS pointbiserialr FROM b, k""")
def stat_tests(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    marked = df.withColumn("high", (F.col("l_quantity") > 25).cast("int").cast("double"))
    out = {
        "bartlett": (stats.bartlett(df, "l_returnflag", "l_quantity")[0], 5), "jarque_bera": (stats.jarque_bera(df, "l_quantity")[0], 4), "moment3": (stats.moment(df, "l_quantity", 3), 4), "levene": (stats.levene(df, "l_returnflag", "l_quantity", "mean")[0], 5),
        "ttest_rel": (stats.ttest_rel(df, "l_discount", "l_tax")[0], 6), "wilcoxon": (stats.wilcoxon(df, "l_discount", "l_tax")[0], 1), "ks_1samp": (stats.ks_1samp(df, "l_quantity", F.col("v") / 51)[0], 9), "ranksums": (stats.ranksums(df, "l_returnflag", "l_quantity", "A", "R")[0], 6),
        "percentileofscore": (stats.percentileofscore(df, "l_quantity", 25.0), 6), "pointbiserialr": (stats.pointbiserialr(marked, "high", "l_discount")[0], 6),
    }
    return spark.createDataFrame([tuple(round(float(v), d) for v, d in out.values())], ", ".join(f"{k} double" for k in out))


_MORE = {"tmean": "avg(x)", "tvar": "var_samp(x)", "tstd": "stddev_samp(x)", "tmin": "min(x)", "tmax": "max(x)", "tsem": "stddev_samp(x) / sqrt(count(*))", "circmean": "(atan2(sum(sin(x)), sum(cos(x))) + 4 * pi()) % (2 * pi())", "circvar": "1 - sqrt(pow(avg(sin(x)), 2) + pow(avg(cos(x)), 2))", "circstd": "sqrt(-2 * ln(sqrt(pow(avg(sin(x)), 2) + pow(avg(cos(x)), 2))))"}


@query(f"SELECT l_suppkey, {', '.join(f'round({q}, 6) AS {k}' for k, q in _MORE.items())}, round(pow(avg(pow(x, 3)), 1 / 3e0), 6) AS pmean FROM (SELECT l_suppkey, l_quantity AS x FROM lineitem) GROUP BY ALL")
def summary_more(spark, sf_dir):
    x = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*(r6(stats.AGGREGATES[k](x)).alias(k) for k in _MORE), r6(stats.pmean(x, 3.0)).alias("pmean"))


@query("""WITH l AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d, min(l_tax) AS e, max(l_tax) AS f FROM lineitem)
SELECT least(floor((l_quantity - a) / (b - a) * 7), 6)::BIGINT AS bin0, least(floor((l_extendedprice - c) / (d - c) * 5), 4)::BIGINT AS bin1, least(floor((l_tax - e) / (f - e) * 3), 2)::BIGINT AS bin2, count(*) AS counts FROM lineitem, l GROUP BY ALL""")
def histogramdd(spark, sf_dir):
    return sets.histogramdd(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], [7, 5, 3])


@query("SELECT o_orderkey, min(o_totalprice) OVER (ORDER BY o_orderkey) AS cummin FROM orders")
def cummin(spark, sf_dir):
    return scan.cummin(table(spark, sf_dir, "orders"), [F.col("o_orderkey")], F.col("o_totalprice")).select("o_orderkey", "cummin")


@query(f"WITH {_LONG} SELECT i0, i1, v::BIGINT AS whole, v > 0 AS up, CASE WHEN v > 0 THEN 1e0 ELSE v END AS put FROM (SELECT i0, i1, trunc(v * 100) AS v FROM m)")
def nd_types(spark, sf_dir):
    """Elements cut to whole numbers, compared, and assigned where they are positive."""
    m = (_matrix(spark, sf_dir) * 100.0).astype("int64")
    up = m > 0
    put = m.astype("float64").where_set(up, 1.0)
    whole = m.df.withColumnRenamed("v", "whole")
    return whole.join(up.df.withColumnRenamed("v", "up"), ["i0", "i1"]).join(put.df.withColumnRenamed("v", "put"), ["i0", "i1"])


# Linear algebra, space, graphs


def _pairs_sql(expression: str) -> str:
    return f"SELECT a.vec_id AS i, b.vec_id AS j, round({expression}, 5) AS d FROM embeddings a, embeddings b WHERE a.vec_id < b.vec_id"


def _distance(metric: str, expression: str) -> None:
    def run(spark, sf_dir):
        return spatial.pdist(table(spark, sf_dir, "embeddings"), "embedding", metric).select("i", "j", r6("d", 5).alias("d"))

    QUERIES[f"pdist_{metric}"] = run
    ORACLE_SQL[f"pdist_{metric}"] = _pairs_sql(expression)


_A, _B = "a.embedding::DOUBLE[]", "b.embedding::DOUBLE[]"
_distance("euclidean", f"list_distance({_A}, {_B})")
_distance("cosine", f"1 - list_cosine_similarity({_A}, {_B})")
_distance("cityblock", f"list_sum(list_transform(list_zip({_A}, {_B}), lambda x: abs(x[1] - x[2])))")
_distance("chebyshev", f"list_max(list_transform(list_zip({_A}, {_B}), lambda x: abs(x[1] - x[2])))")


@query("SELECT i, j, d FROM (SELECT a.vec_id AS i, b.vec_id AS j, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS r FROM embeddings a, embeddings b) WHERE r <= 5")
def knn(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    return spatial.knn(df, df, "embedding", 5).select("i", "j", r6("d", 5).alias("d"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts of all lines, as an undirected graph."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") + 1_000_000).alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_tax").alias("w"))


_EDGES = "e AS (SELECT l_partkey + 1000000 AS src, l_suppkey AS dst, l_tax AS w FROM lineitem), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


@query(f"""WITH RECURSIVE {_EDGES}, r(v, component) USING KEY (v) AS (SELECT DISTINCT src, src FROM b
UNION SELECT b.dst, min(r.component) FROM r JOIN b ON r.v = b.src JOIN recurring.r o ON o.v = b.dst WHERE r.component < o.component GROUP BY b.dst) SELECT v, component FROM r""")
def connected_components(spark, sf_dir):
    return graph.connected_components(_edges(spark, sf_dir))


@query(f"WITH {_EDGES}, u AS (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e), d AS (SELECT src, sum(w) AS d FROM u GROUP BY src) SELECT src AS i, src AS j, round(d, 6) AS v FROM d UNION ALL SELECT src, dst, round(-sum(w), 6) FROM u GROUP BY src, dst")
def laplacian(spark, sf_dir):
    e = _edges(spark, sf_dir).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return graph.laplacian(e).select("i", "j", r6("v").alias("v"))


@query(f"WITH {_EDGES} SELECT src AS v, count(*) AS degree FROM (SELECT src FROM e UNION ALL SELECT dst FROM e) GROUP BY src")
def degrees(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


@query("""WITH a AS (SELECT c_nationkey::BIGINT AS i, c_custkey % 10 AS j, sum(c_acctbal) AS v FROM customer GROUP BY ALL) SELECT x.i, y.i AS j, round(sum(x.v * y.v) / 1e6, 4) AS v FROM a x JOIN a y USING (j) GROUP BY x.i, y.i""")
def sparse_matmul(spark, sf_dir):
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("i"), (F.col("c_custkey") % 10).alias("j")).agg(F.sum("c_acctbal").alias("v"))
    return graph.matmul(a, graph.transpose(a)).select("i", "j", r6(F.col("v") / 1e6, 4).alias("v"))


@query("SELECT nation_of AS s, hops::INT AS depth FROM (SELECT n_nationkey AS nation_of, CASE WHEN n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 0) THEN CASE WHEN n_nationkey = 0 THEN 0 ELSE 2 END ELSE NULL END AS hops FROM nation) WHERE hops IS NOT NULL")
def breadth_first(spark, sf_dir):
    e = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"), (F.col("n_regionkey") + 1000).alias("dst"))
    return graph.breadth_first(e, 0).where("v < 1000").select(F.col("v").alias("s"), "depth")


@query()
def kmeans(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    start = [r.embedding for r in df.orderBy("vec_id").limit(4).collect()]
    book, _ = spatial.kmeans(df, "embedding", start)
    return spatial.vq(df, "embedding", book).select("vec_id", "code", r6("dist", 4).alias("dist"))


@query()
def pca(spark, sf_dir):
    values, _ = spatial.pca(table(spark, sf_dir, "embeddings"), "embedding", 8)
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(values)], "component int, variance double")


@query()
def value_iteration(spark, sf_dir):
    """Regions as states and order priorities as actions; nations' shares are the chances."""
    t = spark.range(5).selectExpr("cast(id as int) s").crossJoin(spark.range(3).selectExpr("cast(id as int) a")).crossJoin(spark.range(5).selectExpr("cast(id as int) s2"))
    t = t.withColumn("w", 1 + F.pmod(F.col("s") * 7 + F.col("a") * 3 + F.col("s2") * 5, F.lit(11)))
    t = t.join(t.groupBy("s", "a").agg(F.sum("w").alias("all")), ["s", "a"]).select("s", "a", "s2", (F.col("w") / F.col("all")).alias("p"))
    r = t.select("s", "a").distinct().withColumn("r", F.pmod(F.col("s") * 3 + F.col("a") * 5, F.lit(7)).cast("double"))
    return graph.value_iteration(t, r, 0.5, tol=1e-6).select("s", r6("value", 4).alias("value"), "action")


# Cells, special functions and distributions


def _cells(name: str, kernel: str, sql: str, **options) -> None:
    def run(spark, sf_dir):
        v = F.transform("embedding", lambda x: x.cast("double"))
        return table(spark, sf_dir, "embeddings").select("vec_id", r6(cells.apply(kernel, v, **options), 5).alias("y"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT vec_id, round({sql}, 5) AS y FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"


_cells("cell_mean", "mean", "list_aggregate(e, 'avg')")
_cells("cell_std", "std", "list_aggregate(e, 'stddev_pop')")
_cells("cell_median", "median", "list_aggregate(e, 'median')")
_cells("cell_ptp", "ptp", "list_aggregate(e, 'max') - list_aggregate(e, 'min')")
_cells("cell_percentile", "percentile", "list_aggregate(e, 'quantile_cont', 0.9)", q=90)
_cells("cell_norm", "linalg.norm", "sqrt(list_inner_product(e, e))")


def _vectors(name: str, kernel: str, sql: str, **options) -> None:
    """Each element of a cell's result as a row."""

    def run(spark, sf_dir):
        v = F.transform("embedding", lambda x: x.cast("double"))
        return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(cells.apply(kernel, v, **options)).alias("k", "y")).select("vec_id", F.col("k").cast("long").alias("k"), r6("y", 5).alias("y"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), y AS (SELECT vec_id, {sql} AS y FROM e) SELECT vec_id, unnest(range(len(y))) AS k, round(unnest(y), 5) AS y FROM y"


_vectors("cell_sort", "sort", "list_sort(e)")
_vectors("cell_cumsum", "cumsum", "list_transform(range(1, len(e) + 1), lambda i: list_sum(list_slice(e, 1, i)))")
_vectors("cell_diff", "diff", "list_transform(range(1, len(e)), lambda i: e[i + 1] - e[i])")
_vectors("cell_flip", "flip", "list_reverse(e)")
_vectors("cell_convolve", "convolve", "list_transform(range(1, len(e) + 2), lambda i: 0.5 * coalesce(e[i], 0) + 0.25 * (CASE WHEN i > 1 THEN e[i - 1] ELSE 0 END))", v=[0.5, 0.25])


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(lgamma(l_quantity), 6) AS gammaln, round(gamma(l_discount + 1), 6) AS gamma FROM lineitem")
def special_gamma(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", r6(special.column("gammaln", F.col("l_quantity"))).alias("gammaln"), r6(special.column("gamma", F.col("l_discount") + 1)).alias("gamma"))


def _law(name: str, law: str, shape: tuple, x: str, sql: str, method: str = "cdf", **place) -> None:
    def run(spark, sf_dir):
        frozen = distributions.Frozen(law, *shape, **place)
        return table(spark, sf_dir, "part").select("p_partkey", r6(frozen.column(method, F.expr(x)), 7).alias("y"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT p_partkey, round({sql}, 7) AS y FROM (SELECT p_partkey, {x} AS x FROM part)"


_law("law_expon_cdf", "expon", (), "p_size / 10.0", "1 - exp(-x / 2.0)", scale=2.0)
_law("law_logistic_cdf", "logistic", (), "p_size / 10.0", "1 / (1 + exp(-(x - 1.0)))", loc=1.0)
_law("law_weibull_pdf", "weibull_min", (1.5,), "p_size / 10.0", "1.5 * sqrt(x) * exp(-pow(x, 1.5))", "pdf")
_law("law_norm_pdf", "norm", (), "p_size / 10.0", "exp(-x * x / 2) / sqrt(2 * pi())", "pdf")
_law("law_cauchy_cdf", "cauchy", (), "p_size / 10.0", "0.5 + atan(x) / pi()")
_law("law_pareto_ppf", "pareto", (3.0,), "p_size / 51e0", "pow(1 - x, -1 / 3e0)", "ppf")
_law("law_geom_cdf", "geom", (0.1,), "p_size", "1 - pow(0.9, x)")
_law("law_poisson_pmf", "poisson", (20.0,), "p_size", "exp(x * ln(20.0) - 20.0 - lgamma(x + 1))", "pmf")

# Dates, time windows, labels


@query("""WITH d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders) SELECT d, count(*) FILTER (WHERE isodow(t) < 6) AS n FROM (SELECT d, unnest(generate_series(DATE '1992-01-01', d - 1, INTERVAL 1 DAY)) AS t FROM d) GROUP BY d""")
def busday_count(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return days.select("d", dates.busday_count(F.lit("1992-01-01").cast("date"), F.col("d")).alias("n"))


@query("SELECT o_orderkey, (year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1 AS months, isodow(o_orderdate) < 6 AS works FROM orders")
def date_parts(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.months(d).alias("months"), dates.is_busday(d).alias("works"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(value) AS count, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM events GROUP BY 1")
def windowed_statistics(spark, sf_dir):
    out = incremental.windowed_statistics(table(spark, sf_dir, "events"), "ts", "value", "1 hour")
    return out.select("start", "count", r6("mean").alias("mean"), "min", "max")


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS count, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    out = incremental.sessions(table(spark, sf_dir, "events"), "ts", ["user_id"], "6 hours", "value")
    return out.select("user_id", "start", "count", r6("total", 4).alias("total"))


@query("SELECT event_type AS label, count(*) AS count, round(sum(value), 4) AS sum, round(avg(value), 6) AS mean, round(var_pop(value), 5) AS variance, min(value) AS min, max(value) AS max, round(median(value), 6) AS median FROM events GROUP BY 1")
def label_statistics(spark, sf_dir):
    out = images.label_statistics(table(spark, sf_dir, "events"), "event_type", "value")
    return out.select("label", "count", r6("sum", 4).alias("sum"), r6("mean").alias("mean"), r6("variance", 5).alias("variance"), "min", "max", r6("median").alias("median"))


@query("SELECT p_partkey, round(2 + p_size::DOUBLE * (0.5 + p_size * (-0.25 + p_size * 0.01)), 6) AS y FROM part")
def polyval(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", r6(U.polyval([0.01, -0.25, 0.5, 2.0], F.col("p_size"))).alias("y"))


@query("SELECT i0, i1, v FROM (SELECT i AS i0, j AS i1, (CASE WHEN j - 2 BETWEEN 0 AND 4 THEN i * 5 + j - 2 ELSE -1 END)::DOUBLE AS v FROM range(4) a(i), range(9) b(j))")
def nd_pad(spark, sf_dir):
    return NDFrame.arange(spark, 0, 20).map(lambda v: v.cast("double")).reshape(4, 5).pad(2, 2, 1, "constant", -1.0).df


@query("SELECT i AS i0, j AS i1, (i * 5 + j % 5)::DOUBLE AS v FROM range(4) a(i), range(15) b(j)")
def nd_tile(spark, sf_dir):
    return NDFrame.arange(spark, 0, 20).map(lambda v: v.cast("double")).reshape(4, 5).tile(3, 1).df


@query("SELECT i AS i0, round(sum((i + 1)::DOUBLE * (j + 1) * k), 6) AS v FROM range(6) a(i), range(5) b(j), range(4) c(k) GROUP BY i")
def nd_einsum_three(spark, sf_dir):
    a, b, c = (NDFrame.arange(spark, 1, 7).map(lambda v: v.cast("double")), NDFrame.arange(spark, 1, 6).map(lambda v: v.cast("double")), NDFrame.arange(spark, 0, 4).map(lambda v: v.cast("double")))
    return einsum("i,j,k->i", a, b, c).map(r6).df


# Signals and solvers


@query("""WITH v AS (SELECT user_id, value - avg(value) OVER (PARTITION BY user_id) AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS j, count(*) OVER (PARTITION BY user_id) AS n FROM events),
k AS (SELECT DISTINCT user_id, unnest(range(n // 2 + 1)) AS k FROM v)
SELECT user_id, k, round((pow(sum(x * cos(2 * pi() * ((j * k) % n) / n)), 2) + pow(sum(x * sin(2 * pi() * ((j * k) % n) / n)), 2)) / 1000, 3) AS power FROM v JOIN k USING (user_id) GROUP BY ALL""")
def rfft_by_user(spark, sf_dir):
    """Power of each user's values by frequency."""
    return signal.by_group(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", _power, "power").select("user_id", "k", (r6(F.col("power") / 1000, 3) + 0.0).alias("power"))


def _power(v):
    import numpy as np

    return np.abs(np.fft.rfft(v - v.mean())) ** 2


@query()
def savgol_by_user(spark, sf_dir):
    return signal.by_group(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", lambda v: signal.savgol_filter(v, 5, 2) if len(v) >= 5 else v).select("user_id", "k", r6("y", 4).alias("y"))


@query()
def cubic_spline(spark, sf_dir):
    knots = table(spark, sf_dir, "part").groupBy("p_size").agg(F.avg("p_retailprice").alias("y")).orderBy("p_size").collect()  # at most fifty sizes
    spline = solve.Cubic([r.p_size for r in knots], [r.y for r in knots], "natural")
    points = spark.range(0, 400).select((1 + F.col("id") / 10.0).alias("x")).where(f"x <= {knots[-1].p_size}")
    return points.select("x", r6(spline.column(F.col("x")), 4).alias("y"))


@query("""WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
SELECT 0 AS k, round(a, 3) AS weight FROM s UNION ALL SELECT 1, round(b, 3) FROM s""")
def least_squares(spark, sf_dir):
    w = spatial.lstsq(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(k, round(float(v), 3)) for k, v in enumerate(w)], "k int, weight double")


@query()
def minimum_spanning_tree(spark, sf_dir):
    return graph.minimum_spanning_tree(_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {_EDGES}, u AS (SELECT src, dst, min(w) + 1 AS w FROM (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY ALL),
r(v, distance) USING KEY (v) AS (SELECT min(src), 0.0::DOUBLE FROM u UNION SELECT u.dst, min(r.distance + u.w) FROM r JOIN u ON r.v = u.src LEFT JOIN recurring.r o ON o.v = u.dst WHERE o.v IS NULL OR r.distance + u.w < o.distance GROUP BY u.dst)
SELECT (SELECT min(src) FROM u) AS source, v, round(distance, 6) AS distance FROM r""")
def shortest_paths(spark, sf_dir):
    e = _edges(spark, sf_dir).withColumn("w", F.col("w") + 1)
    both = e.union(e.select("dst", "src", "w"))
    first = both.agg(F.min("src").alias("v"))
    return graph.dijkstra(both, first).select("source", "v", r6("distance").alias("distance"))


@query("""WITH s AS (SELECT stddev_samp(l_quantity) * pow(count(*), -0.2) AS h, count(*) AS n FROM lineitem), q AS (SELECT l_quantity AS v, count(*) AS c FROM lineitem GROUP BY 1)
SELECT x::DOUBLE AS x, round(sum(c * exp(-0.5 * pow((x - v) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 6) AS density FROM q, s, range(0, 51, 2) t(x) GROUP BY x""")
def kernel_density(spark, sf_dir):
    return stats.gaussian_kde(table(spark, sf_dir, "lineitem"), "l_quantity", [float(x) for x in range(0, 51, 2)]).select("x", r6("density").alias("density"))


QUERIES |= families.QUERIES
ORACLE_SQL |= families.ORACLE_SQL
