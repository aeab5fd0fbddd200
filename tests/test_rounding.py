"""Rounding as SQL engines do it, and wide projections in methods that the JVM compiles."""

import math

import duckdb
from gridlark.functions import ufuncs as U
from gridlark.plans.queries import QUERIES
from pyspark.sql import functions as F

ODD = [33.4334375, -33.4334375, 1.0000005, 2.5, -2.5, 0.5, 3.5, 0.49999999999999994, 1e300, -1.7e308, 4503599627370497.5, 0.0, math.inf, -math.inf, 1069.87 / 32, 1e-7]


def test_ties_of_the_scaled_double(spark):
    df = spark.createDataFrame([(v,) for v in [*ODD, float("nan"), None]], "v double")
    for digits in (0, 3, 6):
        got = [r[0] for r in df.select(U.round_away(F.col("v"), digits)).collect()]
        want = [duckdb.execute("SELECT round(?::DOUBLE, ?)", [v, digits]).fetchone()[0] for v in ODD]
        assert got[: len(ODD)] == want and math.isnan(got[-2]) and got[-1] is None


def test_wide_projections_are_not_one_method(spark):
    """Compiled whole, a row of ufunc_unary took some 90 microseconds, as the method was too long to be compiled."""
    for name in ("ufunc_unary", "ufunc_binary"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        wide = [line for line in plan.splitlines() if "Project [" in line and line.count(" AS ") > 8]
        assert len(wide) == 2 and not any(line.lstrip(" +-:").startswith("*(") for line in wide)
