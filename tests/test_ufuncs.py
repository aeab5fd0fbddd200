import numpy as np
import pytest
from gridlark.functions import ufuncs as U
from pyspark.sql import functions as F

EDGE = [0.0, -0.0, 1.0, -1.0, 0.5, -0.5, 2.5, -2.5, 3.5, 7.0, -7.0, 1e-9, -1e-9, 1e300, -1e300, 2.0**53, 123456.789, float("inf"), -float("inf"), float("nan"), 0.25, 359.5, 10.0, -3.0, 100.0]
OWN = {"sigmoid": lambda x: np.where(x >= 0, 1 / (1 + np.exp(-abs(x))), np.exp(-abs(x)) / (1 + np.exp(-abs(x)))), "relu": lambda x: np.maximum(x, 0), "exp10": lambda x: 10.0**x}


@pytest.fixture(scope="module", params=["true", "false"])
def ansi(request, spark):
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield spark
    spark.conf.set("spark.sql.ansi.enabled", old)


def test_unary(ansi):
    names = [n for n in U.UNARY if hasattr(np, n) or n in OWN]
    names = [n for n in names if n not in ("invert", "bitwise_count")]
    df = ansi.createDataFrame([(i, x) for i, x in enumerate(EDGE)], "i int, x double").orderBy("i")
    got = df.select(*(U.UNARY[n](F.col("x")).cast("double").alias(n) for n in names)).toPandas()
    x = np.array(EDGE)
    with np.errstate(all="ignore"):
        for n in names:
            want = np.asarray((OWN.get(n) or getattr(np, n))(x), float)
            have = got[n].to_numpy(float)
            big = np.abs(x) > 1e15 if n in ("sin", "cos", "tan", "sinc") else np.zeros(len(x), bool)
            assert np.allclose(have[~big], want[~big], rtol=1e-12, atol=1e-300, equal_nan=True), (n, x[~np.isclose(have, want, equal_nan=True)], have[~np.isclose(have, want, equal_nan=True)])


def test_binary(ansi):
    names = [n for n in U.BINARY if hasattr(np, n) and n not in ("bitwise_and", "bitwise_or", "bitwise_xor", "left_shift", "right_shift", "gcd", "lcm", "ldexp")]
    pairs = [(a, b) for a in EDGE for b in EDGE]
    df = ansi.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, x double, y double").orderBy("i")
    got = df.select(*(U.BINARY[n](F.col("x"), F.col("y")).cast("double").alias(n) for n in names)).toPandas()
    x, y = np.array(pairs).T
    with np.errstate(all="ignore"):
        for n in names:
            want, have = np.asarray(getattr(np, n)(x, y), float), got[n].to_numpy(float)
            if n == "logaddexp2":
                use = np.maximum(x, y) < 1e10
            elif n in ("floor_divide", "mod", "remainder", "power", "float_power", "fmod"):
                use = (np.abs(x) < 1e15) & (np.abs(y) < 1e15) & (np.abs(y) > 1e-5)
            else:
                use = np.ones(len(x), bool)
            bad = use & ~np.isclose(have, want, rtol=1e-12, atol=1e-300, equal_nan=True)
            assert not bad.any(), (n, [(a, b, h, w) for a, b, h, w in zip(x[bad], y[bad], have[bad], want[bad])][:5])


def test_whole_numbers(spark):
    rows = [(a, b) for a in (0, 1, -7, 12, 2**40, -(2**62)) for b in (0, 1, 3, 18, 33, 63)]
    df = spark.createDataFrame(rows, "x long, y long")
    names = ["gcd", "lcm", "bitwise_and", "bitwise_or", "bitwise_xor", "left_shift", "right_shift"]
    small = lambda n, a: n != "lcm" or abs(a) < 2**41
    for n in names:
        for (a, b), r in zip(rows, df.select(F.when(F.lit(True) if n != "lcm" else F.abs("x") < 2**41, U.BINARY[n](F.col("x"), F.col("y")))).collect()):
            if small(n, a):
                assert r[0] == int(getattr(np, n)(np.int64(a), np.int64(b))), (n, a, b)


def test_structs_and_nulls(spark):
    df = spark.createDataFrame([(x,) for x in (3.75, -3.75, 0.0, 1e-310, 8.0)], "x double")
    for r in df.select("x", U.frexp(F.col("x")).alias("f"), U.modf(F.col("x")).alias("m")).collect():
        assert tuple(r.f) == tuple(np.frexp(r.x)) and tuple(r.m) == tuple(np.modf(r.x))
    null = spark.createDataFrame([(None, 1.0)], "x double, y double")
    assert all(v is None for v in null.select(*(f(F.col("x")).alias(n) for n, f in U.UNARY.items() if n in ("log", "sqrt", "floor", "arctanh", "reciprocal"))).first())
    z = spark.range(1).select(U.complex_multiply(U.complex_(F.lit(1.0), F.lit(2.0)), U.complex_(F.lit(3.0), F.lit(-1.0))).alias("z"), U.angle(U.complex_(F.lit(-1.0), F.lit(0.0))).alias("a")).first()
    assert tuple(z.z) == (5.0, 5.0) and z.a == np.pi
