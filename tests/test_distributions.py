import math

import numpy as np
import pytest
from gridlark.functions import distributions as D
from gridlark.functions import special as S
from pyspark.sql import functions as F

SHAPES = {1: (2.5,), 2: (2.2, 3.1), 3: (30, 12, 9)}
OWN = {"truncnorm": (-1.0, 2.0), "loguniform": (1.5, 4.0), "triang": (0.3,), "binom": (12, 0.3), "nbinom": (4, 0.4), "bernoulli": (0.3,), "geom": (0.3,), "randint": (2, 9), "zipfian": (1.2, 20), "logser": (0.6,), "betabinom": (10, 2.0, 3.0), "genextreme": (0.3,), "genpareto": (0.3,), "zipf": (3.5,), "yulesimon": (4.5,), "skewcauchy": (0.3,), "wrapcauchy": (0.4,), "truncweibull_min": (1.5, 0.2, 3.0), "truncpareto": (2.0, 9.0), "norminvgauss": (2.0, 0.5), "crystalball": (1.5, 3.0), "tukeylambda": (0.3,), "genexpon": (1.0, 0.5, 2.0), "boltzmann": (0.5, 20), "nhypergeom": (30, 10, 5), "betanbinom": (5, 3.0, 2.0), "skellam": (4.0, 2.0), "genhalflogistic": (0.5,)}


def shape_of(name, family):
    if name in OWN:
        return OWN[name]
    return SHAPES.get(family.pdf.__code__.co_argcount - 1, ()) if family.pdf.__code__.co_argcount > 1 else (2.5,) if "p" in family.pdf.__code__.co_varnames else ()


@pytest.mark.parametrize("name", sorted(D.CONTINUOUS))
def test_continuous(name):
    """The density is the slope of the distribution function, and the quantiles invert it."""
    d = D.Frozen(name, *shape_of(name, D.CONTINUOUS[name]), loc=0.5, scale=2.0)
    p = np.array([0.05, 0.2, 0.5, 0.77, 0.95])
    x = d.ppf(p)
    assert np.allclose(d.cdf(x), p, atol=1e-9)
    h = 1e-5 * np.maximum(np.abs(x - 0.5), 0.01)
    assert np.allclose((d.cdf(x + h) - d.cdf(x - h)) / (2 * h), d.pdf(x), rtol=2e-4, atol=1e-8), (d.pdf(x))
    assert d.cdf(-1e12) <= 1e-5 and d.cdf(1e12) >= 1 - 1e-5


@pytest.mark.parametrize("name", sorted(D.DISCRETE))
def test_discrete(name):
    d = D.Frozen(name, *(OWN.get(name) or ((30, 12, 9) if name == "hypergeom" else (1.3,))))
    low, high = d.support()
    k = np.arange(max(low, -40), min(high, 60) + 1)
    assert np.allclose(np.cumsum(d.pmf(k)), d.cdf(k) - (d.cdf(k[0]) - d.pmf(k[0])), atol=1e-9)
    q = d.ppf([0.1, 0.5, 0.9])
    assert (d.cdf(q) >= [0.1, 0.5, 0.9]).all() and (d.cdf(q - 1) < [0.1, 0.5, 0.9]).all()


def test_moments_and_columns(spark):
    assert D.gamma(3.0, scale=2.0).mean() == pytest.approx(6, rel=1e-4) and D.norm(loc=1, scale=3).var() == pytest.approx(9, rel=1e-3)
    assert D.poisson(4.0).mean() == pytest.approx(4) and D.norm().entropy() == pytest.approx(0.5 * math.log(2 * math.pi * math.e), rel=1e-3)
    got = spark.createDataFrame([(0.1,), (None,), (2.0,)], "x double").select(D.norm().column("cdf", F.col("x"))).collect()
    assert got[0][0] == pytest.approx(float(S.ndtr(0.1))) and got[1][0] is None
    assert D.expon(scale=3.0).sample(spark, 4000, seed=1).agg(F.avg("x")).first()[0] == pytest.approx(3, rel=0.1)
