"""Random numbers. `Generator` gives numpy's streams (PCG64) bit for bit where the plan is made; `columns` are draws that
depend on a key and a row's own number alone, so they don't change with partitions and need no stream."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Generator = np.random.default_rng
SeedSequence = np.random.SeedSequence


def stream(spark: SparkSession, distribution: str, n: int, *parameters: float, seed: int = 0) -> DataFrame:
    """id, x: numpy's own stream. Sequential by nature, so it is made on the driver; for large n use `random_column`."""
    x = getattr(np.random.default_rng(seed), distribution)(*parameters, size=n)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")


def spawned(spark: SparkSession, distribution: str, n: int, *parameters: float, seed: int = 0, parts: int = 8) -> DataFrame:
    """part, id, x: independent numpy streams, one a part, from spawned seeds."""
    import pyarrow as pa

    seeds = [s.generate_state(4).tolist() for s in np.random.SeedSequence(seed).spawn(parts)]

    def draw(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                size = n // parts + (p < n % parts)
                x = getattr(np.random.default_rng(seeds[p]), distribution)(*parameters, size=size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, p)), pa.array(np.arange(size)), pa.array(x.astype(float))], ["part", "id", "x"])

    return spark.range(0, parts, 1, parts).mapInArrow(draw, "part long, id long, x double")


def uniform(key: int, *ids: Column) -> Column:
    """Uniform on [0, 1) by a keyed hash of the row's number."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(key), *ids), 11) / float(1 << 53)).cast("double")


def normal(key: int, *ids: Column) -> Column:
    """Standard normal from two keyed uniforms (Box and Muller)."""
    u, v = uniform(key, *ids), uniform(key + 1, *ids)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def exponential(key: int, *ids: Column) -> Column:
    return -F.log(1 - uniform(key, *ids))


def integers(key: int, low: int, high: int, *ids: Column) -> Column:
    return (F.lit(low) + F.floor(uniform(key, *ids) * (high - low))).cast("long")


def choice(df: DataFrame, n: int, key: int, *ids: str) -> DataFrame:
    """n rows without replacement: those of the least keyed hash."""
    return df.orderBy(F.xxhash64(F.lit(key), *ids), *ids).limit(n)


def permutation(df: DataFrame, key: int, ids: list[str], output: str = "i") -> DataFrame:
    """df with each row's place in a random order, by a distributed scan over keyed hashes."""
    from gridlark.operators.scan import with_index

    return with_index(df, [F.xxhash64(F.lit(key), *ids), *map(F.col, ids)], output)


def vectors(spark: SparkSession, distribution: str, n: int, *parameters, seed: int = 0) -> DataFrame:
    """id, x (an array): n draws of a law of several variates (multivariate_normal, dirichlet, multinomial,
    multivariate_hypergeometric), numpy's own stream."""
    x = np.asarray(getattr(np.random.default_rng(seed), distribution)(*parameters, size=n), float)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")


def multivariate_normal(key: int, mean: list[float], cov: list[list[float]], *ids: Column) -> Column:
    """An array of correlated normals by keyed hashes: the covariance's Cholesky factor times independent ones."""
    low = np.linalg.cholesky(np.asarray(cov, float))
    z = [normal(key + 2 * k, *ids) for k in range(len(mean))]
    return F.array(*(sum((float(low[i, j]) * z[j] for j in range(i + 1)), F.lit(float(m))) for i, m in enumerate(mean)))


def dirichlet(key: int, alpha: list[float], *ids: Column) -> Column:
    """An array of shares by keyed hashes, for whole alphas: sums of exponentials, normalised."""
    if any(a != int(a) or a < 1 for a in alpha):
        raise ValueError("alphas must be whole and positive; `vectors` takes any")
    parts, at = [], key
    for a in alpha:
        parts.append(sum((exponential(at + k, *ids) for k in range(int(a))), F.lit(0.0)))
        at += int(a)
    g = F.array(*parts)
    return F.transform(g, lambda x: x / F.aggregate(g, F.lit(0.0), lambda s, y: s + y))


def multinomial(key: int, n: int, shares: list[float], *ids: Column) -> Column:
    """An array of counts of n keyed draws among the shares."""
    edges = np.cumsum(np.asarray(shares, float))
    if abs(edges[-1] - 1) > 1e-9:
        raise ValueError("shares must add up to 1")
    draws = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: uniform(key, k, *ids))
    low = [0.0, *edges[:-1].tolist()]
    within = lambda a, b: lambda u: (u >= a) & (u < b)
    return F.array(*(F.size(F.filter(draws, within(a, b))).cast("long") for a, b in zip(low, [*edges[:-1].tolist(), 2.0])))


def permuted(cell: Column, key: int, *ids: Column) -> Column:
    """The cell's elements in a keyed random order."""
    keyed = F.zip_with(cell, F.sequence(F.lit(0), F.size(cell) - 1), lambda v, k: F.struct(uniform(key, k, *ids).alias("u"), k.alias("k"), v.alias("v")))
    return F.when(F.size(cell) > 0, F.transform(F.array_sort(keyed), lambda s: s["v"])).otherwise(cell)


def state(generator: np.random.Generator) -> dict:
    """The generator's state, to go on from later."""
    return generator.bit_generator.state


def restored(saved: dict) -> np.random.Generator:
    g = np.random.default_rng()
    g.bit_generator.state = saved
    return g
