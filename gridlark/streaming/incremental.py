"""Statistics over streams, with event time, watermarks and bounded state. Each function takes a streaming (or a batch)
DataFrame and gives one; the same plan on a batch gives what the stream adds up to."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withWatermark(ts, delay) if df.isStreaming else df


def windowed_statistics(df: DataFrame, ts: str, value: str, width: str, *, slide: str | None = None, by: list[str] = [], delay: str = "10 minutes") -> DataFrame:  # noqa: B006
    """start, by..., count, mean, variance, min, max by tumbling (or sliding) windows of event time."""
    v = F.col(value).cast("double")
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = _late(df, ts, delay).groupBy(w.alias("w"), *by).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.min(v).alias("min"), F.max(v).alias("max"))
    return out.select(F.col("w.start").alias("start"), *by, "count", "mean", "variance", "min", "max")


def sessions(df: DataFrame, ts: str, by: list[str], gap: str, value: str, delay: str = "10 minutes") -> DataFrame:
    """by..., start, end, count, total of runs of events without a gap of that length."""
    out = _late(df, ts, delay).groupBy(*by, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("count"), F.sum(value).alias("total"))
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "count", "total")


def windowed_histogram(df: DataFrame, ts: str, value: str, width: str, edges: list[float], delay: str = "10 minutes") -> DataFrame:
    """start, bin, count over fixed edges; the last bin is closed."""
    from gridlark.operators.sets import digitize

    v = F.col(value).cast("double")
    at: Column = F.when(v == edges[-1], F.lit(len(edges) - 2).cast("long")).otherwise(digitize(v, edges) - 1)
    kept = _late(df, ts, delay).where(v.between(edges[0], edges[-1]))
    return kept.groupBy(F.window(ts, width).alias("w"), at.alias("bin")).agg(F.count(F.lit(1)).alias("count")).select(F.col("w.start").alias("start"), "bin", "count")


def deduplicated(df: DataFrame, keys: list[str], ts: str, delay: str = "10 minutes") -> DataFrame:
    return _late(df, ts, delay).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def carried_filter(df: DataFrame, key: str, ts: str, value: str, alpha: float) -> DataFrame:
    """key, ts, y of a stream: y = alpha x + (1 - alpha) y before, the filter's state kept for each key from batch to batch.
    The state is one number a key."""
    kinds = dict(df.dtypes)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(parts)).sort_values(ts)
        y = state.get[0] if state.exists else None
        out = []
        for x in part[value]:
            y = x if y is None else alpha * x + (1 - alpha) * y
            out.append(y)
        state.update((float(y),))
        yield pd.DataFrame({key: k[0], ts: part[ts].to_numpy(), "y": out})

    return df.select(key, ts, value).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {ts} {kinds[ts]}, y double", "y double", "append", "NoTimeout")
