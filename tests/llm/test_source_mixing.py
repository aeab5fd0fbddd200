import math
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from gridlark.llm import source_mixing as X
from gridlark.llm.queries import op1_source_mixing
from pyspark.sql import functions as F


def h(*parts):
    """Spark's xxhash64 of a row of strings, longs and nulls, as a signed long."""
    seed = 42
    for p in parts:
        if p is not None:
            seed = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else int(p).to_bytes(8, "little", signed=True), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute(rows, power, budget=None, key="mix"):
    """(doc_id, source, text) to sorted (doc_id, source, n_tokens, epoch, block)."""
    rows = [(d, s, len(re.findall("[^\x20\x09-\x0d]+", t or ""))) for d, s, t in rows]
    tokens, count = defaultdict(int), defaultdict(int)
    for _, s, n in rows:
        tokens[s] += n
        count[s] += 1
    total = sum(tokens.values())
    once = (max if power <= 1 else min)([t for t in tokens.values() if t], default=0)
    z = sum((t / total) ** power for t in tokens.values() if t)
    out = []
    for s, t in tokens.items():
        name = "0" if s is None else "1" + s
        epochs = 0 if not t else (t / once) ** (power - 1) if budget is None else (t / total) ** power / z * budget / t
        own = math.floor(epochs * t + 0.5)
        full, rest = divmod(own, t) if t else (1, 0)
        blocks = -(-count[s] // X.BLOCK_ROWS)
        docs = [(h(key, full, name, (draw := h(key, d)) % blocks), draw % blocks, h(key, full, draw), draw, d, n) for d, q, n in rows if q == s]
        so_far = 0
        for _, block, _, _, d, n in sorted(docs, key=lambda x: (*x[:4], x[4] is not None, x[4] or 0, x[5])):
            so_far += n
            out += [(d, s, n, e, block) for e in range(full + (rest > 0 and so_far <= rest))]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.source, r.mix.n_tokens, r.mix.epoch, r.mix.block) for r in df.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"max_epochs": 3.5}, {"target_entropy": 1.0, "max_epochs": None}, {"budget": 20_000, "max_epochs": 5.0}, {"max_epochs": None}])
@pytest.mark.parametrize("block_rows", [4096, 3])
def test_against_brute_force(spark, options, block_rows, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(0)
    rows = [(i, "abcde"[min(4, int(rng.exponential(1.2)))] if i % 17 else None, "w " * int(rng.integers(0, 80))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    mixed = X.mix_sources(df, **options)
    weights = {r.source: r.weight for r in mixed.select("source", "mix.weight").distinct().collect()}
    tokens = defaultdict(int)
    for _, s, t in rows:
        tokens[s] += len(t) // 2
    share = {s: t / sum(tokens.values()) for s, t in tokens.items()}
    asked = {"max_epochs": 2.0, "target_entropy": None, "budget": None} | options
    largest, least = max(share, key=share.get), min(share, key=share.get)
    power = math.log(weights[largest] / weights[least]) / math.log(share[largest] / share[least])
    entropy = -sum(w * math.log(w) for w in weights.values())
    if asked["target_entropy"]:
        assert abs(entropy - asked["target_entropy"]) < 1e-6
    elif not asked["max_epochs"]:
        assert max(weights.values()) - min(weights.values()) < 1e-12
    elif asked["budget"]:
        assert max(weights[s] * asked["budget"] / tokens[s] for s in weights) <= asked["max_epochs"] * (1 + 1e-9)
    else:
        assert abs((share[largest] / share[least]) ** (1 - power) - asked["max_epochs"]) < 1e-6
    want = brute(rows, power, options.get("budget"))
    assert len(got(mixed)) == pytest.approx(len(want), abs=3)  # the power read off the weights is rounded
    if not asked["budget"]:
        assert {r[0] for r in got(mixed)} == set(range(600))  # nothing is left out at the least full budget


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sources = spark.createDataFrame(docs, "doc_id long, source string, text string").groupBy("source").agg(F.sum(X.word_tokens(F.col("text"))).alias("tokens"))
    sources = sources.crossJoin(sources.agg(F.sum("tokens").alias("all_tokens")))
    power = X.find_power(sources, target_entropy=None, max_epochs=2.0, budget=None).power
    out = sorted(((r.doc_id, r.source, r.n_tokens, r.epoch, r.block) for r in op1_source_mixing(spark, "/root/testdata/sf0.01").collect()), key=str)
    assert out == brute(docs, power)
    spent = defaultdict(int)
    for _, s, n, _, _ in out:
        spent[s] += n
    assert set(spent) == {s for _, s, _ in docs}


def test_odd(odd, empty):
    out = X.mix_sources(odd)
    assert {(r.doc_id, r.source) for r in out.collect()} == {(r.doc_id, r.source) for r in odd.collect()}
    assert got(out) == brute([(r.doc_id, r.source, r.text) for r in odd.collect()], 0.0 if out.select("mix.weight").distinct().count() == 1 else _power(out))
    assert X.mix_sources(empty).count() == 0


def _power(out):
    rows = out.groupBy("source").agg(F.max("mix.weight").alias("w"), F.sum(F.when(F.col("mix.epoch") == 0, F.col("mix.n_tokens"))).alias("t")).where("t > 0").collect()
    a, b = sorted(rows, key=lambda r: r.t)[-1], sorted(rows, key=lambda r: r.t)[0]
    return math.log(a.w / b.w) / math.log(a.t / b.t)
