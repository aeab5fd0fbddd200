"""Mixing sources to target weights by temperature.

A source's weight is its share of tokens to a power, normalised. The power is found by bisection: it meets a target
entropy of the weights, and it is raised, where that is needed, until no source is repeated more often than a limit.
Weights times the budget give each source a token budget, realised as block permutations: a source's documents are dealt
into blocks by a keyed hash; each epoch takes the blocks, and the documents in them, in a keyed order of its own; the
last, partial epoch takes that order's prefix as far as the budget goes.

Everything is a DataFrame plan: sums by source and block are combined before the shuffle, the running sum goes over the
blocks of a source (some thousand documents each) and then within the one block at the limit, so that a source with a
third of all rows meets in no task.

Edge cases: a null source is a source of its own, apart from the empty name; null and empty texts have no tokens and fit
any budget; a source without tokens is taken once; repeated rows are taken each; rows of one id are in order of their
tokens and their text's hash; a null id is hashed as null; of a very long text only its number of tokens counts; an empty
table gives an empty table; columns of the input keep their names, new ones are in one struct, which replaces a column of its name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.llm.common import durable

BLOCK_ROWS = 4096
#: Powers that are tried in one pass over the sources, and passes: each narrows the bracket by that factor.
GRID, PASSES = 64, 7


def word_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


@dataclass
class Mix:
    """power: of the shares; entropy: of the weights, in nats; epochs: the most that a source is repeated."""

    power: float
    entropy: float
    epochs: float


def _tried(sources: DataFrame, powers: np.ndarray, budget: int | None) -> list[Mix]:
    """What each power would give, by one aggregate over the sources, however many these are."""
    share = F.log("tokens") - F.log("all_tokens")
    terms = [F.struct(F.sum(F.exp(share * p)).alias("z"), F.sum(F.exp(share * p) * share * p).alias("e")) for p in map(float, powers)]
    r = sources.where("tokens > 0").agg(F.array(*terms).alias("t"), F.min(share).alias("low"), F.max(share).alias("high"), F.max("all_tokens").alias("all")).first()
    out = []
    for p, t in zip(powers.tolist(), r.t):
        if r.low is None:
            return [Mix(1.0, 0.0, 1.0)] * len(powers)
        most, once = (r.low, r.high) if p <= 1 else (r.high, r.low)  # shares of the source that is repeated most, and least
        log_epochs = (p - 1) * (most - once) if budget is None else (p - 1) * most - np.log(t.z) + np.log(budget / r["all"])
        out.append(Mix(p, float(np.log(t.z) - t.e / t.z), float(np.exp(log_epochs))))
    return out


def find_power(sources: DataFrame, *, target_entropy: float | None, max_epochs: float | None, budget: int | None) -> Mix:
    """The smallest power in 0..4 at which the entropy isn't above the target and no source is repeated over the limit.

    Entropy and repetition both fall as the power rises, up to 1 for repetition; where even 1 exceeds the limit (a budget
    of more than the limit times all tokens) it is 1."""
    fits = lambda m: (target_entropy is None or m.entropy <= target_entropy) and (max_epochs is None or m.epochs <= max_epochs * (1 + 1e-12))
    low, high = 0.0, 4.0 if target_entropy is not None else 1.0
    best = None
    for _ in range(PASSES):
        powers = np.linspace(low, high, GRID + 1)
        tried = _tried(sources, powers, budget)
        ok = next((i for i, m in enumerate(tried) if fits(m)), None)
        if ok is None:
            return best or _tried(sources, np.array([1.0]), budget)[0]
        best = tried[ok]
        if ok == 0:
            break
        low, high = float(powers[ok - 1]), float(powers[ok])
    return best


def mix_sources(df: DataFrame, *, target_entropy: float | None = None, max_epochs: float | None = 2.0, budget: int | None = None, key: str = "mix", doc_id: str = "doc_id", source: str = "source", tokens: Column | None = None, output: str = "mix") -> DataFrame:
    """df's rows, each as often as the mix takes it, with the struct `output`: n_tokens, weight, epoch, block, and the sort
    keys block_key and row_key: (epoch, block_key, row_key) is the order within a source.

    budget: tokens of all sources together. None: the least at which every source is taken whole at least once."""
    count = word_tokens(df["text"]) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    named = F.when(df[source].isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), df[source].cast("string")))
    rows = df.select(F.struct(*df.columns).alias("all"), named.alias("named"), F.xxhash64(F.lit(key), df[doc_id]).alias("draw"), df[doc_id].alias("id"), count.alias("n_tokens"), (F.xxhash64(df["text"]) if "text" in df.columns else F.lit(0)).alias("tie"))
    narrow = durable(rows.select("named", "draw", "n_tokens"))
    sources = narrow.groupBy("named").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens"))
    totals = sources.agg(F.sum("tokens").alias("all_tokens"), F.max("tokens").alias("most"), F.min(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("least"))
    sources = durable(sources.crossJoin(totals))  # the right side is one row
    mix = find_power(sources, target_entropy=target_entropy, max_epochs=max_epochs, budget=budget)
    power = F.lit(mix.power)
    raised = sources.withColumn("raised", F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("all_tokens"), power)).otherwise(0.0))
    sums = raised.agg(F.sum("raised").alias("total"))
    if budget is None:
        epochs = F.pow(F.col("tokens") / F.col("most" if mix.power <= 1 else "least"), power - 1)
    else:
        epochs = F.col("raised") / F.col("total") * F.lit(float(budget)) / F.col("tokens")
    budgets = raised.crossJoin(sums).select(
        "named", (F.col("raised") / F.col("total")).alias("weight"), F.ceil(F.col("rows") / BLOCK_ROWS).alias("blocks"), "tokens",
        F.when(F.col("tokens") > 0, F.round(epochs * F.col("tokens")).cast("long")).otherwise(F.lit(0)).alias("budget"),
    )
    full = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(1))
    budgets = durable(budgets.select("*", full.alias("full")).select("*", (F.col("budget") - F.col("full") * F.col("tokens")).alias("rest")))
    block = F.pmod(F.col("draw"), F.col("blocks"))
    order = F.xxhash64(F.lit(key), "full", "named", "block")
    # Few rows: one a block. A source's rows here are its documents over BLOCK_ROWS.
    blocks = _with_budget(narrow, budgets).withColumn("block", block).groupBy("named", "block", "full", "rest").agg(F.sum("n_tokens").alias("block_tokens"))
    running = Window.partitionBy("named").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("named", "block", F.coalesce(F.sum("block_tokens").over(running), F.lit(0)).alias("before"))
    each = _with_budget(rows, budgets).withColumn("block", block).join(blocks, ["named", "block"])
    turn = F.xxhash64(F.lit(key), "full", "draw")
    so_far = F.col("before") + F.sum("n_tokens").over(Window.partitionBy("named", "block").orderBy(turn, "draw", "id", "n_tokens", "tie").rowsBetween(Window.unboundedPreceding, 0))
    last = F.when((F.col("rest") > 0) & (so_far <= F.col("rest")), 1).otherwise(0)
    taken = each.withColumn("copies", F.col("full") + last).where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return taken.select(*(F.col("all")[c].alias(c) for c in df.columns if c != output), F.struct("n_tokens", "weight", "epoch", "block", F.xxhash64(F.lit(key), "epoch", "named", "block").alias("block_key"), F.xxhash64(F.lit(key), "epoch", "draw").alias("row_key")).alias(output))


#: Sources up to this number are broadcast with their budgets; more are joined by a shuffle, split where they are hot.
BROADCAST_SOURCES = 10_000


def _with_budget(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    if budgets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        budgets = F.broadcast(budgets)
    return rows.join(budgets, "named")
