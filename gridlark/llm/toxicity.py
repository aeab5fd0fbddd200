"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another; the probability of each earlier category is an input of the later models.
In training these inputs are out-of-fold predictions, so later models learn from probabilities as honest as those that
they meet in scoring. Terms are hashed whole words and word beginnings and endings; a term counts once a document.

Edge cases: null and empty texts have no terms and get the intercepts' probabilities; repeated rows get equal
results; rows with a category whose label is null aren't learnt from; with no labelled rows, or a category without
positives, that category's probability is its base rate; of a very long text only its distinct words are held; extra
columns pass through untouched.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain as joined

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import BLOCK_BYTES, Memo, give_back, labelled_sample, release, words

TERM_BITS = 20
LETTERS = re.compile(rb"[a-z\x80-\xff]+")
SIGNS = re.compile(rb"[^a-z\x80-\xff]+")


def word_terms(word: bytes) -> list[int]:
    """Hashed terms of a word: each run of letters whole, its first 3 to 7 bytes and its last 4 and 6,
    and each run of other signs."""
    out = [zlib.crc32(b"~" + run[:8]) & ((1 << TERM_BITS) - 1) for run in SIGNS.findall(word)]
    for run in LETTERS.findall(word):
        parts = {b"=" + run} | {b"<" + run[:n] for n in range(3, 8) if n < len(run)} | {b">" + run[-n:] for n in (4, 6) if n < len(run)}
        out += [zlib.crc32(p) & ((1 << TERM_BITS) - 1) for p in parts]
    return out


@dataclass
class ChainModel:
    categories: list[str]
    terms: dict[int, int] = field(default_factory=dict)  # term -> place
    weights: np.ndarray = None  # category x place
    links: np.ndarray = None  # category x category: weight of earlier categories' log-odds
    bias: np.ndarray = None

    def scorer(self):
        """A function from texts to an array of probabilities, one row a text."""
        known = self.terms
        places = Memo(lambda w: tuple(known[t] for t in word_terms(w) if t in known))

        def score(texts: list[str | None]) -> np.ndarray:
            out = np.empty((len(texts), len(self.categories)))
            for i, text in enumerate(texts):
                found = list(set(joined.from_iterable(map(places.__getitem__, set(words(text))))))
                own = self.weights[:, found].sum(1) + self.bias
                odds = np.zeros(len(own))
                for k in range(len(own)):
                    odds[k] = np.clip(own[k] + self.links[k, :k] @ odds[:k], -30, 30)
                    out[i, k] = 1 / (1 + np.exp(-odds[k]))
                    odds[k] = np.clip(odds[k], -LINK_LIMIT, LINK_LIMIT)
            return out

        return score


#: Log-odds of earlier categories are held within this as inputs of later ones.
LINK_LIMIT = 6.0


def _logistic(row, col, n_col, dense, y, weight, l2: float = 0.02, steps: int = 130) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of sparse presence columns and of dense columns, and the intercept, by Adam on the penalised loss."""
    n, k = len(y), dense.shape[1]
    theta, m, v = np.zeros(n_col + k + 1), np.zeros(n_col + k + 1), np.zeros(n_col + k + 1)
    rate = np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6)
    theta[-1] = np.log(rate / (1 - rate))
    total = weight.sum()
    for t in range(1, steps + 1):
        z = np.bincount(row, theta[col], n) + dense @ theta[n_col : n_col + k] + theta[-1]
        err = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.concatenate([np.bincount(col, err[row], n_col), dense.T @ err, [err.sum()]]) / total
        g[:-1] += l2 * 0.01 * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return theta[:n_col], theta[n_col : n_col + k], theta[-1]


def fit_chain(doc_terms: list[np.ndarray], labels: np.ndarray, categories: list[str], n_terms: int = 3000, folds: int = 2) -> ChainModel:
    """Fit on documents' distinct terms and a 0/1 row of labels each; terms are chosen by their G statistic."""
    n, c = labels.shape
    model = ChainModel(categories, {}, np.zeros((c, 0)), np.zeros((c, c)), np.full(c, -12.0))
    if not n:
        return model
    size = 1 << TERM_BITS
    # Document by document: all documents' terms are never laid side by side.
    seen, with_pos, chosen = np.zeros(size), np.zeros((c, size)), set()
    for terms, own in zip(doc_terms, labels):
        seen[terms] += 1
        for k in np.flatnonzero(own):
            with_pos[k, terms] += 1
    for k in range(c):
        pos = labels[:, k].sum()
        if 0 < pos < n:
            cells, g = [(with_pos[k], pos), (seen - with_pos[k], n - pos)], np.zeros(size)
            for have, of in cells:
                for obs, exp in ((have, seen * of / n), (of - have, (n - seen) * of / n)):
                    g += 2 * np.where(obs > 0, obs * np.log(np.maximum(obs, 1e-9) / np.maximum(exp, 1e-9)), 0)
            g[seen < 3] = 0
            best = np.argsort(-g, kind="stable")[: n_terms // c]
            chosen |= set(best[g[best] > 12].tolist())
    model.terms = {t: i for i, t in enumerate(sorted(chosen))}
    place = np.full(size, -1, np.int32)
    place[list(model.terms)] = list(model.terms.values())
    del seen, with_pos
    places = [(p := place[t])[p >= 0] for t in doc_terms]
    row, col, n_col = np.repeat(np.arange(n), [len(p) for p in places]), np.concatenate([np.zeros(0, np.int32), *places]), len(model.terms)
    model.weights = np.zeros((c, n_col))
    fold, odds = np.arange(n) % folds, np.zeros((n, c))
    for k in range(c):
        y = labels[:, k].astype(float)
        if not 0 < y.sum() < n:
            model.bias[k] = -12.0 if not y.sum() else 12.0
            continue
        weight = np.ones(n)
        for f in range(folds) if k + 1 < c else ():
            a = fold != f
            w, link, b = _logistic(row, col, n_col, odds[:, :k], y, weight * a)
            z = np.bincount(row, w[col], n) + odds[:, :k] @ link + b
            odds[~a, k] = np.clip(z, -LINK_LIMIT, LINK_LIMIT)[~a]
        model.weights[k], model.links[k, :k], model.bias[k] = _logistic(row, col, n_col, odds[:, :k], y, weight)
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], rows: int = 8000) -> ChainModel:
    """Fit the chain on a sample of at most `rows` labelled documents (the fit's documented bound).

    categories: name -> 0/1 column over `labels`, in the order in which they are predicted."""

    def terms(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            out = [sorted(set(joined.from_iterable(word_terms(w) for w in set(words(t))))) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())), *(b.column(n) for n in names)], ["terms", *names])

    names = list(categories)
    sample = labelled_sample(docs, labels, [c.cast("int").alias(n) for n, c in categories.items()], rows)
    got = sample.orderBy("doc_id").mapInArrow(lambda batches: give_back(terms(batches)), "terms array<int>, " + ", ".join(f"{n} int" for n in names)).toArrow()
    flat, known = [np.asarray(x.values) for x in got.column("terms")], np.stack([got.column(n).to_numpy() for n in names], 1).astype(int).reshape(-1, len(names))
    del got
    model = fit_chain(flat, known, names)
    del flat
    release()  # the driver lives on through all later stages
    return model


def score_toxicity(docs: DataFrame, model: ChainModel, *, text: str = "text", output: str = "toxicity") -> DataFrame:
    """The rows with a struct column `output` of each category's probability. Scores whole texts; no shuffle."""
    names = model.categories
    kind = pa.struct([(n, pa.float64()) for n in names])

    def scored(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = model.scorer()
        for a in arrays:
            step = max(1, len(a) * BLOCK_BYTES // max(a.nbytes, 1))
            parts = [score(a.slice(i, step).to_pylist()) for i in range(0, len(a), step)]
            rows = np.concatenate(parts) if parts else np.zeros((0, len(names)))
            yield pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(names))], fields=list(kind))

    @F.arrow_udf(", ".join(f"{n} double" for n in names))
    def scores(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return give_back(scored(arrays))

    return docs.withColumn(output, scores(docs[text]))
