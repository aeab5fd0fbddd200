"""Quality by supervised subword embeddings: hashed vectors of words and of their character n-grams are averaged over
a document and a softmax over the average gives the classes' probabilities. Trained by stochastic gradient descent in
numpy on a bounded sample of labelled rows.

As the softmax has two classes and the average is linear, what a word adds to the score is one number and a count; it
is worked out once a word and worker.

Edge cases: null and empty texts have no words and get the bias alone; repeated rows get equal scores; without labelled
rows every score is 0.5; rows whose label is null aren't learnt from; a very long text is one cell, scored word by word;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import BLOCK_BYTES, Memo, labelled_sample

BUCKETS = 1 << 18


def raw_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def subwords(word: bytes) -> list[int]:
    """Buckets of the word and of the 3- and 4-byte grams of the word with its ends marked."""
    marked = b"<" + word + b">"
    grams = [marked[i : i + n] for n in (3, 4) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g) % BUCKETS for g in (b"\0" + word, *grams)]


@dataclass
class EmbeddingModel:
    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def pushes(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the log-odds of class 1, and the log-odds without words: all that a score needs."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])

    @staticmethod
    def scorer(push: np.ndarray, base: float):
        """A function from texts to probabilities of class 1."""
        push = push.astype(np.float64)
        made = Memo(lambda w: complex(push[f := subwords(w)].sum(), len(f)))

        def score(texts: list[str | None]) -> np.ndarray:
            sums = [sum(map(made.__getitem__, raw_words(t)), 0j) for t in texts]
            z = np.array([s.real / max(s.imag, 1) for s in sums]) + base
            return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

        return score


def fit_embeddings(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, dim: int = 16, epochs: int = 6, rate: float = 4.0, seed: int = 7) -> EmbeddingModel:
    """docs: (distinct buckets, counts) of each. One document a step; the rate falls linearly to nothing."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    u, b = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, epochs * len(docs)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            lr, done = rate * (1 - done / steps), done + 1
            places, counts = docs[i]
            share = (counts / max(counts.sum(), 1)).astype(np.float32)
            own = e[places]
            h = share @ own
            z = h @ u + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            e[places] = own - lr * share[:, None] * (u @ p)[None, :] * GAIN
            u -= lr * 0.05 * h[:, None] * p[None, :] * GAIN
            b -= lr * 0.01 * p
    return EmbeddingModel(e, u, b)


#: Gradients of an average over some thousand subwords are small; they are scaled by this.
GAIN = 4.0


def fit_quality(docs: DataFrame, labels: DataFrame, label: Column, rows: int = 6000) -> EmbeddingModel:
    """Fit on a sample of at most `rows` labelled documents (the fit's documented bound)."""

    def counted(batches):
        made = Memo(subwords)
        for b in batches:
            places, counts = [], []
            for t in b.column("text").to_pylist():
                c: Counter = Counter()
                for w, n in Counter(raw_words(t)).items():
                    for f in made[w]:
                        c[f] += n
                places.append(list(c))
                counts.append(list(c.values()))
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), b.column("label")], ["places", "counts", "label"])

    sample = labelled_sample(docs, labels, [label.cast("int").alias("label")], rows)
    got = sample.orderBy("doc_id").mapInArrow(counted, "places array<int>, counts array<int>, label int").toArrow()
    pairs = [(np.asarray(p.values), np.asarray(c.values)) for p, c in zip(got.column("places"), got.column("counts"))]
    return fit_embeddings(pairs, got.column("label").to_numpy())


def score_quality(docs: DataFrame, model: EmbeddingModel, *, text: str = "text", output: str = "score") -> DataFrame:
    """The rows with a column `output`: the probability of class 1. Scores whole texts; no shuffle."""

    held = docs.sparkSession.sparkContext.broadcast(model.pushes())  # BUCKETS numbers, a fixed size

    @F.arrow_udf("double")
    def scores(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = EmbeddingModel.scorer(*held.value)
        for a in arrays:
            step = max(1, len(a) * BLOCK_BYTES // max(a.nbytes, 1))
            yield pa.array(np.concatenate([np.zeros(0), *(score(a.slice(i, step).to_pylist()) for i in range(0, len(a), step))]))

    return docs.withColumn(output, scores(docs[text]))
