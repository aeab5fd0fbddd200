import re

import corpus_pipeline
import numpy as np
from gridlark.llm import near_copies as N
from hypothesis import given, settings
from hypothesis import strategies as st


def brute_set(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_components(texts, similarity=0.8):
    """[smallest place reachable by pairs of at least that Jaccard similarity]"""
    found, label = [brute_set(t) for t in texts], list(range(len(texts)))
    for i, u in enumerate(found):
        for j, v in enumerate(found[:i]):
            both = len(u & v)
            if (u == v or both >= similarity * (len(u) + len(v) - both)) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def edited(rng, base, edits):
    """The words with so many replaced, at least five apart."""
    w = list(base)
    for at in (rng.permutation(len(w) // 10)[:edits] * 10).tolist():
        w[at] = f"edit{rng.integers(1 << 30)}"
    return " ".join(w)


def corpus(seed, groups=12, copies=5, words=300):
    rng, texts = np.random.default_rng(seed), []
    for _ in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 5000, words)]
        texts += [" ".join(base), *(edited(rng, base, int(rng.integers(1, 9))) for _ in range(copies))]
    return texts


@given(st.lists(st.sampled_from(["A", "b", "c d e", " ", "\n", "word"]), max_size=30))
@settings(max_examples=60, deadline=None)
def test_sets(parts):
    text = " ".join(parts)
    h = N.shingle_set(text)
    assert len(h) == len(brute_set(text)) and (N.signature(h) == N.signature(h, step=2)).all()


def test_against_brute_force(spark):
    texts = corpus(3)
    got = {r.doc_id: r.component_id for r in N.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_buckets_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "PART", 3)
    texts = corpus(5, groups=2, copies=40)
    got = {r.doc_id: r.component_id for r in N.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_a_crowd_that_shares_a_passage(spark):
    """Texts that share half of their words aren't copies; a pair hidden in the crowd is."""
    rng = np.random.default_rng(9)
    passage = [f"p{x}" for x in range(400)]
    texts = [" ".join([*passage, *(f"w{x}" for x in rng.integers(0, 10**6, 200))]) for _ in range(60)]
    texts += [edited(rng, texts[k].split(), 6) for k in (3, 31)]
    got = {r.doc_id: r.component_id for r in N.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts) and got[60] == 3


def test_stage_keeps_one_row_of_each_group(spark):
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (4, "other text that is here"), (None, "x y z"), (None, "x y z"), (9, "a b c d e f"), (2, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((map(lambda r: (r.doc_id, r.text), corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())), key=str)
    assert got == sorted([(4, "a b c d e f"), (4, "other text that is here"), (None, "x y z"), (2, None)], key=str)


def test_stage_drops_copies_with_word_edits(spark):
    texts = corpus(7, groups=6)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == sorted(set(brute_components(texts))) and len(got) < len(texts) / 2


def test_odd(odd, empty):
    got = {}
    for r in N.near_copies(odd).collect():
        got.setdefault(r.doc_id, set()).add(r.component_id)
    assert got[1] == got[2] == got[3] == {1} and got[6] == got[5] == {5} and got[7] == {7} and got[None] == {None}
    assert N.near_copies(empty).count() == 0
