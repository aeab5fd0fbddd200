import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from gridlark.llm import common, mixing_lm as M
from gridlark.llm.queries import op9_mixing_lm


def brute_base(rows):
    words = lambda t: re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + ["\n"]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = Counter(w for d, t in rows if not held(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    return sorted(((d, held(d), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for d, t in rows for w in [words(t)]), key=str)


def got(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect()), key=str)


def test_codes_are_huffman():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 40])
    codes = M.Codes(counts)
    assert (codes.length * counts).sum() == 151 and abs((0.5**codes.length).sum() - 1) < 1e-12
    node, bit, which = codes.expand(np.array([7, 0, 7]))
    assert len(node) == 2 * codes.length[7] + codes.length[0] and which.tolist() == sorted(which)


def test_mix_is_a_distribution():
    """Over all words of a lexicon the next symbol's probabilities add up to one, whatever was read before."""
    rng = np.random.default_rng(0)
    lex = M.Lexicon([b"w%d" % i for i in range(20)] + [M.END], list(range(60, 39, -1)), 7)
    m = M.Model(lex, M.weighed(rng.integers(0, 60, 2 << lex.bits)))
    before = rng.integers(0, 21, 130).tolist()
    read = m.score(np.array(before, np.int32), np.array([130]))[0]
    after = [m.score(np.array([*before, k], np.int32), np.array([131]))[0] - read for k in range(lex.escape + 1)]
    assert abs(np.exp(after).sum() - 1) < 1e-3


def test_scores_do_not_depend_on_neighbours():
    lex = M.Lexicon([b"a", b"b", M.END], [9, 5, 3], 2)
    m = M.Model(lex, M.weighed(np.random.default_rng(1).integers(0, 9, 2 << lex.bits)))
    texts = ["a b " * 200, "", "c a", "b " * 70]
    together = m.score(*lex.tokens(texts)[:2])
    assert np.allclose(together, [m.score(*lex.tokens([t])[:2])[0] for t in texts], atol=1e-9)


def test_counts_beyond_two_bytes():
    c = M.Counts(14)
    for _ in range(9):
        c.add(np.full(20_000, 7))
        c.settle()
    c.add(np.array([7, 8, 40_000 % (2 << 14)]))
    got = np.concatenate([b.astype(np.int64) for b in c.blocks(M.SLOT_BLOCK)])
    assert got[7] == 180_001 and got[8] == 1 and got.sum() == 180_003


def test_slots_grow_with_the_corpus():
    bits = [M.slot_bits(n) for n in (0, 10_000, 100_000, 1_000_000, 8_000_000, 10**9)]
    assert bits == sorted(bits) and bits[0] == M.LEAST_SLOT_BITS and bits[-2] == bits[-1] == M.MOST_SLOT_BITS


def brute_scores(rows, held):
    """Bit by bit in plain Python, from the module's statement: log10 probability of each text."""
    words = lambda t: [w.encode() for w in re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))] + [M.END]
    c = Counter(w for d, t in rows if not held(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    listed = sorted(c, key=lambda w: (-c[w], w))
    lex = M.Lexicon(listed, [c[w] for w in listed], 0, M.slot_bits(n))
    symbol = {w: i for i, w in enumerate(listed)}
    escape, none = len(listed), len(listed) + 1
    codes = lex.codes
    path = lambda k: [(int(x) >> 1, int(x) & 1) for x in codes.code[codes.start[k] : codes.start[k + 1]]]

    def steps(text):
        """(token number, node, bit, slots) of each bit"""
        ids = [symbol.get(w, escape) for w in words(text)]
        for i, k in enumerate(ids):
            near = [ids[i - 1] if i > 0 else none, ids[i - 2] if i > 1 else none]
            for node, bit in path(k):
                yield i, node, bit, [int(M.slot(np.array([node], np.uint32) * M._MIX[0], (np.array([x], np.uint32) * np.uint32(8) + np.uint32(j)) * M._MIX[1], lex.bits)[0]) for j, x in enumerate(near)]

    seen = Counter()
    for d, t in rows:
        if not held(d):
            seen.update((s, bit) for _, _, bit, slots in steps(t) for s in slots)
    told = lambda s: int(M.weighed(np.array([seen[s, 0], seen[s, 1]]))[0])
    out = {}
    for d, t in rows:
        weights, table, total, run = M.first_weights().tolist(), [1 / (1 + math.exp(-(k - (M.BINS - 1) / 2) * float(M.WIDTH))) for k in range(M.BINS)], 0.0, []
        for i, node, bit, slots in [*steps(t), (None, 0, 0, [])]:
            if run and (i is None or i // M.RUN != run[0][0]):  # what a run learnt counts from the next one on
                for _, key, odds, err, own, off in run:
                    for k in range(3):
                        weights[key][k] += err * odds[k] * 0.01
                    table[own] += 0.005 * off
                table = [min(max(x, 0.001), 0.999) for x in table]
                run = []
            if i is None:
                break
            a, b = map(told, slots)
            key, odds = (a & 3) * 4 + (b & 3), [float(codes.odds[node]), float(M.STEPS[a >> 2]), float(M.STEPS[b >> 2])]
            z = min(max(sum(w * o for w, o in zip(weights[key], odds)), -11), 11)
            p = 1 / (1 + math.exp(-z))
            own = int(min(max(z / float(M.WIDTH) + M.BINS / 2, 0), M.BINS - 1))
            final = 0.85 * p + 0.15 * table[own]
            total += math.log10(final if bit else 1 - final)
            run.append((i // M.RUN, key, odds, bit - p, own, bit - table[own]))
        unknown = sum(w not in symbol for w in words(t))
        out[d] = total - unknown * math.log10(0 + v - len(listed) + 1)
    return out


def test_scores_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000").orderBy("doc_id").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    want = brute_scores(rows, held)
    out = M.score_texts(docs, common.remainder("doc_id", 7) == 2).collect()
    assert len(out) == len(want)
    for r in out:
        assert r.score == pytest.approx(want[r.doc_id], rel=2e-3, abs=0.02), r.doc_id
        text = dict(rows)[r.doc_id] or ""
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / sum(len(w) + 1 for w in [*text.encode().split(), b""]))


@pytest.mark.parametrize("lexicon_words", [0, 3, 1 << 18])
def test_odd(odd, empty, lexicon_words):
    docs = odd.drop("score")
    held = common.remainder("doc_id", 7) == 2
    out = M.score_texts(docs, held, lexicon_words=lexicon_words)
    assert got(out) == brute_base([(r.doc_id, r.text) for r in docs.collect()])
    assert out.where("score is null or isnan(score) or score > 0").count() == 0
    assert M.score_texts(empty, held).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    assert {(r.n_known, r.train_tokens, r.base_score) for r in M.score_texts(docs, common.remainder("doc_id", 7) == 2).collect()} == {(0, 0, 0.0)}


def test_query(spark):
    out = op9_mixing_lm(spark, "/root/testdata/sf0.01").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    want = brute_base([(r.doc_id, r.text) for r in docs])
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=str) == want
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert np.mean([r.score > r.base_score for r in held]) > 0.8
