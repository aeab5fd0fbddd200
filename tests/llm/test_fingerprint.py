import hashlib

import numpy as np
import pytest
import xxhash
from gridlark.llm import fingerprint as P
from gridlark.llm.queries import op7_fingerprint
from hypothesis import given, settings
from hypothesis import strategies as st


def plain_ends(t):
    """Chunk ends byte by byte."""
    ends, start, h = [], 0, 0
    for i, b in enumerate(t):
        h = (h * 2 + int(P.GEAR[b])) % 2**32
        n = i + 1 - start
        mask = int(P.STRICT) if n < P.NORMAL else int(P.LAX)
        if n >= P.LEAST and h & mask == 0 or n == P.GREATEST or i + 1 == len(t):
            ends.append(i + 1)
            start = i + 1
    return ends


def plain_set(t):
    out, at = {}, 0
    for e in plain_ends(t):
        out[xxhash.xxh3_64_intdigest(t[at:e]) >> 16] = e - at
        at = e
    return out


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for i, (d, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        new = (t[:-half] if half else t) + following[:half]
        a, b, c = (plain_set(x.encode()) for x in (t, new, following))
        like = lambda x, y: float(x == y) if not x or not y else sum(x[k] for k in set(x) & set(y)) / min(sum(x.values()), sum(y.values()))
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), P.written(a), P.written(b), like(a, b), like(a, c)))
    return sorted(out, key=str)


@given(st.lists(st.text(alphabet="abc é日\n", max_size=600), max_size=5))
@settings(max_examples=50, deadline=None)
def test_chunks(texts):
    raw = [t.encode() for t in texts]
    assert P.chunk_ends(raw) == [plain_ends(t) for t in raw]
    for s in P.chunk_sets(raw):
        assert P.read(P.written(s)) == s


def test_shift_resistant():
    t = bytes(np.random.default_rng(0).integers(97, 123, 20_000, dtype=np.uint8))
    a, b = P.chunk_sets([t, b"some words in front " + t[:9_000] + b"and within " + t[9_000:]])
    assert P.likeness(a, b) > 0.97


@pytest.mark.parametrize("range_rows", [1, 3, 2000])
def test_odd(odd, empty, range_rows):
    odd = odd.repartition(3)
    got = sorted(map(tuple, P.compare_neighbours(odd, range_rows=range_rows).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert P.compare_neighbours(empty, range_rows=range_rows).count() == 0


@pytest.mark.parametrize("range_rows", [17, 2000])
def test_table(spark, range_rows):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, P.compare_neighbours(docs, range_rows=range_rows).collect()), key=str) == want
    if range_rows == 2000:
        got = op7_fingerprint(spark, "/root/testdata/sf0.001").collect()
        assert sorted(map(tuple, got), key=str) == want
        assert np.mean([r.near_edited for r in got]) > 0.35 > 0.1 > np.mean([r.near_next for r in got])
