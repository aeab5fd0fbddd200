import re

import numpy as np
import pytest
import xxhash
from gridlark.llm import simhash as S
from gridlark.llm.queries import op8_simhash
from hypothesis import given, settings
from hypothesis import strategies as st


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", text)
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(prints):
    """{place: smallest place reachable}"""
    n, root = len(prints), list(range(len(prints)))
    p = np.array(prints, np.uint64)
    todo = list(range(n))
    seen = {}
    for i in todo:
        if i in seen:
            continue
        stack = [i]
        seen[i] = i
        while stack:
            k = stack.pop()
            for j in np.flatnonzero(np.bitwise_count(p ^ p[k]) <= 3).tolist():
                if j not in seen:
                    seen[j] = i
                    stack.append(j)
    return [seen[i] for i in root]


@given(st.lists(st.sampled_from(["A", "b", "ÀB", "\x1c", " ", "\n", "\x0b", "  ", "word", "x\x85y"]), max_size=30))
@settings(max_examples=60, deadline=None)
def test_fingerprint(parts):
    text = " ".join(parts)
    assert S.simhash(text) == brute_print(text) == S.simhash(text, step=2)


def clustered(rng, n):
    p = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
    near = p[: n // 4].copy()
    for k in range(len(near)):
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    one_half = (p[:1] & np.uint64(0xFFFFFFFF)) | (rng.integers(0, 2**24, 400, dtype=np.uint64) << np.uint64(32))
    return np.unique(np.concatenate([p, near, one_half]))


def test_shard_search_finds_what_brute_force_finds():
    p = clustered(np.random.default_rng(3), 3000)
    found, every, low = S.ShardSearch(p), np.arange(len(p)), np.uint64(0xFFFFFFFF)
    found.search(every, every, p & low, 1, p & ~low)
    found.search(every, every, p & ~low, 1, p & low)
    assert found.root.tolist() == brute_components(p)


@pytest.mark.parametrize("shard_points", [100_000, 120, 1])
def test_links_over_shards(spark, shard_points):
    p = clustered(np.random.default_rng(5), 1500)
    want = brute_components(p)
    points = spark.createDataFrame([(i, int(x)) for i, x in enumerate(p.view(np.int64))], "vertex long, simhash long").repartition(3)
    got = {r.vertex: r.component for r in S.components(S.near_links(points, shard_points=shard_points)).collect()}
    assert [got.get(i, i) for i in range(len(p))] == want


@pytest.mark.parametrize("task_links", [S.TASK_LINKS, 0])
def test_components_of_chains_and_stars(spark, task_links):
    found = lambda e: S.components(spark.createDataFrame(e, "src long, dst long"), task_links=task_links).collect()
    links = [(i, i + 1) for i in range(10, 60)] + [(100, i) for i in range(101, 150)] + [(7, 7), (3, 2), (2, 3)]
    got = {r.vertex: r.component for r in found(links)}
    far = [((1 << 62) + i, (1 << 62) + i + 1) for i in range(30)] + [(-(1 << 62) - i, -(1 << 62) - i - 1) for i in range(30)]
    assert {r.component for r in found(far)} == {1 << 62, -(1 << 62) - 30}
    assert got == {**{i: 10 for i in range(10, 61)}, **{i: 100 for i in range(100, 150)}, 2: 2, 3: 2}


def test_odd(odd, empty):
    got = S.near_duplicates(odd).collect()
    rows = {}
    for r in got:
        rows.setdefault(r.doc_id, set()).add((r.simhash, r.component_id))
    assert len(got) == odd.count()
    assert {i: rows[i] for i in (1, 2, 3)} == {i: {(0, 1)} for i in (1, 2, 3)}
    assert len(rows[7]) == 1 and next(iter(rows[6]))[1] == 5 and next(iter(rows[None]))[1] is None
    assert S.near_duplicates(empty).count() == 0


def test_query_against_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    prints = [brute_print(t) for _, t in docs]
    want = [(d, f"{p:016x}", docs[c][0]) for (d, _), p, c in zip(docs, prints, brute_components(prints))]
    assert sorted(map(tuple, op8_simhash(spark, "/root/testdata/sf0.001").collect())) == want
