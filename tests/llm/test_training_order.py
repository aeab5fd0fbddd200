import hashlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from gridlark.llm import training_order as T
from gridlark.llm.queries import op2_training_order, tokenizer_path
from hypothesis import given, settings
from hypothesis import strategies as st


@given(st.integers(1, 3000), st.integers(0, 2**63))
@settings(max_examples=40, deadline=None)
def test_permutation(n, key):
    x = np.arange(n)
    y = T.permute(x, n, key)
    assert sorted(y.tolist()) == list(range(n))
    assert T.permute(y, n, key, inverse=True).tolist() == x.tolist()


def test_permutation_depends_on_key_and_mixes():
    a, b = T.permute(np.arange(10_000), 10_000, 1), T.permute(np.arange(10_000), 10_000, 2)
    assert (a == b).mean() < 0.01
    assert abs(np.corrcoef(np.arange(10_000), a)[0, 1]) < 0.05


LIBRARY = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def brute(rows, length, key):
    """slot -> (number, tokens with PAD, tokens without)"""
    stream = []
    for _, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        stream += LIBRARY.encode(t or "", add_bos=True, add_eos=True)
    n = -(-len(stream) // length)
    slots = T.permute(np.arange(n), n, key)
    parts = [stream[k * length : (k + 1) * length] for k in range(n)]
    return {int(s): (k, [*x, *[T.PAD] * (length - len(x))], len(x)) for k, (s, x) in enumerate(zip(slots, parts))}


def got(df):
    return {r.slot: (r.number, np.frombuffer(r.tokens, "<u2").tolist(), r.n_tokens) for r in df.collect()}


def ordered(docs, **options):
    return T.training_order(docs, tokenizer_path("piece_bpe_32k.model"), **options)


@pytest.mark.parametrize("sizes", [[3] * 100, [2, 700, 1, 64, 64, 5], [64, 128, 192]])
@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_a_range_sends_one_row_a_sequence(sizes, batch):
    rng, length = np.random.default_rng(5), 64
    docs = [(part, rng.integers(0, 30_000, n).astype("<u2")) for part in (0, 1, 3) for n in sizes]
    each = sum(sizes)
    starts, total = [0, each, 2 * each, 2 * each], -(-3 * each // length)
    rows = [(p, len(x), T.pack(x.tobytes())) for p, x in docs]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("part", "n", "ids"), r)) for r in rows[i : i + batch]], pa.schema({"part": pa.int32(), "n": pa.int64(), "ids": pa.binary()})) for i in range(0, len(rows), batch)]
    sent = sorted((r["number"], r["at"], r["n"], r["slot"], T.unpack(r["data"], r["n"])) for b in T.cut(iter(batches), starts=starts, total=total, key=1, length=length) for r in b.to_pylist())
    assert b"".join(r[4] for r in sent) == b"".join(x.tobytes() for _, x in docs)
    assert [r[3] for r in sent] == T.permute(np.array([r[0] for r in sent]), total, 1).tolist()
    at = 0
    for number, start, n, _, _ in sent:
        assert number * length + start == at and start + n <= length
        at += n
    assert len(sent) <= total + 2  # only where a range ends within a sequence are there two rows


def test_packing(spark):
    """What packed ids of whole texts and of sequences take of their bytes (0.684 and 0.716 at zstd's level 1)."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    ids = [np.array(x, "<u2") for x in LIBRARY.encode(texts, add_bos=True, add_eos=True)]
    flat = np.concatenate(ids)
    for parts, most in ((ids, 0.67), ([flat[i : i + T.LENGTH] for i in range(0, len(flat), T.LENGTH)], 0.7)):
        packed = [T.pack(x.tobytes()) for x in parts]
        assert all(T.unpack(p, len(x)) == x.tobytes() for p, x in zip(packed, parts))
        assert sum(map(len, packed)) < most * flat.nbytes


@pytest.mark.parametrize("range_rows", [2, 2000])
def test_odd(odd, empty, range_rows):
    out = ordered(odd, length=8, shard_sequences=5, range_rows=range_rows)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(out) == brute(rows, 8, 1)
    assert out.count() == len(got(out))
    assert ordered(empty).count() == 0 and T.write_shards(ordered(empty), "/tmp/never").count() == 0


def test_query(spark):
    """The registered query's shards, read back from its folder, are the brute-force order of the whole table."""
    out = op2_training_order(spark, "/root/testdata/sf0.01").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    want = brute([(r.doc_id, r.text) for r in docs], T.LENGTH, 1)
    folder = out[0].folder
    assert [x.tolist() for x in T.read_from(folder)] == [want[s][1] for s in range(len(want))]
    for r in out:
        raw = np.array([want[s][1] for s in range(r.first_slot, r.first_slot + r.n_sequences)], "<u2").tobytes()
        assert (r.first_slot, r.bytes, r.sha256) == (r.shard * T.SHARD_SEQUENCES, len(raw), hashlib.sha256(raw).hexdigest())
    assert sum(r.n_sequences for r in out) == len(want) and sum(r.n_tokens for r in out) == sum(w[2] for w in want.values())


def test_shards(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = ordered(docs, length=256, shard_sequences=100)
    want = [np.frombuffer(r.tokens, "<u2").tolist() for r in out.orderBy("slot").collect()]
    folder = f"file://{tmp_path}/shards"
    made = {r.shard: r for r in T.write_shards(out, folder).collect()}
    for k, r in made.items():
        raw = (tmp_path / "shards" / T.shard_name(k)).read_bytes()
        assert len(raw) == r.bytes and hashlib.sha256(raw).hexdigest() == r.sha256
    assert sum(r.bytes for r in made.values()) == len(want) * 512
    for start in (0, 1, 99, 100, 257, len(want) - 1, len(want)):  # resumes in the middle of a shard
        assert [x.tolist() for x in T.read_from(folder, start, length=256, shard_sequences=100)] == want[start:]
    assert not [p for p in (tmp_path / "shards").iterdir() if p.name.startswith(".")]
