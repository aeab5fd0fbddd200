import hashlib
import time

import numpy as np
import pytest
import sentencepiece
from gridlark.llm.queries import op5_sentencepiece, tokenizer_path
from gridlark.llm.sentencepieces import CharacterMap, PieceModel, _fields, encode_documents
from hypothesis import given, settings
from hypothesis import strategies as st

PATH = tokenizer_path("piece_bpe_32k.model")
TEXTS = ["", " ", "  a  b ", "\n", "a\nb\n\n c", "▁x ▁", "日本語 テスト🙂🙂", "\t\tx", "a" * 300, "\x00a", "<s> </s> <0x0A>", "x▁▁ y", "|a|b| c |", "\r\n", "Hello, world. This is it.", "L'été où être naïf"]


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        blob = f.read()
    return PieceModel(blob), sentencepiece.SentencePieceProcessor(model_proto=blob)


@pytest.mark.parametrize("text", TEXTS)
def test_as_the_library(both, text):
    own, library = both
    ids = own.encode(text)
    assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)
    assert own.decode(ids) == library.decode(ids.tolist())
    spans = own.spans(text, ids)
    raw = text.encode()
    assert b"".join(raw[a:b] for a, b in spans) == raw  # every byte belongs to one piece, in order
    proto = library.encode(text, return_type="proto")
    at = [len(text[:i].encode()) for i in range(len(text) + 1)]
    assert spans[1:-1].tolist() in ([[p.begin, p.end] for p in proto.pieces], [[at[min(p.begin, len(text))], at[min(p.end, len(text))]] for p in proto.pieces])


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_character_map(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = library.serialized_normalizer_spec
    spec = dict(_fields(spec() if callable(spec) else spec))
    m = PieceModel.__new__(PieceModel)
    m.map = CharacterMap(spec[2])
    m.dummy, m.squeeze, m.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
    for text in ["Ｈｅｌｌｏ　 ㌔ ﬁne  ", "①②  x", "Ǻé ẞ", "  a\tb​c ", "ｶﾞ日", "½", "   ", "", *TEXTS]:
        text = text.replace("\x00", "")
        norm, place = m.normalise(text)
        assert norm == library.normalize(text)
        assert len(place) == len(norm.encode()) + 1 or not norm
        assert (np.diff(place) >= 0).all()


@given(st.text(alphabet="abcdeé日🙂.-", min_size=1, max_size=200))
@settings(max_examples=150, deadline=None)
def test_long_units_merge_alike(text):
    m = PieceModel(open(PATH, "rb").read()) if not _made else _made[0]
    _made[:] = [m]
    assert m._merged(text) == m._merged_long(text)


_made: list[PieceModel] = []


def test_a_megabyte_without_blanks(both):
    own, library = both
    text = "".join(np.random.default_rng(0).choice(list("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/"), 1_000_000))
    start = time.perf_counter()
    ids = own.encode(text)
    assert time.perf_counter() - start < 20  # a few seconds alone
    assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_the_short_way_is_the_character_maps_way(both, spark):
    """Without a map, encode and spans replace blanks alone. Going through the map's record gives the same on the whole table."""
    own, _ = both
    assert own.plain
    mapped = PieceModel(open(PATH, "rb").read())
    mapped.plain = False
    for t in [*TEXTS, *(r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())]:
        ids = own.encode(t)
        assert (mapped.encode(t) == ids).all() and (mapped.spans(t, ids) == own.spans(t, ids)).all()


def test_query(spark, both):
    """The registered query against the library, on the whole table."""
    library, docs = both[1], spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in docs:
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want.append((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode())))
    got = op5_sentencepiece(spark, "/root/testdata/sf0.01").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_documents(spark, odd, both):
    own, library = both
    rows = encode_documents(odd, PATH, output="digest").collect()
    pieces = encode_documents(odd, PATH).collect()
    assert len(rows) == odd.count() == len(pieces)
    text = {r.doc_id: r.text for r in odd.collect()}
    for r in rows:
        ids = library.encode(text[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    for r in pieces:
        assert r.decoded == library.decode(list(r.ids))


def test_empty(empty):
    assert encode_documents(empty, PATH, output="digest").count() == 0


def test_workers_remember_nothing_between_tasks(spark):
    """A worker that has encoded serves other stages next; the units that it has met would stay in its memory."""

    def remembered(batches):
        import pyarrow as pa
        from gridlark.llm import sentencepieces

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(m.packed) for m in sentencepieces._models.values())], pa.int64())], ["n"])

    rows = spark.range(400).selectExpr("id AS doc_id", "concat('some words and number ', id) AS text").repartition(4)
    assert encode_documents(rows, PATH, output="digest").count() == encode_documents(rows, PATH).count() == 400
    encode_documents(rows, PATH, output="digest").collect()
    assert {r.n for r in rows.select("doc_id").mapInArrow(remembered, "n long").collect()} == {0}
