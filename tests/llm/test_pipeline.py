import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import sentencepiece
from gridlark.llm import queries
from tests.llm import test_line_dedup, test_near_copies, test_source_mixing

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's rows, with those of `documents` first."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs.collect()]
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        f(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "source_mixing", "sentencepiece"]
    assert all(rows[0].__fields__ == stages[0][0].__fields__ for rows in stages[:5])


def test_toxic_documents_go(spark, stages):
    flagged = {r.doc_id for r in queries.op3_toxicity(spark, SMALL).collect() if r.toxic}
    assert {r.doc_id for r in stages[1]} == {r.doc_id for r in stages[0]} - flagged
    assert flagged


def test_lines(stages):
    want = [(d, t) for d, t, _, _ in test_line_dedup.brute([(r.doc_id, r.text) for r in stages[1]])]
    assert sorted((r.doc_id, r.text) for r in stages[2]) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in stages[2])


def test_one_of_each_group_stays(stages):
    docs = sorted((r.doc_id, r.text) for r in stages[2])
    groups = test_near_copies.brute_components([t for _, t in docs])
    assert sorted(r.doc_id for r in stages[3]) == sorted({docs[c][0] for c in groups})


def test_mix(spark, stages):
    rows = [(r.doc_id, r.source, r.text) for r in stages[3]]
    tokens = Counter()
    for _, s, t in rows:
        tokens[s] += len(t.encode().split())
    power = 1 - np.log(2.0) / np.log(max(tokens.values()) / min(t for t in tokens.values() if t))
    want = test_source_mixing.brute(rows, max(power, 0.0))
    assert abs(len(want) - len(stages[4])) <= 2
    assert {r.doc_id for r in stages[4]} == {d for d, _, _ in rows}


def test_encoding(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in stages[4]}
    assert Counter(r.doc_id for r in stages[5]) == Counter(r.doc_id for r in stages[4])
    for r in stages[5]:
        ids = library.encode(text[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, stages[5]))


def test_odd_rows(spark, odd, empty, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 1), (None, None, None)], "doc_id long, quality long, toxic long")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, empty):
        for name, f in corpus_pipeline.STAGES[:-1]:
            docs = f(spark, docs, str(tmp_path))
            assert docs.columns == odd.columns, name
            assert docs.where("kept != 'clash' or toxicity != 'clash' or mix != 'clash'").count() == 0, name
        assert corpus_pipeline.encode(spark, docs, str(tmp_path)).count() == docs.count()
