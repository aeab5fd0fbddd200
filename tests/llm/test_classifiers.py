import zlib
from pathlib import Path

import numpy as np
import pytest
from gridlark.llm import quality, queries, toxicity
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(1, 10)] + [(None, 1, 1), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def planted(spark, n=240):
    """Rude documents in which one of a few stems stands, junk ones with signs after words, and clean ones."""
    rng = np.random.default_rng(1)
    common = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = rng.choice(common, 60).tolist()
        kind = i % 4
        if kind == 1:
            w[5:5] = [f"blarg{rng.choice(list('abcdefgh'))}x", "Snork."]
        if kind == 2:
            w = [f"{x}###" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(kind != 2), int(kind == 1)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_chain_on_planted(spark):
    docs, labels = planted(spark)
    seen = labels.where("doc_id < 160")
    model = toxicity.fit_toxicity(docs, seen, queries.toxicity_categories())
    got = toxicity.score_toxicity(docs, model).join(labels, "doc_id").where("doc_id >= 160").collect()
    for name, want in (("junk", lambda r: r.quality == 0), ("toxic", lambda r: r.toxic == 1), ("unfit", lambda r: r.quality == 0 or r.toxic == 1)):
        assert np.mean([(r.toxicity[name] >= 0.5) == want(r) for r in got]) > 0.95, name


def test_chain_links_are_out_of_fold():
    """A later category that equals an earlier one, whose own terms say nothing more, must use the chain."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    docs = [np.unique([int(10 * (1 + v)), *rng.integers(100, 2000, 5)]) for v in np.where(rng.random(400) < 0.9, y, 1 - y)]
    model = toxicity.fit_chain(docs, np.stack([y, y], 1), ["a", "b"])
    assert model.links[1, 0] > 0.1


def test_quality_on_planted(spark):
    docs, labels = planted(spark)
    model = quality.fit_quality(docs, labels.where("doc_id < 160"), F.col("quality"))
    got = quality.score_quality(docs, model).join(labels, "doc_id").where("doc_id >= 160").collect()
    assert np.mean([(r.score >= 0.3) == (r.quality == 1) for r in got]) > 0.9


def test_odd_rows(odd, empty, labels):
    for docs in (odd, empty):
        model = toxicity.fit_toxicity(docs, labels, queries.toxicity_categories())
        got = toxicity.score_toxicity(docs, model)
        assert got.count() == docs.count() and set(docs.columns) == set(got.columns)  # `toxicity` was there and is replaced
        assert got.where("toxicity.toxic is null or isnan(toxicity.toxic)").count() == 0
        model = quality.fit_quality(docs, labels, F.col("quality"))
        got = quality.score_quality(docs.drop("score"), model)
        assert got.count() == docs.count()
        assert got.where("score is null or score < 0 or score > 1").count() == 0


def test_no_labels(odd, labels):
    none = labels.where("false")
    assert toxicity.score_toxicity(odd, toxicity.fit_toxicity(odd, none, queries.toxicity_categories())).where("toxicity.toxic > 0.5").count() == 0
    assert {r.score for r in quality.score_quality(odd.drop("score"), quality.fit_quality(odd, none, F.col("quality"))).collect()} == {0.5}


def test_queries_hold_out(spark):
    got = {r.doc_id: r for r in queries.op4_quality(spark, SMALL).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for i, r in got.items())
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert np.mean([got[i].predicted == r.quality for i, r in labels.items() if got[i].held_out]) > 0.9
    flagged = {r.doc_id for r in queries.op3_toxicity(spark, SMALL).collect() if r.toxic}
    assert np.mean([(i in flagged) == bool(r.toxic) for i, r in labels.items()]) > 0.97


def resident() -> int:
    """MB of this process that are its own."""
    size = Path("/proc/self/smaps_rollup").read_text()
    return sum(int(line.split()[1]) for line in size.splitlines() if line.startswith("Pss_Anon:")) // 1024


def test_driver_gives_back_what_the_fit_took(spark):
    words = "array_join(transform(sequence(1, 200), i -> translate(hex(xxhash64(id, i) % 60000), '0123456789', 'ghijklmnop')), ' ')"
    docs = spark.range(6000).selectExpr("id AS doc_id", f"{words} AS text")
    labels = spark.range(6000).selectExpr("id AS doc_id", "cast(id % 3 = 0 AS int) AS toxic")
    toxicity.fit_toxicity(docs.limit(10), labels, {"toxic": F.col("toxic")})
    before = resident()
    model = toxicity.fit_toxicity(docs, labels, {"toxic": F.col("toxic")})
    assert model.weights.shape[0] == 1
    assert resident() - before < 30
