import hashlib
from collections import defaultdict

import duckdb
import pytest
from gridlark.llm.exact_dedup import MOST, chunks, exact_groups
from gridlark.llm.queries import ORACLE_SQL, op6_exact_dedup
from pyspark.sql import functions as F


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    out = []
    for r in rows:
        ids = groups[r.text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((r.doc_id, keep, len(ids), r.doc_id == keep, hashlib.sha256((r.text or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 2, 0])
def test_odd(odd, empty, bits):
    """Also where the hash has next to no bits, so that nearly all keys are shared."""
    assert sorted(map(tuple, exact_groups(odd, bits=bits).collect()), key=str) == brute(odd.collect())
    assert exact_groups(empty, bits=bits).count() == 0


def test_collisions_at_equal_length(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["ab", "cd", "ab", "ef", "cd", "gh"])], "doc_id long, text string")
    assert sorted(map(tuple, exact_groups(df, bits=0).collect()), key=str) == brute(df.collect())


def test_chunks_join_to_the_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = docs.select("text", chunks(F.col("text")).alias("c")).where("concat_ws('', c) != text or exists(c, x -> length(x) > %d)" % MOST)
    assert got.count() == 0


def test_against_sql(spark):
    got = sorted(map(tuple, op6_exact_dedup(spark, "/root/testdata/sf0.01").collect()))
    db = duckdb.connect()
    db.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    assert got == sorted(db.execute(ORACLE_SQL["op6_exact_dedup"]).fetchall())
