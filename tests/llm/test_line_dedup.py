from collections import defaultdict

import duckdb
import pytest
from gridlark.llm.line_dedup import apply_bitmaps, dedup_lines
from gridlark.llm.queries import ORACLE_SQL, op10_line_dedup


def brute(rows):
    """(doc_id, text) pairs to (doc_id, kept text, lines, dropped)."""
    order = lambda d: float("inf") if d is None else d
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(order(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(h := holders.get(key(x), ())) > 1 and min(h) != order(d))]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def run(df, settle=1 << 20):
    got = apply_bitmaps(dedup_lines(df, settle=settle)).collect()
    return sorted(((r.doc_id, r.kept.text, r.kept.n_lines, r.kept.n_dropped) for r in got), key=str)


TEXTS = ["A shared line here\nown line of one", "own line of two\n  a SHARED line here \t", "a shared line here\na shared line here", "short\nshort", "short\n\n", None, "ÉÉÉÉÉÉÉÉÉÉ\néééééééééé", "éééééééééé", "\x1ca shared line here", "a shared line here\n" * 70 + "end of it all"]


@pytest.mark.parametrize("settle", [1, 32 << 20])
def test_against_brute_force(spark, odd, empty, settle):
    df = spark.createDataFrame([(i * 7 % 11, t) for i, t in enumerate(TEXTS)] + [(3, "a shared line here again")] * 2 + [(None, "a shared line here again")], "doc_id long, text string").repartition(3)
    assert run(df, settle) == brute([tuple(r) for r in df.collect()])
    assert run(odd, settle) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert run(empty, settle) == []


def test_against_sql(spark):
    got = sorted(map(tuple, op10_line_dedup(spark, "/root/testdata/sf0.01").collect()))
    db = duckdb.connect()
    db.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    assert got == sorted(db.execute(ORACLE_SQL["op10_line_dedup"]).fetchall())
    assert sum(r[2] for r in got) > 0
