import struct

import numpy as np
import pytest
from gridlark.functions import dates as D
from gridlark.functions import random as R
from gridlark.sources import arrays as A
from gridlark.streaming import incremental as S
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

X = np.arange(12.0).reshape(3, 4) / 7


def test_round_trips():
    assert np.array_equal(A.parse_npy(A.encode_npy(X)), X) and np.array_equal(A.parse_npy(A.encode_npy(np.asfortranarray(X))), X)
    back = A.parse_npz(A.encode_npz({"a": X, "b": X.astype("i4")}))
    assert np.array_equal(back["a"], X) and back["b"].dtype == np.int32
    assert np.allclose(A.parse_text(A.encode_text(X)), X) and np.allclose(A.parse_text(b"# c\n1,,3\n4,5,6 # x\n", ","), [[1, np.nan, 3], [4, 5, 6]], equal_nan=True)
    i, j = np.nonzero(X)
    i2, j2, v2, shape = A.parse_matrix_market(A.encode_matrix_market(i, j, X[i, j], X.shape))
    assert shape == (3, 4) and np.array_equal(v2, X[i, j]) and np.array_equal(i2, i) and np.array_equal(j2, j)
    s = A.parse_matrix_market(b"%%MatrixMarket matrix coordinate real symmetric\n2 2 2\n1 1 5\n2 1 3\n")
    assert sorted(zip(*s[:3])) == [(0, 0, 5.0), (0, 1, 3.0), (1, 0, 3.0)]
    wav = (np.sin(np.arange(50)) * 9999).astype("<i2")
    assert A.parse_wav(A.encode_wav(8000, wav))[0] == 8000 and np.array_equal(A.parse_wav(A.encode_wav(8000, wav))[1][:, 0], wav)
    assert np.array_equal(A.parse_fortran(A.encode_fortran([X[0], X[1]]))[1], X[1]) and np.array_equal(A.parse_mat(A.encode_mat({"m": X}))["m"], X)
    name = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    head = b"CDF\1" + struct.pack(">i", 0) + struct.pack(">ii", 10, 1) + name("x") + struct.pack(">i", 3) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, 1) + name("v") + struct.pack(">ii", 1, 0) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 6, 24)
    assert np.array_equal(A.parse_netcdf(head + struct.pack(">i", len(head) + 4) + np.array([1.0, 2, 3], ">f8").tobytes())["v"], [1, 2, 3])


@given(st.binary(max_size=200))
@settings(max_examples=200, deadline=None)
def test_broken_files_are_refused(raw):
    for parse in (A.parse_npy, A.parse_mat, A.parse_netcdf, A.parse_fortran):
        for lead in (b"", A.encode_npy(X)[:80], b"CDF\1"):
            try:
                parse(lead + raw)
            except (ValueError, struct.error, SyntaxError, IndexError, KeyError, TypeError, UnicodeDecodeError, MemoryError):
                pass


def test_read_arrays(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.npy").write_bytes(A.encode_npy(X + k))
    rows = A.read_arrays(spark, f"{tmp_path}/*.npy", "npy", 2).collect()
    assert len(rows) == 36 and {(r.i0, r.i1, round(r.v, 9)) for r in rows if r.path.endswith("2.npy")} == {(a, b, round(X[a, b] + 2, 9)) for a in range(3) for b in range(4)}
    (tmp_path / "m.mtx").write_bytes(A.encode_matrix_market([0], [1], [2.5], (2, 2)))
    assert A.read_matrix_market(spark, f"{tmp_path}/m.mtx").select("i", "j", "v").first() == (0, 1, 2.5)
    A.write_text(spark.createDataFrame([(1, 2.5)], "a int, b double"), f"{tmp_path}/out", ["a", "b"])
    assert spark.read.text(f"{tmp_path}/out").first()[0] == "1,2.5"


def test_dates(spark):
    days = np.arange("2023-12-20", "2024-03-10", dtype="datetime64[D]")
    hol = ["2023-12-25", "2024-01-01", "2024-02-10"]
    df = spark.createDataFrame([(str(a), str(b)) for a in days[::7] for b in days[::5]], "a string, b string").select(F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"))
    for r in df.select("a", "b", D.busday_count(F.col("a"), F.col("b"), holidays=hol).alias("n"), D.is_busday(F.col("a"), holidays=hol).alias("w"), D.busday_offset(F.col("a"), 5, roll="forward").alias("o"), D.busday_offset(F.col("a"), -3, roll="backward").alias("p"), D.months(F.col("a")).alias("m")).collect():
        assert r.n == np.busday_count(r.a, r.b, holidays=hol), (r.a, r.b)
        assert r.w == np.is_busday(r.a, holidays=hol) and r.o == np.busday_offset(r.a, 5, roll="forward").astype(object) and r.p == np.busday_offset(r.a, -3, roll="backward").astype(object)
        assert r.m == np.datetime64(r.a, "M").astype(int)
    assert D.date_range(spark, "2024-01-01", "2024-01-10", 3).count() == 3


def test_random(spark):
    assert [r.x for r in R.stream(spark, "normal", 5, seed=3).collect()] == np.random.default_rng(3).normal(size=5).tolist()
    df = spark.range(4000).select("id", R.uniform(1, F.col("id")).alias("u"), R.normal(2, F.col("id")).alias("n"), R.integers(3, 0, 6, F.col("id")).alias("k"))
    r = df.agg(F.avg("u"), F.stddev("n"), F.min("k"), F.max("k"), F.avg("n")).first()
    assert abs(r[0] - 0.5) < 0.02 and abs(r[1] - 1) < 0.05 and (r[2], r[3]) == (0, 5) and abs(r[4]) < 0.06
    assert df.repartition(7).orderBy("id").select("u").collect() == df.orderBy("id").select("u").collect()
    assert sorted(x.i for x in R.permutation(spark.range(100), 5, ["id"]).collect()) == list(range(100)) and R.choice(spark.range(50), 7, 1, "id").count() == 7
    assert R.spawned(spark, "random", 21, seed=1, parts=4).count() == 21


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    src = str(tmp_path / "src")
    events.repartition(4).write.parquet(src)
    live = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(src)

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return sorted(map(str, spark.table(name).collect()))

    f = lambda d: S.windowed_statistics(d, "ts", "value", "1 hour", delay="3650 days").select("start", "count", F.round("mean", 9).alias("mean"), "min", "max")
    assert run(f(live()), "complete", "stats") == sorted(map(str, f(events).collect()))
    g = lambda d: S.windowed_histogram(d, "ts", "value", "1 day", [0.0, 10.0, 50.0, 1000.0], delay="3650 days")
    assert run(g(live()), "complete", "hist") == sorted(map(str, g(events).collect()))
    assert S.sessions(events, "ts", ["user_id"], "30 minutes", "value").agg(F.sum("count")).first()[0] == events.count()
    assert len(run(S.carried_filter(live(), "user_id", "ts", "value", 0.3), "append", "filter")) == events.count()
    with pytest.raises(ValueError):
        A.parse_npy(b"nothing")
