import numpy as np
import pytest
from gridlark.operators import reduce as R
from gridlark.operators.nd import NDFrame, broadcast_shapes, einsum, promote
from pyspark.sql import functions as F

A = np.arange(24.0).reshape(4, 6) % 7 - 2
T3 = np.arange(24.0).reshape(2, 3, 4)


@pytest.fixture(scope="module")
def frames(spark):
    return NDFrame.array(spark, A), NDFrame.array(spark, T3)


def same(frame, want):
    want = np.asarray(want, float)
    assert frame.shape == want.shape
    assert frame.df.count() == want.size
    assert np.allclose(frame.to_numpy(), want, equal_nan=True)


@pytest.mark.parametrize("spec", ["1:3", "::-1", "1", "-1, 2", "..., 1", "None, 1:, ::2", "0:0", "::2, 5:0:-2", ":, None, 3"])
def test_slices(frames, spec):
    a, _ = frames
    same(eval(f"a[{spec}]"), eval(f"A[{spec}]"))


def test_views(frames):
    a, t = frames
    same(a.transpose(), A.T)
    same(t.transpose([2, 0, 1]), T3.transpose(2, 0, 1))
    same(t.move_axis(0, -1), np.moveaxis(T3, 0, -1))
    same(t.reshape(4, -1), T3.reshape(4, -1))
    same(a.ravel(), A.ravel())
    same(a.expand_dims(1).squeeze(), A)
    same(a.flip(0), A[::-1])
    same(a.roll(-2, 1), np.roll(A, -2, 1))
    same(a.rot90(), np.rot90(A))
    same(a.diagonal(1), np.diagonal(A, 1))
    same(a[0].diag(-1), np.diag(A[0], -1))
    same(a.tril(1), np.tril(A, 1))
    same(a[1].broadcast_to((3, 6)), np.broadcast_to(A[1], (3, 6)))
    assert a.trace(1) == np.trace(A, 1)
    with pytest.raises(IndexError):
        a[9]


def test_joining(frames, spark):
    a, _ = frames
    same(NDFrame.concatenate([a, a[:1]]), np.concatenate([A, A[:1]]))
    same(NDFrame.stack([a[0], a[1]], 1), np.stack([A[0], A[1]], 1))
    same(a.repeat(2, 0), np.repeat(A, 2, 0))
    same(a.tile(2, 1), np.tile(A, (1, 2)))
    for mode in ("constant", "edge", "reflect", "symmetric", "wrap"):
        same(a.pad(2, 3, 1, mode), np.pad(A, ((0, 0), (2, 3)), mode))
    mask = a.map(lambda v: v > 1)
    same(a[mask], A[A > 1])
    idx = spark.createDataFrame([(0, 3), (1, -1), (2, 0)], "k long, i long")
    same(a.take(idx, 3, 0), A[[3, -1, 0]])
    same(a.take(spark.createDataFrame([(0, 9)], "k long, i long"), 1, 0, "clip"), A.take([9], 0, mode="clip"))
    same(a.put(spark.createDataFrame([(5, 99.0)], "i long, v double")), np.where(np.arange(24).reshape(4, 6) == 5, 99.0, A))


def test_arithmetic(frames, spark):
    a, t = frames
    same(a + a[0], A + A[0])
    same(a[:, :1] * a[:1, :], A[:, :1] * A[:1, :])
    same(t / 3.0, T3 / 3)
    same(a.reduce(R.mean, 0), A.mean(0))
    same(t.reduce(R.max_, (0, 2), keepdims=True), T3.max((0, 2), keepdims=True))
    same(a.sum(), A.sum())
    same(a.matmul(a.transpose()), A @ A.T)
    same(einsum("ij,kj,k->i", a, a, a[:, 0]), np.einsum("ij,kj,k->i", A, A, A[:, 0]))
    same(einsum("ii->", a[:, :4]), np.einsum("ii->", A[:, :4]))


def test_making(spark):
    same(NDFrame.arange(spark, 2, 11, 3), np.arange(2, 11, 3))
    same(NDFrame.linspace(spark, 0, 1, 7), np.linspace(0, 1, 7))
    same(NDFrame.eye(spark, 3, 4, 1), np.eye(3, 4, 1))
    same(NDFrame.geomspace(spark, 1, 1000, 4), np.geomspace(1, 1000, 4))
    assert promote("float32", "int32") == "float64" and promote("uint8", "float32") == "float32" and broadcast_shapes((3, 1), (4,)) == (3, 4)
    with pytest.raises(ValueError):
        broadcast_shapes((3,), (4,))
    cells = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "id long, c array<double>")
    m = NDFrame.from_cells(cells, "id", "c", 2, 2)
    same(m, [[1, 2], [3, 4]])
    assert {r.i0: r.cell for r in m.to_cells().collect()} == {0: [1, 2], 1: [3, 4]} and m.df.agg(F.count("v")).first()[0] == 4
