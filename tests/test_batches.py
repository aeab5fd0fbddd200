"""Equal rows of a batch are evaluated once, whatever their number."""

import math

import numpy as np
import pyarrow as pa
import pytest
from gridlark.functions import batches, cells
from gridlark.functions import special as S
from gridlark.functions.distributions import Frozen

N = 2000


def counted(f):
    seen = []

    def one(*args):
        seen.append(max(np.size(a) for a in args))
        return f(*args)

    return one, seen


def test_functions_of_equal_rows():
    x = np.arange(N) % 7 / 10.0
    f, seen = counted(S.stdtrit)
    got = S.on_batch(f, [2.0, None], (pa.array(x, mask=np.arange(N) == 3),))
    assert sum(seen) <= 8 and got.null_count == 1 and not got[3].is_valid
    u = x[6]
    assert got[6].as_py() == pytest.approx((2 * u - 1) / math.sqrt(2 * u * (1 - u)))
    f, seen = counted(np.copysign)
    got = S.on_batch(f, [None, None], (pa.array(np.ones(N)), pa.array(np.where(np.arange(N) % 2, -0.0, 0.0))))
    assert seen == [2] and got.to_pylist() == [1.0, -1.0] * (N // 2)
    assert S.on_batch(lambda v: 1.5, [None], (pa.array(x),)).to_pylist() == [1.5] * N
    law, calls = Frozen("t", 2.0), []
    law.family = type(law.family)(law.family.pdf, lambda z, v: calls.append(np.size(z)) or S.stdtr(v, z), law.family.support)
    S.on_batch(law.cdf, [None], (pa.array(x),))
    assert sum(calls) == 7


def test_kernels_of_equal_cells():
    rows = [[float(i % 5), 1.0, float("nan")] for i in range(N)]
    f, seen = counted(lambda v, n: v * n)
    columns = (pa.array(rows), pa.array(np.arange(N) % 2))
    got = cells._by_cell("vector", f, columns, {})
    assert len(seen) == 10 and repr(got.to_pylist()) == repr([[i % 5 * (i % 2) * 1.0, i % 2 * 1.0, math.nan] for i in range(N)])
    nested = pa.array([[[1.0, float(i % 3)], [2.0, 3.0]] for i in range(N)])
    f, seen = counted(lambda m: m.sum())
    assert cells._by_cell("scalar", f, (nested,), {}).to_pylist() == [6.0 + i % 3 for i in range(N)] and len(seen) == 3
    odd = pa.array([[1.0], None, [1.0, 2.0], []] * 3)
    assert cells._by_cell("scalar", lambda v: float(np.sum(v)), (odd,), {}).to_pylist() == [1.0, None, 3.0, 0.0] * 3


def test_rows_that_differ():
    x = np.random.default_rng(0).normal(size=N)
    assert batches.distinct([x]) is None and batches.distinct([x[:0]]) is None
    first, kind = batches.distinct([np.repeat(x[:9], 6), np.tile([1.0, 2.0, 1.0], 18)])
    assert len(first) == 18 and len(kind) == 54
    assert batches.flat(pa.array([[1.0, None]])) is None and batches.flat(pa.array(["a"])) is None and batches.flat(pa.array([], pa.float64())) is None
