"""Equal rows of an Arrow batch, so that a costly function of its values is evaluated once for each that differs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def distinct(bits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
    """Places of the first of each kind of row, and each row's kind; None where most rows differ. bits: columns of 64-bit
    words, one word (or one row of words) a row. Zeros of both signs differ, and so do NaN of other bits.

    Rows are told apart by a sum of their words, each multiplied by an odd number of its own, and then compared."""
    n = len(bits[0])
    if n < 2:
        return None
    words = [b.reshape(n, -1).view(np.uint64) for b in bits]
    width = sum(w.shape[1] for w in words)
    keys = words[0][:, 0]
    if width > 1:
        odd = np.random.default_rng(1).integers(0, 1 << 63, width, np.uint64) * np.uint64(2) + np.uint64(1)
        keys, at = np.zeros(n, np.uint64), 0
        for w in words:
            mixed = w ^ (w >> np.uint64(29))
            keys = keys + (mixed * odd[at : at + w.shape[1]]).sum(1, dtype=np.uint64)
            at += w.shape[1]
    _, first, kind = np.unique(keys, return_index=True, return_inverse=True)
    if 2 * len(first) > n or width > 1 and any((w != w[first][kind]).any() for w in words):
        return None
    return first, kind


def flat(column: pa.Array) -> np.ndarray | None:
    """The column's numbers as rows of 64-bit words, if its cells are numbers or (nested) lists of one shape without nulls."""
    shape = [len(column)]
    while pa.types.is_list(column.type):
        width = np.diff(np.asarray(column.offsets))
        if column.null_count or not len(column) or (width != width[0]).any():
            return None
        shape.append(int(width[0]))
        column = column.flatten()
    if column.null_count or not (pa.types.is_floating(column.type) or pa.types.is_integer(column.type) or pa.types.is_boolean(column.type)):
        return None
    v = column.to_numpy(zero_copy_only=False)
    v = np.ascontiguousarray(v, np.float64 if v.dtype.kind == "f" else np.int64)
    return v.view(np.uint64).reshape(shape[0], -1) if len(v) else None
