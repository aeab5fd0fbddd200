"""Array files as sources and sinks.

Readers take files through Spark's `binaryFile` source, so any store that Spark reads will do and files are shared out over
the executors; each file is parsed where it lands, within a size limit, and becomes rows of the long form (path, i0, ...,
v) or (path, name, ...). Writers give bytes for a cell or a file for a small array. Parquet is the native form for all
that is large."""

from __future__ import annotations

import ast
import io
import struct
import wave
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A file or member of more bytes than this is refused: its header could promise anything.
MOST_BYTES = 1 << 30


class FormatError(ValueError):
    pass


# numpy's own formats


def npy_header(raw: bytes) -> tuple[np.dtype, bool, tuple[int, ...], int]:
    """Type, column order, shape and data offset of a .npy file of version 1 to 3."""
    if raw[:6] != b"\x93NUMPY" or raw[6] not in (1, 2, 3):
        raise FormatError("not a .npy file")
    size = struct.unpack_from("<H" if raw[6] == 1 else "<I", raw, 8)[0]
    start = 10 if raw[6] == 1 else 12
    head = ast.literal_eval(raw[start : start + size].decode("latin1" if raw[6] < 3 else "utf8"))
    dtype = np.dtype(head["descr"])
    if dtype.hasobject:
        raise FormatError("object arrays are not read")
    shape = tuple(int(s) for s in head["shape"])
    if any(s < 0 for s in shape):
        raise FormatError("negative shape")
    return dtype, bool(head["fortran_order"]), shape, start + size


def parse_npy(raw: bytes) -> np.ndarray:
    dtype, fortran, shape, start = npy_header(raw)
    n = int(np.prod(shape, dtype=object)) if shape else 1
    if n * dtype.itemsize > min(MOST_BYTES, len(raw) - start):
        raise FormatError("the file is shorter than its header says, or too large")
    return np.frombuffer(raw, dtype, n, start).reshape(shape, order="F" if fortran else "C")


def encode_npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.asarray(a), allow_pickle=False)
    return out.getvalue()


def parse_npz(raw: bytes) -> dict[str, np.ndarray]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        out = {}
        for m in z.infolist():
            if m.file_size > MOST_BYTES:
                raise FormatError(f"{m.filename} is too large")
            out[m.filename.removesuffix(".npy")] = parse_npy(z.read(m))
        return out


def encode_npz(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, a in arrays.items():
            z.writestr(f"{name}.npy", encode_npy(a))
    return out.getvalue()


# Text


def parse_text(raw: bytes, delimiter: str | None = None, comments: str = "#", skiprows: int = 0, usecols: list[int] | None = None, missing: float = np.nan) -> np.ndarray:
    rows = []
    for k, line in enumerate(raw.decode().splitlines()):
        line = line.split(comments)[0] if comments else line
        if k < skiprows or not line.strip():
            continue
        cells = [c.strip() for c in line.split(delimiter)]
        cells = [cells[c] for c in usecols] if usecols is not None else cells
        rows.append([float(c) if c else missing for c in cells])
    if len({len(r) for r in rows}) > 1:
        raise FormatError("rows have different numbers of columns")
    return np.array(rows)


def encode_text(a: np.ndarray, delimiter: str = " ", fmt: str = "%.18e") -> bytes:
    out = io.StringIO()
    np.savetxt(out, np.atleast_2d(a), fmt=fmt, delimiter=delimiter)
    return out.getvalue().encode()


# Exchange formats


def parse_matrix_market(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
    """i, j, v and shape of a coordinate or array file, symmetric ones filled out."""
    lines = raw.decode().splitlines()
    head = lines[0].lower().split()
    if len(head) < 5 or head[0] != "%%matrixmarket" or head[1] != "matrix" or head[3] == "complex":
        raise FormatError("not a real Matrix Market file")
    body = [x.split() for x in lines[1:] if x.strip() and not x.startswith("%")]
    n, m = int(body[0][0]), int(body[0][1])
    if head[2] == "coordinate":
        e = body[1 : 1 + int(body[0][2])]
        i, j = np.array([int(x[0]) - 1 for x in e], np.int64), np.array([int(x[1]) - 1 for x in e], np.int64)
        v = np.array([1.0 if head[3] == "pattern" else float(x[2]) for x in e])
    else:
        lower = head[4] in ("symmetric", "skew-symmetric")
        at = [(r, c) for c in range(m) for r in range((c if head[4] == "symmetric" else c + 1) if lower else 0, n)]
        i, j = np.array([a for a, _ in at], np.int64), np.array([b for _, b in at], np.int64)
        v = np.array([float(x[0]) for x in body[1 : 1 + len(at)]])
    if len(i) and (i.max() >= n or j.max() >= m or min(i.min(), j.min()) < 0):
        raise FormatError("an entry is out of bounds")
    if head[4] in ("symmetric", "skew-symmetric", "hermitian"):
        off = i != j
        i, j, v = np.concatenate([i, j[off]]), np.concatenate([j, i[off]]), np.concatenate([v, v[off] * (-1 if head[4].startswith("skew") else 1)])
    return i, j, v, (n, m)


def encode_matrix_market(i, j, v, shape: tuple[int, int]) -> bytes:
    lines = ["%%MatrixMarket matrix coordinate real general", f"{shape[0]} {shape[1]} {len(v)}", *(f"{a + 1} {b + 1} {x!r}" for a, b, x in zip(map(int, i), map(int, j), map(float, v)))]
    return ("\n".join(lines) + "\n").encode()


def parse_wav(raw: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples (frames by channels) of a PCM file of 8, 16 or 32 bits."""
    with wave.open(io.BytesIO(raw)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        kind = {1: np.uint8, 2: "<i2", 4: "<i4"}.get(width)
        if kind is None:
            raise FormatError(f"samples of {8 * width} bits are not read")
        return rate, np.frombuffer(w.readframes(w.getnframes()), kind).reshape(-1, channels)


def encode_wav(rate: int, samples: np.ndarray) -> bytes:
    a = np.asarray(samples)
    a = a[:, None] if a.ndim == 1 else a
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(a.shape[1])
        w.setsampwidth(a.dtype.itemsize)
        w.setframerate(rate)
        w.writeframes(a.tobytes())
    return out.getvalue()


def parse_fortran(raw: bytes, dtype: str = "<f8") -> list[np.ndarray]:
    """Records of an unformatted sequential file: each between two marks of its length."""
    out, at = [], 0
    while at < len(raw):
        n = struct.unpack_from("<i", raw, at)[0]
        if n < 0 or at + 8 + n > len(raw) or struct.unpack_from("<i", raw, at + 4 + n)[0] != n:
            raise FormatError("broken record marks")
        out.append(np.frombuffer(raw, dtype, n // np.dtype(dtype).itemsize, at + 4))
        at += 8 + n
    return out


def encode_fortran(records: list[np.ndarray]) -> bytes:
    return b"".join(struct.pack("<i", len(b)) + b + struct.pack("<i", len(b)) for b in (np.asarray(r).tobytes() for r in records))


#: Element types of MAT and netCDF files, by number. Fixed values.
_MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_NC_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


def parse_mat(raw: bytes) -> dict[str, np.ndarray]:
    """Real numeric arrays of a level 5 MAT file, compressed elements too."""
    order = {b"IM": "<", b"MI": ">"}.get(raw[126:128])
    if order is None:
        raise FormatError("not a level 5 MAT file")

    def element(b: bytes, at: int) -> tuple[int, bytes, int]:
        word = struct.unpack_from(order + "I", b, at)[0]
        if word >> 16:
            return word & 0xFFFF, b[at + 4 : at + 4 + (word >> 16)], at + 8
        n = struct.unpack_from(order + "I", b, at + 4)[0]
        if n > len(b) - at - 8:
            raise FormatError("an element is longer than the file")
        return word, b[at + 8 : at + 8 + n], at + 8 + (n if word == 15 else n + -n % 8)

    out, at = {}, 128
    while at + 8 <= len(raw):
        kind, data, at = element(raw, at)
        if kind == 15:
            inflate = zlib.decompressobj()
            data = inflate.decompress(data, MOST_BYTES)
            if inflate.unconsumed_tail:
                raise FormatError("too large")
            kind, data, _ = element(data, 0)
        if kind != 14:
            continue
        _, flags, p = element(data, 0)
        _, dims, p = element(data, p)
        _, name, p = element(data, p)
        if struct.unpack_from(order + "I", flags)[0] & 0xFF not in range(6, 16):
            continue
        kind, values, p = element(data, p)
        out[name.decode()] = np.frombuffer(values, order + _MAT_TYPES[kind]).reshape(np.frombuffer(dims, order + "i4"), order="F")
    return out


def encode_mat(arrays: dict[str, np.ndarray]) -> bytes:
    pad = lambda b: b + b"\0" * (-len(b) % 8)
    part = lambda kind, b: struct.pack("<II", kind, len(b)) + pad(b)
    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    for name, a in arrays.items():
        a = np.atleast_2d(np.asarray(a, float))
        body = part(6, struct.pack("<II", 6, 0)) + part(5, np.array(a.shape, "<i4").tobytes()) + part(1, name.encode()) + part(9, a.astype("<f8").tobytes(order="F"))
        out += struct.pack("<II", 14, len(body)) + body
    return out


def parse_netcdf(raw: bytes) -> dict[str, np.ndarray]:
    """Variables of a classic netCDF file without a record dimension."""
    if raw[:3] != b"CDF" or raw[3] not in (1, 2):
        raise FormatError("not a classic netCDF file")
    at = 8

    def number(wide: bool = False) -> int:
        nonlocal at
        v = struct.unpack_from(">q" if wide else ">i", raw, at)[0]
        at += 8 if wide else 4
        return v

    def name() -> str:
        nonlocal at
        n = number()
        v = raw[at : at + n].decode()
        at += n + -n % 4
        return v

    def attributes() -> None:
        nonlocal at
        _, n = number(), number()
        for _ in range(n):
            name()
            kind, k = number(), number()
            size = k * np.dtype(_NC_TYPES[kind]).itemsize
            at += size + -size % 4

    _, n = number(), number()
    dims = [(name(), number()) for _ in range(n)]
    attributes()
    _, n = number(), number()
    out = {}
    for _ in range(n):
        key = name()
        ids = [number() for _ in range(number())]
        attributes()
        kind, _, begin = number(), number(), number(raw[3] == 2)
        shape = [dims[d][1] for d in ids]
        if 0 in shape:
            raise FormatError("record variables are not read")
        count = int(np.prod(shape, dtype=object)) if shape else 1
        if begin + count * np.dtype(_NC_TYPES[kind]).itemsize > len(raw):
            raise FormatError("a variable is longer than the file")
        out[key] = np.frombuffer(raw, _NC_TYPES[kind], count, begin).reshape(shape)
    return out


# As DataFrames


def _long(path: str, name: str, a: np.ndarray, ndim: int) -> pa.RecordBatch:
    if a.ndim != ndim:
        raise FormatError(f"{path}: {a.ndim} dimensions where {ndim} are expected")
    n = a.size
    cols = [pa.array([path] * n, pa.string()), pa.array([name] * n, pa.string())]
    cols += [pa.array(i.ravel().astype(np.int64)) for i in np.indices(a.shape)]
    return pa.RecordBatch.from_arrays([*cols, pa.array(np.ascontiguousarray(a, float).ravel())], ["path", "name", *(f"i{k}" for k in range(ndim)), "v"])


#: Parsers by format: bytes to named arrays.
FORMATS: dict[str, Callable[[bytes], dict[str, np.ndarray]]] = {
    "npy": lambda b: {"": parse_npy(b)}, "npz": parse_npz, "text": lambda b: {"": parse_text(b)}, "csv": lambda b: {"": parse_text(b, ",")}, "wav": lambda b: {"": parse_wav(b)[1]}, "mat": parse_mat, "netcdf": parse_netcdf,
    "fortran": lambda b: {str(k): r for k, r in enumerate(parse_fortran(b))},
}


def _files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the files. A file is read whole by one task, so one over MOST_BYTES is an error and not left out."""
    found = spark.read.format("binaryFile").load(path)
    if large := found.where(F.col("length") > MOST_BYTES).select("path", "length").first():
        raise ValueError(f"{large.path} has {large.length} bytes; files of at most {MOST_BYTES} are read: save larger arrays in parts")
    return found.select("path", "content")


def read_arrays(spark: SparkSession, path: str, fmt: str, ndim: int) -> DataFrame:
    """path, name, i0, ..., v of all arrays of `ndim` dimensions in the files at the path (a folder or a pattern)."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gridlark.sources.arrays import FORMATS as known

        for b in batches:
            for p, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                for name, a in known[fmt](raw).items():
                    yield _long(p, name, np.asarray(a), ndim)

    files = _files(spark, path)
    return files.mapInArrow(parse, "path string, name string, " + "".join(f"i{k} long, " for k in range(ndim)) + "v double")


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """path, i, j, v."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                i, j, v, _ = parse_matrix_market(raw)
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(v), pa.string()), pa.array(i), pa.array(j), pa.array(v)], ["path", "i", "j", "v"])

    files = _files(spark, path)
    return files.mapInArrow(parse, "path string, i long, j long, v double")


def write_text(df: DataFrame, path: str, columns: list[str], delimiter: str = ",") -> None:
    """Columns as delimited text, a part file a task."""
    df.select(F.concat_ws(delimiter, *(F.col(c).cast("string") for c in columns)).alias("value")).write.mode("overwrite").text(path)


def to_json(df: DataFrame, axes: list[str]) -> DataFrame:
    """i0, json: each first-axis row of a long matrix as a JSON list."""
    cell = F.transform(F.array_sort(F.collect_list(F.struct(*axes[1:], "v"))), lambda s: s["v"])
    return df.groupBy(axes[0]).agg(F.to_json(cell).alias("json"))
