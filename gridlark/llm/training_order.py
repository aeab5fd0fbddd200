"""Training-order materialisation: every sequence gets a global slot by a keyed permutation, and slots are written as
shards of a fixed stride, so that reading is sequential and can resume anywhere.

Documents become token ids (a SentencePiece model's, with its begin and end ids) and are laid end to end in order of
document id; every `length` tokens are a sequence, so no token is padding but those after the last document. Tokens are
counted by ranges of the id first, and a running sum goes over the documents of a range only. A sequence's number goes
through a Feistel network over the next power of two, walked on until it falls within the number of sequences: a
permutation that needs no table and that can be inverted. Ranges of slots are dealt to tasks, sorted there, and written.

Shards go through pyarrow's file systems into a folder that all executors share: a path, or a URI of a store that pyarrow
knows (file, hdfs, s3, gs, abfs).

Edge cases: null and empty texts are a begin and an end id; a null id comes last; rows of one id are in order of their
text's hash; repeated rows are laid out each; a very long text runs through as many sequences as it needs; an empty table
gives an empty table and no shard; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import blocks, settled, shuffle_partitions

LENGTH = 1024
#: Fills the last sequence; no model has an id as large.
PAD = 0xFFFF
SHARD_SEQUENCES = 4096
RANGE_ROWS = 2000
ROUNDS = 8


def _round(half: np.ndarray, key: int, r: int) -> np.ndarray:
    """A 64-bit mix of half, key and round (the finaliser of splitmix64)."""
    x = half + np.uint64((key + (r + 1) * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(x: np.ndarray, n: int, key: int, *, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of 0..n-1 at x, or its inverse."""
    bits = max(2, (n - 1).bit_length())
    wide = np.array([bits - bits // 2, bits // 2], np.uint64)
    masks = [(np.uint64(1) << w) - np.uint64(1) for w in wide]

    def walk(v: np.ndarray) -> np.ndarray:
        a, b = v >> wide[1], v & masks[1]  # a has wide[0] bits in even rounds
        for r in range(ROUNDS):
            r = ROUNDS - 1 - r if inverse else r
            if r % 2 == 0:
                a = a ^ (_round(b, key, r) & masks[0])
            else:
                b = b ^ (_round(a, key, r) & masks[1])
        return a << wide[1] | b

    out = walk(np.asarray(x, np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = walk(out[outside])
    return out.astype(np.int64)


_processors: dict[str, object] = {}


def _encoder(blob: bytes):
    """The library's processor of a model file, made once a worker."""
    import sentencepiece

    key = hashlib.sha256(blob).hexdigest()
    if key not in _processors:
        _processors.clear()
        _processors[key] = sentencepiece.SentencePieceProcessor(model_proto=blob)
    return _processors[key]


_CODEC = pa.Codec("zstd", 2)


def pack(ids: bytes) -> bytes:
    """Ids are moved packed, which takes more than a third off them."""
    return _CODEC.compress(ids, asbytes=True)


def unpack(raw: bytes, n: int) -> bytes:
    """The n ids of two bytes."""
    return _CODEC.decompress(raw, 2 * n, asbytes=True)


def token_ids(docs: DataFrame, model_path: str) -> DataFrame:
    """part, doc_id, key (the text's xxhash64), n, ids (n little-endian 16-bit ids, packed) of docs' part, doc_id and text."""
    with open(model_path, "rb") as f:
        blob = f.read()
    if _encoder(blob).get_piece_size() > PAD:
        raise ValueError("ids of 16 bits need a vocabulary of at most 65535 pieces")
    held = docs.sparkSession.sparkContext.broadcast(blob)  # a model file: its size doesn't follow the data

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(held.value).encode
        for b in blocks(batches):
            ids = [np.array(x, "<u2") for x in encode([t or "" for t in b.column("text").to_pylist()], add_bos=True, add_eos=True, num_threads=1)]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("doc_id"), b.column("key"), pa.array([len(x) for x in ids], pa.int64()), pa.array([pack(x.tobytes()) for x in ids], pa.binary())], ["part", "doc_id", "key", "n", "ids"])

    return docs.select("part", "doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(encoded, "part int, doc_id long, key long, n long, ids binary")


def cut(batches: Iterator[pa.RecordBatch], starts: list[int], total: int, key: int, length: int) -> Iterator[pa.RecordBatch]:
    """A range's share of each sequence that it reaches into, as one row whatever the number of its documents, and from
    where in the sequence. Rows come range by range, in order. starts: where each range's tokens begin."""
    now, upto, opened, held, rows = None, 0, 0, [], []

    def close() -> None:
        if held:
            raw = b"".join(held)
            rows.append((*divmod(opened, length), len(raw) // 2, pack(raw)))
            held.clear()

    def out() -> pa.RecordBatch:
        number, at, n, data = zip(*rows)
        rows.clear()
        number = np.array(number, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(permute(number, total, key)), pa.array(number), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(data, pa.binary())], ["slot", "number", "at", "n", "data"])

    for b in batches:
        for part, n, packed in zip(b.column("part").to_pylist(), b.column("n").to_pylist(), b.column("ids").to_pylist()):
            if part != now:
                close()
                now, upto = part, starts[part]
            ids, done = unpack(packed, n), 0
            while done < n:
                size = min(length - upto % length, n - done)
                if not held:
                    opened = upto
                held.append(ids[2 * done : 2 * (done + size)])
                done += size
                upto += size
                if upto % length == 0:
                    close()
            if len(rows) >= 2048:
                yield out()
    close()
    if rows:
        yield out()


def training_order(df: DataFrame, model_path: str, *, doc_id: str = "doc_id", text: str = "text", key: int = 1, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """slot, shard, byte_offset (in the shard), number (of the sequence before it was permuted), n_tokens (without PAD),
    tokens (binary, `length` little-endian 16-bit ids); partitions hold ranges of slots, each in order.

    Shard k has the slots from k * shard_sequences on."""
    docs = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"))
    rows = docs.count()
    n = int(min(rows // range_rows + 1, 4 * max(shuffle_partitions(docs), 64)))
    limits = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    limits = np.unique(np.array(limits or [], np.int64))

    @F.arrow_udf("int")
    def range_of(ids: pa.Array) -> pa.Array:
        found = np.searchsorted(limits, pa.compute.fill_null(ids, 0).to_numpy(zero_copy_only=False))
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), len(limits) + 1, found), pa.int32())

    # Ids are dealt by ranges of the document id once; that shuffle is read twice, for the ranges' sums and for the cuts.
    dealt = token_ids(docs.withColumn("part", range_of("doc_id")), model_path).repartitionById(len(limits) + 2, F.col("part"))
    placed = settled(dealt.sortWithinPartitions(F.col("part"), F.col("doc_id").asc_nulls_last(), "key", "n"))
    sums = {r.part: r.n for r in placed.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row a range
    tokens = sum(sums.values())
    total = -(-tokens // length)
    starts, at = [], 0
    for p in range(len(limits) + 2):
        starts.append(at)
        at += sums.get(p, 0)

    shards = max(1, -(-total // shard_sequences))
    parts = min(shards, max(shuffle_partitions(docs), 2 * tokens // (64 << 20)))
    dealt = placed.select("part", "n", "ids").mapInArrow(partial(cut, starts=starts, total=total, key=key, length=length), "slot long, number long, at int, n int, data binary")
    shard = F.expr(f"slot div {shard_sequences}")
    dealt = dealt.repartitionById(parts, (shard * parts / shards).cast("int")).sortWithinPartitions("slot", "at")
    stride = 2 * length

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done = None, [], []

        def close() -> None:
            raw = b"".join(held)
            done.append((*now, len(raw) // 2, raw + PAD.to_bytes(2, "little") * ((stride - len(raw)) // 2)))

        def out() -> pa.RecordBatch:
            slot, number, sizes, raw = zip(*done)
            done.clear()
            slot = np.array(slot, np.int64)
            cols = [pa.array(slot), pa.array(slot // shard_sequences), pa.array(slot % shard_sequences * stride), pa.array(number, pa.int64()), pa.array(sizes, pa.int32()), pa.array(raw, pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["slot", "shard", "byte_offset", "number", "n_tokens", "tokens"])

        for b in batches:
            for slot, number, n, data in zip(*(b.column(c).to_pylist() for c in ("slot", "number", "n", "data"))):
                if now is None or slot != now[0]:
                    if now:
                        close()
                    now, held = (slot, number), []
                held.append(unpack(data, n))
                if len(done) >= 1024:
                    yield out()
        if now:
            close()
        if done:
            yield out()

    return dealt.mapInArrow(joined, "slot long, shard long, byte_offset long, number long, n_tokens int, tokens binary")


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def store(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in folder:
        return pa.fs.LocalFileSystem(), folder.removeprefix("file:")
    return pa.fs.FileSystem.from_uri(folder)


def write_shards(ordered: DataFrame, folder: str) -> DataFrame:
    """Write training_order's rows as one file a shard: shard, first_slot, n_sequences, n_tokens, bytes, sha256 of each.
    A shard appears under its name only when it is whole, so a task that runs again does no harm."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        now, out, sha, path, told, done = None, None, None, "", [], []

        def close():
            if out:
                out.close()
                whole = f"{root}/{shard_name(now)}"
                try:
                    fs.move(path, whole)
                except OSError:  # a store that doesn't replace: the same shard is there from a task before
                    if fs.get_file_info(whole).size != told[3]:
                        raise
                    fs.delete_file(path)
                done.append((now, *told, sha.hexdigest()))

        for b in batches:
            for shard, slot, n, raw in zip(*(b.column(c).to_pylist() for c in ("shard", "slot", "n_tokens", "tokens"))):
                if shard != now:
                    close()
                    now, sha, told = shard, hashlib.sha256(), [slot, 0, 0, 0]
                    path = f"{root}/.{shard_name(shard)}.{os.getpid()}.{os.urandom(4).hex()}"
                    out = fs.open_output_stream(path)
                out.write(raw)
                sha.update(raw)
                told[1:] = told[1] + 1, told[2] + n, told[3] + len(raw)
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["shard", "first_slot", "n_sequences", "n_tokens", "bytes", "sha256"])

    return ordered.select("shard", "slot", "n_tokens", "tokens").mapInArrow(write, "shard long, first_slot long, n_sequences long, n_tokens long, bytes long, sha256 string")


def materialise(df: DataFrame, model_path: str, folder: str, **options) -> DataFrame:
    """Texts to shards: write_shards over training_order. The files are written when the rows are read."""
    return write_shards(training_order(df, model_path, **options), folder)


def read_from(folder: str, slot: int = 0, *, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES) -> Iterator[np.ndarray]:
    """Sequences in training order from a slot on: the place to go on is slot times the stride."""
    fs, root = store(folder)
    shard, skip = divmod(slot, shard_sequences)
    while fs.get_file_info(path := f"{root}/{shard_name(shard)}").type == pa.fs.FileType.File:
        with fs.open_input_file(path) as f:
            f.seek(min(skip * 2 * length, f.size()))
            while raw := f.read(2 * length):
                yield np.frombuffer(raw, "<u2")
        shard, skip = shard + 1, 0
