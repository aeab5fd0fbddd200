"""Line deduplication: of a line that several documents hold, only the copy in the smallest id's document stays.

Lines are compared by a 128-bit hash of their key (blanks stripped, A-Z lowered). A worker first settles each block of
documents by itself: a block sends one row for each different key, with the block's first document, and drops the
later ones' lines on the spot; so however common a line is, it arrives at most once a block. The rows are dealt by
ranges of the hash, sorted by hash and then by document, and streamed: the first document of each hash keeps its lines,
all others lose theirs. The result is a compressed keep bitmap for each document that loses lines, not text; applying
it is a join on the document's row.

Edge cases: null and empty texts have one empty line, which is too short to drop; a null id comes after every other;
a very long text is read line by line, and its bitmap is deflated; rows that share an id count as one document, so lines that only they share stay, and each row has its own bitmap;
extra columns pass through untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import BLANKS, shuffle_partitions

LEAST_CHARS = 10
#: A worker settles about so many bytes of text by itself before it sends its keys.
SETTLE_BYTES = 32 << 20
#: A null id's place in the order of documents.
LAST = (1 << 63) - 1


def line_keys(text: str | None) -> list[bytes]:
    return [x.strip(BLANKS) for x in (text or "").encode("utf-8", "replace").lower().split(b"\n")]


def _hashes(keys: list[bytes]) -> list[tuple[int, bytes]]:
    """(place, hash) of the keys that are long enough to be dropped."""
    digest = xxhash.xxh3_128_digest
    return [(i, digest(k)) for i, k in enumerate(keys) if len(k) >= LEAST_CHARS and (k.isascii() or len(k.decode("utf-8", "replace")) >= LEAST_CHARS)]


_ROW = pa.schema([("hash", pa.binary()), ("doc", pa.int64()), ("row", pa.int64()), ("places", pa.binary())])


def _settled(batches: Iterator[pa.RecordBatch], settle: int = SETTLE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows (hash, doc, row, places). With a hash: a candidate, which stays if its document is the first of the hash
    anywhere. Without: lines that are dropped already."""
    first: dict[bytes, tuple[int, dict[int, list[int]]]] = {}
    dropped: dict[tuple[int, int], list[int]] = {}
    held = 0

    def out():
        rows = [(h, doc, row, p) for h, (doc, at) in first.items() for row, p in at.items()]
        rows += [(None, doc, row, p) for (doc, row), p in dropped.items()]
        for i in range(0, len(rows), 50_000):
            h, d, r, p = zip(*rows[i : i + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(d, pa.int64()), pa.array(r, pa.int64()), pa.array([np.array(x, "<u4").tobytes() for x in p], pa.binary())], schema=_ROW)
        first.clear()
        dropped.clear()

    for batch in batches:
        for doc, row, text in zip(batch.column("doc").to_pylist(), batch.column("row").to_pylist(), batch.column("text").to_pylist()):
            for place, h in _hashes(line_keys(text)):
                known = first.get(h)
                if known is None:
                    first[h] = doc, {row: [place]}
                elif known[0] == doc:
                    known[1].setdefault(row, []).append(place)
                elif known[0] < doc:
                    dropped.setdefault((doc, row), []).append(place)
                else:
                    for r, p in known[1].items():
                        dropped.setdefault((known[0], r), []).extend(p)
                    first[h] = doc, {row: [place]}
            held += len(text or "") + 100
            if held > settle:
                yield from out()
                held = 0
    yield from out()


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash and document, those whose document isn't the first of its hash."""
    last = None
    for batch in batches:
        hashes, docs = batch.column("hash").to_pylist(), batch.column("doc").to_pylist()
        lose = []
        for i, (h, doc) in enumerate(zip(hashes, docs)):
            if h is None:
                lose.append(i)
            elif last is None or h != last[0]:
                last = h, doc
            elif doc != last[1]:
                lose.append(i)
        if lose:
            kept = batch.take(pa.array(lose))
            yield kept.select(["doc", "row", "places"])


def _bitmap(places: list[bytes]) -> bytes:
    """Deflated bitmap with a 1 for each line that stays, up to the last that goes; all lines after it stay."""
    at = np.unique(np.concatenate([np.frombuffer(p, "<u4") for p in places]))
    keep = np.ones(int(at[-1]) + 1, bool)
    keep[at] = False
    return zlib.compress(np.packbits(keep).tobytes() + bytes([len(keep) % 8]), 1)


def kept_lines(text: str | None, bitmap: bytes | None) -> tuple[str, int, int]:
    """The text without the lines that the bitmap drops, its number of lines before, and how many went."""
    lines = (text or "").split("\n")
    if not bitmap:
        return text or "", len(lines), 0
    raw = zlib.decompress(bitmap)
    keep = np.unpackbits(np.frombuffer(raw[:-1], np.uint8))[: (len(raw) - 1) * 8 - (-raw[-1] % 8)]
    lost = np.flatnonzero(keep == 0)
    for i in lost[::-1].tolist():
        del lines[i]
    return "\n".join(lines), len(lines) + len(lost), len(lost)


def line_bitmaps(rows: DataFrame, settle: int = SETTLE_BYTES) -> DataFrame:
    """doc, row, keep_bitmap for each row of `rows` (doc, row, text) that loses lines."""
    n = shuffle_partitions(rows)
    keys = rows.mapInArrow(partial(_settled, settle=settle), "hash binary, doc long, row long, places binary")
    # The hash's first 24 bits are spread evenly: equal ranges of them are equal shares. Settled rows go anywhere.
    lead = F.when(F.col("hash").isNull(), F.pmod(F.xxhash64("doc"), F.lit(1 << 24))).otherwise(F.conv(F.hex(F.substring("hash", 1, 3)), 16, 10).cast("long"))
    dealt = keys.withColumn("part", F.floor(lead * n / (1 << 24)).cast("int")).repartitionById(n, F.col("part"))
    lost = dealt.drop("part").sortWithinPartitions("hash", "doc", "row").mapInArrow(_streamed, "doc long, row long, places binary")
    bitmap = F.arrow_udf(lambda a: pa.array([_bitmap(p) for p in a.to_pylist()], pa.binary()), "binary")
    return lost.groupBy("doc", "row").agg(F.collect_list("places").alias("places")).select("doc", "row", bitmap("places").alias("keep_bitmap"))


def dedup_lines(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", settle: int = SETTLE_BYTES, output: str = "keep_bitmap") -> DataFrame:
    """df with the column `output`, its keep bitmap (null: all lines stay). `kept_lines` applies it.

    A column of the output's name is replaced. A document loses a line at most once, so what is collected for one is bounded by its own lines."""
    rows = df.select(F.struct(*df.columns).alias("all"), F.coalesce(df[doc_id].cast("long"), F.lit(LAST)).alias("doc"), df[text].alias("text"))
    # Rows of one id are told apart by their content, not by their place, which could change when a task runs again.
    rows = rows.withColumn("row", F.xxhash64("text"))
    return rows.select("all", "doc", "row").join(line_bitmaps(rows.select("doc", "row", "text"), settle), ["doc", "row"], "left").select(*(F.col("all")[c].alias(c) for c in df.columns if c != output), F.col("keep_bitmap").alias(output))


def apply_bitmaps(df: DataFrame, *, text: str = "text", bitmap: str = "keep_bitmap", output: str = "kept") -> DataFrame:
    """df with the struct `output`: text, n_lines, n_dropped."""
    kind = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])

    @F.arrow_udf("text string, n_lines long, n_dropped long")
    def kept(texts: pa.Array, bitmaps: pa.Array) -> pa.Array:
        rows = [kept_lines(t, b) for t, b in zip(texts.to_pylist(), bitmaps.to_pylist())]
        cols = list(zip(*rows)) or [(), (), ()]
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind)], fields=list(kind))

    return df.withColumn(output, kept(F.col(text), F.col(bitmap)))
