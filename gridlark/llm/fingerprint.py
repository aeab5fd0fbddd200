"""Document fingerprints: the set of a text's content-defined chunks, by digest, weighted by length.

Chunks end where a gear hash over the last 32 bytes meets a mask: a strict one before the normal size, a lax one after
it (normalised chunking), never before the least and always at the greatest size. So an edit moves only the boundaries
near it, and texts that share passages share chunks wherever these stand. Likeness is the containment of the smaller
set in the larger: the bytes of shared chunks over the smaller set's bytes.

Edge cases: null counts as empty text; empty texts have an empty fingerprint, like each other at 1 and others at 0;
repeated rows have equal fingerprints; an empty table gives an empty table; a null id comes after all others in
descending order; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import BLOCK_BYTES, shuffle_partitions

LEAST, NORMAL, GREATEST = 16, 48, 256
#: Bits that must be zero for a boundary before and after the normal size.
STRICT, LAX = np.uint32(0xFC000000), np.uint32(0xF0000000)
WINDOW = 32


def _gear() -> np.ndarray:
    """A random number for each byte, from a fixed seed; 0xFF, which UTF-8 never has, is the padding and counts 0."""
    g = np.random.default_rng(0x9E3779B9).integers(0, 2**32, 256, dtype=np.uint32)
    g[255] = 0
    return g


GEAR = _gear()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of GEAR of the last 32 bytes, each shifted by its distance. By doubling, in five steps."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def chunk_ends(texts: list[bytes]) -> list[list[int]]:
    """Ends of each text's chunks. The texts lie in one array, kept apart by padding as long as the hash's window."""
    pad = b"\xff" * WINDOW
    data = np.frombuffer(pad.join([*texts, b""]), np.uint8)
    h = gear_hashes(data)
    lax = np.flatnonzero((h & LAX) == 0)
    lax_at, strict_at = lax.tolist(), lax[(h[lax] & STRICT) == 0].tolist()
    lax_at.append(len(data) + GREATEST)
    strict_at.append(len(data) + GREATEST)
    out, a, i, j = [], 0, 0, 0
    for t in texts:
        stop, ends, at = a + len(t), [], a
        while at < stop:
            low, mid, top = at + LEAST - 1, at + NORMAL - 1, min(at + GREATEST, stop)
            while strict_at[i] < low:
                i += 1
            if strict_at[i] < mid:
                end = strict_at[i] + 1
            else:
                while lax_at[j] < mid:
                    j += 1
                end = lax_at[j] + 1
            at = min(end, top)
            ends.append(at - a)
        out.append(ends)
        a = stop + WINDOW
    return out


def chunk_sets(texts: list[bytes]) -> list[dict[int, int]]:
    """48-bit digest -> bytes of each text's chunks, a chunk's repeats counted once."""
    digest, out = xxhash.xxh3_64_intdigest, []
    for t, ends in zip(texts, chunk_ends(texts)):
        found, at = {}, 0
        for e in ends:
            found[digest(t[at:e]) >> 16] = e - at
            at = e
        out.append(found)
    return out


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Bytes of the chunks that both have, over the bytes of the smaller set."""
    if not a or not b:
        return float(not a and not b)
    less = min(sum(a.values()), sum(b.values()))
    return sum(a[k] for k in a.keys() & b.keys()) / less


def written(chunks: dict[int, int]) -> str:
    """The set as text: sorted hex digests, each with its length in two digits (256 as 00)."""
    return "".join([f"{k:012x}{n & 255:02x}" for k, n in sorted(chunks.items())])


def read(fingerprint: str) -> dict[int, int]:
    """The set that a written fingerprint holds."""
    return {int(fingerprint[i : i + 12], 16): int(fingerprint[i + 12 : i + 14], 16) or 256 for i in range(0, len(fingerprint), 14)}


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the first as many characters (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compared(rows: list[tuple[int | None, str]], following: tuple[int | None, str]) -> pa.RecordBatch:
    """Output for rows in order, `following` being the one after the last."""
    texts = [t for _, t in rows] + [following[1]]
    new = [edited(a, b) for a, b in zip(texts, texts[1:])]
    raw, raw_new = [t.encode("utf-8", "replace") for t in texts], [t.encode("utf-8", "replace") for t in new]
    sets = chunk_sets(raw + raw_new)
    own, other = sets[: len(texts)], sets[len(texts) :]
    cols = [
        [d for d, _ in rows], [len(t) for t in texts[:-1]], [hashlib.sha256(t).hexdigest() for t in raw_new],
        [written(s) for s in own[:-1]], [written(s) for s in other],
        [likeness(a, b) for a, b in zip(own, other)], [likeness(a, b) for a, b in zip(own, own[1:])],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT)], schema=_OUT)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of some ranges in order; the last row of each range is a copy of the next range's first (or of the table's
    first) and is compared with, not put out."""
    rows: list[tuple[int | None, str]] = []
    size, now = 0, None
    for batch in batches:
        for part, copy, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "copy", "doc_id", "text"))):
            if part != now:
                rows, size, now = [], 0, part
            if rows and (copy or size > BLOCK_BYTES // 2):
                yield _compared(rows, (doc, text))
                rows, size = [], 0
            if not copy:
                rows.append((doc, text))
                size += len(text)


#: A range holds about so many documents: its rows come one after the other.
RANGE_ROWS = 2000


def compare_neighbours(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that and to the next document.

    Next is the following row in descending order of id (rows of one id: by text; after the last: the first). The table
    is dealt by ranges of the id, so each text moves once; only the first row of each range moves twice."""
    docs = df.select(df[doc_id].cast("long").alias("doc_id"), F.coalesce(df[text], F.lit("")).alias("text"))
    n_rows = docs.count()
    # As many ranges as tasks are wanted, at most: their limits and first rows are what the driver sees.
    n = int(min(n_rows // range_rows + 1, 4 * max(shuffle_partitions(df), 64)))
    limits = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    limits = np.unique(np.array(limits or [], np.int64))
    # Ranges are numbered in descending order of id; the last is for null ids.
    part = F.coalesce(_range_of(limits)("doc_id"), F.lit(len(limits) + 1))
    firsts = {r.part: r.doc_id for r in docs.groupBy(part.alias("part")).agg(F.max("doc_id").alias("doc_id")).collect()}
    heads = sorted(firsts)
    before = dict(zip(heads, [heads[-1:], *([h] for h in heads)]))
    copies = df.sparkSession.createDataFrame([(p, firsts[p], before[p][0]) for p in heads], "part int, first long, goes int")
    placed = docs.withColumn("part", part).join(F.broadcast(copies), "part")  # a row for each range
    stays = F.struct(F.col("part"), F.lit(False).alias("copy"))
    goes = F.struct(F.col("goes").alias("part"), F.lit(True).alias("copy"))
    # Rows that share a range's first id all go along; only the one that comes first there is looked at.
    to = F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.array(stays, goes)).otherwise(F.array(stays))
    sent = placed.select("doc_id", "text", F.explode(to).alias("to")).select("to.part", "to.copy", "doc_id", "text")
    ordered = sent.repartitionById(len(limits) + 2, F.col("part")).sortWithinPartitions("part", "copy", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.mapInArrow(_neighbours, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _range_of(limits: np.ndarray):
    """A function giving the range of ids; null for null."""

    @F.arrow_udf("int")
    def place(ids: pa.Array) -> pa.Array:
        found = len(limits) - np.searchsorted(limits, pa.compute.fill_null(ids, 0).to_numpy(zero_copy_only=False))
        return pa.array(found, pa.int32(), mask=ids.is_null().to_numpy(zero_copy_only=False))

    return place
