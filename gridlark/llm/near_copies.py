"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

The SimHash search by vantage-point trees comes first, over five-word shingles: it links most copies. A pair at a
similarity of 0.8 differs in ten of 64 bits on average, though, and no tree prunes at that radius. What SimHash leaves
apart comes from MinHash signatures of BANDS bands of ROWS values: two points (texts with equal sets are one) meet in a
bucket if a band agrees, which at similarity 0.8 fails with a chance of 7e-5, and above it with less. Each candidate pair
is verified by the Jaccard similarity of the whole sets, so no link is wrong. Links become components.

Only buckets with points of several components are looked into, and there only pairs of different components. The first
pass takes from each bucket the pairs that would connect its components, likeliest first. The passes after it take every
pair, by falling steps of the similarity that the signatures tell, down to LEAST; a pair at 0.8 is below that with a chance
of 3e-5. What a pass links isn't compared again by the next, so a large group of copies costs its points and not its pairs;
only texts that share a band and are truly apart are compared pair by pair. No number of partners or candidates is capped.

A bucket's points are dealt over parts of at most PART points; the points outside the bucket's largest component go to each
part, after those that the part holds, and are streamed past them. So a task holds one part, whatever the bucket's size.

Edge cases: null, empty and blank texts have the empty set and are copies of each other; a text of fewer words than a
shingle is one shingle; a very long text is one set, held by one task at a time; rows without an id come after all others;
repeated rows are copies like any other; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import blocks, durable, give_back, shuffle_partitions
from gridlark.llm.simhash import SEED, components, label_rows, near_links, print_of, shingle_hashes

SIZE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
#: Similarities told by the signatures at which the passes end.
STEPS = 0.7, 0.654
LEAST = STEPS[-1]
#: Points that a task holds of a bucket.
PART = 20_000
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 31, (2, BANDS * ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def signature(hashes: np.ndarray, step: int = 1 << 11) -> np.ndarray:
    """The set's MinHash values."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(hashes), step):
        h = hashes[i : i + step]
        mixed = h.astype(np.uint32) * _DRAWN[0]
        mixed += (h >> np.uint64(32)).astype(np.uint32) * _DRAWN[1]
        np.minimum(least, mixed.min(1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band of a signature."""
    raw = memoryview(least.tobytes())
    return np.array([xxhash.xxh64_intdigest(raw[k * ROWS * 4 : (k + 1) * ROWS * 4], k) for k in range(BANDS)], np.uint64).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def sets(df: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, point (a hash of the set), simhash, bands (none for the empty set), signature (the values' lowest bytes),
    hashes of df's doc_id, text and text_key."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            cols: list[list] = [[], [], [], [], []]
            for t in b.column("text").to_pylist():
                h = shingle_hashes(t, size)
                own = np.unique(h)
                least = signature(own)
                for c, v in zip(cols, (xxhash.xxh64_intdigest(own.tobytes(), SEED), print_of(h), band_keys(least) if len(h) else np.zeros(0, np.int64), least.astype(np.uint8).tobytes(), own.view(np.int64))):
                    c.append(v)
            longs = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in cols[:2]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), *longs, _lists(cols[2]), pa.array(cols[3], pa.binary()), _lists(cols[4])], ["doc_id", "text_key", "point", "simhash", "bands", "signature", "hashes"])

    return df.select("doc_id", "text", "text_key").mapInArrow(lambda batches: give_back(made(batches)), "doc_id long, text_key long, point long, simhash long, bands array<long>, signature binary, hashes array<long>")


def _connecting(est: np.ndarray, q: int, mine: np.ndarray, theirs: np.ndarray, roots: dict[int, int]) -> np.ndarray:
    """Of the held places `mine` (components `theirs`) the likeliest one for each component that isn't joined to q's yet."""

    def find(v: int) -> int:
        while roots.get(v, v) != v:
            v = roots[v]
        return v

    order = mine[np.argsort(-est[mine], kind="stable")]
    _, first = np.unique(theirs[order], return_index=True)
    out = []
    for i in np.sort(first).tolist():
        a, b = find(q), find(int(theirs[order[i]]))
        if a != b:
            roots[max(a, b)] = min(a, b)
            out.append(order[i])
    return np.array(out, np.int64)


def _compared(batches: Iterator[pa.RecordBatch], low: float, high: float, connecting: bool, similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs of different components whose told similarity is in [low, high), from rows sorted by key, part and side."""
    now, held, cat, roots = None, [], None, {}
    for batch in batches:
        key, part, side, band, point, component, outside, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part", "side", "band", "point", "component", "outside", "n"))
        sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
        a, b = [], []
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (side[1:] != side[:-1])])) if len(key) else np.zeros(0, int)
        for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
            if (key[x], part[x]) != now:
                now, held, cat, roots = (key[x], part[x]), [], None, {}
            if side[x] == 0:
                held.append([v[x:y] for v in (point, component, outside, n, sig)])
                continue
            if not held:
                continue
            if cat is None:
                cat = [np.concatenate(v) for v in zip(*held)]
            points, comps, outs, sizes, sigs = cat
            for i in range(x, y):
                # A held point outside the largest component is streamed as well: such a pair is taken once.
                other = (comps != component[i]) & (~outs | (points < point[i])) & (np.minimum(sizes, n[i]) >= similarity * np.maximum(sizes, n[i]))
                at = np.flatnonzero(other)
                if not len(at):
                    continue
                same = sigs[at] == sig[i]
                est = same.mean(1)
                good = np.flatnonzero((est >= low) & (est < high))
                if not connecting:  # a pair is taken where it first meets
                    good = good[same[good].reshape(len(good), BANDS, ROWS).all(2).argmax(1) == band[i]]
                elif len(good):
                    good = _connecting(est, int(component[i]), good, comps[at], roots)
                a += points[at[good]].tolist()
                b += [int(point[i])] * len(good)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])


def shared_buckets(points: DataFrame) -> DataFrame:
    """key, band, point of the buckets that hold several points. points: point, bands."""
    each = points.select("point", F.posexplode("bands").alias("band", "key"))
    several = each.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key")
    return each.join(several, "key").select("key", "band", "point")


def candidates(buckets: DataFrame, known: DataFrame, told: DataFrame, low: float, high: float, *, connecting: bool = False, similarity: float = SIMILARITY) -> DataFrame:
    """a < b: points of different components that share a bucket and whose told similarity is in [low, high).

    connecting: only the likeliest pairs that would connect a bucket's components. buckets: as from shared_buckets. known:
    vertex, component; a point that it doesn't have is a component of its own. told: point, signature, n."""
    each = buckets.join(known.toDF("point", "known"), "point", "left").withColumn("component", F.coalesce("known", "point")).drop("known")
    counts = each.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.count(F.lit(1)).alias("components"), F.sum("k").alias("k"), F.max_by("component", F.struct("k", "component")).alias("largest"))
    mixed = counts.where("components > 1").select("key", "largest", F.ceil(F.col("k") / PART).cast("int").alias("parts"))
    rows = each.join(mixed, "key").withColumn("outside", F.col("component") != F.col("largest")).join(told, "point")
    own = F.pmod(F.xxhash64("point"), F.col("parts")).cast("int")
    place = lambda part, side: F.struct(part.alias("part"), F.lit(side).alias("side"))
    sent = F.concat(F.array(place(own, 0)), F.when(F.col("outside"), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: place(p, 1))).otherwise(F.array().cast("array<struct<part:int,side:int>>")))
    dealt = rows.withColumn("sent", F.explode(sent)).select("key", "sent.part", "sent.side", "band", "point", "component", "outside", "n", "signature")
    dealt = dealt.repartition(shuffle_partitions(buckets), "key", "part").sortWithinPartitions("key", "part", "side", "point")
    pairs = dealt.mapInArrow(partial(_compared, low=low, high=high, connecting=connecting, similarity=similarity), "a long, b long")
    return pairs.distinct() if connecting else pairs


#: Rows whose sets are asked for are told by a broadcast if they are at most so many, else by a shuffle.
BROADCAST_ROWS = 1_000_000


def verified(pairs: DataFrame, points: DataFrame, made: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """src, dst: the pairs (a, b; durable) whose sets are similar enough. Only the sets that are asked for move.

    points: point and row, one of its rows in `made`, which has row, point and hashes. Sets are compared in the JVM: a batch
    of rows with two whole sets each would be laid out whole on both sides of the way to Python."""
    asked = durable(pairs.select(F.col("a").alias("point")).union(pairs.select("b")).distinct().join(points.select("point", "row"), "point").select("row"))
    hashes = made.join(F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked, "row", "left_semi").select("point", "hashes")
    whole = pairs.join(hashes.toDF("a", "x"), "a").join(hashes.toDF("b", "y"), "b")
    compared = whole.select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("sizes"))
    return compared.where(F.col("both") >= similarity * (F.col("sizes") - F.col("both"))).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def near_copies(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """df's rows as doc_id, text_key (the text's xxhash64), point, component_id (the smallest doc_id of the texts that near
    copies link) and kept: whether the row is its component's first by id and text_key. Repeated rows are kept alike."""
    rows = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"), F.xxhash64(df[text]).alias("text_key"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    made = durable(sets(rows, size).select(place.alias("place"), "point", "simhash", "bands", "signature", F.size("hashes").alias("n"), "hashes", F.monotonically_increasing_id().alias("row")))
    points = durable(made.groupBy("point").agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("rows"), F.min(F.struct("row", "simhash")).alias("one")).select("point", "least", "rows", "one.row", "one.simhash"))
    # A point's bands are those of one of its rows, so a huge group of copies doesn't meet in one task.
    ones = made.select("row", "point", "bands", "signature", "n").join(points.select("row"), "row")
    buckets = durable(shared_buckets(ones))
    told = durable(ones.select("point", "signature", "n").join(buckets.select("point").distinct(), "point"))
    links = _simhash_links(points, made, similarity)
    known = durable(components(links))
    for low, high, connecting in ((LEAST, 2.0, True), *((low, high, False) for low, high in zip(STEPS, (2.0, *STEPS)))):
        pairs = durable(candidates(buckets, known, told, low, high, connecting=connecting, similarity=similarity))
        if pairs.isEmpty():
            continue
        more = durable(verified(pairs, points, made, similarity))
        if not more.isEmpty():
            links = known.toDF("src", "dst").unionByName(more)
            known = durable(components(links))
    each = label_rows(made.select("place", "point"), points, known, "point", own="place")
    return each.select("place.doc_id", "place.text_key", "point", F.col("component_id.doc_id").alias("component_id"), F.col("place").eqNullSafe(F.col("component_id")).alias("kept"))


def _simhash_links(points: DataFrame, made: DataFrame, similarity: float) -> DataFrame:
    """Links that the SimHash search finds and whose sets are similar enough: src, dst."""
    prints = durable(points.groupBy("simhash").agg(F.min("point").alias("vertex")))
    near = near_links(prints).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    equal = points.join(prints, "simhash").where("point != vertex").select(F.col("vertex").alias("a"), F.col("point").alias("b"))
    return verified(durable(near.unionByName(equal)), points, made, similarity)
