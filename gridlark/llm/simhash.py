"""SimHash near-duplicates by vantage-point trees over Hamming distance.

Fingerprints that are equal are one point. Two fingerprints at a distance of at most RADIUS are equal in one of RADIUS + 1
parts of their bits, so there is a forest for each part, and the part's leading bits, as many as the number of points
asks for, say in which shard of that forest a point is: RADIUS + 1 rows a point at any size, and no shard overlaps another.

A shard builds vantage-point trees over its points: a node parts them by their distance from a vantage point, and a query
goes to each side that its ball overlaps; by the triangle inequality no other side can hold a partner. A small radius
prunes best, so there are two trees: what is left to differ is at most half of the radius either in the half of the bits
with the shard's part or in the other half. Each hit is verified on all 64 bits, so the pairs found are exact. A shard
returns links that connect what is linked, at most one a point, never all pairs. Links become components by alternating
large-star and small-star steps, or in one task where they are counted to be few.

Edge cases: null, empty and blank texts have fingerprint zero and link to each other; a null id is left aside by the
minimum (a component of null ids alone has a null component_id); repeated rows have equal fingerprints; the shingles
of a very long text are counted in blocks; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import blocks, durable, join_groups, shuffle_partitions, words

RADIUS = 3
SEED = 42
_SHIFTS = np.arange(64, dtype=np.uint64)


def shingle_hashes(text: str | None, size: int = 3) -> np.ndarray:
    """XXH64 of each run of `size` words, or of all words where there are fewer."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    whole = memoryview(b" ".join(w))
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    if len(w) < size:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    starts = [0, *(ends[: len(w) - size] + 1).tolist()]
    cuts = map(slice, starts, ends[size - 1 :].tolist())
    return np.fromiter(map(xxhash.xxh64_intdigest, map(whole.__getitem__, cuts), repeat(SEED)), np.uint64, len(starts))


def print_of(h: np.ndarray, step: int = 1 << 15) -> int:
    """64 bits; each is 1 where more than half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), step):
        bits = np.unpackbits(h[i : i + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int((1 << _SHIFTS[ones * 2 > len(h)]).sum(dtype=np.uint64)) if len(h) else 0


def simhash(text: str | None, size: int = 3, step: int = 1 << 15) -> int:
    """The text's fingerprint, from the hashes of its shingles."""
    return print_of(shingle_hashes(text, size), step)


def fingerprints(df: DataFrame, *, text: str = "text", output: str = "simhash") -> DataFrame:
    """df with its texts' fingerprints as a signed long."""

    @F.arrow_udf("long")
    def prints(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in arrays:
            batch = pa.RecordBatch.from_arrays([a], ["text"])
            found = [np.array([simhash(t) for t in b.column(0).to_pylist()], np.uint64).view(np.int64) for b in blocks([batch])]
            yield pa.array(np.concatenate([np.zeros(0, np.int64), *found]))

    return df.withColumn(output, prints(df[text]))


def _near(a: np.ndarray, b: np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def tie(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Bring `root`, each point's smallest fellow so far, up to date with the links a-b."""
    while len(a):
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root[:] = up


#: A node of a shard's tree with so few points is compared with its queries outright.
LEAF = 192
#: So many comparisons are made at once.
AT_ONCE = 1 << 21
#: So many vantage points are tried for a node; the one whose sides need the fewest comparisons is taken.
VANTAGES = 4


class ShardSearch:
    """Links between points and queries of a shard; collected as a spanning forest, never as all pairs."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        self.root = np.arange(len(prints))

    def compare(self, points: np.ndarray, queries: np.ndarray) -> None:
        step = max(1, AT_ONCE // max(len(points), 1))
        for i in range(0, len(queries), step):
            q = queries[i : i + step]
            hit = np.nonzero(np.bitwise_count(self.prints[q][:, None] ^ self.prints[points][None, :]) <= self.radius)
            a, b = q[hit[0]], points[hit[1]]
            keep = a != b
            tie(self.root, a[keep], b[keep])

    def search(self, points: np.ndarray, queries: np.ndarray, keys: np.ndarray, reach: int, other: np.ndarray | None = None) -> None:
        """Compare the queries with all points within `reach` of them in `keys`. points, queries: places in prints. A node
        parts its points by their distance from a vantage point; a query goes to each side that its ball overlaps. Points
        whose keys are all the same are searched by `other` keys at the whole radius."""
        todo = [(points, queries)]
        while todo:
            p, q = todo.pop()
            if not len(p) or not len(q):
                continue
            if len(p) <= LEAF:
                self.compare(p, q)
                continue
            best = None
            for at in np.unique(np.linspace(0, len(p) - 1, VANTAGES).astype(int)).tolist():
                d = _near(keys[p], keys[p[at]])
                cut = int(np.median(d))
                cut -= cut == d.max()
                if cut < 0 or not (d <= cut).any():
                    continue
                dq = _near(keys[q], keys[p[at]])
                inner, outer = dq <= cut + reach, dq > cut - reach
                cost = int((d <= cut).sum()) * int(inner.sum()) + int((d > cut).sum()) * int(outer.sum())
                if best is None or cost < best[0]:
                    best = cost, d <= cut, inner, outer
            if best is None and other is not None:
                self.search(p, q, other, self.radius)
                continue
            if best is None or best[0] >= len(p) * len(q):
                self.compare(p, q)
                continue
            _, near, inner, outer = best
            todo += [(p[near], q[inner]), (p[~near], q[outer])]


#: A shard's aim: about so many points are stored in it.
SHARD_POINTS = 4_000


def near_links(points: DataFrame, radius: int = RADIUS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """src, dst: links that connect every two points (vertex, simhash; simhashes distinct) within the radius."""
    n, width = points.count(), 64 // (radius + 1)
    lead = int(np.clip(np.ceil(np.log2(max(n / shard_points, 1))), 0, width))
    forests = radius + 1 if lead else 1
    shards = forests << lead
    whole, reach = np.uint64((1 << 64) - 1), radius // 2

    def dealt(batches):
        for b in batches:
            prints = np.asarray(b.column("simhash")).view(np.uint64)
            for f in range(forests):
                shard = (prints >> np.uint64(width * (f + 1) - lead) & np.uint64((1 << lead) - 1)).astype(np.int64) if lead else np.zeros(len(prints), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shard * forests + f), b.column("vertex"), b.column("simhash")], ["shard", "vertex", "simhash"])

    def linked(batches):
        for shard, prints, vertex in _runs(batches):
            found, own = ShardSearch(prints, radius), np.arange(len(prints))
            half = np.uint64((1 << 32) - 1)
            if lead:  # the shard's part is the same in all that it has to find
                f = shard % forests
                half = half if width * f < 32 else half << np.uint64(32)
                half &= ~(np.uint64((1 << width) - 1) << np.uint64(width * f))
                rest = ~half & ~(np.uint64((1 << width) - 1) << np.uint64(width * f)) & whole
            else:
                rest = ~half & whole
            found.search(own, own, prints & half, reach, prints & rest)
            found.search(own, own, prints & rest, reach, prints & half)
            tied = np.flatnonzero(found.root != own)
            yield pa.RecordBatch.from_arrays([pa.array(vertex[tied]), pa.array(vertex[found.root[tied]])], ["src", "dst"])

    n_parts = min(shards, max(shuffle_partitions(points), forests * n // 200_000))
    sent = points.select("vertex", "simhash").mapInArrow(dealt, "shard long, vertex long, simhash long")
    return sent.repartitionById(n_parts, (F.col("shard") % n_parts).cast("int")).sortWithinPartitions("shard").mapInArrow(linked, "src long, dst long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, fingerprints, vertices) of each shard in turn, of rows sorted by shard: one shard is held at a time."""
    now, held = None, []
    for b in batches:
        shard, prints, vertex = (b.column(c).to_numpy() for c in ("shard", "simhash", "vertex"))
        edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for x, y in zip(edges, edges[1:]):
            if x == y:
                continue
            if shard[x] != now and held:
                yield now, np.concatenate([h[0] for h in held]).view(np.uint64), np.concatenate([h[1] for h in held])
                held = []
            now = int(shard[x])
            held.append((prints[x:y], vertex[x:y]))
    if held:
        yield now, np.concatenate([h[0] for h in held]).view(np.uint64), np.concatenate([h[1] for h in held])


#: Links up to this number are joined up by one task, which holds two numbers for each vertex.
TASK_LINKS = 2_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links' spanning forest: each vertex with the smallest one that these links reach from it."""
    held = [(b.column("src").to_numpy(), b.column("dst").to_numpy()) for b in batches if b.num_rows]
    if held:
        src, dst = (np.concatenate(x) for x in zip(*held))
        names, places = np.unique(np.concatenate([src, dst]), return_inverse=True)
        root = np.arange(len(names))  # names are in order: the smallest place is the smallest vertex
        tie(root, places[: len(src)], places[len(src) :])
        for i in range(0, len(names), 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(names[i : i + (1 << 20)]), pa.array(names[root[i : i + (1 << 20)]])], ["src", "dst"])


def components(links: DataFrame, rounds: int = 50, task_links: int = TASK_LINKS) -> DataFrame:
    """vertex, component (its smallest vertex) for every vertex of the links: by one task where they are counted to be few
    enough for its memory, else by large-star and small-star steps."""
    flat = lambda e: e.where("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    edges, before = durable(flat(links)), None
    if edges.count() <= task_links:
        return edges.repartition(1).mapInArrow(_forest, "src long, dst long").toDF("vertex", "component")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
        large = both.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        edges = flat(large)
        low = edges.groupBy("src").agg(F.min("dst").alias("low"))
        joined = edges.join(low, "src")
        small = joined.select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionByName(low.select("src", F.col("low").alias("dst")))
        edges = durable(flat(small))
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("src").alias("vertex"), F.col("dst").alias("component")).unionByName(edges.select(F.col("dst").alias("vertex"), F.col("dst").alias("component"))).distinct()


def near_duplicates(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """df's rows as doc_id, simhash (signed long), component_id."""
    prints = durable(fingerprints(df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"))).select("doc_id", "simhash"))
    points = durable(prints.groupBy("simhash").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")))
    found = components(near_links(points.select(F.col("simhash").alias("vertex"), "simhash"), radius, shard_points))
    return label_rows(prints, points, found, "simhash").select("doc_id", "simhash", "component_id")


def label_rows(prints: DataFrame, points: DataFrame, found: DataFrame, key: str, own: str = "doc_id") -> DataFrame:
    """prints (`own` and `key`, its point; durable) with component_id, the smallest `own` of what is linked.

    points: `key`, least (its smallest `own`), rows; durable. found: vertex (a key), component."""
    least = points.select(F.col(key).alias("vertex"), "least")
    names = found.join(least, "vertex").groupBy("component").agg(F.min("least").alias("component_id"))
    linked = found.join(names, "component").select(F.col("vertex").alias(key), "component_id", F.lit(True).alias("linked"))
    # Rows whose point is theirs alone are their own component. The others are joined, and a huge group of copies is dealt.
    several = points.join(linked, key, "left").where("rows > 1 or linked").select(key, F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"), F.lit(True).alias("several"))
    each = join_groups(prints, several, points.select(key, F.col("rows").alias("n")), [key])
    return each.withColumn("component_id", F.when(F.col("several"), F.col("component_id")).otherwise(F.col(own))).select(*prints.columns, "component_id")
