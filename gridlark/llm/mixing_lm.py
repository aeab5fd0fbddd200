"""Scoring text by online logistic context mixing.

A text is its lower-cased words and one end. Each token is spelt in bits by its Huffman code: one of the lexicon's words,
or an escape. A bit is predicted by several predictors, each knowing how often the bit was 1 in its hashed context: the
place in the code alone, with the last word, and with the word before it. Their log-odds are mixed by weights
that are gated by how much the contexts were seen; a document's weights start at fixed values and follow the error as it
is read, and a last adaptive table maps the mix to what it turned out to mean. After an escape a word of the tail has its
add-one share of the training tokens that escape; a word that no training text has is one event, as in the base score.
The log-probabilities add up to the text's; over the bytes of its words, with one blank or end after each, they give bits
per byte.

Counts cover all training documents: words in a table of any size; contexts, any word of the lexicon being one, in a hashed
table of two slots a training token, up to MOST_SLOT_BITS. That bound is the memory of a task: it holds the whole table. A
slot is a byte in it: the log-odds in 64 steps, and how often it was seen in four. Weights belong to one document, so a
score doesn't depend on how the table is dealt.

Edge cases: null and empty texts are one end; repeated rows get equal scores; without training tokens every word is an
escape; a null id is empty text to the split; a very long text is read run by run, and a word of any length is one token;
extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import blocks, durable

#: Bounds of the logarithm of the number of hashed context slots.
LEAST_SLOT_BITS, MOST_SLOT_BITS = 14, 24
#: The most words that the lexicon holds; all others are escapes.
LEXICON = 1 << 18
#: Weights change after each run of so many tokens.
RUN = 48
END = b"\n"  # no word: words have no blanks
_MIX = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))


class Codes:
    """Huffman codes of symbols 0..n-1: for each its inner nodes from the root down, and the bit taken there.

    Pickled as the tree alone, of which the codes are made again where they are used."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        parent, side = np.zeros(2 * n, np.int32), np.zeros(2 * n, np.uint8)
        total = np.concatenate([np.asarray(counts, np.int64), np.zeros(n, np.int64)])
        heap = [(int(c), i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        top = n
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[1]] = parent[b[1]] = top
            side[b[1]] = 1
            total[top] = a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], top))
            top += 1
        ones = np.zeros(n)
        np.add.at(ones, parent[:top][side[:top] > 0] - n, total[:top][side[:top] > 0].astype(float))
        self.odds = np.log((ones + 0.4) / (total[n:] - ones + 0.4)).astype(np.float32)[: max(top - n, 1)]
        self.__setstate__((parent, side, heap[0][1], self.odds))

    def __getstate__(self):
        return self.tree

    def __setstate__(self, tree) -> None:
        self.tree = parent, side, root, self.odds = tree
        n = len(parent) // 2
        steps, at, alive = [], np.arange(n, dtype=np.int32), np.ones(n, bool)
        while (alive := alive & (at != root)).any():
            steps.append(np.where(alive, (parent[at] - n) * 2 + side[at], -1).astype(np.int32))
            at = np.where(alive, parent[at], at)
        self.length = sum(((s >= 0).astype(np.int64) for s in steps), np.zeros(n, np.int64))
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.code = np.zeros(self.start[-1], np.int32)  # node * 2 + bit
        for k, s in enumerate(steps):  # steps go upward from the leaf
            own = np.flatnonzero(s >= 0)
            self.code[self.start[own] + self.length[own] - 1 - k] = s[own]

    def expand(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """node, bit, and the symbol's place, for each bit of the symbols' codes in turn."""
        n = self.length[symbols]
        which = np.repeat(np.arange(len(symbols), dtype=np.int32), n)
        first = (self.start[symbols] - (np.cumsum(n) - n)).astype(np.int32)
        at = first[which]
        at += np.arange(len(which), dtype=np.int32)
        code = self.code[at]
        return code >> 1, code & 1, which


def slot_bits(tokens: int) -> int:
    """Two slots a training token, within the bounds."""
    return int(np.clip(max(2 * tokens - 1, 1).bit_length(), LEAST_SLOT_BITS, MOST_SLOT_BITS))


def slot(node: np.ndarray, context: np.ndarray, bits: int) -> np.ndarray:
    """node, context: already multiplied by numbers of their own."""
    h = node ^ context
    h *= _MIX[2]
    h ^= h >> np.uint32(15)
    h *= _MIX[0]
    h >>= np.uint32(32 - bits)
    return h.view(np.int32)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in turn, A-Z lowered, and the number of each text's words; null counts as empty."""
    lists = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(pa.compute.fill_null(texts, "")))
    flat, offsets = lists.flatten(), np.asarray(lists.offsets)
    there = np.asarray(pa.compute.binary_length(flat)) > 0  # blanks at a text's ends leave empty strings
    upto = np.concatenate([[0], np.cumsum(there)])
    n = upto[offsets[1:] - offsets[0]] - upto[offsets[:-1] - offsets[0]]
    return (flat if there.all() else flat.filter(pa.array(there))), n


class Lexicon:
    """The most frequent words (and END) by falling count, their codes, and the code of the escape.

    bits: of the number of context slots."""

    def __init__(self, listed: list[bytes], counts: list[int], rare: int, bits: int = LEAST_SLOT_BITS):
        self.bits = bits
        self.words = pa.array(listed, pa.binary()).cast(pa.string())
        self.escape = len(listed)  # of the symbols the last
        self.end = listed.index(END) if END in listed else self.escape
        self.codes = Codes(np.append(np.array(counts, np.int64), max(rare, 1)))

    def tokens(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Symbols of the texts' tokens, the number of each text's tokens, the words of those that are escapes, and each
        text's bytes: of its words, and one after each and for the end."""
        flat, n = split_words(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        found = np.asarray(pa.compute.fill_null(pa.compute.index_in(flat, value_set=self.words), self.escape), np.int32)
        ids = np.full(len(flat) + len(n), self.end, np.int32)
        place = np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)  # each text before has an END of its own
        ids[place] = found
        source = np.full(len(ids), len(flat))
        source[place] = np.arange(len(flat))
        tail = pa.concat_arrays([flat, pa.array([END.decode()])]).take(pa.array(source[ids == self.escape]))
        upto = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.binary_length(flat)), dtype=np.int64)])
        size = np.diff(upto[np.concatenate([[0], np.cumsum(n)])]) + n + 1
        return ids, n + 1, tail.cast(pa.binary()), size

    def contexts(self, ids: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        """Context numbers of each token: by the last word and by the one before it."""
        starts = np.cumsum(n) - n
        none = self.escape + 1  # of a text's first tokens
        last, before = np.full(len(ids), none, np.int32), np.full(len(ids), none, np.int32)
        last[1:], before[2:] = ids[:-1], ids[:-2]
        last[starts] = before[starts] = before[starts[n > 1] + 1] = none
        return [last, before]

    def slots(self, node: np.ndarray, token: np.ndarray, contexts: list[np.ndarray]) -> list[np.ndarray]:
        base = node.astype(np.uint32) * _MIX[0]
        return [slot(base, ((c.astype(np.uint32) * np.uint32(8) + np.uint32(k)) * _MIX[1])[token], self.bits) for k, c in enumerate(contexts)]


class Counts:
    """How often each slot's bit was 0 and 1, in turn. Two bytes a count; what doesn't fit is kept apart."""

    def __init__(self, bits: int):
        self.small, self.large = np.zeros(2 << bits, np.uint16), {}

    def add(self, places: np.ndarray) -> None:
        """places: slot * 2 + bit; at most AT_ONCE of a kind at a time, so that no count wraps."""
        np.add.at(self.small, places, np.uint16(1))

    def settle(self) -> None:
        for i in np.flatnonzero(self.small >= 1 << 15).tolist():
            self.large[i] = self.large.get(i, 0) + int(self.small[i])
            self.small[i] = 0

    def blocks(self, size: int) -> Iterator[np.ndarray]:
        """The counts by blocks of so many slots, each in the smallest type that holds it."""
        own: dict[int, list[int]] = {}
        for i in self.large:
            own.setdefault(i // (2 * size), []).append(i)
        for k, part in enumerate(self.small.reshape(-1, 2 * size)):
            if k in own:
                part = part.astype(np.int64)
                for i in own[k]:
                    part[i % (2 * size)] += self.large[i]
            yield part.astype(np.min_scalar_type(int(part.max())))


def count_contexts(lexicon: Lexicon, texts: pa.Array | list[str | None], out: Counts) -> None:
    """Add how often each slot's bit was 0 and 1."""
    ids, n, *_ = lexicon.tokens(texts)
    contexts = lexicon.contexts(ids, n)
    for i in range(0, len(ids), AT_ONCE):
        part = slice(i, i + AT_ONCE)
        node, bit, token = lexicon.codes.expand(ids[part])
        for s in lexicon.slots(node, token, [c[part] for c in contexts]):
            s <<= 1
            s += bit
            for j in range(0, len(s), AT_ONCE):
                out.add(s[j : j + AT_ONCE])
            out.settle()


#: Texts are split into words in blocks of about so many bytes.
WORK_BYTES = 8 << 20
#: Tokens whose bits are laid out at once.
AT_ONCE = 1 << 15


#: Gates: how often a context was seen, in four steps.
SEEN = np.array([1, 6, 40])
#: What the 64 steps of a slot's log-odds stand for: finer near even odds.
STEPS = (np.sinh((np.arange(64) - 31.5) / 12) * 1.1).astype(np.float32)


def weighed(counts: np.ndarray) -> np.ndarray:
    """A byte a slot, for counts of 0 and 1 in turn: four times the step of the log-odds of a 1, and how often it was seen."""
    zero, one = counts[::2].astype(np.float64), counts[1::2].astype(np.float64)
    odds = np.searchsorted((STEPS[1:] + STEPS[:-1]) / 2, np.log((one + 0.4) / (zero + 0.4)))
    return (odds * 4 + np.searchsorted(SEEN, zero + one, side="right")).astype(np.uint8)


#: First weights of the three predictors in each gate of the second's and third's step, fixed values: a context counts
#: for more as it was seen more, and the first predictor for the less.
TRUST = np.array([0.0, 0.3, 0.55, 0.8])
BINS, WIDTH = 24, np.float32(0.75)


def first_weights() -> np.ndarray:
    a, b = np.meshgrid(TRUST, TRUST, indexing="ij")
    return np.stack([np.maximum(0.1, 1 - 0.9 * (a + 0.6 * b)), a, 0.6 * b], -1).reshape(16, 3)


class Model:
    def __init__(self, lexicon: Lexicon, table: np.ndarray, rate: float = 0.01, refine: float = 0.005):
        """table: a byte a slot, as from weighed()."""
        self.lexicon, self.rate, self.refine = lexicon, np.float32(rate), np.float32(refine)
        self.table, self.start = table, first_weights().astype(np.float32)
        self.odds = np.repeat(STEPS, 4)  # of each byte

    def score(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Natural log probability of each text's symbols. ids, n: as from Lexicon.tokens."""
        lex = self.lexicon
        contexts = lex.contexts(ids, n)
        rank = np.argsort(-n, kind="stable")  # texts by falling number of tokens: those still being read are the first
        place = np.empty(len(n), np.int32)
        place[rank] = np.arange(len(n))
        run = (np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)) // RUN
        by = np.argsort(run.astype(np.uint16 if len(run) and run.max() < 65536 else np.int64), kind="stable")
        ids, doc, contexts = ids[by], np.repeat(place, n)[by], [c[by] for c in contexts]
        edges = np.searchsorted(run[by], np.arange(int(run.max(initial=0)) + 2))
        total = np.zeros(len(n))
        weights = [np.tile(self.start[:, i], len(n)) for i in range(3)]
        table = np.tile((1 / (1 + np.exp(-(np.arange(BINS) - (BINS - 1) / 2) * WIDTH))).astype(np.float32), len(n))
        n_runs = len(edges) - 1
        r = 0
        while r < n_runs:  # some runs are laid out at once
            stop = min(n_runs, max(r + 1, int(np.searchsorted(edges, edges[r] + AT_ONCE, side="right")) - 1))
            part = slice(edges[r], edges[stop])
            node, bits, token = lex.codes.expand(ids[part])
            s1, s2 = lex.slots(node, token, [c[part] for c in contexts])
            p1, p2 = self.table[s1], self.table[s2]
            odds = lex.codes.odds[node], self.odds[p1], self.odds[p2]
            docs = doc[part][token]
            p1 &= 3
            p1 <<= 2
            p2 &= 3
            p1 |= p2
            keys = docs << 4
            keys |= p1
            ends = np.concatenate([[0], np.cumsum(lex.codes.length[ids[part]])])[edges[r : stop + 1] - edges[r]]
            for k in range(stop - r):
                at = slice(ends[k], ends[k + 1])
                d, bit, key = docs[at], bits[at], keys[at]
                live = int(d.max(initial=-1)) + 1
                o0, o1, o2 = (o[at] for o in odds)
                z = weights[0][key] * o0
                z += weights[1][key] * o1
                z += weights[2][key] * o2
                np.clip(z, -11, 11, out=z)
                p = 1 / (1 + np.exp(-z))
                own = np.clip(z * (1 / WIDTH) + np.float32(BINS / 2), 0, BINS - 1).astype(np.int32) + d * np.int32(BINS)
                known = table[own]
                true = bit.astype(np.float32)
                final = np.float32(0.85) * p + np.float32(0.15) * known
                np.add.at(total, d, np.log(np.abs(final + true - 1)).astype(np.float64))
                err = (true - p) * self.rate
                for w, o in zip(weights, (o0, o1, o2)):
                    np.add.at(w, key, err * o)
                np.add.at(table, own, self.refine * (true - known))
                np.clip(seen := table[: live * BINS], 0.001, 0.999, out=seen)
            r = stop
        np.clip(total, None, 0, out=total)
        return total[place]


def word_counts(texts: DataFrame) -> DataFrame:
    """word binary, n: how often each word (and END, once a text) stands in the column text. Counted by task first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "n"])
            c.clear()

        for b in blocks(batches, most=WORK_BYTES):
            counts = pa.compute.value_counts(split_words(b.column("text"))[0])
            for w, k in zip(counts.field(0).cast(pa.binary()).to_pylist(), counts.field(1).to_pylist()):
                c[w] += k
            c[END] += b.num_rows
            if len(c) > 500_000:
                yield from out()
        yield from out()

    return texts.select("text").mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


#: Slots are sent and summed in blocks of so many.
SLOT_BLOCK = 1 << 12
#: A task counts about so many tokens: what it sends is one table, whatever it has read.
TASK_TOKENS = 6_000_000


def slot_table(texts: DataFrame, held, bits: int, tokens: int) -> np.ndarray:
    """weighed() for all slots, from all texts. held: the broadcast lexicon. A task sends its counts as small arrays; the
    sums are weighed where they are made, so the driver gets a byte a slot."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counts(bits)
        for b in blocks(batches, most=WORK_BYTES):
            count_contexts(held.value, b.column("text"), total)
        for k, part in enumerate(total.blocks(SLOT_BLOCK)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.dtype.str]), pa.array([part.tobytes()], pa.binary())], ["block", "kind", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, kind, raw in zip(*(b.column(c).to_pylist() for c in ("block", "kind", "counts"))):
                sums.setdefault(k, np.zeros(2 * SLOT_BLOCK, np.int64))
                sums[k] += np.frombuffer(raw, kind)
        for k, c in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([weighed(c).tobytes()], pa.binary())], ["block", "slots"])

    n = min((1 << bits) // SLOT_BLOCK, max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    tasks = max(1, -(-tokens // TASK_TOKENS))
    parts = texts.select("text").coalesce(tasks).mapInArrow(counted, "block int, kind string, counts binary").repartitionById(n, F.col("block") % n)
    table = np.full(1 << bits, weighed(np.zeros(2, np.int64))[0], np.uint8)
    for k, raw in zip(*(c.to_pylist() for c in parts.mapInArrow(summed, "block int, slots binary").toArrow().columns)):
        table[k * SLOT_BLOCK : (k + 1) * SLOT_BLOCK] = np.frombuffer(raw, np.uint8)
    return table


def score_texts(df: DataFrame, held_out: Column, *, doc_id: str = "doc_id", text: str = "text", lexicon_words: int = LEXICON) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_byte for each row.

    held_out: a column over `doc_id`; the model learns from the rows where it is false."""
    kind = df.schema[doc_id].dataType.simpleString()
    docs = df.select(df[doc_id].alias("doc_id"), df[text].alias("text")).withColumn("held_out", held_out)
    seen = docs.where(~F.col("held_out"))
    counts = durable(word_counts(seen))
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).collect(), reverse=True)  # at most 8 * 63
    n_all, v_all = sum(r.n for r in levels), sum(r.k for r in levels)
    cut, k_lex = 1 << 20, 0
    for r in levels:
        if k_lex + r.k > lexicon_words:
            break
        cut, k_lex = r.level, k_lex + r.k
    listed = sorted(((n, w) for w, n in zip(*(c.to_pylist() for c in counts.where(level >= cut).select("word", "n").toArrow().columns))), key=lambda x: (-x[0], x[1]))
    rare, v_rare = n_all - sum(n for n, _ in listed), v_all - len(listed)
    sc = df.sparkSession.sparkContext
    # Broadcasts of a bounded size: LEXICON words with their codes, a byte for each of the slots.
    bits = slot_bits(n_all)
    lexicon = Lexicon([w for _, w in listed], [n for n, _ in listed], rare, bits)
    held = sc.broadcast(lexicon)
    tables = sc.broadcast(slot_table(seen, held, bits, n_all))
    head = sc.broadcast(np.append(np.log10((np.array([n for n, _ in listed], float) + 1) / (n_all + v_all + 1)), 0.0))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, base = Model(held.value, tables.value), head.value
        for b in blocks(batches, most=WORK_BYTES):
            ids, n, tail, size = m.lexicon.tokens(b.column("text"))
            ends = np.cumsum(n)
            offsets = np.concatenate([[0], np.searchsorted(np.flatnonzero(ids == m.lexicon.escape), ends)]).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(offsets), tail)
            score = m.score(ids, n) / np.log(10)
            cols = [pa.array(n, pa.int64()), pa.array(np.add.reduceat(base[ids], ends - n)), pa.array(score), pa.array(size), rest]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *cols], ["doc_id", "held_out", "n_tokens", "base", "score", "n_bytes", "tail"])

    each = docs.mapInArrow(scored, f"doc_id {kind}, held_out boolean, n_tokens long, base double, score double, n_bytes long, tail array<binary>")
    each = durable(each.withColumn("row", F.monotonically_increasing_id()))
    for b in (held, tables, head):  # what was scored is kept for good; the copies on the executors' disks can go
        b.destroy()
    # Words of the tail are rare, so no key of this join is hot.
    tails = each.select("row", F.explode("tail").alias("word")).join(counts.where(level < cut), "word", "left")
    sums = tails.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))).alias("share"), F.count("n").alias("known"), F.count(F.lit(1)).alias("rare"))
    rare_n, share = F.coalesce("rare", F.lit(0)), F.coalesce("share", F.lit(0.0))
    score = F.col("score") + share - rare_n * F.lit(float(np.log10(rare + v_rare + 1)))
    return each.drop("tail").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_tokens") - rare_n + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + share - rare_n * F.lit(float(np.log10(n_all + v_all + 1)))).alias("base_score"), score.alias("score"),
        (-score * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
