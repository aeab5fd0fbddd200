"""Encoding with a SentencePiece BPE model that keeps every piece's place in the original bytes, and decoding.

Normalisation goes by longest prefix through the model's compiled character map (a double-array trie) and records,
for each byte it writes, the source byte it came from; every piece is projected through that record to a span of the
original text. Merging is BPE by score. Pieces never reach over a boundary that no vocabulary entry spans, so the
text is merged unit by unit and units are remembered per worker. A model without a character map that keeps all blanks
normalises by replacing them alone; then `encode` and `spans` do only that, with the same result.

Edge cases: null and empty texts give begin and end ids only and decode to an empty text; repeated rows give repeated
results; very long texts, with blanks or without any, take time in proportion (n log n for a run without blanks); an
empty table gives an empty table; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridlark.llm.common import Memo, blocks, give_back

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the model format
BPE = 2
#: Units of more characters are merged by a heap.
LONG_UNIT = 60


def _fields(blob: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message's fields: int, 4 or 8 bytes, or bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (blob[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if not blob[at - 1] & 128:
                return value, at

    at = 0
    while at < len(blob):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = blob[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = blob[at : at + n], at + n
        yield key >> 3, value


class CharacterMap:
    """A compiled character map: a double-array trie over source prefixes, and the strings that replace them."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units, self.text = np.frombuffer(blob[4 : 4 + n], "<u4").tolist() if n else [], blob[4 + n :]

    def longest(self, source: bytes, at: int) -> tuple[bytes, int] | None:
        """What replaces the longest prefix of source[at:] that the map knows, and that prefix's length."""
        units, found = self.units, None
        if not units:
            return None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(source)):
            node ^= source[i]
            unit = units[node]
            if unit & 0x800000FF != source[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, i + 1 - at
        return found and (self.text[found[0] : self.text.index(b"\0", found[0])], found[1])


class PieceModel:
    """A model file's content, with encode and decode."""

    def __init__(self, blob: bytes):
        pieces, trainer, normaliser = [], {}, {}
        for number, value in _fields(blob):
            if number == 1:
                pieces.append(dict(_fields(value)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        if trainer.get(3, 1) != BPE:
            raise ValueError("only BPE models are supported")
        self.pieces = [p.get(1, b"").decode() for p in pieces]
        kinds = self.kinds = [p.get(3, NORMAL) for p in pieces]
        if UNUSED in kinds or USER in kinds:
            raise ValueError("models with unused or user-defined pieces are not supported")
        scores = [struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0] for p in pieces]
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == NORMAL}
        # merges in order of score, the earlier-defined piece first never matters: scores of normal pieces differ
        self.rank = {p: -scores[i] for p, i in self.ids.items()}
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i, k in enumerate(kinds) if k == BYTE}
        self.byte_fallback = bool(trainer.get(35, 0)) and len(self.bytes) == 256
        self.unknown = kinds.index(UNKNOWN)
        signed = lambda n, default: (v - (1 << 64) if (v := trainer.get(n, default)) >= 1 << 63 else v)
        self.begin, self.end = signed(41, 1), signed(42, 2)
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode()
        self.map = CharacterMap(normaliser.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(normaliser.get(n, 1)) for n in (3, 4, 5))
        if trainer.get(24, 0):
            raise ValueError("models with white space as a suffix are not supported")
        self.plain = not self.map.units and not self.squeeze and self.escape and self.dummy
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\t\r|" if c not in inside)
        whole = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        brk = f"[{re.escape(alone)}]|" if alone else ""
        self.unit = re.compile("(?s).+" if whole else f"{brk}{SPACE}*[^{SPACE}{re.escape(alone)}]+|{SPACE}+")
        self.packed = Memo(lambda u: struct.pack(f"<{len(x := self.merge(u))}I", *x))
        self.surface = [
            b"" if k == CONTROL else bytes([int(p[1:-1], 16)]) if k == BYTE else self.unknown_text.encode() if k == UNKNOWN else p.replace(SPACE, " ").encode()
            for p, k in zip(self.pieces, kinds)
        ]
        self.lengths = np.array([len(s) for s in self.surface], np.int64)
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.norm_lengths = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(self.pieces, kinds)], np.int64)

    def merge(self, unit: str) -> list[int]:
        """Ids of a unit: the adjacent pair whose joined piece scores best merges, leftmost first, until none can."""
        parts = self._merged_long(unit) if len(unit) > LONG_UNIT else self._merged(unit)
        out: list[int] = []
        for p in parts:
            if (k := self.ids.get(p)) is not None:
                out.append(k)
            elif self.byte_fallback:
                out.extend(self.bytes[b] for b in p.encode())
            else:
                out.append(self.unknown)
        return out

    def _merged(self, unit: str) -> list[str]:
        """The best pair is searched for every time, which is quickest for words."""
        parts, rank, far = list(unit), self.rank, float("inf")
        costs = [rank.get(a + b, far) for a, b in zip(parts, parts[1:])]
        while costs and (best := min(costs)) < far:
            i = costs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = rank.get(parts[i] + parts[i + 1], far)
            if i:
                costs[i - 1] = rank.get(parts[i - 1] + parts[i], far)
        return parts

    def _merged_long(self, unit: str) -> list[str]:
        """The same by a heap of pairs over linked parts: n log n steps, for runs without blanks of any length."""
        parts, rank, n = list(unit), self.rank, len(unit)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := parts[i] + parts[i + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if j == n or parts[i] is None or parts[i] + parts[j] != joined:
                continue  # one of the two has merged otherwise since
            parts[i], parts[j] = joined, None
            after[i] = k = after[j]
            after[j] = n
            if k < n:
                before[k] = i
                if (p := joined + parts[k]) in rank:
                    heapq.heappush(heap, (rank[p], i, p))
            if (h := before[i]) >= 0 and (p := parts[h] + joined) in rank:
                heapq.heappush(heap, (rank[p], h, p))
        return [p for p in parts if p is not None]

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the source byte that it stands for."""
        source, space = text.encode("utf-8", "replace"), SPACE.encode() if self.escape else b" "
        out, place, at = bytearray(), [], 0

        def prefix(at: int) -> tuple[bytes, int]:
            if found := self.map.longest(source, at):
                return found
            lead = source[at]
            n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            return source[at : at + n], n

        if self.squeeze:
            while at < len(source) and (p := prefix(at))[0] == b" ":
                at += p[1]
        if at == len(source):
            return "", np.array([at])
        if self.dummy:
            out += space
            place += [at] * len(space)
        blank = self.squeeze
        while at < len(source):
            new, n = prefix(at)
            if blank:
                new = new.lstrip(b" ")
            if new:
                for b in new:
                    add = space if b == 32 else bytes([b])
                    out += add
                    place += [at] * len(add)
                blank = self.squeeze and new.endswith(b" ")
            at += n
        end = at
        if self.squeeze:
            while out.endswith(space):
                end = place[len(out) - len(space)]
                del out[-len(space) :], place[-len(space) :]
        return out.decode(), np.array([*place, end])

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as the library gives them with begin and end ids, no sampling."""
        text = text or ""
        if self.plain:
            norm = SPACE + text.replace(" ", SPACE) if text else ""
        else:
            norm = self.normalise(text)[0]
        ids = np.frombuffer(b"".join(map(self.packed.__getitem__, self.unit.findall(norm))), "<u4")
        if not self.byte_fallback and len(ids) > 1:  # the library joins a run of unknown pieces
            ids = ids[np.concatenate([[True], (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)])]
        return np.concatenate([np.array([self.begin] * (self.begin >= 0), "<u4"), ids, np.array([self.end] * (self.end >= 0), "<u4")]).astype("<u4", copy=False)

    def spans(self, text: str | None, ids: np.ndarray) -> np.ndarray:
        """(begin, end) in bytes of the original text of each id. Of a character's byte pieces the last has its span
        and the others are empty at its start; begin and end ids are empty at the text's ends."""
        text = text or ""
        inner = ids[self.begin >= 0 : len(ids) - (self.end >= 0)]
        if self.plain and SPACE not in text:
            stop = np.cumsum(self.lengths[inner]) - 1 if len(inner) else np.zeros(0, np.int64)
            start = np.concatenate([[0], stop[:-1]]) if len(inner) else stop
            total = int(stop[-1]) if len(inner) else 0
        else:
            norm, place = self.normalise(text)
            n = self.norm_lengths[inner].copy()
            if not self.byte_fallback and (inner == self.unknown).any():
                raise ValueError("spans of unknown pieces need byte fallback")
            stop = np.cumsum(n)
            start, stop, total = place[stop - n], place[stop], int(place[-1])
        byte = self.is_byte[inner]
        if byte.any():
            lead = np.flatnonzero(byte)
            for i in lead.tolist():
                b = int(self.pieces[inner[i]][1:-1], 16)
                if b < 0x80:
                    continue
                if b >= 0xC0:
                    first, left = int(start[i]), (1 if b < 0xE0 else 2 if b < 0xF0 else 3)
                else:
                    left -= 1
                last = int(stop[i])
                start[i], stop[i] = first, (first if left else last)
        edge = lambda use, at: [[at, at]] * use
        return np.concatenate([np.array(edge(self.begin >= 0, 0)).reshape(-1, 2), np.stack([start, stop], 1).reshape(-1, 2), np.array(edge(self.end >= 0, total)).reshape(-1, 2)]).astype(np.int32)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8: pieces joined, the first space of the dummy prefix left off."""
        out = b"".join(map(self.surface.__getitem__, ids.tolist()))
        first = next((i for i in ids.tolist() if self.kinds[i] != CONTROL), None)
        if (self.dummy or self.squeeze) and first is not None and self.kinds[first] == NORMAL and out.startswith(b" "):
            out = out.lstrip(b" ") if self.squeeze else out[1:]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """As decode_bytes; each byte that isn't part of a character becomes U+FFFD."""
        raw, out = self.decode_bytes(np.asarray(ids)), []
        while True:
            try:
                return "".join(out) + raw.decode()
            except UnicodeDecodeError as e:
                out.append(raw[: e.start].decode() + "�")
                raw = raw[e.start + 1 :]


_models: dict[str, PieceModel] = {}


@contextmanager
def _model(key: str, blob: bytes) -> Iterator[PieceModel]:
    """The worker's model for a task. What it remembers goes when the task ends: the worker serves other stages as well."""
    if key not in _models:
        _models.clear()
        _models[key] = PieceModel(blob)
    try:
        yield _models[key]
    finally:
        _models[key].packed.clear()


def encode_documents(df: DataFrame, model_path: str, *, doc_id: str = "doc_id", text: str = "text", output: str = "pieces") -> DataFrame:
    """Every text encoded and decoded.

    output="pieces": doc_id, ids array<int>, begins array<int>, ends array<int> (byte spans), decoded string.
    output="digest": doc_id, n_tokens long, ids_sha256, decoded_sha256, n_bytes long (of the text), spans_sha256
    (of the spans as little-endian 32-bit pairs).

    The model file is read on the driver and travels with the task. One pass, no shuffle."""
    with open(model_path, "rb") as f:
        blob = f.read()
    key = hashlib.sha256(blob).hexdigest()
    held = df.sparkSession.sparkContext.broadcast(blob)  # a model file: its size doesn't follow the data
    kind = df.schema[doc_id].dataType.simpleString()

    def pieces(batches):
        with _model(key, held.value) as m:
            for batch in blocks(batches):
                rows = []
                for t in batch.column("text").to_pylist():
                    ids = m.encode(t)
                    s = m.spans(t, ids)
                    rows.append((ids.astype(np.int32), s[:, 0], s[:, 1], m.decode(ids)))
                flat = lambda i: pa.array([r[i] for r in rows], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), flat(0), flat(1), flat(2), pa.array([r[3] for r in rows], pa.string())], ["doc_id", "ids", "begins", "ends", "decoded"])

    def digest(batches):
        sha = lambda b: hashlib.sha256(b).hexdigest()
        with _model(key, held.value) as m:
            for batch in blocks(batches):
                rows = []
                for t in batch.column("text").to_pylist():
                    ids = m.encode(t)
                    rows.append((len(ids), sha(ids), sha(m.decode_bytes(ids)), len((t or "").encode("utf-8", "replace")), sha(m.spans(t, ids))))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3], pa.int64()), pa.array(cols[4])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "spans_sha256"])

    chosen = df.select(df[doc_id].alias("doc_id"), df[text].alias("text"))
    if output == "pieces":
        return chosen.mapInArrow(lambda batches: give_back(pieces(batches)), f"doc_id {kind}, ids array<int>, begins array<int>, ends array<int>, decoded string")
    return chosen.mapInArrow(lambda batches: give_back(digest(batches)), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, spans_sha256 string")
