"""SentencePiece BPE encoding with source alignment, and decoding.

Normalisation walks the text by longest prefix through the model's compiled
character map (a double-array trie followed by the replacement strings) and
notes the source byte of every normalised byte. Merging is best score first,
leftmost on ties, with byte fallback; each piece is then projected through the
alignment to the span of source bytes it stands for.

No piece of such a model holds a word mark after another character, so texts
are merged word by word and each worker keeps two bounded tables of words seen:
when the newer is full it becomes the older, from which words are taken back.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
REMEMBERED = 250_000
SHORT = 64
NEVER = float("inf")
CHUNK = 1 << 21


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message: int, or bytes for lengths and fixed32."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


class CharacterMap:
    """Longest-prefix replacement through a compiled character map; empty data maps nothing."""

    def __init__(self, data: bytes):
        size = int.from_bytes(data[:4], "little") if data else 0
        self.units = np.frombuffer(data[4 : 4 + size], "<u4").tolist()
        self.strings = data[4 + size :]

    def longest(self, source: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest mapped prefix of source[at:]."""
        if not self.units:
            return None
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        node, best = offset(self.units[0]), None
        for k in range(at, len(source)):
            node ^= source[k]
            if node >= len(self.units) or self.units[node] & 0x800000FF != source[k]:
                break
            unit = self.units[node]
            node ^= offset(unit)
            if unit >> 8 & 1:
                best = (self.units[node] & 0x7FFFFFFF, k + 1 - at)
        if best is None:
            return None
        return self.strings[best[0] : self.strings.index(0, best[0])], best[1]


class Codec:
    """A BPE model file's encoder and decoder."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.dummy_prefix, self.squeeze, charmap = True, True, b""
        for field, value in _fields(model):
            if field == 1:
                piece, score, kind = "", 0.0, NORMAL
                for f, v in _fields(value):
                    if f == 1:
                        piece = v.decode()
                    elif f == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif f == 3:
                        kind = v
                self.pieces.append(piece)
                self.kinds.append(kind)
                scores.append(score)
            elif field == 3:
                for f, v in _fields(value):
                    if f == 2:
                        charmap = v
                    elif f == 3:
                        self.dummy_prefix = bool(v)
                    elif f == 4:
                        self.squeeze = bool(v)
        if USER_DEFINED in self.kinds or UNUSED in self.kinds:
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.map = CharacterMap(charmap)
        self.plain = not charmap and not self.squeeze
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.rank = {p: -scores[i] for p, i in self.ids.items()}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.split = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.seen: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        surface = {CONTROL: lambda p: b"", UNKNOWN: lambda p: " ⁇ ".encode(), BYTE: lambda p: bytes([int(p[3:5], 16)])}
        self.surfaces = [surface.get(k, lambda p: p.replace(MARK, " ").encode())(p) for p, k in zip(self.pieces, self.kinds)]
        self.normal_bytes = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(self.pieces, self.kinds)])
        self.plain_bytes = np.array([1 if k == BYTE else len(p.replace(MARK, " ").encode()) for p, k in zip(self.pieces, self.kinds)])

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text and, per normalised byte and one past the end, the source byte offset."""
        source = text.encode("utf-8", "replace")
        out, origin, at, space = bytearray(), [], 0, self.squeeze
        mark = MARK.encode()
        if self.squeeze:
            while at < len(source) and (got := self._prefix(source, at))[0] == b" ":
                at += got[1]
            if at == len(source):
                return "", np.zeros(1, np.int64)
        if source and self.dummy_prefix:
            out += mark
            origin += [at] * len(mark)
        while at < len(source):
            piece, used = self._prefix(source, at)
            if space:
                piece = piece.lstrip(b" ")
            if piece:
                new = piece.replace(b" ", mark)
                out += new
                origin += [at] * len(new)
                space = piece.endswith(b" ")
            at += used
            space = space and self.squeeze
        if self.squeeze:
            while out.endswith(mark):
                del out[-len(mark) :]
                at = origin[-1]
                del origin[-len(mark) :]
        return out.decode("utf-8", "replace"), np.array([*origin, at])

    def _prefix(self, source: bytes, at: int) -> tuple[bytes, int]:
        if found := self.map.longest(source, at):
            return found
        lead = source[at]
        n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return source[at : at + n], n

    def _merge(self, word: str) -> tuple[int, ...]:
        """Ids of one word of normalised text."""
        part = self._merge_short(word) if len(word) <= SHORT else self._merge_long(word)
        try:
            return tuple(map(self.ids.__getitem__, part))
        except KeyError:
            spell = lambda p: [self.bytes[b] for b in p.encode()] if self.bytes else [self.unknown]
            return tuple(chain.from_iterable([self.ids[p]] if p in self.ids else spell(p) for p in part))

    def _merge_short(self, word: str) -> list[str]:
        """Pieces of a word by looking through all its pairs for each merge."""
        get, part = self.rank.get, list(word)
        ranks = [get(a + b, NEVER) for a, b in zip(part, part[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            i = ranks.index(best)
            part[i] += part.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = get(part[i - 1] + part[i], NEVER)
            if i < len(ranks):
                ranks[i] = get(part[i] + part[i + 1], NEVER)
        return part

    def _merge_long(self, word: str) -> list[str]:
        """The same by a heap of pairs, for words whose pairs are too many to look through."""
        rank, part = self.rank, list(word)
        after, before = [*range(1, len(part)), -1], [-1, *range(len(part) - 1)]
        heap = [(rank[p], i, p) for i in range(len(part) - 1) if (p := part[i] + part[i + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, merged = heapq.heappop(heap)
            j = after[i] if part[i] else -1
            if j < 0 or part[i] + part[j] != merged:
                continue
            part[i], part[j], after[i] = merged, "", after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if (p := merged + part[after[j]]) in rank:
                    heapq.heappush(heap, (rank[p], i, p))
            if before[i] >= 0 and (p := part[before[i]] + merged) in rank:
                heapq.heappush(heap, (rank[p], before[i], p))
        return [p for p in part if p]

    def _encode_normal(self, normal: str) -> list[int]:
        seen, words = self.seen, self.split(normal) if self.by_word else [normal]
        try:
            return list(chain.from_iterable(map(seen.__getitem__, words)))
        except KeyError:
            if len(seen) > REMEMBERED:
                self.older, self.seen = seen, {}
                seen = self.seen
            missed, older = {}, self.older
            for w in set(words).difference(seen):
                (seen if len(w) <= SHORT else missed)[w] = older[w] if w in older else self._merge(w)
            if missed:
                return list(chain.from_iterable(seen[w] if w in seen else missed[w] for w in words))
            return list(chain.from_iterable(map(seen.__getitem__, words)))

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids and, for each, begin and end of its span in the text's UTF-8 bytes."""
        if self.plain and MARK not in text:
            if not text:
                return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
            prefix = int(self.dummy_prefix)
            ids = self._encode_normal((MARK if prefix else "") + text.replace(" ", MARK))
            ends = np.cumsum(self.plain_bytes[ids]) - prefix
            return ids, np.concatenate(([0], ends[:-1])), ends
        normal, origin = self.normalise(text)
        ids = self._encode_normal(normal)
        ends = np.cumsum(self.normal_bytes[ids]) if ids else np.zeros(0, np.int64)
        return ids, origin[np.concatenate(([0], ends[:-1]))[: len(ids)].astype(np.int64)], origin[ends]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that form no character become U+FFFD one by one."""
        out = b"".join(map(self.surfaces.__getitem__, ids))
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        if first is not None and self.dummy_prefix and self.kinds[first] == NORMAL and self.pieces[first].startswith(MARK):
            out = out[1:]
        try:
            return out.decode()
        except UnicodeDecodeError:
            return out.decode("utf-8", "surrogateescape").translate(_LONE)


_LONE = dict.fromkeys(range(0xDC80, 0xDD00), "�")


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(np.int32)))


def _coder(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for k, (i, t) in enumerate(zip(batch.column(0), batch.column(1)), 1):
                text = t.as_py() or ""
                ids, begins, ends = codec.encode(text)
                rows.append((i.as_py(), np.array(ids, np.int32), begins, ends, codec.decode(ids)))
                held += len(text)
                if held >= CHUNK or k == batch.num_rows:
                    names = ["doc_id", "ids", "begins", "ends", "decoded"]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *[_lists([r[c] for r in rows]) for c in (1, 2, 3)], pa.array([r[4] for r in rows])], names)
                    rows, held = [], 0

    return run


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, ids, begins, ends (arrays of int), decoded.

    ``model_path`` names a SentencePiece BPE model file on the driver; its
    bytes, under a megabyte, travel with the tasks. begins and ends are byte
    offsets into the UTF-8 text; the added leading mark spans no byte and each
    byte-fallback piece its own byte. Null and empty texts have no ids and
    decode to the empty string. Rows are passed on one by one, repeated ones
    included; other columns of docs are ignored.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_coder(model), "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string")
