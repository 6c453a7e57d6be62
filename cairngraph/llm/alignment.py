"""Alignment of the tokens of two tokenizers by the bytes they cover.

A text's tokens of either tokenizer form a token-byte incidence matrix in CSR
form. The row products of A and B transposed (Gustavson's order: for each byte
of an A token, add the row of that byte) give every pair of tokens that share
bytes, with the number of bytes. Byte offsets where tokens of both end cut the
tokens into groups; the products of the group-incidence matrices count the
pairs that share a group.

Texts are encoded once, in tasks. Each task deals its documents into chunks of
bounded size and writes, beside the documents' own rows, one row with the
distinct linked id pairs of each chunk. These are summed over the corpus and
sent back to the chunks that hold them, so no count of all pairs is held by one
process, and a pair that every document holds travels once a chunk.

Texts that are null, empty, or that either tokenizer does not give back byte
for byte have no tokens, groups or links. Repeated rows are documents of their
own; doc_id may be null; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import stored

#: Bytes of text that are aligned at once, and distinct pairs of documents after which a chunk ends.
BYTES, PAIRS = 1 << 20, 2_000_000


@dataclass
class Csr:
    """A sparse matrix: row r has the columns indices[indptr[r]:indptr[r + 1]], rising, with their data."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def row_of(self) -> np.ndarray:
        """The row of every entry."""
        return np.repeat(np.arange(self.rows), np.diff(self.indptr))

    def transposed(self) -> Csr:
        rising = (self.indices[1:] >= self.indices[:-1]).all()
        order = slice(None) if rising else np.argsort(self.indices, kind="stable")
        return Csr(_starts(np.bincount(self.indices, minlength=self.columns)), self.row_of()[order], self.data[order], self.rows)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def incidence(lengths: np.ndarray) -> Csr:
    """Tokens by bytes: each token covers the next ``lengths`` bytes."""
    indptr = _starts(lengths)
    n = int(indptr[-1])
    return Csr(indptr, np.arange(n), np.ones(n, np.int64), n)


def gustavson(a: Csr, b: Csr) -> Csr:
    """a · b by rows: for each entry (i, k) of a, row k of b is added to row i."""
    first = b.indptr[a.indices]
    times = b.indptr[a.indices + 1] - first
    entry = np.repeat(np.arange(len(a.indices)), times)
    at = np.arange(len(entry)) - np.repeat(_starts(times)[:-1] - first, times)
    row, column, value = a.row_of()[entry], b.indices[at], a.data[entry] * b.data[at]
    if not len(row):
        return Csr(np.zeros(a.rows + 1, np.int64), column, value, b.columns)
    same = row[1:] == row[:-1]
    if (same & (column[1:] < column[:-1])).any():
        order = np.lexsort((column, row))
        row, column, value = row[order], column[order], value[order]
    new = np.flatnonzero(np.concatenate([[True], ~same | (column[1:] != column[:-1])]))
    return Csr(_starts(np.bincount(row[new], minlength=a.rows)), column[new], np.add.reduceat(value, new), b.columns)


# Fixed value: how byte-level tokenizers cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 500


def _settled() -> re.Pattern:
    """What holds a character that Unicode versions since 3.2 do not agree on, or a long run of white space."""
    old = unicodedata.ucd_3_2_0
    agreed = [c for c in map(chr, range(0x10000)) if (kind := old.category(c)) not in ("Cn", "Cs") and kind == unicodedata.category(c)]
    return re.compile(f"[^{''.join(map(re.escape, agreed))}]|\\s{{{LONG}}}")


@lru_cache(maxsize=2)
def _byte_bpe(path: str):
    """Encoder of texts by a byte-level BPE file, and the bytes of each id.

    If the file's merges are in the order of their ids, as this format has
    them, a faster library merges the words of texts on whose cutting into
    words the libraries can not differ; all other texts go to the file's own.
    """
    from tiktoken import Encoding
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        text = f.read()
    told, tokenizer = json.loads(text), Tokenizer.from_str(text)
    tokenizer.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(shown))}
    entries = [b""] * tokenizer.get_vocab_size()
    for entry, i in tokenizer.get_vocab().items():
        entries[i] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()

    def own(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    ids, merges, cutter = told["model"]["vocab"], told["model"]["merges"], told["pre_tokenizer"] or {}
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
    plain = told["normalizer"] is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
    if not plain or [ids.get(x) for x in joined] != list(range(256, 256 + len(joined))):
        return own, entries
    added = {a["id"] for a in told["added_tokens"]}
    fast = Encoding("words", pat_str=WORDS, mergeable_ranks={e: i for i, e in enumerate(entries) if i not in added}, special_tokens={}).encode_ordinary
    unsettled = _settled().search

    def encode(texts: list[str]) -> list[list[int]]:
        slow = [n for n, t in enumerate(texts) if unsettled(t) or max(map(len, t.split()), default=0) > LONG]
        rest = dict(zip(slow, own([texts[n] for n in slow]))) if slow else {}
        return [rest[n] if n in rest else fast(" " + t) for n, t in enumerate(texts)]

    return encode, entries


@lru_cache(maxsize=2)
def _pieces(path: str):
    """Encoder of texts by a SentencePiece model, and the bytes of each id."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    entries = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(model.id_to_piece, range(model.get_piece_size())))]
    return lambda texts: model.encode(texts, num_threads=1), entries


class Aligner:
    """Both tokenizers, and what is looked up by token id."""

    def __init__(self, byte_bpe: str, pieces: str):
        (self.encode_a, self.bytes_a), (self.encode_b, self.bytes_b) = _byte_bpe(byte_bpe), _pieces(pieces)
        self.len_a, self.len_b = (np.array([len(e) for e in entries], np.int64) for entries in (self.bytes_a, self.bytes_b))
        self.shown = [f"{i}{mark}" for n, marks in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for mark in marks for i in range(n)]

    def tokens(self, texts: Sequence[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of A and B of each text; none where they do not give back a space and the text."""
        out = []
        for text, a, b in zip(texts, self.encode_a(texts), self.encode_b(texts)):
            source = b" " + text.encode()
            same = text and b"".join(map(self.bytes_a.__getitem__, a)) == source and b"".join(map(self.bytes_b.__getitem__, b)) == source
            out.append((a, b) if same else ([], []))
        return out

    def align(self, texts: Sequence[str]) -> Aligned:
        return Aligned(self, self.tokens(texts))


class Aligned:
    """The alignment of some texts, whose tokens, bytes and groups are numbered through all of them."""

    def __init__(self, by: Aligner, tokens: list[tuple[list[int], list[int]]]):
        self.by, self.docs = by, len(tokens)
        self.a, self.b = (np.fromiter(chain.from_iterable(pair[side] for pair in tokens), np.int64) for side in (0, 1))
        self.n_a, self.n_b = (np.array([len(pair[side]) for pair in tokens], np.int64) for side in (0, 1))
        by_byte_a, by_byte_b = incidence(by.len_a[self.a]), incidence(by.len_b[self.b])
        self.links = gustavson(by_byte_a, by_byte_b.transposed())
        ends_a, ends_b = by_byte_a.indptr[1:], by_byte_b.indptr[1:]
        ends = np.zeros((2, by_byte_a.columns + 1), bool)
        ends[0, ends_a] = ends[1, ends_b] = True
        cut = ends[0] & ends[1]
        cuts, closed = np.flatnonzero(cut), np.cumsum(cut) - cut
        self.group_a, self.group_b = closed[ends_a], closed[ends_b]
        self.in_group_a, self.in_group_b = (np.bincount(g, minlength=len(cuts)) for g in (self.group_a, self.group_b))
        doc = np.repeat(np.arange(self.docs), self.n_a)
        self.doc_of_link = doc[self.links.row_of()]
        self.n_links = np.bincount(self.doc_of_link, minlength=self.docs)
        doc_of_group = np.zeros(len(cuts), np.int64)
        doc_of_group[self.group_a] = doc
        self.n_groups = np.bincount(doc_of_group, minlength=self.docs)
        # Documents by groups, weighted by their tokens in each: row products count the pairs without forming them.
        by_group = [Csr(_starts(self.n_groups), np.arange(len(cuts)), n, len(cuts)) for n in (self.in_group_a, self.in_group_b)]
        both = gustavson(by_group[0], by_group[1].transposed())
        self.n_group_links = np.bincount(both.indices, both.data, minlength=self.docs).astype(np.int64)

    def written(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3``: each text's groups in order, the ids of A and of B."""
        a_before, b_before = _starts(self.in_group_a), _starts(self.in_group_b)
        codes = np.zeros(len(self.a) + len(self.b), np.int64)
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[a_before[1:] - 1] = True
        last_b[b_before[1:] - 1] = True
        n_a, n_b = len(self.by.bytes_a), len(self.by.bytes_b)
        codes[np.arange(len(self.a)) + b_before[self.group_a]] = self.a + last_a * n_a
        codes[np.arange(len(self.b)) + a_before[self.group_b + 1]] = self.b + last_b * n_b + 2 * n_a
        at, each, shown = _starts(self.n_a + self.n_b), codes.tolist(), self.by.shown.__getitem__
        return ["".join(map(shown, each[at[d] : at[d + 1]]))[:-1] for d in range(self.docs)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first entry of each text, pair, links): the distinct id pairs linked in each text and how many links have them."""
        size = len(self.by.bytes_a) * len(self.by.bytes_b)
        pair = self.a[self.links.row_of()] * len(self.by.bytes_b) + self.b[self.links.indices]
        key, times = np.unique(self.doc_of_link * size + pair, return_counts=True)
        doc, pair = np.divmod(key, size)
        return _starts(np.bincount(doc, minlength=self.docs)), pair, times


def _batches(ids: list, texts: list[str | None]) -> Iterator[tuple[list, list[str]]]:
    """ids and texts, of about BYTES at a time."""
    first = size = 0
    for n, text in enumerate(texts):
        size += len(text or "")
        if size >= BYTES or n + 1 == len(texts):
            yield ids[first : n + 1], [t or "" for t in texts[first : n + 1]]
            first, size = n + 1, 0


def alignment(docs: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    """(doc_id, a_ids, b_ids, links, groups) of docs(doc_id, text).

    links holds (a, b, bytes): token numbers within the text, from 0, and the
    bytes they share. groups holds (a_end, b_end): the numbers of the tokens
    behind each group's last; all tokens of a group are linked by it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Aligner(byte_bpe, pieces)
        for batch in batches:
            for ids, texts in _batches(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = by.align(texts)
                starts = [_starts(n) for n in (got.n_a, got.n_b, got.n_links, got.n_groups)]
                row, a_end, b_end = got.links.row_of(), _starts(got.in_group_a)[1:], _starts(got.in_group_b)[1:]
                rows = []
                for d, doc_id in enumerate(ids):
                    (a0, a1), (b0, b1), (l0, l1), (g0, g1) = ((int(s[d]), int(s[d + 1])) for s in starts)
                    links = zip((row[l0:l1] - a0).tolist(), (got.links.indices[l0:l1] - b0).tolist(), got.links.data[l0:l1].tolist())
                    groups = zip((a_end[g0:g1] - a0).tolist(), (b_end[g0:g1] - b0).tolist())
                    rows.append({"doc_id": doc_id, "a_ids": got.a[a0:a1].tolist(), "b_ids": got.b[b0:b1].tolist(), "links": [dict(zip(("a", "b", "bytes"), x)) for x in links], "groups": [dict(zip(("a_end", "b_end"), x)) for x in groups]})
                yield pa.RecordBatch.from_pylist(rows, schema=shape)

    i, ints = pa.int32(), pa.list_(pa.int32())
    struct = lambda *names: pa.list_(pa.struct([(n, i) for n in names]))
    shape = pa.schema([("doc_id", pa.int64()), ("a_ids", ints), ("b_ids", ints), ("links", struct("a", "b", "bytes")), ("groups", struct("a_end", "b_end"))])
    spec = "doc_id long, a_ids array<int>, b_ids array<int>, links array<struct<a:int,b:int,bytes:int>>, groups array<struct<a_end:int,b_end:int>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, spec)


_COUNTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string"


def _encoded(docs: DataFrame, byte_bpe: str, pieces: str, limit: int) -> DataFrame:
    """A row a document, with its distinct pairs and their links, and a row a chunk, with its distinct pairs and their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Aligner(byte_bpe, pieces)
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0

        def whole_chunk() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            none = pa.nulls(1, pa.int64())
            lists = (pa.ListArray.from_arrays([0, len(pair)], pa.array(x, t)) for x, t in ((pair, pa.int64()), (n, pa.int32())))
            return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([True]), *[none] * 6, pa.nulls(1, pa.string()), *lists], names=names)

        for batch in batches:
            for ids, texts in _batches(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = by.align(texts)
                starts, pair, times = got.pairs()
                digests = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in got.written()]
                counts = (got.n_a, got.n_b, got.n_groups, got.n_links, got.n_group_links)
                lists = (pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x, t)) for x, t in ((pair, pa.int64()), (times, pa.int32())))
                same = (pa.array([x] * len(ids)) for x in (chunk, False))
                yield pa.RecordBatch.from_arrays([*same, pa.array(ids, pa.int64()), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), *lists], names=names)
                held.append(pair)
                size += len(pair)
                if size >= limit:
                    yield whole_chunk()
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield whole_chunk()

    names = ["chunk", "of_chunk", *[c.split()[0] for c in _COUNTS.split(", ")], "pairs", "times"]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"chunk long, of_chunk boolean, {_COUNTS}, pairs array<long>, times array<int>")


def _summed(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """The chunk's documents with the sums over their links."""
    order = np.argsort(counts["pair"].to_numpy())
    pair, n, best = (counts[c].to_numpy()[order] for c in ("pair", "n", "best"))
    lists = [docs[c].combine_chunks() for c in ("pairs", "times")]
    starts = lists[0].offsets.to_numpy()
    at = np.searchsorted(pair, lists[0].values.to_numpy())
    times = lists[1].values.to_numpy().astype(np.int64)
    total = lambda x: (lambda s: s[starts[1:]] - s[starts[:-1]])(_starts(times * x[at]))
    kept = docs.select([c.split()[0] for c in _COUNTS.split(", ")])
    return kept.append_column("n_best", pa.array(total(best), pa.int64())).append_column("count_sum", pa.array(total(n), pa.int64()))


def link_counts(docs: DataFrame, byte_bpe: str, pieces: str, limit: int = PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_group_links, groups_sha256, n_best, count_sum), a row each of docs(doc_id, text).

    A pair's count is the number of documents in which its ids are linked;
    count_sum adds the counts of a document's links, n_best counts the links
    whose count is the highest of their A id. n_group_links counts the pairs of
    tokens that share a group. Documents are dealt into chunks of about
    ``limit`` distinct pairs.
    """
    size_b = len(_pieces(pieces)[1])
    coded = stored(_encoded(docs, byte_bpe, pieces, limit))
    local = coded.where("of_chunk").select("chunk", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("chunk", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    totals = stored(local.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("a", F.expr(f"pair div {size_b}L")))
    highest = F.broadcast(totals.groupBy("a").agg(F.max("n").alias("highest")))  # at most as many rows as A has ids
    judged = totals.join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).cast("long").alias("best"))
    counts = local.join(judged, "pair").select(F.col("chunk").alias("sent_to"), "pair", "n", "best")
    return coded.where("not of_chunk").groupBy("chunk").cogroup(counts.groupBy("sent_to")).applyInArrow(_summed, f"{_COUNTS}, n_best long, count_sum long")
