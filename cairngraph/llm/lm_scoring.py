"""Language-model scoring by cross-entropy difference.

A target and a background bigram model are counted over the target texts and
over all documents. Both use one vocabulary and one smoothing, so their losses
differ by what the texts hold. A document's own words are left out of the
models that score it, so a target document is not known by heart. A document's
score is the mean over its words of the target loss minus the background loss:
the lower, the more it is like the target.

Every word and every bigram of the corpus is counted. One seen only once
belongs to one document, and with that left out it has no count anywhere, so
such rows need not travel back and nothing is lost by that.

Words are hashes of their bytes with A-Z in lower case. Documents are dealt
into chunks of about ``CHUNK`` bytes by a hash of their id. A chunk sends each
of its words and bigrams once, in rows of one range of hashes each: sorted
hashes by their differences, and counts, packed. A range's rows are summed
where they meet, and each chunk gets the sums back in the order it sent them.
The most frequent word has one entry a chunk, and nothing is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .neardup import MULT, _mix, _word_hashes

CHUNK = 1 << 24
SLICE = 1 << 18
#: Entries of a range that are meant to meet in one task.
MEET = 1 << 19
WEIGHT = 0.5
#: Hashes that stand for every word and for the start of a text.
ALL, START = 0, 1
SENT = "chunk int, part int, size int, body binary"
SUMMED = "chunk int, part int, size int, body binary, known long, b long, t long"


def _words(rows: pa.Table, bits: int) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's documents, their word hashes end to end, their numbers of words and whether they are in the target."""
    named = np.asarray(rows["named"])
    chosen = pa.chunked_array([rows.filter(pa.array(named))["doc_id"].combine_chunks()])
    docs = rows.filter(pa.array(~named))
    target = np.asarray(pa.compute.is_in(docs["doc_id"], value_set=chosen)) & np.asarray(docs["doc_id"].is_valid())
    hashes, sizes, held, size = [], [np.zeros(0, np.int64)], [], 0
    texts = docs["text"]
    for k in range(len(texts)):
        held.append((texts[k].as_py() or "").encode("utf-8", "replace").lower())
        size += len(held[-1])
        if size >= SLICE or k + 1 == len(texts):
            found, at = _word_hashes(b"\n".join(held))
            begins = np.cumsum([0, *[len(x) + 1 for x in held[:-1]]])
            sizes.append(np.diff(np.searchsorted(at, [*begins, size + len(held)])))
            hashes.append(found)
            held, size = [], 0
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return docs, np.maximum(flat >> np.uint64(64 - bits), np.uint64(2)), np.concatenate(sizes), target


def _pairs(hashes: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """Hash of each word with the one before it, ``START`` at a text's start."""
    before = np.concatenate((np.full(1, START, np.uint64), hashes[:-1]))[: len(hashes)]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = START
    return _mix(_mix(before * MULT) ^ hashes) >> np.uint64(64 - bits)


def _places(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and the place of each one in them."""
    kept, at = np.unique(codes, return_inverse=True)
    return kept, at.astype(np.int32)


def _coded(hashes: np.ndarray, sizes: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places of all words, ``ALL`` and ``START`` first, and of all bigrams."""
    words = _places(np.concatenate((np.array([ALL, START], np.uint64), hashes)))
    return [words, _places(_pairs(hashes, sizes, bits))]


def _counts(at: np.ndarray, flags: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.bincount(at, minlength=n), np.bincount(at[flags], minlength=n)


def _squeeze(*columns: np.ndarray) -> bytes:
    """64-bit columns by byte planes, compressed."""
    planes = [np.ascontiguousarray(c.astype(np.uint64).view(np.uint8).reshape(-1, 8).T) for c in columns]
    return pa.Codec("zstd", 1).compress(b"".join(p.tobytes() for p in planes), asbytes=True)


def _spread(body: bytes, size: int, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(body, size * columns * 8), np.uint8).reshape(columns, 8, size)
    return [np.ascontiguousarray(c.T).view(np.uint64).reshape(-1) for c in raw]


def _cuts(codes: np.ndarray, bits: int, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges, of 2^ranges equal ones, that sorted codes fall in, and where each begins and the last ends."""
    numbers = (codes >> np.uint64(bits - ranges)).astype(np.int64)
    begins = np.flatnonzero(np.diff(numbers, prepend=-1))
    return numbers[begins], np.append(begins, len(codes))


def _sender(bits: int, ranges: int):
    """Rows of a chunk: part 2k of words and 2k + 1 of bigrams for range k."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        _, hashes, sizes, target = _words(rows, bits)
        flags = np.repeat(target, sizes)
        out = []
        for kind, (codes, at) in enumerate(_coded(hashes, sizes, bits)):
            b, t = _counts(at[2:] if kind == 0 else at, flags, len(codes))
            if kind == 0:
                b[:2], t[:2] = [len(hashes), (sizes > 0).sum()], [flags.sum(), (sizes[target] > 0).sum()]
            numbers, edges = _cuts(codes, bits, ranges)
            for k, low, high in zip(numbers, edges, edges[1:]):
                part = slice(low, high)
                out.append((2 * k + kind, high - low, _squeeze(np.diff(codes[part], prepend=np.uint64(0)), b[part], t[part])))
        names = ["part", "size", "body"]
        made = {n: pa.array([r[k] for r in out], ty) for k, (n, ty) in enumerate(zip(names, (pa.int32(), pa.int32(), pa.binary())))}
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(out), pa.int32()), **made})

    return run


def _sum(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Sums over all chunks of a range, for each chunk in its order; 0 for what is seen once in all."""
    sizes = rows["size"].to_numpy()
    columns = [_spread(body.as_py(), n, 3) for body, n in zip(rows["body"], sizes)]
    codes, at = np.unique(np.concatenate([np.cumsum(d, dtype=np.uint64) for d, _, _ in columns]), return_inverse=True)
    b, t = (np.bincount(at, np.concatenate([c[k] for c in columns])).astype(np.int64) for k in (1, 2))
    is_word = key[0].as_py() % 2 == 0
    known = (b > 1) & (codes > START) & is_word
    kept = (b > 1) | (is_word & (codes <= START))
    b, t = np.where(kept, b, 0), np.where(kept, t, 0)
    ends = np.cumsum(sizes)
    bodies = [_squeeze(b[at[e - n : e]], t[at[e - n : e]]) for e, n in zip(ends, sizes)]
    first = lambda x: pa.array([int(x), *[0] * (len(sizes) - 1)], pa.int64())
    return pa.table({"chunk": rows["chunk"], "part": rows["part"], "size": rows["size"], "body": pa.array(bodies, pa.binary()), "known": first(known.sum()), "b": first(b[known].sum()), "t": first(t[known].sum())})


def _own(at: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """For each word, how often its own document has the code at its place."""
    _, place, count = np.unique(doc * np.int64(n) + at, return_inverse=True, return_counts=True)
    return count[place]


def _scorer(bits: int, n_known: int, known_sums: tuple[int, int]):
    """Losses of a chunk's documents; sums has what _sum gave back to the chunk."""

    def losses(at: np.ndarray, at_pair: np.ndarray, sizes: np.ndarray, target: np.ndarray, words: list, pairs: list) -> list[np.ndarray]:
        """Mean losses of some documents, whose words lie end to end, under the target and the background model."""
        doc, mine = np.repeat(np.arange(len(sizes)), sizes), np.repeat(target, sizes)
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        before = np.concatenate((at[:1], at[:-1]))
        before[starts] = START
        own, own_pair = _own(at, doc, len(words[0])), _own(at_pair, doc, len(pairs[0]))
        own_before = np.concatenate((own[:1], own[:-1]))
        own_before[starts] = 1
        length, ends, means = sizes[doc], np.cumsum(sizes), []
        for m in (1, 0):
            out = mine if m else 1
            share = (words[m][at] - own * out + 1) / (words[m][ALL] - length * out + n_known + 1)
            seen = words[m][before] - own_before * out
            pair = np.maximum(pairs[m][at_pair] - own_pair * out, 0) / np.maximum(seen, 1)
            mix = np.where(seen > 0, WEIGHT, 0.0)
            lost = np.concatenate(([0.0], np.cumsum(-np.log(mix * pair + (1 - mix) * share))))
            means.append(np.where(sizes > 0, (lost[ends] - lost[ends - sizes]) / np.maximum(sizes, 1), np.nan))
        return means

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, sums: pa.Table) -> pa.Table:
        docs, hashes, sizes, target = _words(rows, bits)
        (_, at_word), (_, at_pair) = _coded(hashes, sizes, bits)
        del hashes
        back: list[list] = [[], []]
        for part, n, body in sorted(zip(sums["part"].to_pylist(), sums["size"].to_pylist(), sums["body"])):
            back[part % 2].append(_spread(body.as_py(), n, 2))
        words, pairs = ([np.concatenate([c[m] for c in got]).astype(np.int64) if got else np.zeros(0, np.int64) for m in (0, 1)] for got in back)
        del back
        # words out of the vocabulary share one place, the last
        at = at_word[2:]
        if len(at):
            at = np.where(words[0][at] > 0, at, np.int32(len(words[0])))
            words = [np.append(w, w[ALL] - known_sums[m]) for m, w in enumerate(words)]
        edges = np.concatenate(([0], np.cumsum(sizes)))
        means: list[list] = [[np.zeros(0)], [np.zeros(0)]]
        low = 0
        while len(at) and low < len(sizes):  # some documents at a time, to hold little beside the chunk's places
            high = max(low + 1, int(np.searchsorted(edges, edges[low] + SLICE)))
            part = slice(edges[low], edges[high] if high < len(edges) else None)
            for m, got in enumerate(losses(at[part], at_pair[part], sizes[low:high], target[low:high].astype(np.int64), words, pairs)):
                means[m].append(got)
            low = high
        got = [np.concatenate(m) if len(at) else np.full(len(sizes), np.nan) for m in means]
        return pa.table({"doc_id": docs["doc_id"], "n_words": sizes, "target_loss": pa.array(got[0], pa.float64(), from_pandas=True), "background_loss": pa.array(got[1], pa.float64(), from_pandas=True)})

    return run


def score_against(docs: DataFrame, chosen: DataFrame, chunk: int = CHUNK, meet: int = MEET) -> DataFrame:
    """Score all docs; the target is the docs whose doc_id is in chosen(doc_id), the background all of them.

    Per row of docs(doc_id, text): doc_id, n_words, target_loss,
    background_loss, score. Losses are nats per word under models that lack
    the row itself, rounded to 6 digits. The vocabulary is every word seen
    twice; all others are one unknown word. A null text or one without words
    has no loss and a null score. Repeated rows are scored one by one; other
    columns are ignored. ``chunk`` (bytes) and ``meet`` (entries) size the
    tasks and do not change any result.
    """
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "false named")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = 1 + size // chunk
    # hashes wide enough that few of the bigrams share one, ranges as many as their entries need
    bits = min(62, max(40, size.bit_length() + 20))
    ranges = min(bits - 1, (size // (8 * meet)).bit_length())
    names = chosen.selectExpr("cast(doc_id as long) doc_id", "cast(null as string) text", "true named").where("doc_id is not null").distinct()
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    rows = texts.union(names).withColumn("chunk", F.pmod(key, F.lit(n_chunks)).cast("int"))
    parts = rows.groupBy("chunk")
    summed = cut(parts.applyInArrow(_sender(bits, ranges), SENT).groupBy("part").applyInArrow(_sum, SUMMED))
    known = summed.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("known", "b", "t")]).first()
    back = summed.select("chunk", "part", "size", "body").groupBy("chunk")
    scored = parts.cogroup(back).applyInArrow(_scorer(bits, known[0], (known[1], known[2])), "doc_id long, n_words long, target_loss double, background_loss double")
    rounded = [F.round(c, 6).alias(c) for c in ("target_loss", "background_loss")]
    return scored.select("doc_id", "n_words", *rounded, F.round(F.col("target_loss") - F.col("background_loss"), 6).alias("score"))
