"""Ranked lexical search by branch-and-bound over document FP-trees.

Documents are restricted to the terms that the items hold, and their terms
ordered by how many documents hold them, most first. Sorted so, documents that
share a prefix lie together: a range of documents is a node of the tree, and
the ranges that share one term more are its children. Each task builds the
trees of its documents, a bounded number at a time. With the highest tf of each
term and the least m of a node's documents, the weights give an upper bound of
their scores for every item. A depth-first search enters the children with the
highest bounds first and drops an item where its bound is below the item's
k-th best score so far; a single document's bound is its score.

Texts that are null hold no terms. Rows that share an item_id are one item with
the terms of all of them; rows that share a doc_id are documents of their own.
Documents without an id rank behind others of equal score, an item without an
id is one like the others. Columns besides the ids and texts are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..lineage import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms of items (once an item) that are looked for at once; more items than that are dealt over several passes.
TERMS = 500_000
#: Documents of a tree, and terms of its documents.
DOCS, ENTRIES = 4096, 1_000_000
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: Column) -> Column:
    """Array of a text's terms, in order, with repeats; empty for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({TERM})"), F.lit(1))


def _vectors(vocabulary: dict[bytes, int]):
    """Mapper of (doc_id, text) to the number of terms and, of those in the vocabulary, the numbers and tf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, starts, ids, tfs = [], [0], [], []
            for text in batch.column(1):
                found = (text.as_py() or "").encode().translate(_TABLE).split()
                n.append(len(found))
                for term, tf in Counter(found).items():
                    i = vocabulary.get(term)
                    if i is not None:
                        ids.append(i)
                        tfs.append(tf)
                starts.append(len(ids))
            lists = (pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x, pa.int32())) for x in (ids, tfs))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "ids", "tfs"])

    return run


def gain(weight, tf, m):
    """What a term adds to a score; it rises with tf and falls with m."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Tree:
    """The FP-tree of some documents, whose terms are numbered by their place in the order of frequency."""

    def __init__(self, doc_ids: list[int | None], m: np.ndarray, starts: np.ndarray, ranks: np.ndarray, tfs: np.ndarray, weights: np.ndarray):
        doc = np.repeat(np.arange(len(m)), np.diff(starts))
        by_term = np.lexsort((ranks, doc))
        ranks, tfs = ranks[by_term], tfs[by_term]
        keys = ranks.astype(">u4").tobytes()
        paths = [keys[4 * a : 4 * b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        order = sorted(range(len(paths)), key=paths.__getitem__)
        lengths = np.diff(starts)[order]
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(starts[order] - self.starts[:-1], lengths) + np.arange(len(ranks))
        self.ranks, self.tfs = ranks[at], tfs[at].astype(np.int64)
        self.weights, self.m = weights[self.ranks], m[order]
        self.doc_ids = [doc_ids[i] for i in order]
        self.shared = np.array([_shared(paths[a], paths[b]) for a, b in zip(order[:-1], order[1:])], np.int64)

    def children(self, low: int, high: int) -> list[tuple[int, int]]:
        """The ranges of documents that share one term more than all of low..high do."""
        shared = self.shared[low : high - 1]
        cuts = (np.flatnonzero(shared == shared.min()) + low + 1).tolist()
        return list(zip([low, *cuts], [*cuts, high]))

    def bounds(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the documents low..high, with repeats, and what each adds at most."""
        at = slice(self.starts[low], self.starts[high])
        return self.ranks[at], gain(self.weights[at], self.tfs[at], self.m[low:high].min())


def _shared(a: bytes, b: bytes) -> int:
    """How many terms two paths share from their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // 4
    x, y = np.frombuffer(a[:n], ">u4"), np.frombuffer(b[:n], ">u4")
    return int((x != y).argmax())


class Search:
    """The best k documents of each item, over the trees it is given."""

    def __init__(self, items: list[np.ndarray], n_terms: int, k: int):
        self.items, self.k = items, k
        self.gains = np.zeros(n_terms, np.int64)
        self.least = np.ones(len(items), np.int64)
        self.best: list[list] = [[] for _ in items]
        self.all = np.arange(len(items))
        self.of_all = self._terms(self.all)

    def _terms(self, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the items, one after the other, and where each item's start."""
        found = [self.items[i] for i in active]
        return np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])[:-1]]).astype(np.int64)

    def _sums(self, tree: Tree, low: int, high: int, where: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """For each of the items an upper bound of the scores of low..high."""
        ranks, gains = tree.bounds(low, high)
        if high - low == 1:
            self.gains[ranks] = gains
        else:
            np.maximum.at(self.gains, ranks, gains)
        sums = np.add.reduceat(self.gains[where[0]], where[1])
        self.gains[ranks] = 0
        return sums

    def visit(self, tree: Tree) -> None:
        todo = [(0, len(tree.m), self.all, self._sums(tree, 0, len(tree.m), self.of_all))]
        while todo:
            low, high, active, sums = todo.pop()
            open_ = sums >= self.least[active]
            active = active[open_]
            if not len(active):
                continue
            if high - low == 1:
                for item, score in zip(active.tolist(), sums[open_].tolist()):
                    self._offer(item, score, tree.doc_ids[low])
                continue
            where = self.of_all if len(active) == len(self.all) else self._terms(active)
            met = [(a, b, active, self._sums(tree, a, b, where)) for a, b in tree.children(low, high)]
            todo.extend(sorted((x for x in met if (x[3] >= self.least[active]).any()), key=lambda x: int(x[3].max())))

    def _offer(self, item: int, score: int, doc_id: int | None) -> None:
        """Heap entries fall behind others by score, then by an id that is larger or missing."""
        entry = (score, doc_id is not None, -(doc_id or 0))
        held = self.best[item]
        if len(held) < self.k:
            heapq.heappush(held, entry)
        elif entry > held[0]:
            heapq.heapreplace(held, entry)
        if len(held) == self.k:
            self.least[item] = held[0][0]


def _searcher(ids: list[int | None], items: list[np.ndarray], rank: np.ndarray, weights: np.ndarray, n_docs: int, length: int, k: int):
    """Mapper of vectors to the best k of each item in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items, len(weights), k)
        for batch in batches:
            doc_ids, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            starts = batch.column(2).offsets.to_numpy().astype(np.int64)
            ranks, tfs = rank[batch.column(2).values.to_numpy()], batch.column(3).values.to_numpy()
            m = 10 + (90 * n * n_docs) // length
            first = 0
            while first < len(n):
                last = min(first + DOCS, max(first + 1, int(np.searchsorted(starts, starts[first] + ENTRIES, "right")) - 1), len(n))
                at = slice(starts[first], starts[last])
                search.visit(Tree(doc_ids[first:last], m[first:last], starts[first : last + 1] - starts[first], ranks[at], tfs[at], weights))
                first = last
        rows = [(ids[i], None if not known else -minus, score) for i, held in enumerate(search.best) for score, known, minus in held]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])

    return run


def _best(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(item_id, doc_id, score): the best k of each task for wanted(item_id, term)."""
    spark = docs.sparkSession
    rows = wanted.collect()  # bounded by TERMS, or by the terms of one item
    vocabulary = {t: i for i, t in enumerate(sorted({r.term.encode() for r in rows}))}
    vectors = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_vectors(vocabulary), "doc_id long, n long, ids array<int>, tfs array<int>"))
    n_docs, length = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not length or not rows:
        return spark.createDataFrame([], "item_id long, doc_id long, score long")
    df = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("ids").alias("i")).groupBy("i").count().collect():
        df[r.i] = r["count"]
    order = np.argsort(-df, kind="stable")
    rank = np.empty(len(df), np.int64)
    rank[order] = np.arange(len(df))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df[order].tolist()], np.int64)
    of_item: dict[int | None, list[int]] = {}
    for r in rows:
        of_item.setdefault(r.item_id, []).append(int(rank[vocabulary[r.term.encode()]]))
    run = _searcher(list(of_item), [np.array(sorted(x)) for x in of_item.values()], rank, weights, n_docs, length, k)
    return vectors.where(F.size("ids") > 0).mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, at_once: int = TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of docs(doc_id, text) with a score above 0 for each of items(item_id, text).

    Items are looked for about ``at_once`` of their terms at a time, each time
    over all documents.
    """
    wanted = stored(items.select(F.col("item_id").cast("long"), F.explode(terms(F.col("text"))).alias("term")).distinct())
    passes = max(1, -(-wanted.count() // at_once))
    dealt = [wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p) for p in range(passes)]
    found = reduce(DataFrame.union, [_best(docs, part, k) for part in dealt])
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_SQL_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_TERMS} AS t FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS l FROM d),
i AS (SELECT DISTINCT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY 1, 2, 3, 4),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, n_docs),
p AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // l)))) AS BIGINT) AS score FROM f JOIN w USING (term) JOIN i USING (term), s GROUP BY 1, 2, 3)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0) WHERE rank <= 10
"""
