"""MinHash near-duplicates with min-max hashing.

Every permutation of the shingle hashes gives two signature values, its
minimum and its maximum, so a signature of 2p values costs p hash passes.
Bands of the signature are bucket keys. Links between bucket members are
confirmed on the full shingle sets and closed into components.

Work inside a bucket is kept below all pairs where texts are copies or differ in
rare shingles; texts made of one template by filling in from a few words, which
share buckets without being linked, can cost as much as all their pairs:

* identical texts are one class and travel as one row;
* a small bucket (at most ``SMALL`` classes) yields its pairs;
* in a large bucket each class is compared with a pivot, first the class with
  the fewest rare shingles and then, for ``ROUNDS`` rounds at most, others. Two
  classes that are in one component already are not compared any more;
* what is still apart can be linked to another class of the bucket only if the
  two share a rare shingle (found by an equi-join on rare shingles, whose groups
  are bounded by ``RARE``) or if the bound
  ``rare_i + rare_j + |common_i - common_j| <= 15/185 * (n_i + n_j)`` (for 0.85)
  holds; only such pairs are confirmed, each given by one of its buckets.

Large buckets are dealt over many tasks by a salt. No partner or candidate is
capped: the limits choose the route a pair takes, not whether it is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import stored
from .common import cut

SMALL = 8
RARE = 3
ROUNDS = 4
#: Classes of one large bucket that are meant to meet in one task.
BLOCK = 256
#: Parts into which the rows of a key are dealt where they meet one row of it.
SALT = 16
CHUNK = 1 << 21
MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^k and P^-k modulo 2^64 for k < n."""
    inverse = pow(int(MULT), -1, 1 << 64)
    up, down = np.full(n, MULT), np.full(n, np.uint64(inverse))
    up[:1], down[:1] = 1, 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_TABLE = _mix(np.arange(1, 257, dtype=np.uint64) * MULT)
_POWERS = _powers(1 << 16)


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start offset of each word of data, already in lower case."""
    global _POWERS
    raw = np.frombuffer(data, np.uint8)
    if len(raw) > len(_POWERS[0]):
        _POWERS = _powers(2 * len(raw))
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[raw] * _POWERS[0][: len(raw)], dtype=np.uint64)))
    return _mix((sums[end] - sums[start]) * _POWERS[1][start] + (end - start).astype(np.uint64)), start


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    Fewer words than ``size`` make one shingle; no word makes none.
    """
    w, _ = _word_hashes((text or "").encode("utf-8", "replace").lower())
    if not len(w):
        return np.zeros(0, np.uint64)
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, np.uint64(n))
    for j in range(n):
        h = (h ^ w[j : len(w) - n + 1 + j]) * MULT
        h ^= h >> np.uint64(29)
    return np.unique(_mix(h))


def minmax_signature(sets: list[np.ndarray], perms: int) -> np.ndarray:
    """Rows of perms minima and perms maxima, one row per non-empty set."""
    h = np.concatenate(sets)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    rng = np.random.Generator(np.random.PCG64(20240229))
    a = rng.integers(0, 1 << 63, perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, perms, dtype=np.uint64)
    out = np.empty((len(sets), 2 * perms), np.uint64)
    for k in range(perms):
        v = h * a[k] + b[k]
        v ^= v >> np.uint64(32)
        out[:, 2 * k] = np.minimum.reduceat(v, at)
        out[:, 2 * k + 1] = np.maximum.reduceat(v, at)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(signature), bands), np.uint64)
    for k in range(bands):
        x = np.full(len(signature), k + 1, np.uint64) * MULT
        for j in range(k * rows, (k + 1) * rows):
            x = _mix((x ^ signature[:, j]) * MULT)
        keys[:, k] = x
    return keys.view(np.int64)


def layout(threshold: float) -> tuple[int, int]:
    """Bands and rows: at the threshold a linked pair is missed less than once in a million."""
    rows = 6 if threshold >= 0.85 else 4
    bands = int(np.ceil(np.log(1e-6) / np.log1p(-(threshold**rows))))
    return bands, rows


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    for batch in batches:
        ids, texts, held = [], [], 0
        for i, t in zip(batch.column(0), batch.column(1)):
            ids.append(i.as_py())
            texts.append(t.as_py())
            held += len(texts[-1] or "")
            if held >= CHUNK:
                yield ids, texts
                ids, texts, held = [], [], 0
        if ids:
            yield ids, texts


def _digest(text: str | None) -> bytes:
    """Names the sequence of a text's words in lower case."""
    return hashlib.blake2b(b" ".join((text or "").encode("utf-8", "replace").lower().split()), digest_size=16).digest()


def _signer(size: int, bands: int, rows: int):
    def sign(batches):
        for ids, texts in _chunks(batches):
            sets = [shingle_set(t, size) for t in texts]
            full = [k for k, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(ids)
            if full:
                made = band_keys(minmax_signature([sets[k] for k in full], bands * rows // 2), bands, rows)
                for k, row in zip(full, made):
                    keys[k] = row
            digest = [_digest(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(digest, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "digest", "n_shingles", "keys"],
            )

    return sign


def _setter(size: int):
    def make(batches):
        for ids, texts in _chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([shingle_set(t, size).view(np.int64) for t in texts], pa.list_(pa.int64()))], ["id", "shingles"])

    return make


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges(a, b).

    Each round takes the least label among the neighbours and then the label
    of the label, so a chain of n nodes ends after about log n rounds.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("low"))
        step = labels.join(near, labels.id == near.a, "left").select("id", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        up = step.select(F.col("id").alias("up"), F.col("label").alias("top"))
        new = stored(step.join(up, step.label == up.up, "left").select("id", "was", F.least("label", "top").alias("label")))
        labels = new.select("id", "label")
        if new.where("was <> label").isEmpty():
            return labels.select("id", F.col("label").alias("component"))


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    shared = pairs.join(a, "a").join(b, "b").select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("s"))
    return shared.where(den * F.col("i") >= num * (F.col("s") - F.col("i"))).select("a", "b")


def _fits(na: Column, nb: Column, num: int, den: int) -> Column:
    return den * F.least(na, nb) >= num * F.greatest(na, nb)


def _salted(big: DataFrame, small: DataFrame) -> DataFrame:
    """big joined to the one row a key of small, the rows of a frequent key being dealt over ``SALT`` tasks."""
    each = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return big.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(each, ["key", "_salt"]).drop("_salt")


def _classes(lead: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(digest, rep, id) of the classes of equal texts, and the edges (a, b) between classes that share a doc_id.

    A class's id is its least doc_id. Where rows of one doc_id have several
    texts only one class can have it; the others take a negative number of
    their digest. Then there are edges, else None.
    """
    classes = lead.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    several = lead.groupBy("doc_id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least <> most")
    several = cut(several)
    if several.isEmpty():
        return classes.withColumn("id", F.col("rep")), None
    number = -1 - F.abs(F.xxhash64("digest") % (1 << 62))
    first = several.select(F.col("doc_id").alias("rep"), "least")
    classes = cut(classes.join(first, "rep", "left").withColumn("id", F.when(F.col("least").isNull() | (F.col("least") == F.col("digest")), F.col("rep")).otherwise(number)).select("digest", "rep", "id"))
    shared = lead.join(several.select("doc_id"), "doc_id", "left_semi").select("doc_id", "digest").distinct().join(classes, "digest").select("doc_id", "id")
    heads = shared.groupBy("doc_id").agg(F.min("id").alias("a"))
    return classes, shared.join(heads, "doc_id").where("a <> id").select("a", F.col("id").alias("b"))


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100, size: int = 5) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents with den * intersection >= num * union of their shingle sets are
    linked. Null and empty texts have no shingle and no link. Rows that share
    a doc_id count as one document, which is linked by any of its texts. A null
    doc_id gives a row that is never kept. Other columns of docs are ignored.
    """
    bands, rows = layout(num / den)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(text.mapInArrow(_signer(size, bands, rows), "doc_id long, digest binary, n_shingles long, keys array<long>"))
    lead = signed.where("n_shingles > 0 and doc_id is not null")
    classes, shared = _classes(lead)
    heads = classes.withColumn("doc_id", F.col("rep"))
    reps = lead.join(heads, ["doc_id", "digest"]).select("id", "digest", "rep", "n_shingles", "keys").dropDuplicates(["id"])

    member = reps.select(F.explode("keys").alias("key"), "id", F.col("n_shingles").alias("n"))
    sizes = member.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    member = cut(_salted(member, sizes))

    small = member.where(F.col("m") <= SMALL)
    other = small.select("key", F.col("id").alias("b"), F.col("n").alias("nb"))
    pairs = small.join(other, "key").where((F.col("id") < F.col("b")) & _fits(F.col("n"), F.col("nb"), num, den)).select(F.col("id").alias("a"), "b").distinct()
    pairs = cut(pairs)

    large = member.where(F.col("m") > SMALL)
    crowd = large.select("id").distinct()
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(crowd).distinct()
    if shared is None:
        sources = text.join(wanted, text.doc_id == wanted.id).select("id", "text").dropDuplicates(["id"])
    else:  # a doc_id does not tell its class; the text's digest does
        ids = wanted.join(classes, "id").select("id", F.col("rep").alias("doc_id"), "digest")
        sources = text.join(ids, "doc_id").mapInArrow(_of_class, "id long, text string")
    made = sources.mapInArrow(_setter(size), "id long, shingles array<long>")
    sets = cut(made if shared is None else made.dropDuplicates(["id"]))

    links = cut(_linked(pairs, sets, num, den))
    if not crowd.isEmpty():
        links = cut(links.union(_crowded(large, crowd, sets, reps.select("id", "keys"), links, num, den)))
    if shared is not None:
        links = cut(links.union(shared))

    if links.isEmpty():
        parts = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    else:
        parts = connected_components(links)
    if shared is not None:  # ids of classes are not all doc_ids
        least = parts.join(classes, "id").groupBy("component").agg(F.min("rep").alias("least"))
        parts = parts.join(least, "component").select("id", F.col("least").alias("component"))
    named = classes.join(parts, "id", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = signed.join(named, "digest", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("component").isNotNull(), F.least("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _of_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) of the rows of (doc_id, text, id, digest) whose text has the digest."""
    for batch in batches:
        column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
        keep = pa.array([_digest(t.as_py()) == d.as_py() for t, d in zip(column["text"], column["digest"])], pa.bool_())
        yield pa.RecordBatch.from_arrays([column["id"].filter(keep), column["text"].filter(keep)], ["id", "text"])


def _crowded(large: DataFrame, crowd: DataFrame, sets: DataFrame, keys: DataFrame, known_links: DataFrame, num: int, den: int) -> DataFrame:
    """Links between the classes of large buckets; see the module's text.

    keys has each class's bucket keys: a pair of the last step is given only by
    the least key that its two classes share, and not by each of them.
    """
    each = sets.join(crowd, "id").select("id", F.explode("shingles").alias("h"))
    seen = each.groupBy("h").agg(F.count("*").alias("df")).where(F.col("df") <= RARE)
    rare = stored(each.join(seen, "h"))
    n_rare = rare.groupBy("id").agg(F.count("*").alias("rare"))
    known = stored(large.join(n_rare, "id", "left").select("key", "m", "id", "n", F.coalesce("rare", F.lit(0)).alias("rare")))

    shared = rare.where("df > 1").select("h", "id")
    twin = shared.select("h", F.col("id").alias("b"))
    by_rare = shared.join(twin, "h").where("id < b").select(F.col("id").alias("a"), "b")

    gap = num_gap(num, den)
    bound = lambda x, y: gap * (F.col(f"{x}n") + F.col(f"{y}n")) >= (den + num) * (F.col(f"{x}rare") + F.col(f"{y}rare") + F.abs((F.col(f"{x}n") - F.col(f"{x}rare")) - (F.col(f"{y}n") - F.col(f"{y}rare"))))
    pair = [F.least("id", "xid").alias("a"), F.greatest("id", "xid").alias("b")]
    placed, links = known.withColumn("part", F.col("id")), known_links.limit(0)
    for turn in range(ROUNDS):
        # the first pivot has the fewest rare shingles, later ones are any class of the part most of the bucket is in
        best = (F.col("rare") / F.col("n")) if turn == 0 else F.xxhash64("id", F.lit(turn))
        facts = [F.col(c).alias(f"x{c}") for c in ("id", "n", "rare", "part")]
        if turn:
            main = placed.groupBy("key", "part").agg(F.count("*").alias("held"), F.min_by(F.struct(*facts), best).alias("p"))
            pivot = main.groupBy("key").agg(F.max_by("p", F.struct("held", "part")).alias("p"), F.count("*").alias("apart")).where("apart > 1").select("key", "p.*")
        else:
            pivot = placed.groupBy("key").agg(F.min_by(F.struct(*facts), best).alias("p")).select("key", "p.*")
        star = stored(_salted(placed, pivot).where((F.col("part") != F.col("xpart")) & bound("", "x")).select(*pair).distinct())
        if turn and star.isEmpty():
            break
        found = stored(_linked(star if turn else by_rare.union(star).distinct(), sets, num, den))
        more = found.count()
        links = links.union(found)
        if more:
            parts = connected_components(links.union(known_links))
            placed = stored(known.join(parts, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component"))
        if turn and 8 * more < star.count():
            break

    held = placed.groupBy("key", "part").agg(F.count("*").alias("held"))
    head = held.groupBy("key").agg(F.max_by("part", F.struct("held", "part")).alias("main"), F.count("*").alias("apart")).where("apart > 1").select("key", "main")
    mixed = stored(_salted(placed, head).join(keys, "id"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    apart = mixed.where("part <> main").select("key", *[F.col(c).alias(f"x{c}") for c in ("id", "n", "rare", "part", "keys")], F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    near = mixed.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    once = F.array_min(F.array_intersect("xkeys", "keys")) == F.col("key")
    rest = apart.join(near, ["key", "block"]).where((F.col("xpart") != F.col("part")) & bound("x", "") & once).select(*pair).distinct()
    return links.union(_linked(rest, sets, num, den))


def num_gap(num: int, den: int) -> int:
    """Of linked sets, (den + num) * symmetric difference <= (den - num) * sum of the sizes."""
    return den - num
