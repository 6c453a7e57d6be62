"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule gets the golden-ratio point frac(i * 0.618...). The
points are mapped through the sources' cumulative target shares, so any run of
slots holds each source in nearly its share. The slots of a source are ranked
and its k-th slot reads the k-th block of ``block`` words of the source's
documents, laid end to end in hashed order; after the last document the source
starts over. As blocks are equal, the slots a source gets decide its words.

Ranks and running sums are taken in two levels (inside a bucket, then over the
buckets' totals), so no source is ordered by one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, cut

GOLDEN = 0.6180339887498949
BLOCK = 128
#: A mix has at least so many slots, or one a word, so that a few of them are a small part of a source.
SLOTS = 1 << 17
BINS = 1024
HALF = 1 << 20


def sized(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, draw): words of each text and its place in the shuffle."""
    return docs.select(
        F.col("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("draw"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, sid, source_size, target) from sizes(source, source_size), one row per source.

    Weights repeat over the sources in code point order, null last. A target
    stops at cap times its source's size; with the sources ordered by
    cap * size / weight, those before the first that its share does not fill
    are full, and the rest split what is left by weight.
    """
    by_name, whole = W.orderBy(F.col("source").asc_nulls_last()), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    named = sizes.select("source", "source_size", (F.row_number().over(by_name) - 1).cast("long").alias("sid")).withColumn("weight", weight)
    named = named.withColumn("full", cap * F.col("source_size").cast("double")).withColumn("level", F.col("full") / F.col("weight"))
    upto = W.orderBy("level", "sid").rowsBetween(W.unboundedPreceding, 0)
    ranked = named.withColumn("before", F.sum("full").over(upto) - F.col("full"))
    ranked = ranked.withColumn("rest", F.sum("weight").over(whole) - F.sum("weight").over(upto) + F.col("weight"))
    share = (F.sum(F.col("source_size").cast("double")).over(whole) - F.col("before")) / F.col("rest")
    ranked = ranked.withColumn("share", share).withColumn("pos", F.row_number().over(W.orderBy("level", "sid")))
    ranked = ranked.withColumn("first", F.min(F.when(F.col("share") <= F.col("level"), F.col("pos"))).over(whole))
    ranked = ranked.withColumn("share", F.max(F.when(F.col("pos") == F.col("first"), F.col("share"))).over(whole))
    return ranked.select("source", "sid", "source_size", F.when(F.col("pos") < F.col("first"), F.col("full")).otherwise(F.col("weight") * F.col("share")).alias("target"))


def block_of(total: float, most: int = BLOCK, slots: int = SLOTS) -> int:
    """Words a slot reads: ``most``, or fewer where the mix would have less than ``slots`` slots."""
    return max(1, min(most, int(total) // slots))


def schedule(plan: DataFrame, block: int | None = None, cap: int = 3) -> DataFrame:
    """(slot, sid, k, block, words) from targets(): slot is the k-th of its source and reads its words from k * block on.

    There are as many slots as blocks in the whole mix, and a source gets those
    whose points fall into its share, so what it reads is its target but for
    the few blocks by which the points are uneven. ``words`` is below the block
    only where a source was read ``cap`` times; slots beyond that are left out.
    ``block`` follows from the mix's size (block_of) unless it is given.
    """
    spark = plan.sparkSession
    plan = plan.where("source_size > 0")
    all_rows, upto = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0)
    plan = plan.withColumn("high", F.sum("target").over(upto) / F.sum("target").over(all_rows))
    plan = cut(plan.withColumn("low", F.lag("high", 1, 0.0).over(W.orderBy("sid"))).withColumn("last", F.lead("sid").over(W.orderBy("sid")).isNull()))

    total = plan.agg(F.coalesce(F.sum(F.col("source_size").cast("double")), F.lit(0.0))).first()[0]
    block = block or block_of(total)
    n = math.ceil(total / block)
    chunk = max(4096, int(n**0.5))
    step = (HALF * GOLDEN) % 1.0
    point = F.expr(f"pmod(pmod((id div {HALF}) * {step!r}D, 1D) + (id % {HALF}) * {GOLDEN!r}D, 1D)")
    slots = spark.range(n).select(F.col("id").alias("slot"), point.alias("u")).withColumn("bin", F.floor(F.col("u") * BINS).cast("long"))
    spans = plan.select("sid", "low", F.when(F.col("last"), F.lit(2.0)).otherwise(F.col("high")).alias("high"))
    spans = spans.select("*", F.explode(F.sequence(F.floor(F.col("low") * BINS), F.least(F.floor(F.col("high") * BINS), F.lit(BINS - 1)))).alias("bin"))
    slots = slots.join(spans, "bin").where("low <= u and u < high").select("slot", "sid", F.expr(f"slot div {chunk}").alias("chunk"))
    slots = cut(slots)

    counts = slots.groupBy("sid", "chunk").agg(F.count("*").alias("c"))
    counts = counts.withColumn("off", F.sum("c").over(W.partitionBy("sid").orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)) - F.col("c"))
    inside = F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot")) - 1
    ranked = slots.withColumn("at", inside).join(counts, ["sid", "chunk"]).select("slot", "sid", (F.col("off") + F.col("at")).alias("k"))
    words = F.least(F.lit(block), cap * F.col("source_size") - F.col("k") * block).cast("long")
    return ranked.join(plan.select("sid", "source_size"), "sid").select("slot", "sid", "k", F.lit(block).alias("block"), words.alias("words")).where("words > 0")


def laid(docs: DataFrame) -> DataFrame:
    """docs(sid, draw, doc_id, size, ...) with start, the words before it in its source's shuffled order."""
    docs = docs.withColumn("bucket", F.substring("draw", 1, 3))
    sums = docs.groupBy("sid", "bucket").agg(F.sum("size").alias("held"))
    sums = sums.withColumn("base", F.sum("held").over(W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("held"))
    order = W.partitionBy("sid", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    within = docs.withColumn("inner", F.sum("size").over(order) - F.col("size"))
    return within.join(sums.drop("held"), ["sid", "bucket"]).withColumn("start", F.col("base") + F.col("inner")).drop("bucket", "base", "inner")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block: int | None = None, seed: str = "mix") -> DataFrame:
    """Per row of docs(doc_id, text, source): doc_id, source, size, source_size, target, taken, first_slot, last_slot.

    ``taken`` counts the words that the schedule reads from the document, with
    repeats, ``first_slot`` and ``last_slot`` are where it first and last reads
    one, null if it never does. taken is at most cap times the size, and a
    source's sum misses its target by a few blocks at most. Null and empty
    texts have size 0 and nothing taken; a null source is a source of its own;
    a null doc_id is drawn as an empty one; rows that share a doc_id are read
    separately. An empty table gives no row.
    """
    rows = cut(sized(docs, seed))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = cut(targets(sizes, weights, cap))
    known = plan.withColumnRenamed("source", "name")
    placed = rows.join(known, rows.source.eqNullSafe(known.name)).drop("name")
    full = cut(laid(placed.where("size > 0")))

    reads = cut(schedule(plan, block, cap))
    ends = reads.groupBy("sid", F.col("block").alias("b")).agg(F.sum("words").alias("read"))
    # a document stands in the source's stream of words once for every pass that is begun
    times = full.join(ends, "sid").select("sid", "start", "size", "b", "read", F.explode(F.expr("sequence(0L, (read - 1) div source_size)")).alias("pass"), "source_size")
    times = times.withColumn("low", F.col("start") + F.col("pass") * F.col("source_size")).withColumn("high", F.least(F.col("low") + F.col("size"), F.col("read"))).where("low < high")
    parts = times.select("sid", "start", "low", "high", F.explode(F.expr("sequence(low div b, (high - 1) div b)")).alias("k"))
    got = F.least(F.col("high"), F.col("k") * F.col("block") + F.col("words")) - F.greatest(F.col("low"), F.col("k") * F.col("block"))
    used = parts.join(reads, ["sid", "k"]).groupBy("sid", "start").agg(F.sum(got).alias("got"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
    facts = ["doc_id", "source", "size", "source_size", "target"]
    read = full.join(used, ["sid", "start"], "left").select(*facts, F.coalesce("got", F.lit(0)).cast("long").alias("taken"), "first_slot", "last_slot")
    none = F.lit(None).cast("long")
    empty = placed.where("size = 0").select(*facts, F.lit(0).cast("long"), none, none)
    return read.union(empty)


def copies(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block: int | None = None, seed: str = "mix") -> DataFrame:
    """The mixed corpus as whole documents: each row of docs round(taken / size) times.

    The schedule cuts a source's stream inside one document, so the copies miss
    the words read by half of that document at most. Rows without a word, or of
    which less than half was read, are left out.
    """
    times = mix(docs, weights, cap, block, seed).where("size > 0").groupBy("doc_id").agg(F.max(F.expr("(2 * taken + size) div (2 * size)")).alias("times_read"))
    rows = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).alias("d")
    kept = rows.join(times.alias("t"), F.col("d.doc_id").eqNullSafe(F.col("t.doc_id"))).where("times_read > 0")
    return kept.select("row", F.explode(F.sequence(F.lit(1), F.col("times_read").cast("int"))).alias("copy")).select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sid FROM s),
w AS (SELECT *, CAST([5, 2, 1][sid % 3 + 1] AS DOUBLE) AS weight FROM n),
l AS (SELECT *, 3 * CAST(source_size AS DOUBLE) AS full_size, 3 * CAST(source_size AS DOUBLE) / weight AS level FROM w),
r AS (SELECT *, row_number() OVER o AS pos, sum(full_size) OVER o - full_size AS before,
             sum(weight) OVER () - sum(weight) OVER o + weight AS rest, sum(CAST(source_size AS DOUBLE)) OVER () AS total
      FROM l WINDOW o AS (ORDER BY level, sid ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, (total - before) / rest AS share, min(CASE WHEN (total - before) / rest <= level THEN pos END) OVER () AS first_open FROM r),
t AS (SELECT source, sid, source_size,
             CASE WHEN pos < first_open THEN full_size ELSE weight * max(CASE WHEN pos = first_open THEN share END) OVER () END AS target FROM f),
g AS (SELECT greatest(1, least(128, CAST(sum(source_size) AS BIGINT) // 131072)) AS block, CAST(ceil(sum(source_size) / greatest(1, least(128, CAST(sum(source_size) AS BIGINT) // 131072))) AS BIGINT) AS n FROM t),
p AS (SELECT d.doc_id, d.size, t.sid, t.source_size, t.target,
             CAST(sum(d.size) OVER (PARTITION BY t.sid ORDER BY draw, doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT sid, source_size, sum(target) OVER (ORDER BY sid ROWS UNBOUNDED PRECEDING) / sum(target) OVER () AS high FROM t WHERE source_size > 0),
q AS (SELECT *, lag(high, 1, 0.0) OVER (ORDER BY sid) AS low, lead(sid) OVER (ORDER BY sid) IS NULL AS last FROM b),
i AS (SELECT unnest(range(n)) AS slot FROM g),
u AS (SELECT slot, fmod(fmod((slot // 1048576) * fmod(1048576 * 0.6180339887498949::DOUBLE, 1.0::DOUBLE), 1.0::DOUBLE) + (slot % 1048576) * 0.6180339887498949::DOUBLE, 1.0::DOUBLE) AS u FROM i),
k AS (SELECT slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS k FROM u JOIN q ON low <= u AND u < CASE WHEN last THEN 2.0 ELSE high END),
c AS (SELECT q.sid, CAST(least(count(k.sid) * any_value(block), 3 * any_value(source_size)) AS BIGINT) AS read FROM q CROSS JOIN g LEFT JOIN k ON k.sid = q.sid GROUP BY q.sid),
a AS (SELECT p.sid, start, (start + pass * source_size) // block AS low_k, (least(start + pass * source_size + size, read) - 1) // block AS high_k
      FROM p JOIN c USING (sid) CROSS JOIN g CROSS JOIN (SELECT unnest([0, 1, 2]) AS pass) WHERE size > 0 AND start + pass * source_size < read),
o AS (SELECT a.sid, a.start, min(x.slot) AS first_slot, max(y.slot) AS last_slot FROM a JOIN k x ON x.sid = a.sid AND x.k = low_k JOIN k y ON y.sid = a.sid AND y.k = high_k GROUP BY 1, 2)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE CAST(read // source_size * size + greatest(0, least(size, read % source_size - p.start)) AS BIGINT) END AS taken, first_slot, last_slot
FROM p LEFT JOIN c ON c.sid = p.sid LEFT JOIN o ON o.sid = p.sid AND o.start = p.start AND p.size > 0
"""
