"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code is the signs of its elements. A code is cut into segments,
each an index of its own. Round r looks, in every segment, for the values at
distance r from the query's. After round r every code within
``segments * (r + 1) - 1`` bits has been met in some segment (else each segment
would differ in more than r bits), so a query whose k-th verified distance is
within that bound is finished; the others go on to radius r + 1.

Equal codes are one entry of the index. An entry carries its k smallest ids,
which are all that any list of k can take from it. A candidate farther than a
query's k-th distance so far is dropped where it is met.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut

WORD_BITS = 32


def sign_code(vector: Column, bits: int) -> Column:
    """array<long> of 32-bit words: bit i of the code is set where element i is above 0; missing elements are 0."""
    words = []
    for at in range(0, bits, WORD_BITS):
        set_bits = [F.when(F.get(vector, i) > 0, F.lit(1 << (i - at))).otherwise(F.lit(0)) for i in range(at, min(bits, at + WORD_BITS))]
        words.append(reduce(lambda a, b: a + b, set_bits).cast("long"))
    return F.array(*words)


def hamming(a: Column, b: Column, bits: int) -> Column:
    """Bits in which two codes of so many bits differ, word by word and without a lambda, which Spark would not compile."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.get(a, n).bitwiseXOR(F.get(b, n))) for n in range(-(-bits // WORD_BITS))])


#: What it costs to send a value to the index, in entries compared.
PROBE = 10


def cost(widths: list[int], bits: int, rows: int, k: int) -> float:
    """Entries compared and values looked for, weighed, until a query has its k nearest of so many rows, if their bits were even and independent."""
    within, far = 0.0, -1
    while within < k and far < bits:
        far += 1
        within += math.ldexp(rows * math.comb(bits, far), -bits)
    looked = ((math.comb(w, r), w) for n, w in enumerate(widths) for r in range(min(w, (far - n) // len(widths)) + 1))
    return sum(flips * (PROBE + math.ldexp(rows, -w)) for flips, w in looked)


def cut_points(bits: int, rows: int, k: int = 10) -> list[tuple[int, int]]:
    """Segments that do not straddle code words, all words being cut into as many as cost least.

    Short segments are held by many rows each, long ones have more values near
    the query's than rows: with 600,000 rows of 64 bits a query looks for some
    4,600 values in segments of 16 bits and for 20 million in those of 32.
    """
    best: tuple[float, list[tuple[int, int]]] = (math.inf, [])
    for pieces in range(1, WORD_BITS + 1):
        out = []
        for at in range(0, bits, WORD_BITS):
            have = min(WORD_BITS, bits - at)
            n = max(1, round(have * pieces / WORD_BITS))
            edges = [at + have * i // n for i in range(n + 1)]
            out += list(zip(edges, edges[1:]))
        best = min(best, (cost([high - low for low, high in out], bits, max(rows, 1), k), out))
    return best[1]


def segment(code: Column, low: int, high: int) -> Column:
    return F.shiftright(F.get(code, F.lit(low // WORD_BITS)), low % WORD_BITS).bitwiseAND(F.lit((1 << (high - low)) - 1))


def masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for bits in combinations(range(width), radius)]


def longest(*tables: DataFrame) -> int:
    """Elements of the longest embedding."""
    return max(1, *[df.agg(F.max(F.size("embedding"))).first()[0] or 0 for df in tables])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, bits: int | None = None) -> DataFrame:
    """Per query the k nearest rows: query_id, rank (from 1), vec_id, distance.

    vectors and queries have (vec_id, embedding). Ties go to the smaller
    vec_id; a query that is in vectors finds itself. Rows with a null id or
    embedding are left out on both sides; null and missing elements are 0 bits.
    Rows that share a vec_id count with each row's code. Fewer than k rows give as many as there are.
    Codes have a bit for each element of the longest embedding; with ``bits``
    given a longer one is an error.
    """
    bits = longest(vectors, queries) if bits is None else bits
    fits = F.when(F.size("embedding") > bits, F.raise_error(F.lit(f"an embedding has more than {bits} elements"))).otherwise(F.col("embedding"))
    coded = lambda df: df.where("vec_id is not null and embedding is not null").select("vec_id", fits.alias("embedding")).select("vec_id", sign_code(F.col("embedding"), bits).alias("code")).distinct()
    numbered = coded(vectors).withColumn("place", F.row_number().over(W.partitionBy("code", F.col("vec_id") % 64).orderBy("vec_id"))).where(F.col("place") <= k)
    index = numbered.groupBy("code").agg(F.slice(F.sort_array(F.collect_set("vec_id")), 1, k).alias("ids"))
    index = cut(index)
    entries = index.count()
    asked = cut(coded(queries).select(F.col("vec_id").alias("query_id"), "code"))
    parts = cut_points(bits, entries, k)
    widest = max(high - low for low, high in parts)

    keyed = index.select("code", "ids", F.explode(F.array(*[F.struct(F.lit(n).alias("part"), segment(F.col("code"), *p).alias("value")) for n, p in enumerate(parts)])).alias("at")).select("at.part", "at.value", F.col("code").alias("found"), "ids")
    keyed = cut(keyed)
    by = ["query_id", "code"]
    found, done, active = None, [], asked.withColumn("bound", F.lit(bits))
    for radius in range(widest + 1):
        probes = []
        for n, (low, high) in enumerate(parts):
            flips = masks(high - low, radius)
            if flips:
                each = _flipped(segment(F.col("code"), low, high), flips)
                near = active.where(F.col("bound") >= len(parts) * radius + n)
                probes.append(near.select(*by, "bound", F.lit(n).alias("part"), F.explode(each).alias("value")))
        if probes:
            met = reduce(DataFrame.union, probes).join(keyed, ["part", "value"]).withColumn("distance", hamming(F.col("code"), F.col("found"), bits))
            met = met.where("distance <= bound").select(*by, "found", "distance", "ids")
            met = met if found is None else met.union(found.join(active, by, "left_semi"))
            nearest = W.partitionBy(*by).orderBy("distance", F.get("ids", 0))
            met = met.dropDuplicates([*by, "found"]).withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k).drop("place")
            found = cut(met)
        items = found.select(*by, "distance", F.explode("ids").alias("vec_id"))
        items = items.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy("distance", "vec_id"))).where(F.col("place") <= k)
        full = items.groupBy(*by).agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        covered = len(parts) * (radius + 1) - 1
        sure = full.where((F.col("n") >= k) & (F.col("far") <= covered)) if radius < widest else full
        done.append(items.drop("place").join(sure, by, "left_semi"))
        left = active.drop("bound").join(sure, by, "left_anti").join(full, by, "left")
        active = cut(left.select(*by, F.when(F.col("n") >= k, F.col("far")).otherwise(bits).alias("bound")))
        if active.isEmpty():
            break
    ranked = reduce(DataFrame.union, done).groupBy("query_id", "vec_id").agg(F.min("distance").alias("distance"))
    best = ranked.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("distance").cast("int").alias("distance"))


def _flipped(value: Column, flips: list[int]) -> Column:
    """value XOR each mask, the masks parsed from one literal so that the plan stays small."""
    table = F.split(F.lit(",".join(map(str, flips))), ",").cast("array<bigint>")
    return F.transform(table, lambda m: value.bitwiseXOR(m))


ORACLE = r"""
WITH c AS (SELECT vec_id, list_aggregate(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS HUGEINT) << (i - 1) ELSE CAST(0 AS HUGEINT) END), 'sum') AS code
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
d AS (SELECT q.vec_id AS query_id, v.vec_id, bit_count(xor(CAST(q.code AS HUGEINT), CAST(v.code AS HUGEINT))) AS distance
      FROM c q CROSS JOIN c v WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(distance AS INTEGER) AS distance FROM r WHERE rank <= 10
"""
