"""The star-schema tables as a typed graph: region, nation, customer, order, part, supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}::"), F.col(key).cast("string"))


#: Ids as numbers: the key above so many bits, which hold the kind's place in KINDS. Keys stay below 2^60.
KIND_BITS = 3


def code(kind: str, key: str):
    """The number of an entity, which joins, sorts and shuffles at a fraction of its name's cost."""
    return F.shiftleft(F.col(key).cast("long"), KIND_BITS).bitwiseOR(F.lit(KINDS.index(kind)).cast("long"))


def name(coded):
    """The name of a number that code gave; null has none."""
    coded = F.col(coded) if isinstance(coded, str) else coded
    kinds = F.array(*[F.lit(f"{kind}::") for kind in KINDS])
    return F.concat(F.get(kinds, coded.bitwiseAND(F.lit(2**KIND_BITS - 1)).cast("int")), F.shiftright(coded, KIND_BITS).cast("string"))


NODE_SPECS = [("region", "region", "r_regionkey", "r_name"), ("nation", "nation", "n_nationkey", "n_name"), ("customer", "customer", "c_custkey", "c_name"), ("order", "orders", "o_orderkey", "o_orderstatus"), ("part", "part", "p_partkey", "p_name"), ("supplier", "supplier", "s_suppkey", "s_name")]
KINDS = [spec[0] for spec in NODE_SPECS] + ["document", "label"]
EDGE_SPECS = [
    ("nation", "region", "n_regionkey", "nation", "n_nationkey", False),
    ("customer", "nation", "c_nationkey", "customer", "c_custkey", False),
    ("supplier", "nation", "s_nationkey", "supplier", "s_suppkey", False),
    ("orders", "customer", "o_custkey", "order", "o_orderkey", False),
    ("lineitem", "order", "l_orderkey", "part", "l_partkey", True),
    ("lineitem", "supplier", "l_suppkey", "part", "l_partkey", True),
]


def nodes(spark: SparkSession, sf: str, coded: bool = False) -> DataFrame:
    """(id, type, label, ord); coded: with numbers for ids, which name() turns back."""
    of, out = code if coded else _id, None
    for n, (kind, table, key, label) in enumerate(NODE_SPECS):
        part = _t(spark, sf, table).select(of(kind, key).alias("id"), F.lit(kind).alias("type"), F.col(label).alias("label"), (F.col(key).cast("long") + n * 10**9).alias("ord"))
        out = part if out is None else out.union(part)
    return out


#: Rows of a part in which repeated edges are found.
PART = 250_000


def _once(keys: DataFrame) -> DataFrame:
    """keys, each once, in as many parts as their number asks for; nearly all differ, so counting them before they are dealt out would only hold them twice."""
    return keys.repartition(max(1, keys.count() // PART), *keys.columns).distinct()


def edges(spark: SparkSession, sf: str, coded: bool = False) -> DataFrame:
    """(source, target, type, ord); coded: with numbers for ids, as in nodes."""
    of, out = code if coded else _id, None
    for table, a, akey, b, bkey, repeated in EDGE_SPECS:
        keys = _t(spark, sf, table).select(akey, bkey)
        keys = _once(keys) if repeated else keys  # as numbers, which are a fraction of the names' size
        part = keys.select(of(a, akey).alias("source"), of(b, bkey).alias("target"), F.lit(f"{a}-to-{b}").alias("type"), F.col(bkey).cast("long").alias("ord"))
        out = part if out is None else out.union(part)
    return out


NODES_SQL = " UNION ALL ".join(f"SELECT '{k}::' || {key} AS id, '{k}' AS type, {label} AS label, CAST({key} AS BIGINT) + {n}000000000 AS ord FROM {t}" for n, (k, t, key, label) in enumerate(NODE_SPECS))
EDGES_SQL = " UNION ALL ".join(f"SELECT {'DISTINCT ' if d else ''}'{a}::' || {ak} AS source, '{b}::' || {bk} AS target, '{a}-to-{b}' AS type, CAST({bk} AS BIGINT) AS ord FROM {t}" for t, a, ak, b, bk, d in EDGE_SPECS)
G = f"WITH RECURSIVE nodes AS ({NODES_SQL}), edges AS ({EDGES_SQL})"



def wide_nodes(spark: SparkSession, sf: str, coded: bool = False) -> DataFrame:
    """The graph's nodes and the documents; coded as in nodes."""
    docs = _t(spark, sf, "documents").select((code if coded else _id)("document", "doc_id").alias("id"), F.lit("document").alias("type"), F.col("lang").alias("label"), (F.col("doc_id") + 9 * 10**9).alias("ord"))
    return nodes(spark, sf, coded).union(docs)


def mentions(spark: SparkSession, sf: str, coded: bool = False) -> DataFrame:
    """Edges from entities to what they only name (segments, brands, priorities), and from kinds of labels to labelled documents.

    coded as in nodes; what is only named has no integer key. It gets a
    negative number, a hash, which no node has and name() does not turn back.
    """
    of = code if coded else _id
    met = (lambda what, key: F.xxhash64(_id(what, key)).bitwiseOR(F.lit(-(2**63)))) if coded else _id
    named = [("customer", "customer", "c_custkey", "segment", "c_mktsegment"), ("part", "part", "p_partkey", "brand", "p_brand"), ("order", "orders", "o_orderkey", "priority", "o_orderpriority")]
    out = _t(spark, sf, "labels").select(of("label", "quality").alias("source"), of("document", "doc_id").alias("target"), F.lit("label-to-document").alias("type"), F.col("doc_id").alias("ord")).distinct()
    for kind, table, key, what, name in named:
        out = out.union(_t(spark, sf, table).select(of(kind, key), met(what, name), F.lit(f"{kind}-to-{what}"), F.col(key).cast("long")))
    return out


def wide_edges(spark: SparkSession, sf: str, coded: bool = False) -> DataFrame:
    return edges(spark, sf, coded).union(mentions(spark, sf, coded))


WIDE = (
    G
    + """, wnodes AS (SELECT * FROM nodes UNION ALL SELECT 'document::' || doc_id, 'document', lang, doc_id + 9000000000 FROM documents),
wedges AS (SELECT * FROM edges UNION ALL SELECT DISTINCT 'label::' || quality, 'document::' || doc_id, 'label-to-document', doc_id FROM labels
 UNION ALL SELECT 'customer::' || c_custkey, 'segment::' || c_mktsegment, 'customer-to-segment', c_custkey FROM customer
 UNION ALL SELECT 'part::' || p_partkey, 'brand::' || p_brand, 'part-to-brand', p_partkey FROM part
 UNION ALL SELECT 'order::' || o_orderkey, 'priority::' || o_orderpriority, 'order-to-priority', o_orderkey FROM orders)"""
)


def urgent(spark: SparkSession, sf: str, coded: bool = False) -> DataFrame:
    """(id): the open orders of the highest priority, entry points of the graph; coded as in nodes."""
    return _t(spark, sf, "orders").where("o_orderstatus = 'O' and o_orderpriority like '1%'").select((code if coded else _id)("order", "o_orderkey").alias("id"))


URGENT = "urgent AS (SELECT 'order::' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '1%')"
