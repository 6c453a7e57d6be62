"""Queries of flattened steps, tab lists, settings and file round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lineage import scratch
from ..operators import aggs as A
from ..operators import graph as O
from ..sources import io as S
from .base import registrar
from .base import table as _t
from .g1 import G, edges, nodes

QUERIES, ORACLES, query = registrar()


@query("SELECT l_orderkey AS node_id, bool_or(l_quantity >= 49) AS n1 FROM lineitem GROUP BY 1")
def any_flag(spark, sf):
    return O.any_flag(_t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("node_id"), (F.col("l_quantity") >= 49).alias("n1")), "n1")


@query(
    """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'model' WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size = 1) THEN 'facade' WHEN p_name IN (SELECT p_name FROM part WHERE p_size = 2) THEN 'validation_request' WHEN p_size > 30 THEN 'action_class' ELSE 'service' END AS type FROM part"""
)
def classify_refine(spark, sf):
    """Parts as classes named by brand in files named by part name, of which those of large parts lie under a root; some have a type already."""
    p = _t(spark, sf, "part")
    file = lambda root: F.concat(root, F.lit("/"), F.col("p_name"))
    root = F.when(F.col("p_size") > 30, "app/Actions").otherwise("app/Actionsets")
    n = p.select("p_partkey", F.col("p_brand").alias("fqcn"), F.when(F.col("p_size") % 5 == 0, "model").otherwise("service").alias("type"), file(root).alias("file"))
    checked = p.where("p_size = 2").select(F.explode(F.array(file(F.lit("app/Actions")), file(F.lit("app/Actionsets")))).alias("file"))
    return O.refine_types(n, p.where("p_size = 1").select(F.col("p_brand").alias("fqcn")), checked, ["app/Actions"]).select("p_partkey", "type")


@query("SELECT DISTINCT user_id AS node_id, event_type AS kind, json_extract_string(props, '$.k') AS k FROM events")
def nested_dedupe(spark, sf):
    e = _t(spark, sf, "events")
    steps = e.groupBy(F.col("user_id").alias("node_id"), (F.col("event_id") % 8).alias("path")).agg(F.collect_list(F.struct(F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").alias("k"))).alias("calls"))
    return O.flatten_calls(steps, "calls")


FLOWS = """WITH f AS (SELECT o_custkey AS node_id, o_orderkey % 4 AS kind, l_quantity >= 45 AS n1, l_returnflag AS verb, l_suppkey % 7 AS host FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def _flows(spark, sf):
    """Customers as nodes, their orders as steps (if, loop, try and an if in a loop) and the line items as steps below them."""
    li = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct(F.lit("call").alias("type"), (F.col("l_quantity") >= 45).alias("n1"), F.array(F.struct(F.col("l_returnflag").alias("verb"), (F.col("l_suppkey") % 7).alias("host"))).alias("http")).alias("s"))
    leaf = li.groupBy("o_orderkey").agg(F.collect_list("s").alias("s"))
    kind = F.col("o_orderkey") % 4
    below = F.when(kind == 3, F.array(F.struct(F.lit("if").alias("type"), F.col("s").alias("else")))).alias("body")
    step = F.struct(F.element_at(F.array(*map(F.lit, ("if", "loop", "try", "loop"))), (kind + 1).cast("int")).alias("type"), F.when(kind == 0, F.col("s")).alias("then"), F.when(kind.isin(1, 2), F.to_json("s")).otherwise(F.to_json(below)).alias("body"))
    orders = _t(spark, sf, "orders").join(leaf, "o_orderkey").select(F.col("o_custkey").alias("node_id"), step.alias("step"))
    text = lambda c: F.coalesce(c, F.lit("null"))
    one = F.concat(F.lit('{"type":"'), F.col("step.type"), F.lit('","then":'), text(F.to_json("step.then")), F.lit(',"body":'), text(F.col("step.body")), F.lit("}"))
    return orders.groupBy("node_id").agg(F.parse_json(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]"))).alias("steps"))


@query(FLOWS + " SELECT node_id, bool_or(n1 AND kind <> 2) AS n1 FROM f GROUP BY 1")
def flag_trees(spark, sf):
    return O.any_flag_in_trees(_flows(spark, sf), "n1")


@query(FLOWS + """ SELECT DISTINCT node_id, '{"host":' || host || ',"verb":"' || verb || '"}' AS call FROM f""")
def call_trees(spark, sf):
    return O.calls_in_trees(_flows(spark, sf), "http")


@query("SELECT c_custkey AS tab_id, c_custkey % 5 AS severity FROM customer WHERE contains(lower(c_name), '1') AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 5 > 0")
def tab_list(spark, sf):
    risk = F.get(F.array(*[F.lit(x) for x in ("none", "low", "medium", "high", "critical")]), (F.col("c_custkey") % 5).cast("int"))
    manifest = _t(spark, sf, "customer").select(F.col("c_custkey").alias("tab_id"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("verb"), risk.alias("risk_level"), F.lit("new").alias("status"))
    return O.tab_list(manifest, "risk", "1", ["BUILDING", "MACHINERY"]).select("tab_id", F.col("severity").cast("long").alias("severity"))


@query("SELECT p_partkey FROM part WHERE p_size > 40 OR p_partkey % 4 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0")
def stated_settings(spark, sf):
    k = F.col("p_partkey")
    jobs = _t(spark, sf, "part").select("p_partkey", (F.col("p_size") > 40).alias("queued"), F.when(k % 4 == 0, k).alias("tries"), F.when(k % 3 == 0, "x").otherwise("").alias("queue"), F.when(k % 5 == 0, F.array(k)).otherwise(F.array().cast("array<bigint>")).alias("backoff"))
    return O.stated(jobs, ["queued", "tries", "queue", "backoff"]).select("p_partkey")


@query(G + " SELECT 'region-' || n_regionkey AS tab_id, count(*) AS edges, count(DISTINCT n_nationkey) AS nodes FROM nation GROUP BY 1")
def graph_roundtrip(spark, sf):
    """Stored tabs, one JSON document a region, written and read back."""
    e = edges(spark, sf).where("type = 'region-to-nation'").withColumn("tab", F.regexp_replace("source", "::", "-"))
    n = nodes(spark, sf).where("type = 'nation'").join(e.select(F.col("target").alias("id"), "tab"), "id")
    blank = F.lit("").alias("data")
    ns = n.groupBy("tab").agg(F.collect_list(F.struct("id", "type", "label", blank)).alias("nodes"))
    es = e.groupBy("tab").agg(F.collect_list(F.struct(F.lit("").alias("id"), "source", "target", F.lit("").alias("label"), "type")).alias("edges"))
    tabs = ns.join(es, "tab").select("tab", F.struct(F.lit("p").alias("project"), F.lit("now").alias("analyzedAt")).alias("meta"), "nodes", "edges")
    path = scratch(spark, "tabs")
    tabs.write.partitionBy("tab").json(path)
    got_nodes, got_edges, _ = S.read_graph(spark, f"{path}/*")
    a = got_nodes.join(got_edges.select(F.col("target").alias("id"), "source").distinct(), "id").groupBy(F.regexp_replace("source", "::", "-").alias("tab_id")).agg(F.count_distinct("id").alias("nodes"))
    b = got_edges.groupBy(F.regexp_replace("source", "::", "-").alias("tab_id")).agg(F.count("*").alias("edges"))
    return a.join(b, "tab_id").select("tab_id", "edges", "nodes")


def _log(spark, sf):
    """Orders written as commit logs, one a year, and read back."""
    head = F.concat(F.lit("@@"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("␟"), "o_orderpriority")
    text = F.concat(head, F.lit("\nc"), F.col("o_custkey").cast("string"), F.lit("\n")).alias("value")
    day = F.to_date("o_orderdate").alias("day")
    lines = _t(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), day, "o_orderkey", text)
    path = scratch(spark, "log")
    lines.repartition("year").sortWithinPartitions("year", F.desc("day"), F.desc("o_orderkey")).select("year", "value").write.partitionBy("year").text(path)
    return S.read_commit_log(spark, path, "2000-01-01")


@query(
    """SELECT * FROM (SELECT CAST(o_orderdate AS DATE)::VARCHAR AS day, o_orderpriority AS author, 'c' || o_custkey AS file, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) - 1 AS ord FROM orders) WHERE day >= '2000-01-01'"""
)
def commit_log(spark, sf):
    return _log(spark, sf).select(F.col("commit_date").cast("string").alias("day"), "author", "file", "ord")


@query(
    """SELECT 'c' || o_custkey AS file, count(*) AS commits, max(CAST(o_orderdate AS DATE))::VARCHAR AS last_changed, max(o_orderpriority) FILTER (WHERE k = 1) AS last_author
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01') GROUP BY o_custkey"""
)
def churn_log(spark, sf):
    """Commits and the last author of each file, out of logs of several years."""
    return A.churn(_log(spark, sf)).withColumn("last_changed", F.col("last_changed").cast("string"))


@query("SELECT 's' || l_suppkey AS project, 'p' || l_partkey AS package, l_returnflag = 'R' AS dev FROM lineitem GROUP BY 1, 2, 3")
def manifest_packages(spark, sf):
    """Suppliers as manifests of their parts, written and read back."""
    li = _t(spark, sf, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("name"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("p"), (F.col("l_returnflag") == "R").alias("dev")).distinct()
    pick = lambda dev: F.map_from_entries(F.collect_list(F.when(F.col("dev") == dev, F.struct(F.col("p"), F.lit("1"))))).alias("require-dev" if dev else "require")
    path = scratch(spark, "manifests")
    li.groupBy("name").agg(pick(False), pick(True)).write.json(path)
    return S.read_manifests(spark, path, False).select("project", "package", "dev")


@query("SELECT 't' || p_partkey AS \"table\", unnest(['id', lower(p_brand)]) AS col FROM part")
def catalog_columns(spark, sf):
    """Parts as catalogue extracts with two columns each, written among an unreadable line and read back."""
    col = lambda c: F.struct(c.alias("name"), F.lit("int").alias("type"))
    good = _t(spark, sf, "part").select(F.to_json(F.struct(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("table"), F.array(col(F.lit("id")), col(F.lower("p_brand"))).alias("columns"))))
    path = scratch(spark, "tabs")
    good.union(spark.range(1).select(F.lit("{broken"))).write.text(path)
    got = S.read_table_schemas(spark, path).where("table is not null")
    return got.select("table", F.explode("columns").alias("c")).select("table", F.col("c.name").alias("col"))
