"""Queries on the entity graph: closures, neighbourhoods, fan-in and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import exprs as X
from ..operators import aggs as A
from ..operators import closure as C
from ..operators import graph as O
from ..lineage import stored
from .base import registrar
from .g1 import URGENT, WIDE, G, code, edges, name, nodes, urgent, wide_edges, wide_nodes

QUERIES, ORACLES, query = registrar()
SKIP = ["supplier-to-part"]


def _named(df, *ids):
    """df with names for the numbers of its ids."""
    return df.withColumns({c: name(c) for c in ids})


def _regions(spark, sf, coded=False):
    return nodes(spark, sf, coded).where("type = 'region'").select(F.col("id").alias("tab_id"), "id")


def _seeded(start, where="", base=G, e="edges"):
    return base + f", reach(tab_id, id) AS (SELECT id, id FROM nodes WHERE {start} UNION SELECT r.tab_id, e.target FROM reach r JOIN {e} e ON e.source = r.id {where})"


def _deep(start, where="", base=G, e="edges", limit=""):
    return base + f", walk(tab_id, id, depth) AS (SELECT id, id, 0 FROM nodes WHERE {start} UNION SELECT r.tab_id, e.target, r.depth + 1 FROM walk r JOIN {e} e ON e.source = r.id {where} {limit}), best AS (SELECT tab_id, id, min(depth) AS depth FROM walk GROUP BY 1, 2)"


SKIPPED = "AND e.type <> 'supplier-to-part'"


@query(_deep("type = 'region'", SKIPPED) + " SELECT tab_id, type, count(*) AS n, CAST(min(depth) AS INTEGER) AS depth FROM best JOIN nodes USING (id) GROUP BY 1, 2")
def tab_closure(spark, sf):
    met = C.tab_closure(edges(spark, sf, coded=True), _regions(spark, sf, coded=True), SKIP)
    return _named(met.join(nodes(spark, sf, coded=True).select("id", "type"), "id").groupBy("tab_id", "type").agg(F.count("*").alias("n"), F.min("depth").alias("depth")), "tab_id")


@query(_seeded("type = 'region'", SKIPPED) + " SELECT a.tab_id, e.type, count(*) AS n FROM edges e JOIN reach a ON a.id = e.source JOIN reach b ON b.id = e.target AND a.tab_id = b.tab_id GROUP BY 1, 2")
def tab_edges(spark, sf):
    e, n = stored(edges(spark, sf, coded=True)), nodes(spark, sf, coded=True)
    return _named(C.tab_edges(C.tab_closure(e, _regions(spark, sf, coded=True), SKIP), n, e).groupBy("tab_id", "type").agg(F.count("*").alias("n")), "tab_id")


@query(
    G
    + """, sched AS (SELECT c_nationkey AS k, min(c_custkey) AS ord, arg_min(c_mktsegment, c_custkey) AS label FROM customer GROUP BY 1),
sl AS (SELECT k, 'schedule-' || lower(label) || CASE WHEN row_number() OVER (PARTITION BY lower(label) ORDER BY ord) > 1 THEN '-' || row_number() OVER (PARTITION BY lower(label) ORDER BY ord) ELSE '' END AS tab_id FROM sched),
seeds AS (SELECT lower(r_name) AS tab_id, 'region::' || r_regionkey AS id, 'route' AS family FROM region UNION SELECT 'cmd-' || regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), 'customer::' || c_custkey, 'command' FROM customer
 UNION SELECT 'channel-part-' || p_partkey, 'part::' || p_partkey, 'channel' FROM part UNION SELECT 'macros', 'nation::' || n_nationkey, 'macro' FROM nation WHERE n_name LIKE '%1'
 UNION SELECT tab_id, 'nation::' || k, 'schedule' FROM sl UNION SELECT 'get-page-' || s_suppkey, x, 'page' FROM (SELECT s_suppkey, unnest(['supplier::' || s_suppkey, 'nation::' || s_nationkey]) AS x FROM supplier)),
reach(tab_id, id, family) AS (SELECT tab_id, id, family FROM seeds UNION SELECT r.tab_id, e.target, r.family FROM reach r JOIN edges e ON e.source = r.id WHERE e.type <> 'supplier-to-part'),
whole AS (SELECT tab_id, id, family FROM reach UNION SELECT s.tab_id, e.source, s.family FROM seeds s JOIN edges e ON e.target = s.id AND e.type = 'supplier-to-part' WHERE s.family = 'channel')
SELECT family, count(DISTINCT tab_id) AS tabs, count(*) AS members FROM whole GROUP BY 1"""
)
def tab_families(spark, sf):
    """Regions as routes, customers as commands, parts as channels with suppliers as broadcasters, customers' nations as schedules, suppliers as pages."""
    t = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    row = lambda df, label, kind, key, ord: df.select(label.alias("label"), code(kind, key).alias("id"), F.col(ord).cast("long").alias("ord"))
    part = F.concat(F.lit("part "), F.col("p_partkey").cast("string"))
    page = F.concat(F.lit("GET /page/"), F.col("s_suppkey").cast("string"))
    seeds = C.tab_seeds(
        routes=row(t("region"), F.col("r_name"), "region", "r_regionkey", "r_regionkey"),
        commands=row(t("customer"), F.col("c_name"), "customer", "c_custkey", "c_custkey"),
        channels=row(t("part"), part, "part", "p_partkey", "p_partkey"),
        schedules=row(t("customer"), F.col("c_mktsegment"), "nation", "c_nationkey", "c_custkey"),
        macros=row(t("nation").where("n_name like '%1'"), F.col("n_name"), "nation", "n_nationkey", "n_nationkey"),
        pages=row(t("supplier"), page, "supplier", "s_suppkey", "s_suppkey").union(row(t("supplier"), page, "nation", "s_nationkey", "s_suppkey")),
    )
    e = edges(spark, sf, coded=True)
    channels = seeds.where("family = 'channel'").select("tab_id", "id")
    sizes, members = C.tab_sizes(e, seeds, channels.select("tab_id").distinct(), SKIP)
    heard = C.with_broadcasters(members, channels, nodes(spark, sf, coded=True), e, "supplier-to-part")
    sizes = sizes.union(heard.groupBy("tab_id").agg(F.count("*").alias("n")))
    return sizes.join(seeds.select("tab_id", "family").distinct(), "tab_id").groupBy("family").agg(F.count("*").alias("tabs"), F.sum("n").alias("members"))


@query(_seeded("id IN ('region::0', 'nation::3')") + " SELECT type, count(*) AS n, count(DISTINCT reach.id) AS reached FROM nodes LEFT JOIN (SELECT DISTINCT id FROM reach) reach USING (id) GROUP BY 1")
def reached(spark, sf):
    n = nodes(spark, sf, coded=True)
    entry = n.where(name("id").isin("region::0", "nation::3")).select("id")
    met = C.reached(n, edges(spark, sf, coded=True), entry.withColumn("fqcn", F.lit(None).cast("string"))).select("id", F.lit(1).alias("hit"))
    return n.join(met, "id", "left").groupBy("type").agg(F.count("*").alias("n"), F.count("hit").alias("reached"))


@query(G + ", up(id) AS (SELECT id FROM nodes WHERE type = 'part' AND id LIKE '%00' UNION SELECT e.source FROM up JOIN edges e ON e.target = up.id) SELECT id FROM up JOIN nodes USING (id) WHERE type IN ('customer', 'supplier')")
def impact(spark, sf):
    n = nodes(spark, sf, coded=True)
    return C.impact(n, edges(spark, sf, coded=True), n.where((F.col("type") == "part") & name("id").endswith("00")), ["customer", "supplier"]).select(name("id").alias("id"))


@query(
    G
    + """, r AS (SELECT e.*, CASE n.type WHEN 'supplier' THEN 0 WHEN 'order' THEN 1 ELSE 99 END AS rank FROM edges e LEFT JOIN nodes n ON n.id = e.target),
w(id, depth, keys) AS (SELECT 'nation::7', 0, CAST([] AS STRUCT(rank INTEGER, ord BIGINT, target VARCHAR)[]) UNION ALL SELECT r.target, w.depth + 1, list_append(w.keys, {'rank': r.rank, 'ord': r.ord, 'target': r.target}) FROM w JOIN r ON r.source = w.id WHERE w.depth < 3),
b AS (SELECT id, depth, keys, row_number() OVER (PARTITION BY id ORDER BY depth, keys) AS k FROM w)
SELECT id, type, depth, row_number() OVER (ORDER BY depth, keys) - 1 AS place FROM b JOIN nodes USING (id) WHERE k = 1"""
)
def neighbourhood(spark, sf):
    """Within three steps of a nation; suppliers and orders come before other types."""
    n = nodes(spark, sf, coded=True)
    return C.neighbourhood(n, stored(edges(spark, sf, coded=True)), n.where(name("id") == "nation::7"), 3, {"supplier": 0, "order": 1}).select(name("id").alias("id"), "type", "depth", "place")


@query(
    G
    + """, w(tab_id, id) AS (SELECT id, id FROM nodes WHERE type = 'region' UNION SELECT w.tab_id, e.target FROM w JOIN edges e ON e.source = w.id WHERE e.type IN ('region-to-nation', 'nation-to-customer')),
o AS (SELECT DISTINCT w.tab_id, 'model' AS kind, e.target AS operation FROM w JOIN edges e ON e.source = w.id WHERE e.type = 'customer-to-order' UNION SELECT w.tab_id, 'raw', 'select ' || c_mktsegment || ' ' || floor(c_acctbal) FROM w JOIN customer ON w.id = 'customer::' || c_custkey)
SELECT tab_id, kind, count(*) AS ops FROM o GROUP BY 1, 2"""
)
def attributed_ops(spark, sf):
    """Regions walk through nations and customers to orders; each customer has one raw statement."""
    kinds = {"region-to-nation": "service", "nation-to-customer": "repository", "customer-to-order": "model"}
    calls = edges(spark, sf).select("source", "target", X.lookup(F.col("type"), kinds, "other").alias("type"))
    said = F.concat(F.lit("select "), "c_mktsegment", F.lit(" "), F.format_string("%.1f", F.floor("c_acctbal").cast("double")))
    statements = spark.read.parquet(f"{sf}/customer.parquet").select(F.concat(F.lit("customer::"), F.col("c_custkey").cast("string")).alias("id"), said.alias("statement"))
    return C.attributed(calls, _regions(spark, sf), statements).groupBy("tab_id", "kind").agg(F.count("*").alias("ops"))


@query(_deep("type = 'region'", limit="WHERE r.depth < 5 AND split_part(r.id, '::', 1) IN ('region', 'nation', 'customer')") + " SELECT b.tab_id, e.type, count(*) AS hops FROM best b JOIN edges e ON e.source = b.id WHERE split_part(b.id, '::', 1) IN ('region', 'nation', 'customer') GROUP BY 1, 2")
def trace_depth5(spark, sf):
    hops = C.trace(stored(edges(spark, sf, coded=True)), _regions(spark, sf, coded=True), nodes(spark, sf, coded=True), ["nation", "customer"], 5)
    return _named(hops.groupBy("tab_id", "type").agg(F.count("*").alias("hops")), "tab_id")


@query(G + " SELECT n.id, n.type <> 'order' OR n.id IN (SELECT e.target FROM edges e JOIN edges f ON f.target = e.source WHERE f.source IN ('nation::1', 'nation::2')) AS inherits FROM nodes n WHERE n.type = 'order'")
def inherits_from(spark, sf):
    parents = edges(spark, sf).where("type in ('customer-to-order', 'nation-to-customer')").select(F.col("target").alias("child"), F.col("source").alias("parent"))
    bases = nodes(spark, sf).where("id in ('nation::1', 'nation::2')").select("id")
    return C.inherits_from(parents, bases).where("id like 'order::%'")


@query("SELECT conv_id, turn, role, max(declared) AS declared_turn FROM (SELECT a.conv_id, a.turn, a.role, b.turn AS declared FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.role = 'user' AND b.turn BETWEEN a.turn - 5 AND a.turn) GROUP BY 1, 2, 3")
def resolve_member(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role")
    key = lambda t: F.concat_ws("#", F.col("conv_id"), t)
    parents = c.where("turn > 0").select(key(F.col("turn")).alias("child"), key(F.col("turn") - 1).alias("parent"))
    methods = c.where("role = 'user'").select(key(F.col("turn")).alias("id"), F.lit("user").alias("method"))
    asked = c.select("conv_id", "turn", "role", key(F.col("turn")).alias("id"), F.lit("user").alias("method"))
    got = C.resolve_member(parents, methods, asked, 5)
    return asked.join(got, ["id", "method"]).select("conv_id", "turn", "role", F.substring_index("declared_in", "#", -1).cast("long").alias("declared_turn"))


@query(
    _seeded("type IN ('region', 'nation')", "AND e.type NOT IN ('order-to-part', 'supplier-to-part', 'nation-to-supplier')")
    + """ SELECT n.id, count(r.id) AS hidden, n.id IN (SELECT id FROM reach WHERE id <> tab_id) AS itself_hidden, (SELECT count(DISTINCT id) FROM reach WHERE id <> tab_id) AS all_hidden
FROM nodes n LEFT JOIN reach r ON r.tab_id = n.id AND r.id <> n.id WHERE n.type IN ('region', 'nation') GROUP BY 1"""
)
def collapsed_counts(spark, sf):
    n = nodes(spark, sf, coded=True)
    hidden, counts = C.collapse(n, edges(spark, sf, coded=True), n.where("type in ('region', 'nation')"), ["region", "nation", "customer", "order"])
    whole = hidden.agg(F.count("*").alias("all_hidden"))
    return counts.join(hidden.withColumn("itself_hidden", F.lit(True)), "id", "left").join(F.broadcast(whole)).select(name("id").alias("id"), "hidden", F.coalesce("itself_hidden", F.lit(False)).alias("itself_hidden"), "all_hidden")


@query(
    """WITH RECURSIVE t AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS b, user_id FROM events),
e AS (SELECT DISTINCT a, b FROM t WHERE b IS NOT NULL), r(s, id) AS (SELECT a, b FROM e UNION SELECT r.s, e.b FROM r JOIN e ON e.a = r.id)
SELECT s AS event, id AS reached, EXISTS (SELECT 1 FROM r x WHERE x.s = r.s AND x.id = r.s) AS cyclic FROM r"""
)
def event_cascade(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    nxt = F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_type"))
    t = ev.select("event_type", nxt.alias("b"), "user_id").where("b is not null").select("event_type", "b").distinct()
    listeners = t.select(F.col("event_type").alias("event"), F.concat_ws(">", "event_type", "b").alias("listener"))
    fired = t.select(F.concat_ws(">", "event_type", "b").alias("listener"), F.col("b").alias("event"))
    return C.event_cascade(listeners, fired)


REFS = r"""refs AS (SELECT DISTINCT 'page::' || page_id AS source, 'path::' || h AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS h FROM pages)),
both_ways AS (SELECT source, target FROM refs UNION ALL SELECT target, source FROM refs)"""


def page_refs_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    hrefs = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("h"))
    return hrefs.select(F.concat(F.lit("page::"), "page_id").alias("source"), F.concat(F.lit("path::"), "h").alias("target")).distinct()


@query("WITH RECURSIVE " + REFS + ", w(id) AS (SELECT 'page::0' UNION SELECT b.target FROM w JOIN both_ways b ON b.source = w.id) SELECT id FROM w")
def page_closure(spark, sf):
    r = page_refs_table(spark, sf)
    refs = r.union(r.select("target", "source")).toDF("parent", "child")
    met, _ = C.view_closure(refs, spark.createDataFrame([("page::0",)], "id string"))
    return met.select("id")


@query("WITH RECURSIVE " + REFS + ", w(id, d) AS (SELECT 'page::' || page_id, 0 FROM pages WHERE page_id IN (1, 2) UNION SELECT b.target, w.d + 1 FROM w JOIN both_ways b ON b.source = w.id WHERE w.d < 3) SELECT id, min(d) AS depth FROM w GROUP BY 1")
def reference_growth(spark, sf):
    r = page_refs_table(spark, sf)
    pages = spark.read.parquet(f"{sf}/pages.parquet").where("page_id in (1, 2)").select(F.concat(F.lit("page::"), "page_id").alias("id"))
    return C.grow(r.union(r.select("target", "source")), pages, 3).select("id", "depth")


@query(
    """WITH RECURSIVE g AS (SELECT 'r' || n_regionkey AS grp, n_nationkey AS pos, 'n' || n_nationkey AS member FROM nation UNION ALL SELECT 'n' || s_nationkey, s_suppkey, 's' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN ':' || s_suppkey || ',1' ELSE '' END FROM supplier
 UNION ALL SELECT 'n' || s_nationkey, 100000000 + s_suppkey, 'r' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 = 0),
w(owner, name, place, seen) AS (SELECT 'o' || r_regionkey, 'r' || r_regionkey, [r_regionkey]::BIGINT[], []::VARCHAR[] FROM region UNION ALL SELECT w.owner, g.member, list_append(w.place, g.pos), list_append(w.seen, w.name) FROM w JOIN g ON g.grp = w.name WHERE NOT list_contains(w.seen, w.name)),
l AS (SELECT owner, CASE WHEN s_suppkey % 3 = 1 THEN s_name || substr(name, length(split_part(name, ':', 1)) + 1) ELSE name END AS name, place FROM w LEFT JOIN supplier ON split_part(name, ':', 1) = 's' || s_suppkey WHERE name NOT IN (SELECT grp FROM g))
SELECT owner, name, array_to_string(min(place), '/') AS place FROM l GROUP BY 1, 2 UNION ALL SELECT 'p' || r_regionkey, 'r0:x', CAST(r_regionkey AS VARCHAR) FROM region"""
)
def group_expand(spark, sf):
    """Regions expand to nations and those to suppliers, some with parameters or an alias, and some back to their region; a group's name with parameters is no group."""
    t = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    named = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    s = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    params = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(":"), F.col("s_suppkey").cast("string"), F.lit(",1"))).otherwise("")
    groups = t("nation").select(named("r", "n_regionkey").alias("group"), F.col("n_nationkey").cast("long").alias("pos"), named("n", "n_nationkey").alias("member"))
    groups = groups.union(s.select(named("n", "s_nationkey"), "s_suppkey", F.concat(named("s", "s_suppkey"), params)))
    groups = groups.union(s.where("s_suppkey % 5 = 0").select(named("n", "s_nationkey"), F.lit(100000000) + F.col("s_suppkey"), named("r", "n_regionkey")))
    names = t("region").select(named("o", "r_regionkey").alias("owner"), F.col("r_regionkey").alias("pos"), named("r", "r_regionkey").alias("name"))
    names = names.union(t("region").select(named("p", "r_regionkey"), "r_regionkey", F.lit("r0:x")))
    aliases = t("supplier").where("s_suppkey % 3 = 1").select(named("s", "s_suppkey").alias("alias"), F.col("s_name").alias("target"))
    return C.expand_groups(names, groups, aliases).select("owner", "name", F.array_join(F.col("place").cast("array<string>"), "/").alias("place"))


@query(
    G
    + """, fp AS (SELECT target, source, ord FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ord, source) AS k FROM edges) WHERE k = 1),
w(root, id, path, keys) AS (SELECT id, id, [id], CAST([] AS STRUCT(ord BIGINT, id VARCHAR)[]) FROM nodes WHERE id NOT IN (SELECT target FROM fp) UNION ALL SELECT w.root, fp.target, list_append(w.path, fp.target), list_append(w.keys, {'ord': fp.ord, 'id': fp.target}) FROM w JOIN fp ON fp.source = w.id)
SELECT root, CAST(len(path) AS INTEGER) AS length, array_to_string(path, '>') AS path FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY len(path) DESC, keys) AS k FROM w) WHERE k = 1"""
)
def longest_path(spark, sf):
    out = C.longest_path(nodes(spark, sf), edges(spark, sf))
    return out.select("root", "length", F.array_join("path", ">").alias("path"))


@query(G + " SELECT target, source FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ord, source) AS k FROM edges) WHERE k = 1")
def first_parent(spark, sf):
    return C.first_parent(edges(spark, sf))


RANKS = {"region": 0, "nation": 1, "customer": 2, "order": 3, "part": 4, "supplier": 5}


@query(
    G
    + """, l1 AS (SELECT target AS id, row_number() OVER (ORDER BY ord, target) AS p FROM edges WHERE source = 'nation::1'),
l2 AS (SELECT target AS id, p, ord FROM edges JOIN l1 ON source = l1.id WHERE type = 'customer-to-order'),
calls AS (SELECT 0 AS level, 0 AS p, 0 AS q, source, target, ord FROM edges WHERE source = 'nation::1' UNION ALL SELECT 1, p, 0, source, target, ord FROM edges JOIN l1 ON source = l1.id
 UNION ALL SELECT 2, p, l2.ord, source, target, edges.ord FROM edges JOIN l2 ON source = l2.id),
parts AS (SELECT DISTINCT target AS id FROM calls WHERE starts_with(target, 'part::')),
m AS (SELECT 0 AS part, 0 AS level, 0 AS p, 0 AS q, 0 AS ord, '' AS t, '__client__' AS sender, 'nation::1' AS receiver, 'request' AS label, false AS is_return
 UNION ALL SELECT 1, level, p, q, ord, target, source, target, 'call', false FROM calls
 UNION ALL SELECT 2, 0, 0, 0, 0, id || chr(1) || '0', id, '__db__', 'query', false FROM parts UNION ALL SELECT 2, 0, 0, 0, 0, id || chr(1) || '1', '__db__', id, 'result', true FROM parts
 UNION ALL SELECT 3, 0, 0, 0, 0, '', 'nation::1', '__client__', 'response', true)
SELECT row_number() OVER (ORDER BY part, level, p, q, ord, t) - 1 AS place, sender, receiver, label, is_return FROM m"""
)
def sequence_messages(spark, sf):
    """The calls that start at one nation, in their order; parts are the models."""
    n = nodes(spark, sf, coded=True).withColumn("type", F.when(F.col("type") == "part", "model").otherwise(F.col("type")))
    e = stored(edges(spark, sf, coded=True)).withColumn("label", F.lit("call"))
    _, messages = C.sequence(n, e, n.where(name("id") == "nation::1"), RANKS, name=name, order=("ord", "target"))
    return A.numbered(messages, ["pos"], "place").select("place", "sender", "receiver", "label", "is_return")


@query(WIDE + " SELECT type, count(*) AS n FROM wedges WHERE source IN (SELECT id FROM wnodes) AND target IN (SELECT id FROM wnodes) GROUP BY 1")
def valid_edges(spark, sf):
    return O.valid_edges(wide_nodes(spark, sf), wide_edges(spark, sf)).groupBy("type").agg(F.count("*").alias("n"))


@query(WIDE + " SELECT DISTINCT id, true AS external FROM (SELECT source AS id FROM wedges UNION ALL SELECT target FROM wedges) WHERE id NOT IN (SELECT id FROM wnodes)")
def placeholders(spark, sf):
    return O.placeholders(wide_nodes(spark, sf), wide_edges(spark, sf))


@query(WIDE + " SELECT type, count(*) AS n FROM wnodes WHERE id NOT IN (SELECT source FROM wedges UNION ALL SELECT target FROM wedges) GROUP BY 1")
def isolated_by_type(spark, sf):
    return O.isolated(wide_nodes(spark, sf), wide_edges(spark, sf))


@query(_seeded("id IN (SELECT id FROM urgent)", base=WIDE + ", " + URGENT, e="wedges") + " SELECT type, count(*) AS n FROM wnodes WHERE id NOT IN (SELECT id FROM reach) GROUP BY 1")
def outside_tabs(spark, sf):
    """A tab for each urgent open order; what is in any of them is what all their orders reach together, walked once."""
    met = C.closure(wide_edges(spark, sf), urgent(spark, sf))
    return O.outside_tabs(wide_nodes(spark, sf), met)


@query(G + " SELECT type, count(*) AS n FROM nodes GROUP BY 1")
def type_counts(spark, sf):
    return O.type_counts(nodes(spark, sf))


@query(G + " SELECT source, target, type FROM edges WHERE type IN ('region-to-nation', 'nation-to-customer')")
def induced_subgraph(spark, sf):
    return O.induced(nodes(spark, sf), edges(spark, sf), ["region", "nation", "customer"])[1].select("source", "target", "type")


@query(G + " SELECT source AS id, count(*) AS n FROM edges WHERE type IN ('region-to-nation', 'nation-to-customer', 'customer-to-order') AND target NOT LIKE '%5' GROUP BY 1")
def out_degree(spark, sf):
    n = nodes(spark, sf, coded=True)
    return _named(O.out_degree(n, edges(spark, sf, coded=True), ["region", "nation", "customer", "order"], n.where(name("id").endswith("5"))), "id")


@query("SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) - 1 AS occurrence FROM lineitem")
def edge_occurrence(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return O.edge_ids(li, ["l_orderkey", "l_partkey"], ["l_linenumber"]).select("l_orderkey", "l_partkey", "l_linenumber", F.col("occurrence").cast("long").alias("occurrence"))


@query(
    WIDE
    + """, f AS (SELECT id, CASE WHEN type = 'order' THEN 'f' || ord % 10 END AS file FROM wnodes)
SELECT target AS id, coalesce(file, '#' || source) AS file, count(DISTINCT source) AS callers FROM wedges LEFT JOIN f ON f.id = source WHERE source <> target AND target IN (SELECT id FROM wnodes) GROUP BY 1, 2"""
)
def usages_all(spark, sf):
    """Orders lie in files; the callers of documents are no nodes."""
    file = F.when(F.col("type") == "order", F.concat(F.lit("f"), (F.col("ord") % 10).cast("string")))
    return O.usages(wide_nodes(spark, sf, coded=True).withColumn("file", file), wide_edges(spark, sf, coded=True), named=name)


@query(
    WIDE
    + """, f AS (SELECT id, label, type, CASE WHEN type = 'order' THEN 'f' || ord % 10 END AS file FROM wnodes),
x AS (SELECT *, CASE WHEN ord % 3 > 0 THEN 'k' || ord % 3 ELSE '' END AS label FROM wedges),
c AS (SELECT target AS id, source, string_agg(DISTINCT label, ', ') FILTER (WHERE label <> '') AS edge_labels, string_agg(DISTINCT type, ', ') AS edge_types FROM x WHERE source <> target AND target IN (SELECT id FROM wnodes) GROUP BY 1, 2),
u AS (SELECT c.id, coalesce(file, '#' || source) AS file, source, coalesce(label, source) AS label, coalesce(type, 'unknown') AS type, coalesce(edge_labels, '') AS edge_labels, edge_types FROM c LEFT JOIN f ON f.id = source)
SELECT *, count(*) OVER (PARTITION BY id, file) AS callers FROM u"""
)
def usage_list(spark, sf):
    """Every caller with its edges' labels and types."""
    file = F.when(F.col("type") == "order", F.concat(F.lit("f"), (F.col("ord") % 10).cast("string")))
    label = F.when(F.col("ord") % 3 > 0, F.concat(F.lit("k"), (F.col("ord") % 3).cast("string"))).otherwise("")
    return O.usage_list(wide_nodes(spark, sf, coded=True).withColumn("file", file), wide_edges(spark, sf, coded=True).withColumn("label", label), named=name)


@query(
    G
    + """, u AS (SELECT *, CASE WHEN type = 'nation' THEN '/API/' || label END AS uri FROM nodes)
SELECT 'id' AS asked, id FROM u WHERE id = 'nation::3' UNION ALL (SELECT 'label', id FROM u WHERE lower(label) = 'nation_7' ORDER BY ord LIMIT 1) UNION ALL (SELECT 'uri', id FROM u WHERE lower(uri) = '/api/nation_5' ORDER BY ord LIMIT 1)"""
)
def focal_lookup(spark, sf):
    n = nodes(spark, sf).withColumn("uri", F.when(F.col("type") == "nation", F.concat(F.lit("/API/"), "label")))
    asked = {"id": ("nation::3", "Nation_7"), "label": ("gone", "Nation_7"), "uri": (None, "/api/NATION_5"), "none": ("gone", None)}
    each = [O.focal(n, *key).select(F.lit(name).alias("asked"), "id") for name, key in asked.items()]
    return reduce(lambda a, b: a.union(b), each)


@query(
    _seeded("type IN ('region', 'nation')", SKIPPED)
    + """, f AS (SELECT id, CASE WHEN type = 'region' AND ord % 2 = 1 THEN 'high' WHEN type = 'nation' AND ord % 3 = 0 THEN 'medium' WHEN type = 'nation' AND ord % 3 = 1 THEN 'low' WHEN type = 'part' AND ord % 7 = 0 THEN 'critical' END AS severity, type IN ('order', 'part') AND ord % 11 = 0 AS smell FROM nodes)
SELECT tab_id, count(severity) FILTER (WHERE tab_id = id) AS security, coalesce(max(severity) FILTER (WHERE tab_id = id), 'none') AS worst,
 count(*) FILTER (WHERE smell) AS smells, count(severity) FILTER (WHERE tab_id = id) + count(*) FILTER (WHERE smell) AS total FROM reach JOIN f USING (id) GROUP BY 1"""
)
def tab_rollup(spark, sf):
    """Regions and nations as tabs; findings of what lies below their entry do not count."""
    kind, ord = F.col("type"), F.col("ord")
    severity = F.when((kind == "region") & (ord % 2 == 1), "high").when((kind == "nation") & (ord % 3 == 0), "medium").when((kind == "nation") & (ord % 3 == 1), "low").when((kind == "part") & (ord % 7 == 0), "critical")
    n = nodes(spark, sf)
    facts = n.withColumn("severity", severity).withColumn("smell", kind.isin("order", "part") & (ord % 11 == 0))
    seeds = n.where("type in ('region', 'nation')").select(F.col("id").alias("tab_id"), "id")
    return O.tab_rollup(C.tab_closure(edges(spark, sf), seeds, SKIP), seeds, facts)


@query(G + " SELECT id, CASE type WHEN 'region' THEN 0 WHEN 'nation' THEN 2 WHEN 'customer' THEN 2 WHEN 'order' THEN 7 WHEN 'part' THEN 99 ELSE 10 END AS type_rank FROM nodes")
def actor_order(spark, sf):
    """Entities under the names of the actors that they stand for."""
    names = {"region": "route", "nation": "controller", "customer": "action", "order": "model", "supplier": "command"}
    return O.actor_order(nodes(spark, sf).withColumn("type", X.lookup(F.col("type"), names, "unknown"))).select("id", "type_rank")


@query(
    G
    + """, tabs AS (SELECT id, label || ':' || k AS label, ord * 2 + k AS ord FROM nodes CROSS JOIN (VALUES (0), (1)) v(k))
SELECT 'node' AS kind, id, max_by(label, ord) AS label FROM tabs GROUP BY 2 UNION ALL SELECT 'edge', source || '|' || target || '|' || type, type FROM edges"""
)
def merge_tabs(spark, sf):
    """Every node stored in two tabs, every edge in two without an id."""
    n, e = nodes(spark, sf), edges(spark, sf)
    tabs = n.select("id", F.concat("label", F.lit(":0")).alias("label"), (F.col("ord") * 2).alias("ord")).union(n.select("id", F.concat("label", F.lit(":1")), F.col("ord") * 2 + 1))
    named = e.withColumn("id", F.lit("")).union(e.withColumn("id", F.lit(None).cast("string")))
    got_n, got_e = O.merge_graphs(tabs, named)
    return got_n.select(F.lit("node").alias("kind"), "id", "label").union(got_e.select(F.lit("edge"), "id", "type"))
