"""Queries of the assembling and rewiring joins over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lineage import stored
from ..operators import rewire as R
from .base import registrar
from .base import table as _t
from .g1 import URGENT, G, code, edges, name, mentions, nodes, urgent, wide_edges, wide_nodes

QUERIES, ORACLES, query = registrar()


def _pre(p, c):
    return F.concat(F.lit(p), F.col(c).cast("string"))


@query("SELECT c_custkey, coalesce(r.n_name, 'k' || c_nationkey) || CASE WHEN c_custkey % 2 = 0 THEN ':' || c_mktsegment || ':x' ELSE '' END AS resolved FROM customer LEFT JOIN nation r ON c_nationkey = n_nationkey AND n_nationkey % 3 > 0")
def alias_resolve(spark, sf):
    tail = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(":"), "c_mktsegment", F.lit(":x"))).otherwise("")
    names = _t(spark, sf, "customer").select("c_custkey", F.concat(_pre("k", "c_nationkey"), tail).alias("name"))
    aliases = _t(spark, sf, "nation").where("n_nationkey % 3 > 0").select(_pre("k", "n_nationkey").alias("alias"), F.col("n_name").alias("target"))
    return R.resolve_alias(names, aliases).select("c_custkey", "resolved")


@query(
    """WITH b AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS provider, 'p' || (l_partkey - l_partkey % 3) AS concrete FROM lineitem WHERE l_partkey % 2 = 0 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20))
SELECT DISTINCT a AS source, provider AS target, 'bound-in' AS type FROM b UNION SELECT DISTINCT a, concrete, 'bound-to' FROM b WHERE a <> concrete"""
)
def rewire_bindings(spark, sf):
    li = _t(spark, sf, "lineitem")
    calls = li.select(_pre("o", "l_orderkey").alias("caller"), _pre("p", "l_partkey").alias("callee"))
    kind = F.when(F.col("p_size") < 20, F.when(F.col("p_size") < 10, "interface").otherwise("abstract")).otherwise("class")
    classes = _t(spark, sf, "part").select(_pre("p", "p_partkey").alias("fqcn"), kind.alias("kind"))
    base = (F.col("l_partkey") - F.col("l_partkey") % 3).cast("string")
    bindings = li.where("l_partkey % 2 = 0").select(_pre("p", "l_partkey").alias("abstract"), _pre("s", "l_suppkey").alias("provider"), F.concat(F.lit("p"), base).alias("concrete"))
    return R.rewire_bindings(calls, classes, bindings)


@query("SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 'own' END, n.n_name) AS concrete FROM supplier LEFT JOIN nation n ON n_nationkey = s_nationkey AND n_nationkey < 15")
def resolve_facades(spark, sf):
    own = F.when(F.col("s_suppkey") % 3 == 0, "own")
    facades = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("facade"), F.col("s_nationkey").alias("accessor"), own.alias("concrete"))
    bindings = _t(spark, sf, "nation").where("n_nationkey < 15").select(F.col("n_nationkey").alias("abstract"), F.col("n_name").alias("concrete"))
    return R.resolve_facades(facades, bindings).select(F.col("facade").alias("s_suppkey"), "concrete")


@query(
    """WITH s AS (SELECT c_custkey AS key, c_custkey * 10 AS value, 0 AS rank FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT o_custkey, max(o_orderkey), 1 FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, CAST(c_nationkey AS BIGINT), 2 FROM customer UNION ALL SELECT -1, 7, 0)
SELECT key, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, value) AS k FROM s WHERE value <> key) WHERE k = 1"""
)
def priority_resolve(spark, sf):
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders")
    explicit = c.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") * 10).alias("value")).union(spark.range(1).select(F.lit(-1), F.lit(7)))
    attribute = o.groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderkey").alias("value"))
    convention = c.select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("value"))
    return R.priority_resolve(c.select(F.col("c_custkey").alias("key")), explicit, attribute, convention)


@query(
    r"""WITH t AS (SELECT page_id, coalesce(nullif(regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1), ''), 'x') AS lang FROM pages),
r AS (SELECT lang, min(page_id) AS first_id FROM t WHERE page_id % 2 = 0 GROUP BY 1)
SELECT page_id, first_id FROM t JOIN r USING (lang) WHERE page_id % 3 > 0"""
)
def template_match(spark, sf):
    """A placeholder stands for a placeholder: those inside a segment are literal and find no partner here."""
    lang = F.coalesce(F.nullif(F.regexp_extract("url", "^https?://[^/]+/([a-z]+)", 1), F.lit("")), F.lit("x"))
    p = _t(spark, sf, "pages").select("page_id", lang.alias("lang"))
    name = lambda before: F.concat("lang", F.lit(before), F.col("page_id").cast("string"), F.lit("}"))
    left = p.select(F.when(F.col("page_id") % 3 == 0, name(".p{p")).otherwise(name(".{p")).alias("template"))
    right = p.where("page_id % 2 = 0").select(name(".{q").alias("template"), F.col("page_id").alias("ord"))
    number = lambda c: F.regexp_extract(c, "([0-9]+)", 1).cast("long")
    return R.template_match(left, right).select(number("left").alias("page_id"), number("right").alias("first_id"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN c_name END, 'any' || (o_custkey % 7)) AS linked FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 = 0 OR o_custkey % 7 < 4 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE NOT (o_orderkey % 3 = 0 OR o_custkey % 7 < 4)")
def two_key_link(spark, sf):
    left = _t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("a"), (F.col("o_custkey") % 7).alias("b"))
    by_class = _t(spark, sf, "customer").select(F.col("c_custkey").alias("a"), F.lit(None).cast("long").alias("b"), F.col("c_name").alias("linked"))
    by_name = spark.range(4).select(F.lit(None).cast("long"), F.col("id"), _pre("any", "id"))
    return R.two_key_link(left, by_class.union(by_name), "a", "b", "linked").select("o_orderkey", "linked")


@query("SELECT DISTINCT 'o' || l_orderkey AS source, l_suppkey AS target FROM lineitem WHERE l_suppkey % 4 = 0")
def provides_edges(spark, sf):
    li = _t(spark, sf, "lineitem")
    providers = li.groupBy(F.col("l_suppkey").alias("fqcn")).agg(F.collect_set("l_orderkey").alias("provides")).withColumn("deferred", F.col("fqcn") % 4 == 0)
    n = li.select(F.col("l_orderkey").alias("fqcn"), _pre("o", "l_orderkey").alias("id")).distinct()
    return R.provides_edges(providers, n)


@query(
    r"""WITH s AS (SELECT s_suppkey, 'A\S' || s_suppkey AS f, s_suppkey % 5 AS m, s_nationkey FROM supplier),
e AS (SELECT f AS source, CASE m WHEN 0 THEN 'A\S' || (s_suppkey - 1) WHEN 1 THEN CASE WHEN s_suppkey + 1 IN (SELECT s_suppkey FROM s) THEN 'A\S' || (s_suppkey + 1) ELSE 's' || (s_suppkey + 1) END WHEN 2 THEN 'X\Lost' WHEN 3 THEN f ELSE 'X\S' || s_suppkey END AS target, 'has' AS type FROM s),
t AS (SELECT n_nationkey AS k, n_regionkey AS rows FROM nation WHERE n_nationkey % 2 = 0), c AS (SELECT n_nationkey AS k, n_name FROM nation WHERE n_nationkey % 3 = 0)
SELECT DISTINCT source, target, type, s.f IS NULL AS external, t.rows, c.n_name AS shape FROM e LEFT JOIN s ON s.f = target LEFT JOIN t ON t.k = s.s_nationkey LEFT JOIN c ON c.k = s.s_nationkey"""
)
def erd_edges(spark, sf):
    """Suppliers as entities of their nation's table: related by full name, bare name, unknown names, themselves, another namespace."""
    k, m = F.col("s_suppkey"), F.col("s_suppkey") % 5
    name = lambda n, space="A\\S": F.concat(F.lit(space), n.cast("string"))
    related = F.when(m == 0, name(k - 1)).when(m == 1, name(k + 1, "s")).when(m == 2, F.lit("\\X\\Lost")).when(m == 3, name(k)).otherwise(name(k, "X\\S"))
    models = _t(spark, sf, "supplier").select(name(k).alias("fqcn"), F.col("s_nationkey").alias("table"), F.array(F.struct(F.lit("has").alias("type"), related.alias("related"))).alias("relationships"))
    n = _t(spark, sf, "nation")
    stats = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("table"), F.col("n_regionkey").alias("rows"))
    schemas = n.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("table"), F.col("n_name").alias("shape"))
    ids, e = R.er_graph(models, stats, schemas)
    return e.join(ids.withColumnRenamed("id", "target"), "target").select("source", "target", "type", "external", "stats.rows", "schema.shape")


@query("SELECT p_partkey, CAST(n AS BIGINT) AS n_lines, last_ship FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1 HAVING count(*) < 30) ON l_partkey = p_partkey")
def stamp_stats(spark, sf):
    """Parts with the figures of those that fewer than 30 line items name."""
    facts = _t(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n_lines"), F.max("l_shipdate").alias("last_ship")).where("n_lines < 30")
    return R.stamp(_t(spark, sf, "part").select("p_partkey"), facts, "p_partkey", ["n_lines", "last_ship"])


@query(
    """WITH f AS (SELECT doc_id, doc_id % 50 AS file, CASE WHEN doc_id % 5 > 0 THEN doc_id % 90 END AS line FROM documents), s AS (SELECT file, file * 10 + k AS id, k * 30 AS first, k * 30 + 29 AS last FROM (SELECT DISTINCT doc_id % 50 AS file FROM documents) CROSS JOIN (VALUES (0), (1), (2)) v(k))
SELECT f.doc_id, s.id FROM f JOIN s USING (file) WHERE line IS NULL OR line BETWEEN first AND last"""
)
def range_findings(spark, sf):
    d = _t(spark, sf, "documents")
    findings = d.select("doc_id", (F.col("doc_id") % 50).alias("file"), F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 90).alias("line"))
    spans = findings.select("file").distinct().select("file", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k"))
    spans = spans.select("file", (F.col("file") * 10 + F.col("k")).alias("id"), (F.col("k") * 30).alias("first"), (F.col("k") * 30 + 29).alias("last"))
    return R.range_findings(findings, spans).select("doc_id", "id")


@query(
    G.replace("WITH RECURSIVE", "WITH", 1)
    + ", "
    + URGENT
    + """, reached AS (SELECT DISTINCT target AS id FROM edges WHERE source IN (SELECT id FROM urgent)), u AS (SELECT 'part::' || p_partkey AS id, 'f' || p_partkey % 5 AS file, p_partkey AS k FROM part WHERE 'part::' || p_partkey NOT IN (SELECT id FROM reached)),
li AS (SELECT DISTINCT 'part::' || l_partkey AS id, l_returnflag AS f, l_linestatus AS s, 'f' || l_suppkey % 5 AS file FROM lineitem)
SELECT id, file, concat_ws(',', CASE WHEN k % 4 = 0 THEN 'facade' WHEN k % 3 = 0 THEN 'bound' END, CASE WHEN EXISTS (SELECT 1 FROM li WHERE li.id = u.id AND f = 'A' AND li.file <> u.file) THEN 'configured' END,
 CASE WHEN 'part::' || (k + 1) IN (SELECT id FROM reached) OR ('part::' || (k + 2) IN (SELECT id FROM reached)) THEN 'inherited' END, CASE WHEN EXISTS (SELECT 1 FROM li WHERE li.id = u.id AND s = 'O' AND li.file <> u.file) THEN 'mentioned' END) AS evidence FROM u"""
)
def unreached_evidence(spark, sf):
    """Parts in no urgent open order; a part extends the one before it and implements the one before that."""
    file = lambda c: F.concat(F.lit("f"), (F.col(c) % 5).cast("string")).alias("file")
    part = _t(spark, sf, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") - 1).alias("before"), (F.col("p_partkey") - 2).alias("earlier"), file("p_partkey"))
    part = part.withColumn("id", code("part", "k"))
    entry = urgent(spark, sf, coded=True).withColumnRenamed("id", "source").hint("shuffle_hash")  # the edges, far more, pass it unsorted
    reached = stored(edges(spark, sf, coded=True).join(entry, "source", "left_semi").select(F.col("target").alias("id")).distinct())
    unreached = stored(part.join(reached, "id", "left_anti").select("id", "file"))
    classes = part.select("id", code("part", "before").alias("parent"), F.array(code("part", "earlier")).alias("interfaces"), F.array().cast("array<long>").alias("traits"))
    li = _t(spark, sf, "lineitem").select(code("part", "l_partkey").alias("id"), "l_returnflag", "l_linestatus", file("l_suppkey"))
    got = R.evidence(unreached, bound=part.where("k % 3 = 0"), facades=part.where("k % 4 = 0"), inherited=R.inherited(classes, reached), configured=li.where("l_returnflag = 'A'"), mentioned=li.where("l_linestatus = 'O'"))
    return got.select(name("id").alias("id"), "file", F.array_join("evidence", ",").alias("evidence"))


@query("SELECT o_orderkey AS key, CASE WHEN o_custkey % 3 = 0 THEN 'c' || o_custkey ELSE 'n' || o_custkey % 30 END AS id FROM orders WHERE o_custkey % 3 = 0 OR o_custkey % 30 IN (SELECT n_nationkey FROM nation)")
def first_existing(spark, sf):
    ids = F.array(F.lit("none"), _pre("c", "o_custkey"), F.concat(F.lit("n"), (F.col("o_custkey") % 30).cast("string")))
    cands = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), ids.alias("ids"))
    have = _t(spark, sf, "customer").where("c_custkey % 3 = 0").select(_pre("c", "c_custkey").alias("id")).union(_t(spark, sf, "nation").select(_pre("n", "n_nationkey")))
    return R.first_existing(cands, have)


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS invoked FROM documents")
def invoked_members(spark, sf):
    members = _t(spark, sf, "documents").select(F.lit("document").alias("class"), F.col("doc_id").cast("string").alias("member"))
    return R.invoked(members, wide_edges(spark, sf)).select(F.col("member").cast("long").alias("doc_id"), "invoked")


@query("SELECT 'n::' || role AS id, conv_id AS region, CASE WHEN conv_id % 2 = 0 THEN 'chain' ELSE 'batch' END AS kind, CASE WHEN conv_id % 2 = 0 THEN min(turn) END AS pos FROM conversations GROUP BY role, conv_id")
def group_regions(spark, sf):
    c = _t(spark, sf, "conversations")
    kind = F.when(F.col("conv_id") % 2 == 0, "chain").otherwise("batch")
    groups = c.select(F.col("conv_id").alias("id"), kind.alias("kind"), F.col("turn").alias("pos"), F.col("role").alias("job"))
    n = c.select(F.col("role").alias("fqcn"), F.concat(F.lit("n::"), "role").alias("id")).distinct()
    return R.group_regions(groups, n)


@query(
    """WITH e AS (SELECT 'e' || event_id % 200 AS id, user_id AS span, event_type = 'error' AS r FROM events WHERE event_type IN ('purchase', 'error')), o AS (SELECT DISTINCT 'u' || user_id AS id, user_id AS span, false AS r FROM events)
SELECT id, span, CASE WHEN bool_or(r) THEN 'rollback' ELSE 'transaction' END AS kind FROM (SELECT * FROM e UNION ALL SELECT * FROM o) GROUP BY 1, 2"""
)
def span_regions(spark, sf):
    ev = _t(spark, sf, "events")
    calls = ev.select(F.concat(F.lit("e"), (F.col("event_id") % 200).cast("string")).alias("callee"), F.col("user_id").alias("span"), (F.col("event_type") == "purchase").alias("in_transaction"), (F.col("event_type") == "error").alias("in_rollback"))
    return R.span_regions(calls, ev.select(_pre("u", "user_id").alias("id"), F.col("user_id").alias("span")).distinct())


@query(
    """SELECT type, count(*) AS n, count(DISTINCT source) AS sources FROM (SELECT 'c' || o_custkey AS source, 'action-to-' || lower(o_orderstatus) AS type FROM orders UNION ALL SELECT 'e' || l_returnflag, 'event-to-listener' FROM lineitem) GROUP BY 1"""
)
def assemble_edges(spark, sf):
    calls = _t(spark, sf, "orders").select(_pre("c", "o_custkey").alias("caller"), _pre("o", "o_orderkey").alias("callee"), F.lower("o_orderstatus").alias("callee_type"))
    heard = _t(spark, sf, "lineitem").select(_pre("p", "l_partkey").alias("listener"), _pre("e", "l_returnflag").alias("event"))
    return R.assemble_calls(calls, heard)[1].groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query(
    r"""WITH r AS (SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS controller, lower(c_mktsegment) AS action, c_nationkey AS k FROM customer),
m AS (SELECT unnest(['web', 'throttle:60,1', 'App\Session']) AS target)
SELECT DISTINCT id AS source, controller AS target, 'route-to-controller' AS type FROM r UNION SELECT controller, controller || '::' || action, 'controller-to-action' FROM r UNION SELECT id, target, 'route-to-guard' FROM r, m
UNION SELECT id, 'App\Auth:api', 'route-to-guard' FROM r WHERE (k % 3 = 0 OR (k % 3 = 1 AND action = 'building')) AND action <> 'machinery'"""
)
def assemble_routes(spark, sf):
    """A group on every route and a parameterised alias on the controllers, for all, some or no actions."""
    routes = _t(spark, sf, "customer").select(_pre("c", "c_custkey").alias("id"), _pre("n", "c_nationkey").alias("controller"), F.lower("c_mktsegment").alias("action"), F.array(F.lit("web")).alias("middlewares"))
    k = F.col("n_nationkey") % 3
    only = F.when(k == 1, F.array(F.lit("building"))).when(k == 2, F.array().cast("array<string>"))
    guards = _t(spark, sf, "nation").select(_pre("n", "n_nationkey").alias("controller"), F.lit("auth:api").alias("name"), only.alias("only"), F.array(F.lit("machinery")).alias("except"))
    groups = spark.createDataFrame([("web", 0, "throttle:60,1"), ("web", 1, "session"), ("web", 2, "web")], "group string, pos int, member string")
    aliases = spark.createDataFrame([("session", "App\\Session"), ("auth", "App\\Auth")], "alias string, target string")
    return R.assemble_routes(routes, guards, groups, aliases)


@query("SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target, 'supplier-to-part' AS type FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 'f' || l_returnflag, 'part-to-flag' FROM lineitem WHERE l_linestatus = 'O'")
def declared_edges(spark, sf):
    flag = F.when(F.col("l_linestatus") == "O", _pre("f", "l_returnflag"))
    return R.edges_from(_t(spark, sf, "lineitem"), [(_pre("s", "l_suppkey"), _pre("p", "l_partkey"), "supplier-to-part"), (_pre("p", "l_partkey"), flag, "part-to-flag")])


@query("SELECT o_custkey AS fqcn, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS declared FROM orders GROUP BY 1 HAVING o_custkey % 2 = 1")
def unwired(spark, sf):
    agents = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("fqcn")).agg(F.collect_set("o_orderpriority").alias("tools")).withColumn("has_tools", F.when(F.col("fqcn") % 2 == 0, True))
    return R.unwired(agents).select("fqcn", F.array_join("declared", ",").alias("declared"))


@query(G + " SELECT source, target, 'needs' AS type FROM edges WHERE type = 'supplier-to-part' AND target IN (SELECT 'part::' || p_partkey FROM part WHERE p_size < 25) AND (source, target) NOT IN (SELECT 'supplier::' || l_suppkey, 'part::' || l_partkey FROM lineitem WHERE l_quantity >= 40)")
def dependency_edges(spark, sf):
    deps = edges(spark, sf, coded=True).where("type = 'supplier-to-part'")
    classes = _t(spark, sf, "part").where("p_size < 25").select(code("part", "p_partkey").alias("fqcn"))
    old = _t(spark, sf, "lineitem").where("l_quantity >= 40").select(code("supplier", "l_suppkey").alias("source"), code("part", "l_partkey").alias("target"))
    return R.dependency_edges(deps, classes, old, "needs").withColumns({"source": name("source"), "target": name("target")})


@query(
    """SELECT DISTINCT id, kind FROM (SELECT 'brand::' || p_brand AS id, CASE WHEN p_brand LIKE '%1' THEN 'interface' ELSE 'enum' END AS kind FROM part UNION ALL SELECT 'segment::' || c_mktsegment, 'trait' FROM customer UNION ALL SELECT 'priority::' || o_orderpriority, 'class' FROM orders) WHERE kind IN ('enum', 'trait')"""
)
def supplement_nodes(spark, sf):
    """What entities only name: brands as enums or interfaces, segments as traits, priorities as classes; orders are declared, but nodes already."""
    id = F.col("target")
    kind = F.when(id.startswith("brand::") & id.endswith("1"), "interface").when(id.startswith("brand::"), "enum").when(id.startswith("segment::"), "trait").otherwise("class")
    classes = mentions(spark, sf).select(id.alias("fqcn"), kind.alias("kind")).distinct().union(nodes(spark, sf).where("type = 'order'").select("id", F.lit("enum")))
    return R.supplement(wide_edges(spark, sf), classes, wide_nodes(spark, sf))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS filled FROM conversations")
def forward_fill(spark, sf):
    c = _t(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("head"))
    return R.forward_fill(c, ["conv_id"], "turn", "head").select("conv_id", "turn", "filled")
