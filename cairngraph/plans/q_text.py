"""Queries of text jobs and audits over documents, pages and the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as U
from ..operators import rules as K
from ..operators import text as T
from ..operators.closure import guard_names
from .base import registrar
from .base import table as _t

QUERIES, ORACLES, query = registrar()


RULES = [("ip", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "low"), ("secret", r"(?:token|password|secret) *= *[^ ]+", "high"), ("license", r"[Ll]icensed under [A-Za-z -]+", "none")]


@query(
    r"""WITH g AS (SELECT doc_id AS file, string_split_regex(text, '[a-z]+\.\n[A-Z][a-z]+') AS gaps, regexp_extract_all(text, '[a-z]+\.\n[A-Z][a-z]+') AS hits FROM documents),
m AS (SELECT file, unnest(range(1, len(hits) + 1)) AS k, unnest(gaps[1:len(hits)]) AS gap, unnest(hits) AS hit FROM g),
spans AS (SELECT file, sum(length(gap) - length(replace(gap, chr(10), ''))) OVER (PARTITION BY file ORDER BY k) + k AS line, hit FROM m),
l AS (SELECT doc_id AS file, unnest(range(1, len(a) + 1)) AS line, unnest(a) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
r(rule, p, severity) AS (VALUES ('ip', '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}', 'low'), ('secret', '(?:token|password|secret) *= *[^ ]+', 'high'), ('license', '[Ll]icensed under [A-Za-z -]+', 'none')),
h AS (SELECT file, line, 'ip' AS rule, 'low' AS severity, unnest(regexp_extract_all(t, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) AS hit FROM l
UNION ALL SELECT file, line, 'secret', 'high', unnest(regexp_extract_all(t, '(?:token|password|secret) *= *[^ ]+')) FROM l
UNION ALL SELECT file, line, 'license', 'none', unnest(regexp_extract_all(t, '[Ll]icensed under [A-Za-z -]+')) FROM l
UNION ALL SELECT file, line, 'ending', 'low', hit FROM spans)
SELECT file, line, rule, severity, CASE WHEN length(hit) > 60 THEN substr(hit, 1, 57) || '...' ELSE hit END AS snippet FROM h"""
)
def rule_scan(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("file"), "text")
    both = T.rule_scan(docs, RULES).union(T.spanning_scan(docs, [("ending", r"[a-z]+\.\n[A-Z][a-z]+", "low")]))
    return both.withColumn("line", F.col("line").cast("long"))


@query("SELECT doc_id, CASE WHEN (toxic = 1 AND contains(lower(coalesce(text, '')), lang)) OR regexp_matches(lower(coalesce(text, '')), 'password|licensed') THEN 'high' ELSE 'medium' END AS severity FROM labels JOIN documents USING (doc_id)")
def finding_severity(spark, sf):
    """Documents as messages; the name of its language is tainted in toxic ones."""
    both = _t(spark, sf, "labels").join(_t(spark, sf, "documents"), "doc_id")
    found = both.select("doc_id", F.col("doc_id").alias("file"), F.coalesce("text", F.lit("")).alias("message"))
    tainted = both.where("toxic = 1").select(F.col("doc_id").alias("file"), F.upper("lang").alias("name"))
    return T.finding_severity(found, tainted, ["password", "licensed"]).select("doc_id", "severity")


@query(
    """WITH k AS (SELECT conv_id, turn, 'v' || conv_id || '.' || turn AS name FROM conversations), n AS (SELECT DISTINCT name FROM k)
SELECT DISTINCT a.name AS parent, b AS child FROM (SELECT name, unnest(['v' || conv_id || '.' || (turn + 1), 'v' || (conv_id + 1) || '.0']) AS b FROM k WHERE turn % 2 = 0) a WHERE b IN (SELECT name FROM n)
UNION SELECT name, 'components.c' || turn % 3 || CASE WHEN turn % 3 = 1 THEN '.index' ELSE '' END FROM k WHERE turn % 2 = 1 AND turn % 3 < 2"""
)
def template_references(spark, sf):
    c = _t(spark, sf, "conversations")
    name = F.concat(F.lit("v"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"))
    nxt = F.concat(F.lit("@include('v"), F.col("conv_id").cast("string"), F.lit("."), (F.col("turn") + 1).cast("string"), F.lit("') @includeWhen($a, 'v"), (F.col("conv_id") + 1).cast("string"), F.lit(".0') @include('pkg::x') @include('a$b')"))
    tag = F.concat(F.lit("<x-c"), (F.col("turn") % 3).cast("string"), F.lit(" a=1>"))
    sources = c.select(name.alias("name"), F.when(F.col("turn") % 2 == 0, nxt).otherwise(tag).alias("text"))
    comps = spark.createDataFrame([("components.c0",), ("components.c0.index",), ("components.c1.index",)], "name string")
    return T.template_refs(sources, sources.select("name").union(comps))


@query(r"""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS href FROM pages""")
def page_refs(spark, sf):
    return T.page_refs(_t(spark, sf, "pages"))


@query("SELECT doc_id FROM documents WHERE contains(text, 'token') OR contains(text, 'Licensed')")
def prefilter(spark, sf):
    return T.prefilter(_t(spark, sf, "documents"), ["token", "Licensed"]).select("doc_id")


@query(
    """WITH n AS (SELECT DISTINCT t AS name, item_id % 20 AS file FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]{3,}')) AS t FROM benchmark) WHERE length(t) > 8),
d AS (SELECT DISTINCT doc_id AS file, unnest(regexp_extract_all(text, '[A-Za-z0-9_]{3,}')) AS name FROM documents)
SELECT DISTINCT d.name, d.file FROM d JOIN n USING (name) WHERE n.file <> d.file"""
)
def name_mentions(spark, sf):
    b = _t(spark, sf, "benchmark").select((F.col("item_id") % 20).alias("file"), F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9_]{3,})"), F.lit(1))).alias("name")).where(F.length("name") > 8).distinct()
    return T.name_mentions(_t(spark, sf, "documents").select(F.col("doc_id").alias("file"), "text"), b)


@query(r"SELECT page_id, starts_with(p, '/en/') OR p = '/en' OR regexp_matches(p, '(?is)^(?:.*7)$') AS inside FROM (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS p FROM pages)")
def under_roots(spark, sf):
    pages = _t(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1).alias("path"))
    return T.under_roots(pages, ["/en"], ["*7"]).select("page_id", "inside")


def _routes(spark, sf):
    """A route per customer: verb by key, address by segment, guards by nation."""
    k = F.col("c_custkey")
    verb = F.get(F.array(*[F.lit(v) for v in ("GET", "POST", "PUT", "DELETE")]), (k % 4).cast("int"))
    uri = F.concat(F.lit("/"), F.lower("c_mktsegment"), F.lit("/"), k.cast("string"))
    return _t(spark, sf, "customer").select(k.alias("route"), verb.alias("method"), uri.alias("uri"), F.col("c_name").alias("name"), (k % 9 == 0).alias("throttled_in_code"), "c_nationkey")


def _guards(spark, sf):
    """Guard names as written, resolved and expanded through groups and aliases."""
    n = F.col("c_nationkey") % 7
    written = F.when(n == 0, "web").when(n == 1, "staff").when(n == 2, "guest:x").when(n == 3, "web:tenant").when(n == 4, "club").when(n == 5, "loop")
    names = _routes(spark, sf).select(F.col("route").alias("owner"), F.lit(0).alias("pos"), written.alias("name")).where("name is not null")
    groups = [("staff", 0, "web"), ("staff", 1, "can:manage"), ("web", 0, "AUTH:api"), ("web", 1, "throttle:60,1"), ("web", 2, "web"), ("club", 0, "member:gold"), ("loop", 0, "loop")]
    aliases = [("guest", "Framework\\Guest"), ("member", "App\\Members")]
    return guard_names(names, spark.createDataFrame(groups, "group string, pos int, member string"), spark.createDataFrame(aliases, "alias string, target string")).select(F.col("owner").alias("route"), F.col("name").alias("guard"))


def _exposure(spark, sf):
    """A guard of its own class counts as authed because of what the class extends."""
    parents = spark.createDataFrame([("App\\Members", "App\\Base"), ("App\\Base", "Framework\\Authenticate"), ("A", "B"), ("B", "A")], "child string, parent string")
    bases = spark.createDataFrame([("Framework\\Authenticate",)], "id string")
    return U.exposure(_guards(spark, sf), _routes(spark, sf), PATTERNS, parents, bases)


ROUTES = "r AS (SELECT c_custkey AS route, ['GET','POST','PUT','DELETE'][c_custkey % 4 + 1] AS method, '/' || lower(c_mktsegment) || '/' || c_custkey AS uri, c_name AS name, c_custkey % 9 = 0 AS throttled, c_nationkey % 7 AS g FROM customer), x AS (SELECT *, CASE g WHEN 0 THEN 'authed' WHEN 1 THEN 'admin' WHEN 2 THEN 'guest' WHEN 4 THEN 'authed' ELSE 'public' END AS exposure FROM r)"
PATTERNS = {"guest": ["Other\\Guest"], "authed": ["auth"], "admin": ["can:"]}


@query("WITH " + ROUTES + " SELECT route, exposure FROM x")
def exposure(spark, sf):
    return _exposure(spark, sf)


@query("WITH " + ROUTES + " SELECT route, 'high' AS severity FROM x WHERE method IN ('POST', 'PUT') AND regexp_matches(uri, 'machinery|building') AND NOT throttled AND g > 1")
def missing_throttle(spark, sf):
    return U.missing_throttle(_routes(spark, sf), _guards(spark, sf), ["machinery", "building"])


@query("WITH " + ROUTES + " SELECT route, CASE method WHEN 'DELETE' THEN 'high' ELSE 'medium' END AS severity FROM x WHERE method <> 'GET' AND exposure = 'public' AND NOT regexp_matches(uri, '^/(?:furniture|building)/') AND name NOT LIKE '%7'")
def public_write(spark, sf):
    return U.public_write(_routes(spark, sf), _exposure(spark, sf), ["FURNITURE/*", "/building/*"], ["customer#*7"])


@query("WITH " + ROUTES + ", s AS (SELECT route, method, uri, nullif(exposure, 'guest') AS exposure, CASE WHEN method = 'DELETE' THEN 'high' WHEN method = 'GET' AND exposure <> 'admin' THEN 'low' END AS risk FROM x) SELECT 'admin' AS asked, route, method, exposure, coalesce(risk, 'none') AS risk FROM s WHERE exposure = 'admin' AND contains(uri, 'auto') UNION ALL SELECT 'high', route, method, coalesce(exposure, 'unknown'), risk FROM s WHERE risk = 'high'")
def route_filter(spark, sf):
    """Asked for admin routes of an address and for those of high risk; guests' exposure and some risks are not stored."""
    risk = F.when(F.col("method") == "DELETE", "high").when((F.col("method") == "GET") & (F.col("exposure") != "admin"), "low")
    r = _routes(spark, sf).join(_exposure(spark, sf), "route").withColumn("risk_level", risk).withColumn("exposure", F.nullif("exposure", F.lit("guest")))
    n = r.select(F.col("route").alias("id"), F.lit("route").alias("type"), "method", "uri", "name", "exposure", "risk_level")
    asked = lambda name, **by: U.route_filter(n, **by).select(F.lit(name).alias("asked"), F.col("id").alias("route"), "method", "exposure", F.col("risk_level").alias("risk"))
    return asked("admin", exposure="admin", contains="auto").union(asked("high", risk="high"))


@query("SELECT 't' || p_partkey AS \"table\", 'fk' AS foreign_key FROM part WHERE p_size % 4 > 0")
def fk_index(spark, sf):
    """Indexes that lead with the key, that turn it round, that are too short, and a key without columns."""
    cols = lambda *c: F.array(*[F.lit(x) for x in c])
    n = F.col("p_size") % 4
    index = F.when(n == 1, cols("b", "a")).when(n == 2, cols("a")).otherwise(cols("a", "b", "c"))
    key = F.when(n == 3, F.array().cast("array<string>")).otherwise(cols("a", "b"))
    schemas = _t(spark, sf, "part").select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("table"), F.array(F.struct(index.alias("columns"))).alias("indexes"), F.array(F.struct(F.lit("fk").alias("name"), key.alias("columns"))).alias("foreign_keys"))
    return U.fk_index(schemas)


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 > 0 AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def missing_alias(spark, sf):
    models = _t(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("fqcn"), (F.col("s_suppkey") % 4 == 0).alias("abstract"))
    return U.missing_alias(models, _t(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("fqcn"))).select("s_suppkey")


@query(
    """SELECT 'orders-customer' AS relation, count(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'lineitem-part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)
UNION ALL SELECT 'nation-region', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)"""
)
def fk_orphans(spark, sf):
    t = lambda n: _t(spark, sf, n)
    return U.fk_orphans(
        [
            ("orders-customer", t("orders"), "o_custkey", t("customer").where("c_acctbal > 0"), "c_custkey"),
            ("lineitem-part", t("lineitem"), "l_partkey", t("part").where("p_size < 40"), "p_partkey"),
            ("nation-region", t("nation"), "n_regionkey", t("region"), "r_regionkey"),
        ]
    )


@query("SELECT DISTINCT o_custkey AS caller, o_orderpriority AS callee FROM orders WHERE o_orderstatus = 'P'")
def unresolved(spark, sf):
    return U.unresolved(_t(spark, sf, "orders").select(F.col("o_custkey").alias("caller"), F.col("o_orderpriority").alias("callee"), (F.col("o_orderstatus") != "P").alias("resolved")))


PATHS = "SELECT DISTINCT 'app/' || p_brand || '/' || p_type || '/' || p_name || '.php' AS value FROM part"
GLOBS = "SELECT s_suppkey AS rule_id, s_nationkey AS n, CASE s_suppkey % 5 WHEN 0 THEN 'APP/Brand#' || s_nationkey || '/*' WHEN 1 THEN '*' || chr(97 + s_nationkey) || '?lt.p*' WHEN 2 THEN '*/SMALL/*' || chr(97 + s_nationkey) || '*' WHEN 3 THEN repeat('?', 25 + s_nationkey) ELSE repeat('?', 30 + s_nationkey) || '*' END AS pattern FROM supplier"


def _globs(spark, sf):
    k, n = F.col("s_suppkey") % 5, F.col("s_nationkey")
    text, letter = n.cast("string"), F.char(n + 97)
    pattern = F.when(k == 0, F.concat(F.lit("APP/Brand#"), text, F.lit("/*"))).when(k == 1, F.concat(F.lit("*"), letter, F.lit("?lt.p*"))).when(k == 2, F.concat(F.lit("*/SMALL/*"), letter, F.lit("*")))
    pattern = pattern.when(k == 3, F.repeat(F.lit("?"), n + 25)).otherwise(F.concat(F.repeat(F.lit("?"), n + 30), F.lit("*")))
    return _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("rule_id"), pattern.alias("pattern"), F.concat(F.lit("n"), text).alias("label"))


def _paths(spark, sf):
    return _t(spark, sf, "part").select(F.concat(F.lit("app/"), "p_brand", F.lit("/"), "p_type", F.lit("/"), "p_name", F.lit(".php")).alias("value"))


GLOB_HITS = f"p AS ({PATHS}), g AS ({GLOBS}), hits AS (SELECT value, rule_id, n FROM p JOIN g ON lower(value) LIKE replace(replace(lower(pattern), '*', '%'), '?', '_'))"


@query(f"WITH {GLOB_HITS} SELECT value, rule_id FROM hits")
def glob_rules(spark, sf):
    """Suppliers as globs, of all kinds of anchors, against parts as paths."""
    return K.match_globs(_paths(spark, sf), _globs(spark, sf))


@query(f"WITH {GLOB_HITS}, best AS (SELECT value, arg_min(n, rule_id) AS n FROM hits GROUP BY value) SELECT value, coalesce('n' || n, 'none') AS label FROM p LEFT JOIN best USING (value)")
def first_rule(spark, sf):
    return K.first_rule(_paths(spark, sf), _globs(spark, sf), "none")


@query(
    r"""WITH g AS (SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN 'App\Http\' || c_mktsegment || ':' || c_nationkey || ':x' WHEN 1 THEN c_mktsegment || ':' || c_nationkey ELSE 'Lib\' || c_mktsegment END AS name FROM customer),
r AS (SELECT n_nationkey AS rule_id, lower(CASE n_nationkey % 4 WHEN 0 THEN 'building:' WHEN 1 THEN 'MACHINERY:' || n_nationkey WHEN 2 THEN 'Any\Furniture' ELSE 'app\http' END) AS p FROM nation),
x AS (SELECT name, rule_id, lower(name) AS l, p, regexp_extract(split_part(lower(name), ':', 1), '[^\\]*$') AS b, regexp_extract(split_part(p, ':', 1), '[^\\]*$') AS pb FROM g, r)
SELECT name, rule_id FROM x WHERE CASE WHEN p LIKE '%:' THEN starts_with(l, p) OR l = rtrim(p, ':') ELSE l = p OR starts_with(l, p || ':') OR starts_with(l, p || '\') OR (contains(p, '\') AND b <> '' AND b = pb) END"""
)
def guard_rules(spark, sf):
    """Nations as patterns of guards, against customers' segments as guards."""
    k, n = F.col("c_custkey") % 3, F.col("c_nationkey").cast("string")
    name = F.when(k == 0, F.concat(F.lit("App\\Http\\"), "c_mktsegment", F.lit(":"), n, F.lit(":x"))).when(k == 1, F.concat("c_mktsegment", F.lit(":"), n)).otherwise(F.concat(F.lit("Lib\\"), "c_mktsegment"))
    r, m = F.col("n_nationkey") % 4, F.col("n_nationkey").cast("string")
    pattern = F.when(r == 0, "building:").when(r == 1, F.concat(F.lit("MACHINERY:"), m)).when(r == 2, "Any\\Furniture").otherwise("app\\http")
    return K.match_guards(_t(spark, sf, "customer").select(name.alias("name")), _t(spark, sf, "nation").select(F.col("n_nationkey").alias("rule_id"), pattern.alias("pattern")))


@query(
    r"""WITH r AS (SELECT 'r' || item_id AS rule, '(?:^|[^A-Za-z0-9_])' || w || '[.,]?\s+[A-Za-z]+' AS p FROM (SELECT item_id, regexp_extract(text, '[A-Za-z]{3,}') AS w FROM benchmark) WHERE w <> ''),
c AS (SELECT doc_id AS file, rule, string_split_regex(text, p) AS gaps, regexp_extract_all(text, p) AS hits FROM documents, r WHERE regexp_matches(text, p)),
m AS (SELECT file, rule, unnest(range(1, len(hits) + 1)) AS k, unnest(gaps[1:len(hits)]) AS gap, unnest(hits) AS hit FROM c),
n AS (SELECT *, length(gap) - length(replace(gap, chr(10), '')) AS before, length(hit) - length(replace(hit, chr(10), '')) AS own FROM m)
SELECT file, rule, CAST(1 + sum(before + own) OVER (PARTITION BY file, rule ORDER BY k) - own AS BIGINT) AS line, CASE WHEN length(hit) > 60 THEN substr(hit, 1, 57) || '...' ELSE hit END AS snippet FROM n"""
)
def text_rules(spark, sf):
    """A rule for each benchmark item, its first word and the one behind it, in all documents."""
    word = F.regexp_extract("text", "[A-Za-z]{3,}", 0)
    regex = F.concat(F.lit(r"(?:^|\W)"), word, F.lit(r"[.,]?\s+[A-Za-z]+"))
    items = _t(spark, sf, "benchmark").where(word != "")
    made = items.select(F.concat(F.lit("r"), F.col("item_id").cast("string")).alias("rule"), word.alias("anchor"), regex.alias("regex"), F.lit("low").alias("severity"), F.lit(True).alias("cased"))
    found = K.scan_table(_t(spark, sf, "documents").select(F.col("doc_id").alias("file"), "text"), made)
    return found.select("file", "rule", F.col("line").cast("long").alias("line"), "snippet")
