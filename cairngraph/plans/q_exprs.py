"""Queries of the scalar functions over the star-schema, page, document and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from .base import registrar
from .base import table as _t

PART_RULES = [("BRASS$", "metal"), ("^PROMO", "promotion"), ("POLISHED", "finish")]
EDGE_LABELS = {"region-to-nation": "holds", "nation-to-customer": "serves", "nation-to-supplier": "sources", "customer-to-order": "places", "order-to-part": "contains", "supplier-to-part": "supplies"}


def _path(url="url"):
    return F.coalesce(F.nullif(F.regexp_extract(F.col(url), r"^https?://[^/?#]+([^?#]*)", 1), F.lit("")), F.lit("/"))


PATH_SQL = r"coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/')"
QUERIES, ORACLES, query = registrar()


@query(
    r"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'route::GET::/' || p_name WHEN 1 THEN 'action::App\Http\' || p_name || '::run' WHEN 2 THEN 'view::blade__' || regexp_replace(lower(p_name), '[^a-z0-9._]', '_', 'g')
 WHEN 3 THEN regexp_replace(lower(p_brand), '[^a-z0-9_]', '_', 'g') || '__' || regexp_replace(lower(p_name), '[^a-z0-9_]', '_', 'g') || '::run' ELSE 'action::' || p_name || 'Controller::run' END AS id FROM part"""
)
def node_ids(spark, sf):
    kind, name = F.col("p_partkey") % 5, F.col("p_name")
    named = F.when(kind == 0, F.concat(F.lit("route::GET::/"), name)).when(kind == 1, F.concat(F.lit("App\\Http\\"), name)).when(kind == 2, F.concat(F.lit("blade::"), name)).when(kind == 3, F.concat("p_brand", F.lit("\\_"), name)).otherwise(F.concat(name, F.lit("Controller")))
    return _t(spark, sf, "part").select("p_partkey", X.node_id(named, F.lit("run")).alias("id"))


@query("SELECT page_id, split_part(url, '/', -1) AS short FROM pages")
def short_names(spark, sf):
    return _t(spark, sf, "pages").select("page_id", X.short_name(F.col("url"), "/").alias("short"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'BRASS$') THEN 'metal' WHEN regexp_matches(p_type, '^PROMO') THEN 'promotion' WHEN regexp_matches(p_type, 'POLISHED') THEN 'finish' ELSE 'class' END AS kind FROM part")
def classify_rules(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", X.classify(F.col("p_type"), PART_RULES, "class").alias("kind"))


@query("SELECT page_id, regexp_matches(" + PATH_SQL + r", '(?is)^(?:/en/.*|/de/4.|.*5)$') AS hit FROM pages")
def glob_match(spark, sf):
    return _t(spark, sf, "pages").select("page_id", X.glob_match(_path(), ["/EN/*", "/de/4?", "*5"]).alias("hit"))


@query(
    r"""SELECT page_id, lower(h) = 'fr' OR starts_with(lower(h), 'fr:') OR starts_with(lower(h), 'fr/') OR lower(h) = 'can' OR starts_with(lower(h), 'can:')
      OR lower(h) = 'web/auth' OR starts_with(lower(h), 'web/auth:') OR starts_with(lower(h), 'web/auth/') OR split_part(split_part(lower(h), ':', 1), '/', -1) = 'auth' AS hit
    FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN upper(l) || ':' || page_id WHEN 1 THEN 'app/' || l WHEN 2 THEN 'CAN' WHEN 3 THEN 'can:x' WHEN 4 THEN 'App/Auth:' || l ELSE l || '/auth' END AS h
    FROM (SELECT page_id, split_part("""
    + PATH_SQL
    + ", '/', 2) AS l FROM pages))"
)
def guard_match(spark, sf):
    lang, n = F.coalesce(F.get(F.split(_path(), "/"), 1), F.lit("")), F.col("page_id") % 6
    guard = F.when(n == 0, F.concat(F.upper(lang), F.lit(":"), "page_id")).when(n == 1, F.concat(F.lit("app/"), lang)).when(n == 2, "CAN").when(n == 3, "can:x").when(n == 4, F.concat(F.lit("App/Auth:"), lang)).otherwise(F.concat(lang, F.lit("/auth")))
    return _t(spark, sf, "pages").select("page_id", X.guard_match(guard, ["fr", "Can:", "Web/Auth"], sep="/").alias("hit"))


@query("SELECT doc_id, regexp_matches(lower(coalesce(text, '')), 'token|password|secret') AS sensitive FROM documents")
def sensitive_docs(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", X.contains_any(F.coalesce("text", F.lit("")), ["token", "password", "secret"]).alias("sensitive"))


@query("SELECT tier, count(*) AS n FROM (SELECT CASE WHEN c <= 5 THEN 'low' WHEN c <= 10 THEN 'moderate' WHEN c <= 15 THEN 'high' ELSE 'severe' END AS tier FROM (SELECT l_orderkey, sum(l_linenumber) AS c FROM lineitem GROUP BY 1)) GROUP BY 1")
def tier_histogram(spark, sf):
    cc = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_linenumber").alias("cc"))
    return cc.groupBy(X.tier(F.col("cc")).alias("tier")).agg(F.count("*").alias("n"))


@query("SELECT type, label FROM (VALUES ('region-to-nation','holds'),('nation-to-customer','serves'),('nation-to-supplier','sources'),('customer-to-order','places'),('order-to-part','contains'),('supplier-to-part','supplies')) v(type,label)")
def edge_labels(spark, sf):
    from .g1 import edges

    return edges(spark, sf).select("type").distinct().select("type", X.lookup(F.col("type"), EDGE_LABELS, "uses").alias("label"))


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'invalidate' WHEN 3 THEN 'lock' WHEN 4 THEN 'invalidate' END AS kind FROM events"""
)
def op_kinds(spark, sf):
    method = F.get(F.array(*[F.lit(m) for m in ("rememberForever", "increment", "pull", "restoreLock", "deleteMultiple", "connection")]), (F.col("event_id") % 6).cast("int"))
    return _t(spark, sf, "events").select("event_id", X.op_kind(method).alias("kind"))


@query("SELECT doc_id, f AS cadence FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN lang WHEN doc_id % 4 = 2 THEN trim('daily ' || lang || ', ' || source) ELSE 'weekly' END AS f FROM documents)")
def cadence(spark, sf):
    n = F.col("doc_id") % 4
    f = F.when(n == 0, F.lit(None)).when(n == 1, "cron").when(n == 2, "daily").otherwise("weekly")
    args = F.when(n == 1, F.array("lang")).when(n == 2, F.array("lang", "source")).otherwise(F.array().cast("array<string>"))
    return _t(spark, sf, "documents").select("doc_id", X.cadence(f, args).alias("cadence"))


SLUG_SQL = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"SELECT page_id, CASE WHEN length(s) > 30 THEN substr(s, 1, 30) || '-' || substr(md5(url), 1, 8) ELSE s END AS slug FROM (SELECT page_id, url, {SLUG_SQL.format('url')} AS s FROM pages)")
def slugs(spark, sf):
    return _t(spark, sf, "pages").select("page_id", X.slug(F.col("url"), 30).alias("slug"))


@query(
    r"""SELECT page_id, CASE p % 4 WHEN 0 THEN 'routes.php' WHEN 1 THEN 'v1/' || tail WHEN 2 THEN 'a/routes/' || tail ELSE tail END AS rel FROM (SELECT page_id, page_id AS p, split_part(url, '/', -1) || '.php' AS tail FROM pages)"""
)
def rel_paths(spark, sf):
    p, tail = F.col("page_id") % 4, F.concat(F.substring_index("url", "/", -1), F.lit(".php"))
    path = F.when(p == 0, "").when(p == 1, F.concat(F.lit("C:\\app\\routes\\v1\\"), tail)).when(p == 2, F.concat(F.lit("/app/routes/a/routes/"), tail)).otherwise(F.concat(F.lit("/app/web/"), tail))
    return _t(spark, sf, "pages").select("page_id", X.rel_path(path, "routes", "routes.php").alias("rel"))


@query(
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'order_items' WHEN 1 THEN 'categories' WHEN 2 THEN 'addresses' WHEN 3 THEN 'bus_quizs' WHEN 4 THEN 'h_t_m_l_boxes' ELSE 'day' || p_size || 's' END AS tbl FROM part"""
)
def table_names(spark, sf):
    names = ["App\\Models\\OrderItem", "Category", "App\\Address", "BusQuiz", "HTMLBox"]
    name = F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % 6).cast("int")), F.concat(F.lit("Day"), F.col("p_size").cast("string")))
    return _t(spark, sf, "part").select("p_partkey", X.table_name(name).alias("tbl"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 't' || o_custkey WHEN 1 THEN 'log' WHEN 2 THEN 'a' WHEN 3 THEN 'real' END AS target FROM orders")
def sql_targets(spark, sf):
    n, k = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    sql = F.when(n == 0, F.concat(F.lit("select * from t"), k, F.lit(" where x=1"))).when(n == 1, F.lit("INSERT INTO `log` VALUES (1)")).when(n == 2, F.lit("update a.b set c=1")).when(n == 3, F.lit("select datefrom x, y FROM real")).otherwise(F.lit("begin"))
    return _t(spark, sf, "orders").select("o_orderkey", X.statement_target(sql).alias("target"))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 57) || '...' ELSE text END AS label, CASE WHEN length(source) > 4 THEN substr(source, 1, 3) || '…' ELSE source END AS src FROM documents")
def short_labels(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", X.truncate(F.col("text"), 60, 57, "...").alias("label"), X.truncate(F.col("source"), 4, 3, "…").alias("src"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END, -1) AS k, CASE WHEN event_id % 2 = 1 THEN json_extract_string(props, '$.k') ELSE 'absent' END AS name, 'absent' AS missing FROM events")
def json_fields(spark, sf):
    """Half of the properties carry their number as a text, which is no number."""
    props = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.regexp_replace("props", "([0-9]+)", '"$1"'))
    return _t(spark, sf, "events").select("event_id", X.payload(props, "$.k", "bigint", -1).alias("k"), X.payload(props, "$.k", "string", "absent").alias("name"), X.payload(props, "$.none", "string", "absent").alias("missing"))


@query(
    r"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN '' WHEN 3 THEN '' ELSE regexp_extract(url, '^https?://([^/?#:]+)', 1) END AS host, page_id % 3 = 0 AS asynchronous,
 CASE page_id % 4 WHEN 0 THEN 'config' WHEN 1 THEN 'literal' WHEN 2 THEN 'constructed' ELSE 'dynamic' END AS address FROM pages"""
)
def url_hosts(spark, sf):
    n = F.col("page_id") % 4
    url = F.when(n == 1, F.col("url")).when(n == 2, F.concat("url", F.lit("…"))).otherwise("")
    calls = _t(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, "postAsync").otherwise("post").alias("verb"), url.alias("url"), F.when(n == 0, "config").alias("key_source"))
    return X.call_attrs(calls).select("page_id", "host", "asynchronous", "address")


@query("SELECT DISTINCT t AS edge_type, t IN ('action-to-job', 'model-to-event') AS deferred FROM (SELECT CASE event_type WHEN 'purchase' THEN 'action-to-job' WHEN 'error' THEN 'event-to-listener' WHEN 'view' THEN 'model-to-event' ELSE 'action-to-' || event_type END AS t FROM events)")
def async_edges(spark, sf):
    e = F.col("event_type")
    t = F.when(e == "purchase", "action-to-job").when(e == "error", "event-to-listener").when(e == "view", "model-to-event").otherwise(F.concat(F.lit("action-to-"), e))
    return _t(spark, sf, "events").select(t.alias("edge_type")).distinct().select("edge_type", X.is_async(F.col("edge_type")).alias("deferred"))


@query("SELECT o_custkey, CASE max(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 4 WHEN '2' THEN 3 WHEN '3' THEN 2 WHEN '4' THEN 0 ELSE 1 END) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'none' END AS worst FROM orders GROUP BY 1")
def max_severity(spark, sf):
    level = X.lookup(F.substring("o_orderpriority", 1, 1), {"1": "critical", "2": "HIGH", "3": "medium", "4": "unknown"})
    return _t(spark, sf, "orders").groupBy("o_custkey").agg(X.max_severity(level).alias("worst"))


@query(
    """SELECT bucket, count(*) AS n FROM (SELECT CASE doc_id % 6 WHEN 0 THEN 'Console Commands' WHEN 1 THEN 'Event Choreography' WHEN 2 THEN 'Filament' || coalesce(' · ' || upper(substr(lang, 1, 1)) || substr(lang, 2) || ' Panel', '') WHEN 3 THEN 'Filament' WHEN 4 THEN 'Model ERD' ELSE 'Other' END AS bucket FROM documents) GROUP BY 1"""
)
def tab_buckets(spark, sf):
    n = F.col("doc_id") % 6
    category = F.get(F.array(*[F.lit(c) for c in ("Command", "Events", "Filament", "Filament", "ERD", "Route")]), n.cast("int"))
    return _t(spark, sf, "documents").groupBy(X.tab_bucket(category, F.when(n == 2, F.col("lang"))).alias("bucket")).agg(F.count("*").alias("n"))
