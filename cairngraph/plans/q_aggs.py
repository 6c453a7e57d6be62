"""Queries of aggregations, rankings, run comparisons and snapshot differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import aggs as A
from ..lineage import scratch, stored
from ..operators import diff as D
from .base import registrar
from .base import table as _t
from ..sources import io as S
from .g1 import WIDE, G, edges, name, nodes, wide_edges, wide_nodes

QUERIES, ORACLES, query = registrar()


def _metrics(spark, sf):
    """One method per order: lines are its quantities, complexity its number of items times the largest line number."""
    li = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("lines"), F.sum("l_linenumber").alias("cc"))
    return _t(spark, sf, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("class"), F.col("o_orderkey").alias("method"), "lines", "cc")


METRICS = "m AS (SELECT o_custkey AS class, o_orderkey AS method, lines, cc FROM orders JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS lines, CAST(sum(l_linenumber) AS BIGINT) AS cc FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"


@query("WITH " + METRICS + " SELECT class, CAST(sum(lines) AS BIGINT) AS lines, count(*) AS methods, sum(lines) > 300 OR count(*) > 10 AS fat_class, count(*) FILTER (WHERE lines > 30 OR cc > 10) AS fat_methods FROM m GROUP BY 1")
def fat_flags(spark, sf):
    methods, classes = A.fat_flags(_metrics(spark, sf))
    return classes.join(methods.groupBy("class").agg(F.count_if("fat_method").alias("fat_methods")), "class")


@query("WITH " + METRICS + " SELECT method, CASE o_orderstatus WHEN 'O' THEN 'action' ELSE 'service' END AS type, cc FROM m JOIN orders ON o_orderkey = method WHERE o_orderstatus <> 'P' AND cc > 10")
def complex_items(spark, sf):
    """Open orders as actions, finished ones as services, pending ones as models, which carry no complexity of interest."""
    kind = F.when(F.col("o_orderstatus") == "O", "action").when(F.col("o_orderstatus") == "F", "service").otherwise("model")
    typed = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), kind.alias("type"))
    items = typed.join(_metrics(spark, sf).select(F.col("method").alias("id"), "cc"), "id", "left")
    return A.complex_items(items, above=10).select(F.col("id").alias("method"), "type", "cc")


def _commits(spark, sf):
    newest = F.row_number().over(A.W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return _t(spark, sf, "orders").select(F.col("o_custkey").alias("file"), F.to_date("o_orderdate").alias("commit_date"), F.col("o_orderpriority").alias("author"), newest.alias("ord"))


@query("SELECT o_custkey AS file, count(*) AS commits, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_changed, arg_min(o_orderpriority, (-epoch(o_orderdate), o_orderkey)) AS last_author FROM orders GROUP BY 1")
def churn(spark, sf):
    return A.churn(_commits(spark, sf)).withColumn("last_changed", F.col("last_changed").cast("string"))


@query("WITH " + METRICS + ", c AS (SELECT o_custkey AS file, count(*) AS commits FROM orders GROUP BY 1) SELECT file, complexity, commits, complexity * commits AS risk FROM (SELECT class AS file, max(cc) AS complexity FROM m GROUP BY 1) JOIN c USING (file) ORDER BY risk DESC, file LIMIT 50")
def risk_rank(spark, sf):
    metrics = _metrics(spark, sf).select(F.col("class").alias("file"), "cc")
    return A.risk_rank(metrics, A.churn(_commits(spark, sf)).select("file", "commits"))


@query(WIDE + ", u AS (SELECT id, type AS kind, type IN ('region', 'document') AS blind FROM wnodes WHERE id NOT IN (SELECT target FROM wedges)) SELECT blind, kind, count(*) AS n FROM u GROUP BY 1, 2")
def unreached_by_kind(spark, sf):
    met = wide_edges(spark, sf).select(F.col("target").alias("id")).distinct()
    items = wide_nodes(spark, sf).join(met, "id", "left_anti").select(F.col("type").isin("region", "document").alias("blind"), F.col("type").alias("kind"))
    return A.by_kind(items)


@query("SELECT event_type AS kind, count(*) AS n, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS place FROM events GROUP BY 1")
def entry_by_kind(spark, sf):
    out = A.entry_by_kind(_t(spark, sf, "events").select(F.col("event_type").alias("kind")), ["signup", "view", "click"])
    return out.select("kind", "n", F.col("place").cast("int").alias("place"))


@query(
    """WITH ev AS (SELECT DISTINCT user_id AS event, user_id % 7 = 0 AS deferred FROM events), l AS (SELECT DISTINCT user_id AS event, event_type AS listener FROM events WHERE value > 50)
SELECT ev.event, count(DISTINCT listener) AS listeners, count(listener) = 0 AS orphan, NOT any_value(deferred) AND coalesce(bool_or(listener NOT IN ('view', 'click')), false) AND count(listener) > 0 AS observable_before_commit FROM ev LEFT JOIN l USING (event) GROUP BY 1"""
)
def event_facts(spark, sf):
    e = _t(spark, sf, "events")
    ev = e.select(F.col("user_id").alias("event"), (F.col("user_id") % 7 == 0).alias("deferred")).distinct()
    listeners = e.where("value > 50").select(F.col("user_id").alias("event"), F.col("event_type").alias("listener"))
    jobs = spark.createDataFrame([("view", True, True), ("click", True, None), ("purchase", True, False), ("error", False, True)], "fqcn string, queued boolean, after_commit boolean")
    return A.event_facts(ev, listeners, jobs, defer_default=True)


def _samples(spark, sf):
    e = _t(spark, sf, "events")
    mid = e.agg((F.unix_micros(F.min(F.col("ts").cast("timestamp"))) + F.unix_micros(F.max(F.col("ts").cast("timestamp")))).alias("twice"))
    arm = F.when(2 * F.unix_micros(F.col("ts").cast("timestamp")) <= F.col("twice"), "base").otherwise("head")
    return e.join(F.broadcast(mid)).select(arm.alias("arm"), F.col("event_type").alias("scenario"), F.col("value").alias("ms"), "user_id", "event_id")


SAMPLES = "s AS (SELECT CASE WHEN 2 * epoch_us(ts) <= (SELECT epoch_us(min(ts)) + epoch_us(max(ts)) FROM events) THEN 'base' ELSE 'head' END AS arm, event_type AS scenario, value AS ms, user_id, event_id FROM events)"


@query("WITH " + SAMPLES + " SELECT arm, scenario, count(*) AS samples, round(sum(ms), 3) AS total FROM s GROUP BY 1, 2")
def bench_samples(spark, sf):
    """Each user's events of an arm as one round, written and read back."""
    times = _samples(spark, sf).groupBy("arm", "user_id", "scenario").agg(F.collect_list("ms").alias("times_ms"))
    scenario = F.struct("times_ms", F.create_map(F.lit("n"), F.size("times_ms").cast("long")).alias("counts"))
    path = scratch(spark, "rounds")
    times.groupBy("arm", "user_id").agg(F.map_from_entries(F.collect_list(F.struct("scenario", scenario))).alias("scenarios")).write.json(path)
    return S.read_rounds(spark, path, False).groupBy("arm", "scenario").agg(F.count("*").alias("samples"), F.round(F.sum("ms"), 3).alias("total"))


@query("WITH " + SAMPLES + " SELECT arm, scenario, count(*) AS reps, round(quantile_cont(ms, 0.5), 6) AS median FROM s GROUP BY 1, 2")
def bench_median(spark, sf):
    return A.bench_median(_samples(spark, sf)).withColumn("median", F.round("median", 6))


RANKED = ", r AS (SELECT *, row_number() OVER (PARTITION BY arm, scenario ORDER BY ms) - 1 AS r, count(*) OVER (PARTITION BY arm, scenario) AS n FROM s), q AS (SELECT arm, scenario, max(ms) FILTER (WHERE r = floor(0.1 * (n - 1) + 0.5)) AS p10, max(ms) FILTER (WHERE r = floor(0.9 * (n - 1) + 0.5)) AS p90, quantile_cont(ms, 0.5) AS m, min(ms) AS low, max(ms) AS high, count(*) AS reps FROM r GROUP BY 1, 2), z AS (SELECT *, CASE WHEN reps < 2 OR m <= 0 THEN 0.0 ELSE greatest(abs(p10 - m), abs(p90 - m)) / m END AS noise FROM q)"


@query("WITH " + SAMPLES + RANKED + " SELECT arm, scenario, round(noise, 6) AS noise, low, high FROM z")
def bench_noise(spark, sf):
    return A.bench_noise(_samples(spark, sf)).withColumn("noise", F.round("noise", 6))


JUDGED = "CASE WHEN a.m > 0 THEN (b.m - a.m) / a.m ELSE 0.0 END"
VERDICT = f"CASE WHEN a.reps < 4 THEN 'too few repetitions' WHEN abs({JUDGED}) <= a.noise THEN 'within noise' WHEN abs({JUDGED}) >= 0.1 THEN 'significant' ELSE 'small' END"


@query("WITH " + SAMPLES + RANKED + f" SELECT a.scenario, round({JUDGED}, 6) AS change, {VERDICT} AS verdict FROM z a JOIN z b USING (scenario) WHERE a.arm = 'base' AND b.arm = 'head'")
def bench_verdict(spark, sf):
    return A.bench_verdict(_samples(spark, sf), "base", "head").withColumn("change", F.round("change", 6))


@query("WITH " + SAMPLES + " SELECT arm, scenario, max(v) <= 1 AS stable FROM (SELECT arm, scenario, user_id, count(DISTINCT CAST(floor(ms / 500) AS BIGINT)) AS v FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2")
def bench_stability(spark, sf):
    counts = _samples(spark, sf).select("arm", "scenario", F.col("user_id").cast("string").alias("key"), F.floor(F.col("ms") / 500).alias("value"))
    return A.bench_stability(counts, ["none"])


PHASED = SAMPLES.replace("s AS (", "t AS (", 1) + ", s AS (SELECT CASE WHEN event_id % 7 = 0 AND arm = 'head' THEN 'new' ELSE 'p' || event_id % 4 END AS phase, arm, scenario, ms / 10 AS ms FROM t)"
PHASES = RANKED.replace("PARTITION BY arm, scenario", "PARTITION BY arm, scenario, phase").replace("SELECT arm, scenario, max", "SELECT arm, scenario, phase, max").replace("GROUP BY 1, 2)", "GROUP BY 1, 2, 3)")
KNOWN = "CASE WHEN a.m > 0 THEN {} END"


@query("WITH " + PHASED + PHASES + f" SELECT b.scenario, b.phase, round({KNOWN.format('a.m')}, 6) AS base_ms, round(b.m, 6) AS head_ms, round({KNOWN.format('a.noise')}, 6) AS noise, round({KNOWN.format(JUDGED)}, 6) AS change, {KNOWN.format(VERDICT)} AS verdict FROM (SELECT * FROM z WHERE arm = 'head') b LEFT JOIN (SELECT * FROM z WHERE arm = 'base') a USING (scenario, phase) WHERE greatest(coalesce(a.m, 0), b.m) >= 0.5")
def bench_phases(spark, sf):
    """Four phases on both arms and one that only the head has."""
    name = F.when((F.col("event_id") % 7 == 0) & (F.col("arm") == "head"), "new").otherwise(F.concat(F.lit("p"), (F.col("event_id") % 4).cast("string")))
    phases = _samples(spark, sf).select("arm", "scenario", name.alias("phase"), (F.col("ms") / 10).alias("ms"))
    out = A.bench_phases(phases, "base", "head", 0.5)
    return out.select("scenario", "phase", *[F.round(c, 6).alias(c) for c in ("base_ms", "head_ms", "noise", "change")], "verdict")


@query(
    """WITH s AS (SELECT event_type, value, ts, value > 1 AS ok, CASE WHEN value > 100 THEN 'slow' WHEN value > 1 THEN 'ok' ELSE 'none' END AS status FROM events), d AS (SELECT event_type, string_agg(status || ':' || n, ',' ORDER BY status) AS statuses FROM (SELECT event_type, status, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1)
SELECT event_type, count(*) AS n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS success, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS throughput, min(value) AS low, round(avg(value), 6) AS mean, max(value) AS high, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, any_value(statuses) AS statuses FROM s JOIN d USING (event_type) GROUP BY 1"""
)
def timing_summary(spark, sf):
    status = F.when(F.col("value") > 100, "slow").when(F.col("value") > 1, "ok").otherwise("none")
    samples = _t(spark, sf, "events").select("event_type", "ts", F.col("value").alias("ms"), (F.col("value") > 1).alias("ok"), status.alias("status"))
    said = F.array_join(F.transform("statuses", lambda s: F.concat_ws(":", s["status"], s["n"].cast("string"))), ",")
    return A.timing_summary(samples, ["event_type"]).withColumns({c: F.round(c, 6) for c in ("success", "throughput", "mean")}).withColumn("statuses", said)


@query(G + " SELECT source AS id, count(DISTINCT target) AS receivers FROM edges GROUP BY 1")
def receiver_counts(spark, sf):
    return A.receiver_counts(edges(spark, sf))


@query(
    G
    + ", "
    + METRICS
    + """, n AS (SELECT id, CASE type WHEN 'customer' THEN 'route' ELSE type END AS type, ord, cc, lines > 300 OR cc > 25 AS fat_method, cc > 27 AS has_n1, type = 'region' AND ord % 2 = 0 AS fat_class FROM nodes LEFT JOIN m ON id = 'order::' || method)
SELECT 'types' AS section, type AS name, count(*) AS value FROM n GROUP BY 2 UNION ALL (SELECT 'hotspots', id, cc FROM n WHERE cc IS NOT NULL ORDER BY cc DESC, id LIMIT 10)
UNION ALL SELECT 'has_n1', id, cc FROM n WHERE has_n1 UNION ALL SELECT 'fat_method', id, cc FROM n WHERE fat_method UNION ALL SELECT 'fat_class', id, cc FROM n WHERE fat_class UNION ALL (SELECT 'routes', id, ord FROM n WHERE type = 'route' ORDER BY ord LIMIT 15)"""
)
def project_summary(spark, sf):
    """Customers stand for routes and orders for methods."""
    m = _metrics(spark, sf).select(F.concat(F.lit("order::"), F.col("method").cast("string")).alias("id"), "cc", "lines")
    n = nodes(spark, sf).join(m, "id", "left").withColumns({"fat_method": (F.col("lines") > 300) | (F.col("cc") > 25), "has_n1": F.col("cc") > 27, "fat_class": (F.col("type") == "region") & (F.col("ord") % 2 == 0)})
    return A.project_summary(n.withColumn("type", F.when(F.col("type") == "customer", "route").otherwise(F.col("type"))))


@query("SELECT conv_id, role, CASE WHEN count(*) > 1 THEN role || ' ×' || count(*) ELSE role END AS label, count(*) AS times, min(turn) AS pos FROM conversations GROUP BY 1, 2")
def message_collapse(spark, sf):
    messages = _t(spark, sf, "conversations").select("conv_id", "role", F.col("role").alias("label"), F.col("turn").alias("pos"))
    return A.collapse_messages(messages, ["conv_id", "role", "label"])


@query("SELECT lang AS type, source AS message, min(doc_id) AS ord FROM documents GROUP BY 1, 2")
def issue_dedupe(spark, sf):
    return A.dedupe_issues(_t(spark, sf, "documents").select(F.col("lang").alias("type"), F.col("source").alias("message"), F.col("doc_id").alias("ord")))


@query(
    """WITH o AS (SELECT user_id AS entry, CASE WHEN event_type = 'view' THEN 'http' WHEN event_type = 'click' THEN 'cache' ELSE 'db' END AS family, event_type AS kind, 's' || event_id % 9 AS subject FROM events)
SELECT CASE grouping_id(entry, family, kind, subject) WHEN 0 THEN 'operation' WHEN 7 THEN 'entry' WHEN 9 THEN 'family' WHEN 10 THEN 'subject' ELSE 'total' END AS level, entry, family, kind, subject, count(*) AS n FROM o GROUP BY GROUPING SETS ((entry, family, kind, subject), (entry), (family, kind), (family, subject), ())"""
)
def ops_rollup(spark, sf):
    family = F.when(F.col("event_type") == "view", "http").when(F.col("event_type") == "click", "cache").otherwise("db")
    subject = F.concat(F.lit("s"), (F.col("event_id") % 9).cast("string"))
    ops = _t(spark, sf, "events").select(F.col("user_id").alias("entry"), family.alias("family"), F.col("event_type").alias("kind"), F.when(family != "http", subject).alias("table"), F.when(family == "http", subject).alias("host"))
    return A.ops_rollup(ops)


@query(
    """WITH p AS (SELECT 'r/' || n_regionkey || CASE WHEN n_nationkey % 4 > 0 THEN '/n' || n_nationkey ELSE '' END || CASE WHEN n_nationkey % 4 = 2 THEN '/x' ELSE '' END AS path FROM nation),
s AS (SELECT path, string_split(path, '/') AS a FROM p), e AS (SELECT path, len(a) AS deep, unnest(list_transform(range(1, len(a) + 1), lambda n: array_to_string(a[1:n], '/'))) AS prefix FROM s),
i AS (SELECT DISTINCT prefix FROM e WHERE prefix <> path), r AS (SELECT e.* FROM e JOIN i USING (prefix))
SELECT prefix, count(*) FILTER (WHERE prefix = path OR (len(string_split(prefix, '/')) = deep - 1 AND path NOT IN (SELECT prefix FROM i))) AS direct, count(*) AS total FROM r GROUP BY 1"""
)
def path_tree(spark, sf):
    k = F.col("n_nationkey")
    path = F.concat(F.lit("r/"), F.col("n_regionkey").cast("string"), F.when(k % 4 > 0, F.concat(F.lit("/n"), k.cast("string"))).otherwise(""), F.when(k % 4 == 2, "/x").otherwise(""))
    return A.path_tree(_t(spark, sf, "nation").select(path.alias("path")))


@query("SELECT doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) <= 20000 AS kept FROM documents")
def budget_pack(spark, sf):
    return A.budget_pack(_t(spark, sf, "documents"), "source", "doc_id", "n_chars", 20000).select("doc_id", "running", "kept")


@query("SELECT conv_id, role, turn, dense_rank() OVER (PARTITION BY conv_id, role ORDER BY turn) AS idx FROM conversations")
def region_index(spark, sf):
    regions = _t(spark, sf, "conversations").select(F.col("conv_id").alias("tab"), F.col("role").alias("kind"), F.col("turn").alias("id"))
    return A.region_index(regions).select(F.col("tab").alias("conv_id"), F.col("kind").alias("role"), F.col("id").alias("turn"), F.col("idx").cast("long").alias("idx"))


@query("SELECT page_id, CASE WHEN k > 1 THEN s || '-' || k ELSE s END AS unique_slug FROM (SELECT page_id, s, row_number() OVER (PARTITION BY s ORDER BY page_id) AS k FROM (SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)), '[^a-z]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM pages))")
def slug_collisions(spark, sf):
    letters = F.regexp_replace(F.lower(F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)), "[^a-z]+", "-")
    return A.unique_slugs(_t(spark, sf, "pages").select("page_id", X.slug(letters).alias("s")), "s", "page_id").select("page_id", "unique_slug")


@query("SELECT conv_id AS region, turn || role AS source, nxt AS target FROM (SELECT *, lead(turn || role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL")
def chain_arrows(spark, sf):
    c = _t(spark, sf, "conversations")
    return A.chain_arrows(c.select(F.col("conv_id").alias("region"), F.col("turn").alias("pos"), F.concat(F.col("turn").cast("string"), "role").alias("member")))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 3")
def topk_per_group(spark, sf):
    out = A.topk(_t(spark, sf, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 3)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


@query("WITH " + METRICS + " SELECT method, cc FROM m ORDER BY cc DESC, method LIMIT 10")
def hotspots(spark, sf):
    return A.hotspots(_metrics(spark, sf).select(F.col("method").alias("id"), "cc")).select(F.col("id").alias("method"), "cc")


@query("WITH " + METRICS + " SELECT method, cc FROM m")
def summary_order(spark, sf):
    items = _metrics(spark, sf).select(F.col("method").alias("id"), F.lit("service").alias("type"), "cc")
    return A.complex_items(items).select(F.col("id").alias("method"), "cc")


def _versions(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    new = d.where("doc_id % 7 > 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("\nadded line"))).otherwise(F.col("text")))
    return d.where("doc_id % 11 > 0"), new


def _hashes(d):
    return d.select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"))


@query("SELECT doc_id AS path, CASE WHEN doc_id % 11 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'deleted' ELSE 'modified' END AS change FROM documents WHERE (doc_id % 11 = 0 AND doc_id % 7 > 0) OR (doc_id % 11 > 0 AND (doc_id % 7 = 0 OR doc_id % 5 = 0))")
def snapshot_diff(spark, sf):
    old, new = _versions(spark, sf)
    return D.snapshot_diff(_hashes(old), _hashes(new))


@query("SELECT doc_id, md5(coalesce(text, '')) AS fingerprint FROM documents")
def doc_fingerprint(spark, sf):
    return S.content_hash(_t(spark, sf, "documents"), "doc_id")


@query("SELECT doc_id, CAST(CASE WHEN o = 0 THEN lines WHEN doc_id % 5 = 0 AND n > 0 THEN 1 ELSE 0 END + CASE WHEN o = 0 AND doc_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS added, CAST(CASE WHEN n = 0 THEN lines ELSE 0 END AS BIGINT) AS removed FROM (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS lines, doc_id % 11 AS o, doc_id % 7 AS n FROM documents) WHERE o > 0 OR n > 0")
def line_delta(spark, sf):
    old, new = _versions(spark, sf)
    return D.line_delta(old, new)


def _halves(spark, sf):
    li = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("type"), "l_linenumber")
    return li.where("l_linenumber <= 4"), li.where("l_linenumber >= 2")


@query(
    """WITH o AS (SELECT l_suppkey AS source, l_partkey AS target, l_returnflag AS type, count(*) AS n FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2, 3), w AS (SELECT l_suppkey AS source, l_partkey AS target, l_returnflag AS type, count(*) AS n FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1, 2, 3)
SELECT source, target, type, unnest(range(least(coalesce(o.n, 0), coalesce(w.n, 0)), greatest(coalesce(o.n, 0), coalesce(w.n, 0)))) AS occurrence, CASE WHEN coalesce(w.n, 0) > coalesce(o.n, 0) THEN 'added' ELSE 'removed' END AS side FROM o FULL JOIN w USING (source, target, type)"""
)
def edge_delta(spark, sf):
    old, new = _halves(spark, sf)
    return D.edge_delta(old, new).withColumn("occurrence", F.col("occurrence").cast("long"))


@query(
    """WITH o AS (SELECT l_suppkey AS s, l_partkey AS p, l_returnflag AS f FROM lineitem), n AS (SELECT s, p, CASE WHEN f = 'A' AND s % 7 = 3 THEN 'N' ELSE f END AS f FROM o),
k AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS file)
SELECT file, NOT EXISTS (SELECT s, p, f FROM o WHERE s % 7 = file EXCEPT ALL SELECT s, p, f FROM n WHERE s % 7 = file) AND NOT EXISTS (SELECT s, p, f FROM n WHERE s % 7 = file EXCEPT ALL SELECT s, p, f FROM o WHERE s % 7 = file) AS equal FROM k"""
)
def owned_equal(spark, sf):
    """Suppliers in seven files, of which one moved its edges of one type to another."""
    old = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("type"))
    new = old.withColumn("type", F.when((F.col("type") == "A") & (F.col("source") % 7 == 3), "N").otherwise(F.col("type")))
    n = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 7).alias("file"))
    each = [D.owned_equal(n, old, n, new, spark.range(k, k + 1).toDF("file")).select(F.lit(k).alias("file"), "equal") for k in range(7)]
    return reduce(lambda a, b: a.union(b), each)


def _providers(spark, sf):
    n = F.col("c_custkey")
    o = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderpriority").alias("p"), F.collect_set(F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority"))).alias("b"))
    c = _t(spark, sf, "customer").join(o, "c_custkey", "left")
    none = F.array().cast("array<string>")
    return c.select("c_custkey", F.when(n % 14 == 0, none).otherwise(F.coalesce("p", none)).alias("provides"), F.coalesce("b", none).alias("binding_keys"), (n % 5 == 0).alias("provides_dynamic"), (n % 2 == 0).alias("deferred"), (n % 3 == 0).alias("legacy_defer"), none.alias("when_events"))


PROVIDERS = "p AS (SELECT c_custkey, CASE WHEN c_custkey % 14 = 0 THEN [] ELSE coalesce(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderpriority IS NOT NULL), []) END AS pr, coalesce(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'O'), []) AS bk FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1), u AS (SELECT *, CASE WHEN c_custkey % 2 > 0 OR c_custkey % 5 = 0 OR len(bk) = 0 THEN [] ELSE list_sort(list_filter(pr, lambda x: NOT list_contains(bk, x))) END AS missing FROM p)"


@query("WITH " + PROVIDERS + " SELECT c_custkey, array_to_string(missing, ',') AS missing FROM u")
def unbacked(spark, sf):
    return D.unbacked(_providers(spark, sf)).select("c_custkey", F.array_join("missing", ",").alias("missing"))


@query("WITH " + PROVIDERS + " SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND len(pr) = 0 AND c_custkey % 5 > 0 THEN 'never-boots' WHEN len(missing) > 0 THEN 'unbacked-provides' WHEN c_custkey % 3 = 0 AND c_custkey % 2 > 0 THEN 'legacy-defer' END AS defect FROM u")
def provider_defects(spark, sf):
    return D.provider_defects(_providers(spark, sf)).select("c_custkey", "defect")


@query(
    """SELECT n_nationkey AS tab_id, 'first' AS run, 'unchanged' AS status FROM nation UNION ALL
SELECT n_nationkey, 'second', CASE WHEN n_nationkey % 6 = 0 THEN 'new' WHEN c > d OR n_nationkey % 5 = 1 THEN 'changed' ELSE 'unchanged' END FROM (SELECT n_nationkey, count(c_custkey) AS c, count(c_custkey) FILTER (WHERE c_custkey % 10 > 0) AS d FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)"""
)
def tab_status(spark, sf):
    """Nations as tabs: first without an earlier manifest, then against one with other counts, other risks and fewer tabs."""
    c, n = _t(spark, sf, "customer"), _t(spark, sf, "nation")
    manifest = lambda df: n.join(df, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_nationkey").alias("tab_id")).agg(F.count("c_custkey").alias("node_count"), F.nullif(F.count("c_custkey"), F.lit(0)).alias("edge_count"))
    new = manifest(c).withColumn("risk_level", F.when(F.col("tab_id") % 5 == 1, "low"))
    old = manifest(c.where("c_custkey % 10 > 0")).where("tab_id % 6 > 0").withColumn("risk_level", F.when(F.col("tab_id") % 2 == 0, "none"))
    first, second = D.tab_status(new), D.tab_status(new, old)
    return first.select("tab_id", F.lit("first").alias("run"), "status").union(second.select("tab_id", F.lit("second"), "status"))


@query("WITH " + SAMPLES + " SELECT scenario, key, b AS base, h AS head FROM (SELECT scenario, user_id % 20 AS key, nullif(count(*) FILTER (WHERE arm = 'base'), 0) AS b, nullif(count(*) FILTER (WHERE arm = 'head'), 0) AS h FROM s GROUP BY 1, 2) WHERE b IS DISTINCT FROM h")
def count_changes(spark, sf):
    counts = _samples(spark, sf).groupBy("arm", "scenario", (F.col("user_id") % 20).alias("key")).agg(F.count("*").alias("value"))
    return D.count_changes(counts.where("arm = 'base'"), counts.where("arm = 'head'"))


_EXACT = lambda *cols: " || ".join(f"coalesce(strlen({c}) || ':' || {c} || ';', '-;')" for c in cols)
SIGNED = (
    G
    + f""", e AS (SELECT *, 'n' || ord % 3 AS label FROM edges), o AS (SELECT 'node' AS kind, id, md5({_EXACT("type", "label")}) AS a, md5({_EXACT("type", "(CASE WHEN ord % 10 = 3 THEN label || '!' ELSE label END)")}) AS b FROM nodes
UNION ALL SELECT 'edge', {_EXACT("source", "target", "type")} || '#0', md5({_EXACT("source", "target", "type", "label")}), CASE WHEN ord % 10 <> 4 THEN md5({_EXACT("source", "target", "type", "CASE WHEN ord % 10 = 5 THEN 'moved' ELSE label END")}) END FROM e)
"""
)


def _signature_pairs(spark, sf):
    """The graph's signatures with those of one with some labels of nodes and edges changed and some edges gone."""
    n, e = nodes(spark, sf, coded=True), stored(edges(spark, sf, coded=True)).withColumn("label", F.concat(F.lit("n"), (F.col("ord") % 3).cast("string")))
    other = n.withColumn("label", F.when(F.col("ord") % 10 == 3, F.concat("label", F.lit("!"))).otherwise(F.col("label")))
    moved = e.where("ord % 10 <> 4").withColumn("label", F.when(F.col("ord") % 10 == 5, "moved").otherwise(F.col("label")))
    return D.signature_pairs(n, e, other, moved, name=name)


@query(SIGNED + "SELECT kind, id, a AS signature, a IS DISTINCT FROM b AS differs FROM o")
def graph_signature(spark, sf):
    pairs = _signature_pairs(spark, sf).where("old is not null")
    return pairs.select("kind", "id", F.col("old").alias("signature"), (~F.col("old").eqNullSafe(F.col("new"))).alias("differs"))


@query(SIGNED + "SELECT kind, substr(md5(id), 1, 3) AS range, count(*) AS elements FROM o WHERE a IS DISTINCT FROM b GROUP BY 1, 2")
def graph_ranges(spark, sf):
    """The ranges of ids in which two builds differ, found by their trees of signatures, and the elements that do."""
    old, new, odd = D.pair_trees(_signature_pairs(spark, sf), 3)
    return D.tree_diff(old, new).join(odd, ["kind", "range"]).select("kind", "range", F.col("odd").alias("elements"))


def _filed(spark, sf, coded=False):
    file = F.when(F.col("type") != "region", F.concat(F.lit("f"), (F.col("ord") % 17).cast("string")))
    return nodes(spark, sf, coded).withColumn("file", file)


FILED = G + ", fn AS (SELECT *, CASE WHEN type <> 'region' THEN 'f' || ord % 17 END AS file FROM nodes)"


@query(FILED + " SELECT 'node' AS kind, id, coalesce(file, '') AS file FROM fn UNION ALL SELECT 'edge', source || '|' || target || '|' || edges.type, coalesce(fn.file, '') FROM edges LEFT JOIN fn ON fn.id = source")
def provenance(spark, sf):
    return D.provenance(_filed(spark, sf), edges(spark, sf))


CHANGED = "('f3', 'f5')"


def _changed(spark):
    return spark.createDataFrame([("f3",), ("f5",)], "file string")


@query(FILED + f" SELECT id FROM fn WHERE file IN {CHANGED} UNION SELECT source FROM edges WHERE ord % 9 = 0 UNION SELECT target FROM edges WHERE ord % 9 = 0")
def dirty_set(spark, sf):
    """The graph against a build that lacks its even nodes and every ninth edge."""
    n, e = _filed(spark, sf), edges(spark, sf)
    return D.dirty_set(n.where("ord % 2 = 0"), n, D.edge_delta(e, e.where("ord % 9 > 0")), _changed(spark))


@query(
    FILED
    + f""", gone AS (SELECT * FROM edges WHERE ord % 9 = 0), dirty AS (SELECT id FROM fn WHERE file IN {CHANGED} UNION SELECT source FROM gone UNION SELECT target FROM gone)
SELECT 'node' AS kind, id, CASE WHEN id IN (SELECT id FROM dirty) OR ord % 4 = 0 THEN label || '!' ELSE label END AS label FROM fn
UNION ALL SELECT 'edge', source || '>' || target, CASE WHEN e.ord % 9 = 0 OR fn.file IN {CHANGED} THEN e.type || '!' ELSE e.type END FROM edges e LEFT JOIN fn ON fn.id = e.source"""
)
def reconstruct(spark, sf):
    """A build whose every label is new, over one that lacks some nodes and edges: only what is dirty takes the new label."""
    n, e = _filed(spark, sf, coded=True).select("id", "file", "label", "ord"), stored(edges(spark, sf, coded=True)).select("source", "target", "type", F.col("type").alias("label"), "ord")
    mark = lambda df: df.withColumn("label", F.concat("label", F.lit("!")))
    old_n, old_e = n.where("ord % 4 > 0"), e.where("ord % 9 > 0")
    got_n, got_e = D.reconstruct(old_n.drop("ord"), old_e.drop("ord"), mark(n).drop("ord"), mark(e).drop("ord"), _changed(spark))
    return got_n.select(F.lit("node").alias("kind"), name("id").alias("id"), "label").union(got_e.select(F.lit("edge"), F.concat_ws(">", name("source"), name("target")), "label"))


@query(
    FILED
    + f""" SELECT 'node' AS kind, id, CASE WHEN file IN {CHANGED} THEN label || '!' ELSE label END AS label, ord FROM fn WHERE coalesce(file, '') NOT IN {CHANGED} OR ord % 2 = 0
UNION ALL SELECT 'edge', source || '>' || target, type, ord FROM edges"""
)
def apply_partial(spark, sf):
    """A partial build of two files that has half of their nodes, its own order and one node more, which is not taken."""
    n, e = _filed(spark, sf, coded=True).select("id", "label", "file", "ord"), edges(spark, sf, coded=True)
    more = spark.range(1).select(F.lit(-1).cast("long"), F.lit("x"), F.lit("f3"), F.lit(0).cast("long"))
    partial = n.where("ord % 2 = 0").withColumns({"label": F.concat("label", F.lit("!")), "ord": F.lit(0).cast("long")}).join(_changed(spark), "file", "left_semi").select("id", "label", "file", "ord").union(more)
    got_n, got_e = D.apply_partial(n, e, partial, _changed(spark))
    return got_n.select(F.lit("node").alias("kind"), name("id").alias("id"), "label", "ord").union(got_e.select(F.lit("edge"), F.concat_ws(">", name("source"), name("target")), "type", "ord"))


@query(
    """SELECT project, CASE WHEN count(*) FILTER (WHERE change <> 'modified' OR outside) > 0 THEN 'full' ELSE 'list' END AS decision, count(*) AS files FROM (
SELECT doc_id % 23 AS project, doc_id % 3 = 0 AND doc_id % 23 = 7 AS outside, CASE WHEN doc_id % 11 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'deleted' ELSE 'modified' END AS change FROM documents
 WHERE (doc_id % 11 = 0 AND doc_id % 7 > 0) OR (doc_id % 11 > 0 AND (doc_id % 7 = 0 OR doc_id % 5 = 0))) WHERE change = 'modified' OR project % 2 = 0 GROUP BY 1"""
)
def scope_decision(spark, sf):
    """A decision per project: paths come and go only in the even ones, and one has paths outside the roots."""
    old, new = _versions(spark, sf)
    project = F.col("doc_id") % 23
    root = F.when((F.col("doc_id") % 3 == 0) & (project == 7), "lib/").otherwise("src/")
    named = lambda d: d.select(F.concat(project.cast("string"), F.lit(":"), root, F.col("doc_id").cast("string")).alias("path"), F.md5("text").alias("hash"))
    diff = D.snapshot_diff(named(old), named(new)).select(F.substring_index("path", ":", 1).cast("long").alias("project"), F.substring_index("path", ":", -1).alias("path"), "change")
    return D.scope_decision(diff.where("change = 'modified' or project % 2 = 0"), ["src/", "app/"], ["project"])
