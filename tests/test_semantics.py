"""Behaviour on small hand-made tables, odd input included."""

import json

import pytest
from pyspark.sql import functions as F

from cairngraph.functions import exprs as X
from cairngraph.operators import aggs, audit, closure, diff, graph, rewire, text
from cairngraph.sources import io
from cairngraph.streaming import streams


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def g(spark):
    nodes = spark.createDataFrame([("r", "route", 0), ("a", "action", 1), ("s", "service", 2), ("m", "model", 3), ("x", "model", 4)], "id string, type string, ord long")
    edges = spark.createDataFrame([("r", "a", "call", 0), ("a", "s", "call", 1), ("s", "a", "call", 2), ("s", "m", "bind", 3), ("a", "ghost", "call", 4), ("m", "m", "call", 5), ("r", "m", "call", 6)], "source string, target string, type string, ord long")
    return nodes, edges


def test_closure_ends_on_cycles_with_least_depth(spark, g):
    seeds = spark.createDataFrame([("t", "r"), ("u", "s"), ("v", "nowhere")], "tab_id string, id string")
    got = rows(closure.tab_closure(g[1], seeds))
    assert got == [("t", "a", 1), ("t", "ghost", 2), ("t", "m", 1), ("t", "r", 0), ("t", "s", 2), ("u", "a", 1), ("u", "ghost", 2), ("u", "m", 1), ("u", "s", 0), ("v", "nowhere", 0)]
    assert rows(closure.tab_closure(g[1].orderBy(F.rand(1)), seeds)) == got
    again = closure.tab_closure(g[1], closure.tab_closure(g[1], seeds).select("tab_id", "id"))
    assert {r[:2] for r in rows(again)} == {r[:2] for r in got}


def test_a_long_chain_is_compacted(spark):
    edges = spark.range(30).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    assert closure.closure(edges, spark.createDataFrame([(0,)], "id long")).agg(F.max("depth"), F.count("*")).first() == (30, 31)


def test_skipped_types_stay_in_the_induced_subgraph(spark, g):
    seeds = spark.createDataFrame([("t", "r")], "tab_id string, id string")
    met = closure.tab_closure(g[1], seeds, ["bind"])
    assert ("t", "s", "m", "bind") in rows(closure.tab_edges(met, *g))
    assert all("ghost" not in r for r in rows(closure.tab_edges(met, *g)))


def test_entry_class_counts_without_a_node(spark, g):
    entry = spark.createDataFrame([("lost", None), (None, "C")], "id string, fqcn string")
    nodes = g[0].withColumn("fqcn", F.when(F.col("id") == "s", "C"))
    assert {r.id for r in closure.reached(nodes, g[1], entry).collect()} == {"lost", "s", "a", "m", "ghost"}


def test_resolve_member_stops_after_hops(spark):
    parents = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(7)], "child string, parent string")
    methods = spark.createDataFrame([("c6", "go"), ("c3", "run"), ("c5", "run")], "id string, method string")
    asked = spark.createDataFrame([("c0", "go"), ("c0", "run"), ("c2", "go")], "id string, method string")
    assert rows(closure.resolve_member(parents, methods, asked)) == [("c0", "run", "c3", 3), ("c2", "go", "c6", 4)]


def test_inheritance_cycles_do_not_reach_a_base(spark):
    parents = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "base")], "child string, parent string")
    assert rows(closure.inherits_from(parents, spark.createDataFrame([("base",)], "id string"))) == [("a", False), ("b", False), ("c", True)]


def test_longest_path_ends_when_every_node_has_a_parent(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "b", 0), ("b", "a", 1)], "source string, target string, ord long")
    assert closure.longest_path(nodes, edges).count() == 0


def test_merge_takes_the_last_writer_and_names_edges(spark):
    nodes = spark.createDataFrame([("a", "old", 0), ("a", "new", 1), ("", "blank", 2), (None, "null", 3)], "id string, label string, ord long")
    edges = spark.createDataFrame([("", "a", "b", "t", 0), (None, "a", "b", "t", 1), ("e", "a", "c", "t", 2)], "id string, source string, target string, type string, ord long")
    n, e = graph.merge_graphs(nodes, edges)
    assert rows(n) == [("a", "new", 1)] and {r.id for r in e.collect()} == {"a|b|t", "e"}


def test_usages_keep_callers_without_a_file_apart(spark):
    nodes = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", None), ("d", ""), ("t", "f")], "id string, file string")
    edges = spark.createDataFrame([("a", "t"), ("a", "t"), ("b", "t"), ("c", "t"), ("d", "t"), ("t", "t"), ("ghost", "t"), ("a", "gone"), ("", "t")], "source string, target string")
    assert rows(graph.usages(nodes, edges)) == [("t", "#c", 1), ("t", "#d", 1), ("t", "#ghost", 1), ("t", "f", 2)]
    assert [tuple(r) for r in graph.usages(nodes, edges).collect()][0] == ("t", "f", 2)


def test_repeated_edges_get_stable_ids(spark):
    edges = spark.createDataFrame([("a", "b", "t", 0), ("a", "b", "t", 1)], "source string, target string, type string, ord long")
    first, second = [r.id for r in graph.edge_ids(edges).orderBy("ord").collect()]
    assert second == first + "_1"


def test_rollup_takes_findings_of_entries_and_smells_of_all(spark):
    tab = spark.createDataFrame([("t", "r"), ("t", "m")], "tab_id string, id string")
    nodes = spark.createDataFrame([("r", "low", False), ("m", "critical", True)], "id string, severity string, smell boolean")
    assert rows(graph.tab_rollup(tab, tab.where("id = 'r'"), nodes)) == [("t", 1, "low", 1, 2)]


def test_risk_uses_the_highest_complexity(spark):
    metrics = spark.createDataFrame([("f", 3), ("f", 5), ("g", 0), ("h", 9)], "file string, cc int")
    assert rows(aggs.risk_rank(metrics, spark.createDataFrame([("f", 2), ("g", 7)], "file string, commits long"))) == [("f", 5, 2, 10)]


def samples(spark, arms):
    return spark.createDataFrame([(arm, "x", float(v)) for arm, values in arms.items() for v in values], "arm string, scenario string, ms double")


@pytest.mark.parametrize(
    "base, head, want",
    [
        ([80, 80, 100, 100, 120, 120, 100, 100], [110] * 4, (0.1, "within noise")),
        ([100] * 4, [140] * 4, (0.4, "significant")),
        ([100], [140], (0.4, "too few repetitions")),
        ([100] * 4, [140], (0.4, "significant")),
        ([100] * 4, [80, 140, 140, 200], (0.4, "significant")),
        ([100] * 4, [105] * 4, (0.05, "small")),
        ([0] * 4, [5] * 4, (0.0, "within noise")),
    ],
)
def test_the_base_arm_alone_tells_what_can_be_judged(spark, base, head, want):
    got = aggs.bench_verdict(samples(spark, {"b": base, "h": head}), "b", "h").first()
    assert (round(got.change, 6), got.verdict) == want


def test_a_phase_is_held_to_its_own_noise(spark):
    base = {"graph": [40] * 4, "facades": [70, 33, 71, 130], "gone": [50] * 4, "idle": [0.2] * 4}
    head = {"graph": [60] * 4, "facades": [35] * 4, "fresh": [8] * 4, "idle": [0.3] * 4}
    data = [(arm, "x", p, float(v)) for arm, phases in (("b", base), ("h", head)) for p, vs in phases.items() for v in vs]
    df = spark.createDataFrame(data, "arm string, scenario string, phase string, ms double")
    got = {r.phase: (r.base_ms, r.head_ms, r.verdict) for r in aggs.bench_phases(df, "b", "h").collect()}
    assert got == {"graph": (40.0, 60.0, "significant"), "facades": (70.5, 35.0, "within noise"), "fresh": (None, 8.0, None)}


def test_order_statistics_equal_a_sort(spark):
    import random

    rng = random.Random(5)
    groups = {"ties": [1.0] * 50 + [2.0] * 3, "one": [7.0], "wide": [rng.expovariate(1e-3) for _ in range(501)], "far": [0.0, 1e300, -5.0, 1e-9], "same": [3.0] * 9}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("ties", None)], "g string, v double")
    at = lambda p: F.floor(p * (F.col("n") - 1) + 0.5)
    got = {r.g: r for r in aggs.order_stats(df, ["g"], "v", {"a": at(0.1), "b": at(0.5), "c": at(0.9)}).collect()}
    for g, vs in groups.items():
        o = sorted(vs)
        assert (got[g].n, got[g].low, got[g].high) == (len(o), o[0], o[-1])
        assert [got[g].a, got[g].b, got[g].c] == [o[int(p * (len(o) - 1) + 0.5)] for p in (0.1, 0.5, 0.9)]


def test_running_sums_in_two_levels(spark):
    df = spark.createDataFrame([("a", k, k) for k in range(40)] + [(None, 3, 5), (None, 9, 1)], "g string, k long, s long")
    got = {(r.g, r.k): r.t for r in aggs.running(df, "g", "k", "s", "t", width=7).collect()}
    assert got == {("a", k): k * (k + 1) // 2 for k in range(40)} | {(None, 3): 5, (None, 9): 6}


def test_unknown_event_is_an_orphan(spark):
    ev = spark.createDataFrame([("e", False), ("o", False)], "event string, deferred boolean")
    listeners = spark.createDataFrame([("e", "l"), ("e", "l")], "event string, listener string")
    jobs = spark.createDataFrame([("l", True, True)], "fqcn string, queued boolean, after_commit boolean")
    assert rows(aggs.event_facts(ev, listeners, jobs)) == [("e", 1, False, False), ("o", 0, True, False)]


def test_foreign_key_needs_leading_columns_in_order(spark):
    schema = "table string, indexes array<struct<columns:array<string>>>, foreign_keys array<struct<name:string,columns:array<string>>>"
    data = [("ok", [(["a", "b", "c"],)], [("k", ["a", "b"])]), ("order", [(["b", "a"],)], [("k", ["a", "b"])]), ("none", None, [("k", ["a"])]), ("bare", [(["a"],)], [("k", [])])]
    assert rows(audit.fk_index(spark.createDataFrame(data, schema))) == [("bare", "k"), ("none", "k"), ("order", "k")]


def test_findings_without_a_line_match_every_span(spark):
    found = spark.createDataFrame([("f", None, "n"), ("f", 5, "m"), ("f", 99, "o")], "file string, line int, id string")
    spans = spark.createDataFrame([("f", "s1", 1, 9), ("f", "s2", 10, 20)], "file string, span string, first int, last int")
    assert sorted((r.id, r.span) for r in rewire.range_findings(found, spans).collect()) == [("m", "s1"), ("n", "s1"), ("n", "s2")]


def test_incremental_equals_full(spark):
    node, edge = "id string, file string, label string, ord long", "source string, target string, type string, label string"
    old = spark.createDataFrame([("a", "f", "1", 0), ("b", "g", "1", 1), ("z", "f", "1", 2)], node)
    new = spark.createDataFrame([("a", "f", "2", 0), ("b", "g", "1", 1), ("c", "f", "1", 2)], node)
    old_e = spark.createDataFrame([("a", "b", "t", "1"), ("b", "a", "t", "1"), ("b", "z", "t", "1"), ("b", "a", "t", "1")], edge)
    new_e = spark.createDataFrame([("a", "b", "t", "2"), ("b", "a", "t", "1"), ("b", "c", "t", "1")], edge)
    files = spark.createDataFrame([("f",)], "file string")
    nodes, edges = diff.reconstruct(old, old_e, new, new_e, files)
    assert rows(nodes) == rows(new) and rows(edges) == rows(new_e)
    partial = spark.createDataFrame([("a", "f", "2", 7), ("c", "f", "1", 8)], node)
    nodes, edges = diff.apply_partial(old, old_e, partial, files)
    assert rows(nodes) == [("a", "f", "2", 0), ("b", "g", "1", 1)] and rows(edges) == rows(old_e)
    same = lambda e: diff.owned_equal(old, old_e, new, e, files).first()[0]
    assert same(new_e) and same(old_e) and not same(new_e.where("source <> 'a'")) and not same(new_e.union(new_e.where("source = 'a'")))
    a, b = diff.graph_signature(old, old_e, ("label",)), diff.graph_signature(new, new_e, ("label",))
    assert diff.signature_diff(a, a).isEmpty() and not diff.signature_diff(a, b).isEmpty()


def test_providers(spark):
    schema = "name string, deferred boolean, legacy_defer boolean, provides array<string>, provides_dynamic boolean, when_events array<string>, binding_keys array<string>"
    data = [
        ("silent", True, False, [], False, [], ["k"]),
        ("waits", True, False, [], False, ["e"], []),
        ("clock", True, False, ["Clock", "SystemClock"], False, [], ["Clock"]),
        ("redundant", True, True, ["k"], False, [], ["k"]),
        ("old", False, True, ["x"], False, [], ["k"]),
        ("eager", False, False, ["x"], False, [], ["k"]),
        ("dynamic", True, False, ["x"], True, [], ["k"]),
        ("loop", True, False, ["x"], False, [], []),
    ]
    got = {r.name: (r.defect, r.missing) for r in diff.provider_defects(spark.createDataFrame(data, schema)).collect()}
    assert got == {"silent": ("never-boots", []), "waits": (None, []), "clock": ("unbacked-provides", ["SystemClock"]), "redundant": (None, []), "old": ("legacy-defer", []), "eager": (None, []), "dynamic": (None, []), "loop": (None, [])}


def test_tab_status(spark):
    schema = "tab_id string, node_count long, edge_count long, risk_level string"
    new = spark.createDataFrame([("a", 1, 2, "low"), ("b", None, 0, None), ("c", 1, 1, "none"), (None, 1, 1, "none")], schema)
    old = spark.createDataFrame([("a", 1, 2, "high"), ("b", 0, None, "none")], schema)
    assert {r.status for r in diff.tab_status(new).collect()} == {"unchanged"}
    assert {(r.tab_id, r.status) for r in diff.tab_status(new, old).collect()} == {("a", "changed"), ("b", "unchanged"), ("c", "new"), (None, "unchanged")}


def test_groups_expand_in_order_with_parameters(spark):
    groups = spark.createDataFrame([("api", 0, "throttle:60,1"), ("api", 1, "protected"), ("protected", 0, "auth"), ("web", 0, "auth"), ("loop", 0, "x"), ("loop", 1, "loop"), ("empty", 0, None), ("both", 0, "auth")], "group string, pos int, member string")
    aliases = spark.createDataFrame([("auth", "App\\Auth"), ("both", "App\\Both")], "alias string, target string")
    names = spark.createDataFrame([("r", 0, "api"), ("r", 1, "auth:x"), ("s", 0, "web:tenant"), ("l", 0, "loop"), ("e", 0, "empty"), ("b", 0, "both"), ("t", 0, "auth"), ("t", 1, "web")], "owner string, pos int, name string")
    got = {}
    for r in closure.expand_groups(names, groups, aliases).orderBy("owner", "place").collect():
        got.setdefault(r.owner, []).append(r.name)
    assert got == {"r": ["throttle:60,1", "App\\Auth", "App\\Auth:x"], "s": ["web:tenant"], "l": ["x"], "b": ["App\\Auth"], "t": ["App\\Auth"]}
    whole = {(r.owner, r.name) for r in closure.guard_names(names, groups, aliases).collect()}
    assert {("r", "api"), ("b", "App\\Both"), ("e", "empty"), ("b", "App\\Auth")} <= whole


def test_exposure_and_public_writes(spark):
    guards = spark.createDataFrame([("p", "throttle"), ("g", "GUEST"), ("a", "auth:api"), ("c", "\\App\\Customer:web"), ("m", "can"), ("m", "auth"), ("n", "cannot")], "route string, guard string")
    parents = spark.createDataFrame([("App\\Customer", "Base"), ("Base", "Fw\\Authenticate"), ("X", "Y"), ("Y", "X")], "child string, parent string")
    routes = spark.createDataFrame([(r, "POST", f"/hooks/{r}", "") for r in "pgacmn"] + [("q", "DELETE", "other", "in.q")], "route string, method string, uri string, name string")
    got = audit.exposure(guards, routes, {"guest": ["guest"], "authed": ["auth"], "admin": ["can:"]}, parents, spark.createDataFrame([("Fw\\Authenticate",)], "id string"))
    assert rows(got) == [("a", "authed"), ("c", "authed"), ("g", "guest"), ("m", "admin"), ("n", "public"), ("p", "public"), ("q", "public")]
    assert rows(audit.public_write(routes, got, ["HOOKS/*"])) == [("q", "high")]
    assert rows(audit.public_write(routes, got, ["/hooks/p"], ["in.*"])) == [("n", "medium")]


def test_placeholders_are_whole_segments(spark):
    left = spark.createDataFrame([(t,) for t in ("orders.{id}", "orders.summary", "{team}.updates", "a{x}.b", "{a}.{b}")], "template string")
    right = spark.createDataFrame([("orders.{orderId}", 0), ("orders.updates", 1), ("a{y}.b", 2), ("{tenant}.{stream}", 3), ("orders.{o}", 4)], "template string, ord int")
    assert rows(rewire.template_match(left, right)) == [("orders.{id}", "orders.{orderId}"), ("{a}.{b}", "{tenant}.{stream}")]


def test_tab_seeds(spark):
    t = lambda *x: spark.createDataFrame(list(x), "label string, id string, ord long")
    seeds = closure.tab_seeds(
        routes=t(("GET /a", "r1", 0), ("GET /a", "act", 0)),
        schedules=t(("job x", "s1", 0), ("job x", "s2", 1), ("job x", "s1", 2)),
        macros=t(("M", "m1", 0), ("N", "m2", 1)),
        pages=t(("GET /a", "page", 0), ("GET /b", "page2", 1)),
    )
    assert rows(seeds) == [("get-a", "act", "route"), ("get-a", "r1", "route"), ("get-b", "page2", "page"), ("macros", "m1", "macro"), ("macros", "m2", "macro"), ("schedule-job-x", "s1", "schedule"), ("schedule-job-x-2", "s2", "schedule")]
    nodes = spark.createDataFrame([("ev",), ("c",)], "id string")
    edges = spark.createDataFrame([("ev", "c", "event-to-channel"), ("lost", "c", "event-to-channel"), ("ev", "down", "x")], "source string, target string, type string")
    channel = spark.createDataFrame([("t", "c")], "tab_id string, id string")
    assert rows(closure.with_broadcasters(channel, channel, nodes, edges)) == [("t", "c"), ("t", "ev")]


def test_types_are_refined_from_the_default_only(spark):
    nodes = spark.createDataFrame([("1", "F", "service", "x"), ("2", "G", "service", "req"), ("3", "H", "service", "app/Actions/a"), ("4", "F", "model", "app/Actions/b"), ("5", "H", "service", "app/Actionsets/c"), ("6", "H", "service", None), ("7", "F", "service", "req")], "id string, fqcn string, type string, file string")
    got = graph.refine_types(nodes, spark.createDataFrame([("F",)], "fqcn string"), spark.createDataFrame([("req",)], "file string"), ["app/Actions"])
    assert {r.id: r.type for r in got.collect()} == {"1": "facade", "2": "validation_request", "3": "action_class", "4": "model", "5": "service", "6": "service", "7": "facade"}


def test_evidence(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    named = lambda *x: spark.createDataFrame(list(x), "id string, file string")
    classes = spark.createDataFrame([("r", "p", ["i"], None), ("u", "q", [], ["t"])], "id string, parent string, interfaces array<string>, traits array<string>")
    got = rewire.evidence(named(("p", "f"), ("i", "f"), ("q", "f"), ("b", "f")), bound=ids("b", "p"), facades=ids("b"), inherited=rewire.inherited(classes, ids("r")), configured=named(("p", "f"), ("i", "g")), mentioned=named(("q", "g")))
    assert {r.id: r.evidence for r in got.collect()} == {"p": ["bound", "inherited"], "i": ["configured", "inherited"], "q": ["mentioned"], "b": ["facade"]}


def test_sequence(spark):
    nodes = spark.createDataFrame([("r", "route"), ("a", "action"), ("m", "model")], "id string, type string")
    edges = spark.createDataFrame([("r", "a", "calls", "x", 0), ("a", "m", "reads", "x", 1), ("a", "m", "reads", "x", 2), ("a", "j", "sends", "action-to-job", 3), ("m", "m", "self", "x", 4)], "source string, target string, label string, type string, ord long")
    actors, messages = closure.sequence(nodes, edges, nodes.where("id = 'r'"))
    assert [(r.id, r.type) for r in actors.orderBy("place").collect()] == [("__client__", "client"), ("r", "route"), ("a", "controller"), ("m", "model"), ("__db__", "db")]
    got = [(r.sender, r.receiver, r.label) for r in messages.orderBy("pos").collect()]
    assert got == [("__client__", "r", "request"), ("r", "a", "calls"), ("a", "m", "reads ×2"), ("m", "__db__", "query"), ("__db__", "m", "result"), ("r", "__client__", "response")]


def test_finding_severity(spark):
    found = spark.createDataFrame([("f", "{!! $Profile !!}"), ("f", "{!! $x->BODY !!}"), ("g", "{!! $profile !!}"), ("g", None)], "file string, message string")
    got = text.finding_severity(found, spark.createDataFrame([("f", "profile")], "file string, name string"))
    assert rows(got.select(F.coalesce("message", F.lit("")), "severity")) == [("", "medium"), ("{!! $Profile !!}", "high"), ("{!! $profile !!}", "medium"), ("{!! $x->BODY !!}", "high")]


def test_scope_decision(spark):
    d = lambda *x: spark.createDataFrame(list(x), "path string, change string")
    assert [diff.scope_decision(x, ["app/"]).first()[0] for x in (d(), d(("app/x", "modified")), d(("lib/x", "modified")), d(("app/x", "added")))] == ["none", "list", "full", "full"]


def test_template_references(spark):
    s = spark.createDataFrame([("p", "@include('a') @include(\"pkg::b\") @includeWhen($x, 'c') @includeFirst(['zz', 'd']) <x-card/> <x-nav.top>")], "name string, text string")
    names = spark.createDataFrame([(n,) for n in ("a", "c", "d", "components.card", "components.card.index", "components.nav.top.index")], "name string")
    assert {r.child for r in text.template_refs(s, names).collect()} == {"a", "c", "d", "components.card", "components.nav.top.index"}


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


@pytest.mark.parametrize(
    "name, want",
    [
        ("App\\Models\\OrderItem", "order_items"),
        ("Category", "categories"),
        ("Day", "days"),
        ("Class", "classes"),
        ("Bus", "buss"),
        ("Box", "boxes"),
        ("HTMLPage", "h_t_m_l_pages"),
    ],
)
def test_table_names(spark, name, want):
    assert value(spark, X.table_name(F.lit(name))) == want


def test_expressions(spark):
    lit, v = F.lit, lambda col: value(spark, col)
    assert v(X.glob_match(lit("App/User.php"), ["app/*.PHP"])) and v(X.cadence(lit("cron"), F.array(lit("* * *")))) == "* * *"
    assert [v(X.payload(lit('{"a":"5","b":7}'), p, k, d)) for p, k, d in (("$.a", "int", 3), ("$.b", "int", 3), ("$.a", "string", "z"), ("$.b", "string", "z"), ("$.c", "int", 3))] == [3, 7, "5", "z", 3]
    assert v(X.payload(lit("broken"), "$.a", "int", 3)) == 3
    guard = lambda g, *p: v(X.guard_match(lit(g), list(p)))
    assert guard("CAN", "can:") and guard("Can:edit", "can:") and not guard("cannot", "can:")
    assert guard("AUTH:api", "auth") and guard("auth\\x", "Auth") and not guard("App\\Auth", "auth") and guard("App\\Http\\Authenticate:web", "Fw\\Authenticate") and not guard("authx", "auth")
    long = "a" * 60 + "/" + "b" * 60
    assert v(X.slug(lit(" POST /Api/Orders "))) == "post-api-orders" and len(v(X.slug(lit(long)))) == 109 and v(X.slug(lit(long)))[:-8] == v(X.slug(lit(long.replace("/", "_"))))[:-8]
    assert v(X.slug(lit(long))) != v(X.slug(lit(long.replace("/", "_"))))
    assert [v(X.rel_path(lit(p), "routes", "routes.php")) for p in ("/x/routes/v1/u.php", "C:\\r\\routes\\a.php", "/x/web.php", "")] == ["v1/u.php", "a.php", "web.php", "routes.php"]
    assert [v(X.statement_target(lit(q))) for q in ("select 1 FROM `users`", "delete from a.b", "xfrom y", "update t set")] == ["users", "a", None, "t"]
    assert [v(X.is_async(lit(t))) for t in ("action-to-job", "model-to-event", "event-to-listener", "queue")] == [True, True, False, False]
    assert [v(X.node_id(lit(n), lit("go"))) for n in ("App\\Svc A_b", "route::x", "App\\Http\\C", "blade::a.b/C")] == ["app_svc_a_b::go", "route::x", "action::App\\Http\\C::go", "view::blade__a.b_c"]
    assert [v(X.severity_name(X.severity_rank(lit(s).cast("string")))) for s in ("HIGH", "odd", None)] == ["high", "none", "low"]
    assert [v(X.tab_bucket(lit(c), lit(p).cast("string"))) for c, p in (("Command", None), ("Filament", "admin"), ("Filament", None), ("Route", "admin"), (None, None))] == ["Console Commands", "Filament · Admin Panel", "Filament", "Other", "Other"]
    assert [v(X.op_kind(lit(m))) for m in ("pull", "sear", "nope")] == ["invalidate", "read", None]


def test_sources(spark, tmp_path):
    (tmp_path / "tabs").mkdir()
    doc = {"meta": {"project": "p", "analyzedAt": "t"}, "nodes": [{"id": "a", "type": "x", "label": "A"}], "edges": [{"id": "e", "source": "a", "target": "b", "type": "t"}]}
    (tmp_path / "tabs/one.json").write_text(json.dumps(doc))
    nodes, edges, meta = io.read_graph(spark, str(tmp_path / "tabs"))
    assert nodes.first().tab_id == "one" and edges.first().target == "b" and meta.first().project == "p"
    (tmp_path / "log.txt").write_text("@@2024-02-01␟ann\na.php\nb@@c.php\n\n@@2020-01-01␟bob\na.php\n")
    log = io.read_commit_log(spark, str(tmp_path / "log.txt"), "2021-01-01")
    assert {(r.author, r.file) for r in log.collect()} == {("ann", "a.php"), ("ann", "b@@c.php")}
    (tmp_path / "m.json").write_text(json.dumps({"name": "n", "require": {"a": "1"}, "require-dev": {"b": "2"}}))
    assert rows(io.read_manifests(spark, str(tmp_path / "m.json"))) == [("n", "a", "1", False), ("n", "b", "2", True)]
    (tmp_path / "s.json").write_text('{"table": "t", "columns": [{"name": "c", "type": "int"}]}\nbroken\n')
    s = io.read_table_schemas(spark, str(tmp_path / "s.json")).cache()
    assert s.where("table = 't'").count() == 1 and s.where("_corrupt_record is not null").count() == 1
    (tmp_path / "rounds").mkdir()
    (tmp_path / "rounds/r.json").write_text(json.dumps({"arm": "a", "scenarios": {"x": {"times_ms": [1.5, 2.5], "counts": {"n": 3}, "phases_ms": {"p": 0.5}}}}))
    assert rows(io.read_rounds(spark, str(tmp_path / "rounds")).select("arm", "scenario", "rep", "ms")) == [("a", "x", 0, 1.5), ("a", "x", 1, 2.5)]
    assert io.fingerprint(spark, str(tmp_path / "tabs")).first().length == (tmp_path / "tabs/one.json").stat().st_size
    tabs = spark.createDataFrame([("t1", 1), ("t2", 2)], "tab_id string, id int")
    io.write_tabs(tabs, str(tmp_path / "out"))
    io.write_tabs(spark.createDataFrame([("t1", 9)], "tab_id string, id int"), str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("tab_id", "id")) == [("t1", 9), ("t2", 2)]
    tabs.union(spark.createDataFrame([("it's \\\\", 3)], tabs.schema)).write.partitionBy("tab_id").saveAsTable("stored_tabs")
    place = spark.conf.get("spark.sql.warehouse.dir") + "/stored_tabs"
    assert io.prune_tabs(spark, "stored_tabs", tabs.where("tab_id = 't2'")) == 2 and rows(spark.table("stored_tabs").select("tab_id")) == [("t2",)]
    assert rows(spark.read.parquet(place).select("tab_id")) == [("t2",)]
    spark.sql("DROP TABLE stored_tabs")
    stats = io.table_stats(spark, {"a": str(tmp_path / "out")})
    other = spark.createDataFrame([("a", 9, 1, 2, 3), ("b", 8, 1, None, 1)], "table string, rows long, table_bytes long, index_bytes long, total_bytes long")
    merged = {r.table: r for r in io.merge_stats(stats, other).collect()}
    assert merged["a"].rows == 2 and not merged["a"].estimated and merged["a"].index_bytes == 2 and merged["b"].estimated
    size = sum(f.stat().st_size for f in (tmp_path / "out").rglob("*.parquet"))
    assert merged["a"].total_bytes == size
    for table in (tabs, spark.createDataFrame([("t1", 5), ("t1", 4), ("t3", 6)], "tab_id string, id int")):
        io.upsert(table, str(tmp_path / "unique"), "tab_id", buckets=2)
    assert rows(spark.read.parquet(str(tmp_path / "unique")).select("tab_id", "id")) == [("t1", 5), ("t2", 2), ("t3", 6)]
    (tmp_path / "found.json").write_text(json.dumps({"findings": [{"file": "a", "ruleId": "x.weak-validation", "severity": "HIGH"}, {"file": "a", "ruleId": "x.ssrf.http-client", "line": 3}, {"file": "b", "severity": "style", "message": "m"}, {"ruleId": "lost"}]}))
    got = rows(io.read_findings(spark, str(tmp_path / "found.json")).select("file", "type", "severity", "message"))
    assert got == [("a", "SSRF", "medium", "x.ssrf.http-client"), ("a", "UNVALIDATED_INPUT", "high", "x.weak-validation"), ("b", "UNKNOWN", "medium", "m")]


def run_stream(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_streams_equal_their_batch_twins(spark, tmp_path):
    data = [(i, f"2024-01-01 {i // 4:02d}:{i % 4 * 15:02d}:00", i % 3, ("view", "click")[i // 5 % 2], float(i)) for i in range(80)]
    batch = spark.createDataFrame(data, "event_id long, t string, user_id long, event_type string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value")
    batch.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    last = batch.agg(F.max("ts")).first()[0]

    keyed = lambda df: df.select("ts", F.col("event_type").alias("key"), F.col("value").alias("ms"))
    run_stream(streams.churn_windows(keyed(stream), "4 hours", "2 hours", "0 seconds"), "append", "windows")
    twin = streams.churn_windows(keyed(batch), "4 hours", "2 hours", "0 seconds").where(F.col("start") + F.expr("interval 4 hours") <= F.lit(last))
    assert rows(spark.table("windows")) == rows(twin)
    run_stream(streams.timing_windows(keyed(stream), "4 hours", "0 seconds"), "append", "timing")
    twin = streams.timing_windows(keyed(batch), "4 hours", "0 seconds").where(F.col("start") + F.expr("interval 4 hours") <= F.lit(last))
    assert rows(spark.table("timing")) == rows(twin)
    run_stream(streams.dedupe_events(stream, ["user_id", "event_type"], "10 days"), "append", "once")
    assert rows(spark.table("once").select("user_id", "event_type")) == rows(streams.dedupe_events(batch, ["user_id", "event_type"], "10 days").select("user_id", "event_type"))
    cascade = lambda df: streams.session_cascade(df.where("hour(ts) not in (8, 9)").select("ts", "user_id", "event_type"), "50 minutes", "0 seconds")
    run_stream(cascade(stream), "append", "bursts")
    assert rows(spark.table("bursts")) == rows(cascade(batch).where("start < '2024-01-01 08:00:00'")) and spark.table("bursts").where("size(transitions) > 1").count() == 3


def test_change_feed_over_batches_equals_one_batch(spark, tmp_path):
    def put(n, *facts):
        spark.createDataFrame([(p, h, f"2024-01-01 00:00:{t:02d}") for p, h, t in facts], "path string, hash string, t string").select("path", "hash", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("path string, hash string, ts timestamp").parquet(str(tmp_path / "in"))
        streams.change_feed(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)

    put(0, ("a", "1", 1), ("a", "1", 2), ("b", "1", 3), ("a", "2", 4))
    put(1, ("a", "2", 5), ("b", "2", 6), ("c", "1", 7))
    put(2, ("b", "2", 8), ("a", "1", 9))
    got = rows(spark.read.parquet(str(tmp_path / "out")).select("path", "hash", "change", F.second("ts")))
    assert got == rows(streams.changes(spark.read.parquet(str(tmp_path / "in"))).select("path", "hash", "change", F.second("ts")))
    assert got == [("a", "1", "added", 1), ("a", "1", "modified", 9), ("a", "2", "modified", 4), ("b", "1", "added", 3), ("b", "2", "modified", 6), ("c", "1", "added", 7)]


def test_incremental_merge_is_scoped_or_full(spark, tmp_path):
    schema = "id string, label string, ord long, file string"
    old = spark.createDataFrame([("a", "1", 0, "f"), ("b", "1", 1, "g"), ("c", "1", 2, "f")], schema)
    edges = spark.createDataFrame([("a", "b", "t")], "source string, target string, type string")
    full = old.withColumn("label", F.lit("3"))
    for n, (fresh, now, want) in enumerate(
        [
            ([("a", "2", 9, "f")], edges, [("a", "2", 0, "f"), ("b", "1", 1, "g")]),
            ([("a", "2", 9, "f"), ("c", "2", 9, "f")], edges.limit(0), rows(full)),
            ([("b", "2", 9, "f")], edges, rows(full)),
        ]
    ):
        path, feed = str(tmp_path / f"nodes{n}"), str(tmp_path / f"in{n}")
        old.write.partitionBy("file").parquet(path)
        spark.createDataFrame(fresh, schema).write.parquet(feed)
        streams.incremental_merge(spark.readStream.schema(schema).parquet(feed), path, str(tmp_path / f"ck{n}"), lambda files, now=now: (edges, now), lambda: full).awaitTermination(120)
        assert rows(spark.read.parquet(path).select("id", "label", "ord", "file")) == want


def test_late_rows_are_counted_and_backfilled(spark, tmp_path):
    at = lambda *hours: spark.createDataFrame([(f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00", "k") for h in hours], "t string, key string").select(F.to_timestamp("t").alias("ts"), "key").coalesce(1)
    daily = lambda df: streams.churn_windows(df, "1 day", "1 day", "1 hour")
    for part in (at(1, 2, 30), at(60), at(3, 61)):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("ts timestamp, key string").parquet(str(tmp_path / "in"))
        q = daily(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert streams.late_rows(q) == 1
    whole = spark.read.parquet(str(tmp_path / "in"))
    daily(whole.where("ts < '2024-01-02'")).withColumn("day", F.to_date("start")).where("commits < 0").write.partitionBy("day").parquet(str(tmp_path / "days"))
    streams.backfill(whole, str(tmp_path / "days"), ["2024-01-01", "2024-01-02"], daily)
    assert rows(spark.read.parquet(str(tmp_path / "days")).select(F.col("day").cast("string"), "commits")) == [("2024-01-01", 3), ("2024-01-02", 1)]
