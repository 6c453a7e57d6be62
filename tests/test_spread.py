"""Orders with outliers and sparse values, and graphs' odd corners."""

from pyspark.sql import functions as F

from cairngraph.operators import aggs, closure, diff, graph, text
from cairngraph.sources import io


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols or df.columns).collect()), key=str)


def test_an_outlier_does_not_put_all_values_in_one_range(spark):
    n = 5000
    df = spark.range(n).select(F.lit("g").alias("g"), F.when(F.col("id") == 0, 1e12).otherwise(F.col("id") / 7).alias("v"))
    got = aggs.order_stats(df, ["g"], "v", {"mid": F.floor(F.col("n") / 2), "top": F.col("n") - 1}).first()
    assert (got.n, got.low, got.mid, got.top) == (n, 1 / 7, (n // 2 + 1) / 7, 1e12)
    cuts = df.agg(F.percentile_approx("v", [k / aggs.BINS for k in range(1, aggs.BINS)], 20 * aggs.BINS).alias("c"))
    held = df.join(F.broadcast(cuts)).groupBy(F.size(F.filter("c", lambda c: c < F.col("v")))).count()
    assert held.agg(F.max("count")).first()[0] < 3 * n / aggs.BINS


def test_ranges_are_cut_once(spark):
    n = 300_000
    df = spark.range(n, numPartitions=24).select((F.col("id") % 3).alias("g"), (F.hash("id") % 20_000).cast("double").alias("v"))
    places = {"mid": F.floor(F.col("n") / 2), "top": F.floor(F.col("n") * 0.95)}
    got = aggs.order_stats(df, ["g"], "v", places)
    assert "percentile_approx" not in got._jdf.queryExecution().optimizedPlan().toString()  # two plans of one cut may differ
    for r in got.collect():
        v = sorted(x.v for x in df.where(F.col("g") == r.g).collect())
        assert (r.mid, r.top) == (v[len(v) // 2], v[int(len(v) * 0.95)])


def test_running_sums_over_sparse_orders(spark):
    ids = [k * 2**40 + (k * 7919) % 1000 for k in range(400)] + [2**62]
    df = spark.createDataFrame([("a", i, 1) for i in ids] + [("b", None, 2), ("b", 5, 3)], "g string, k long, s long")
    got = {(r.g, r.k): r.t for r in aggs.running(df, "g", "k", "s", "t").collect()}
    assert got == {("a", k): n + 1 for n, k in enumerate(sorted(ids))} | {("b", None): 2, ("b", 5): 5}


def test_a_tab_without_a_name_is_pruned(spark):
    spark.sql("DROP TABLE IF EXISTS odd_tabs")
    spark.createDataFrame([(1, None), (2, "it's"), (3, "kept"), (4, "a\\b")], "x int, tab_id string").write.partitionBy("tab_id").saveAsTable("odd_tabs")
    keep = spark.createDataFrame([("kept",)], "tab_id string")
    assert io.prune_tabs(spark, "odd_tabs", keep) == 3
    assert rows(spark.table("odd_tabs")) == [(3, "kept")]
    assert io.stale_tabs(spark.createDataFrame([(None,), ("x",)], "tab_id string"), spark.createDataFrame([(None,)], "tab_id string")).collect()[0].tab_id == "x"
    spark.sql("DROP TABLE odd_tabs")


def test_roots_end_at_their_name(spark):
    d = lambda path: spark.createDataFrame([(path, "modified")], "path string, change string")
    assert [diff.scope_decision(d(p), ["src"]).first()[0] for p in ("src/a", "src", "src2/a")] == ["list", "list", "full"]


def test_usages_name_the_edges(spark):
    nodes = spark.createDataFrame([("t", "T", "service", "f"), ("a", "A", "action", "f"), ("b", "B", "job", "f"), ("c", "C", "job", "")], "id string, label string, type string, file string")
    edges = spark.createDataFrame([("a", "t", "y", "calls", 2), ("a", "t", "x", "calls", 1), ("a", "t", "", "uses", 3), ("a", "t", "x", "uses", 4), ("b", "t", None, "calls", 0), ("c", "t", "z", "z", 0), ("ghost", "t", "q", "q", 0), ("t", "t", "q", "q", 0), ("", "t", "q", "q", 0), ("a", "gone", "q", "q", 0)], "source string, target string, label string, type string, ord long")
    assert rows(graph.usage_list(nodes, edges)) == [("t", "#c", 1, "c", "C", "job", "z", "z"), ("t", "#ghost", 1, "ghost", "ghost", "unknown", "q", "q"), ("t", "f", 2, "a", "A", "action", "x, y", "calls, uses"), ("t", "f", 2, "b", "B", "job", "", "calls")]


def test_members_are_not_looked_for_in_the_framework(spark):
    parents = spark.createDataFrame([("App\\A", "App\\B"), ("App\\B", "Illuminate\\C"), ("Illuminate\\C", "App\\D")], "child string, parent string")
    methods = spark.createDataFrame([("Illuminate\\C", "go"), ("App\\D", "go"), ("App\\B", "run"), ("App\\A", "own")], "id string, method string")
    asked = spark.createDataFrame([("App\\A", m) for m in ("go", "run", "own")], "id string, method string")
    got = closure.resolve_member(parents, methods, asked)
    assert rows(got) == [("App\\A", "own", "App\\A", 0), ("App\\A", "run", "App\\B", 1)]
    found, new = closure.inherited_methods(spark.createDataFrame([("x",)], "id string"), got.union(got))
    assert rows(found) == [("app_a::run", "app_b::run", "→ B::run", "inherits-method")]
    assert rows(new) == [("app_b::run", "App\\B", "run", "B@run")]


def test_template_tags_of_any_case(spark):
    s = spark.createDataFrame([("p", "< x-My_card.Top/> <x-slot name=a> <x-pkg::a> <x-dynamic-component> @include  ( 'a b' ) @includeWhen ( $x , \"c\" )")], "name string, text string")
    names = spark.createDataFrame([(n,) for n in ("a b", "c", "components.My_card.Top", "components.pkg", "components.slot", "components.slot.index", "components.dynamic-component", "components.My")], "name string")
    assert {r.child for r in text.template_refs(s, names).collect()} == {"a b", "c", "components.My_card.Top"}


def test_neighbours_come_by_type_and_then_by_edge(spark):
    nodes = spark.createDataFrame([("r", "route"), ("v", "view"), ("s", "service"), ("o", "odd"), ("m", "model"), ("z", "service")], "id string, type string")
    edges = spark.createDataFrame([("r", "o", 0), ("r", "v", 1), ("r", "z", 3), ("r", "s", 2), ("s", "m", 5), ("v", "m", 0), ("m", "far", 0), ("r", "gone", 0)], "source string, target string, ord long")
    got = closure.neighbourhood(nodes, edges, spark.createDataFrame([("r",)], "id string"), 2).orderBy("place").collect()
    assert [(r.id, r.depth) for r in got] == [("r", 0), ("s", 1), ("z", 1), ("v", 1), ("o", 1), ("m", 2)]


def test_longest_paths_take_the_first_of_equal_ones(spark):
    import random

    rng = random.Random(9)
    parents = {n: (rng.randrange(max(0, n - 9), n), rng.randrange(4)) for n in range(2, 120) if n % 40}
    edges = [(f"n{p}", f"n{c}", o) for c, (p, o) in parents.items()] + [("c1", "c2", 0), ("c2", "c1", 0), ("c1", "c3", 0), ("x", "lost", 0), ("n0", "n0", 0)]
    below = {}
    for s, t, o in edges:
        below.setdefault(s, []).append((o, t))

    def best(at):
        found = [best(t) for _, t in sorted(below.get(at, [])) if t != at]
        return [at, *max(found, key=len, default=[])]

    nodes = spark.createDataFrame([(f"n{i}",) for i in range(120)] + [("c1",), ("c2",), ("c3",), ("lost",)], "id string")
    got = closure.longest_path(nodes, spark.createDataFrame(edges, "source string, target string, ord long"))
    assert {r.root: (r.length, r.path) for r in got.collect()} == {f"n{i}": (len(best(f"n{i}")), best(f"n{i}")) for i in range(120) if i not in parents}


def test_a_long_chain_takes_few_rounds(spark):
    n = 3000
    chain = spark.range(n).select(F.concat(F.lit("k"), "id").alias("source"), F.concat(F.lit("k"), F.col("id") + 1).alias("target"), F.lit(0).alias("ord"))
    got = closure.longest_path(chain.select(F.col("source").alias("id")), chain).collect()
    assert [(r.root, r.length, r.path[-1]) for r in got] == [("k0", n + 1, f"k{n}")]


def test_tabs_that_share_seeds_are_walked_once(spark):
    hub = [("hub", f"n{k}") for k in range(50)] + [("hub", f"leaf{k}") for k in range(40)] + [("n1", "n2"), ("n2", "n1"), ("far", "end")]
    e = spark.createDataFrame([(a, b, "calls") for a, b in hub] + [("n3", "never", "bind")], "source string, target string, type string")
    pairs = [(f"t{k}", s) for k in range(40) for s in (f"leaf{k}", "hub")] + [("loop", "n1"), ("loop", "n2"), ("two", "far"), ("two", "n1"), ("gone", "no node")] + [("many", f"n{k}") for k in range(12)]
    seeds = spark.createDataFrame(pairs, "tab_id string, id string")
    tabs, members = closure.tab_classes(e, seeds, ["bind"])
    assert rows(tabs.join(members, "class"), "tab_id", "id") == rows(closure.tab_closure(e, seeds, ["bind"]), "tab_id", "id")
    assert tabs.where("tab_id rlike '^t[0-9]'").select("class").distinct().count() == 1
    assert members.count() == 91 + 2 + 4 + 1 + 12
    listed = spark.createDataFrame([("t3",), ("two",), ("many",)], "tab_id string")
    sizes, own = closure.tab_sizes(e, seeds, listed, ["bind"])
    want = closure.tab_closure(e, seeds, ["bind"]).select("tab_id", "id")
    assert rows(own, "tab_id", "id") == rows(want.join(listed, "tab_id", "left_semi"), "tab_id", "id")
    assert rows(sizes, "tab_id", "n") == rows(want.join(listed, "tab_id", "left_anti").groupBy("tab_id").agg(F.count("*").alias("n")), "tab_id", "n")


def test_families_of_tabs_are_walked_as_numbers(spark):
    from cairngraph.plans import q_graph

    got = q_graph.tab_families(spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "::" not in plan
    assert {r.family for r in got.collect()} == {"route", "command", "channel", "macro", "schedule", "page"}


def test_repeated_edges_are_merged_as_numbers(spark):
    from cairngraph.plans import g1

    e = g1.edges(spark, "/root/testdata/sf0.001")
    assert e.count() == e.distinct().count()
    merged = [line for line in e._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line]
    assert len(merged) == 2 and all("l_partkey" in line.split("], [")[0] and "::" not in line.split("], [")[0] for line in merged)
