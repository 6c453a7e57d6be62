"""Two builds meet once, by their keys, and ids may be numbers."""

from pyspark.sql import functions as F

from cairngraph.operators import closure, diff, graph, rewire
from cairngraph.plans import g1

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def builds(spark):
    n = lambda *r: spark.createDataFrame(r, "id string, file string, label string")
    e = lambda *r: spark.createDataFrame(r, "source string, target string, type string, label string")
    old = n(("a", "f", "a"), ("b", "g", "b"), ("c", "g", "c"), ("d", None, "d")), e(("a", "b", "t", "x"), ("b", "c", "t", "x"), ("c", "d", "t", "x"), ("c", "d", "t", "x"), ("d", "a", "t", "x"))
    new = n(("a", "f", "A"), ("b", "g", "B"), ("c", "g", "C"), ("d", None, "D"), ("e", "g", "E")), e(("a", "b", "t", "y"), ("b", "c", "t", "y"), ("c", "d", "t", "y"), ("e", "e", "t", "y"), (None, "d", "t", "y"))
    return old, new


def test_reconstruct_reads_the_edges_once(spark):
    (old_n, old_e), (new_n, new_e) = builds(spark)
    got_n, got_e = diff.reconstruct(old_n, old_e, new_n, new_e, spark.createDataFrame([("f",)], "file string"))
    assert rows(got_e) == [("a", "b", "t", "y"), ("b", "c", "t", "x"), ("c", "d", "t", "x"), ("e", "e", "t", "y"), (None, "d", "t", "y")]
    assert rows(got_n) == [("a", "f", "A"), ("b", "g", "b"), ("c", "g", "C"), ("d", None, "D"), ("e", "g", "E")]
    assert all("Window" not in x._jdf.queryExecution().optimizedPlan().toString() for x in (got_n, got_e))  # numbered and met before


def test_pairs_of_signatures_are_those_of_both_graphs(spark):
    (old_n, old_e), (new_n, new_e) = builds(spark)
    pairs = diff.signature_pairs(old_n, old_e, new_n, new_e, ("label",))
    for side, n, e in (("old", old_n, old_e), ("new", new_n, new_e)):
        assert rows(pairs.where(f"{side} is not null").select("kind", "id", side)) == rows(diff.graph_signature(n, e, ("label",)))
    a, b, odd = diff.pair_trees(pairs, 2)
    both = pairs.where("not (old <=> new)").groupBy("kind", diff.id_range("id", 2)).count()
    assert rows(diff.tree_diff(a, b).join(odd, ["kind", "range"])) == rows(both)
    assert {(r.level, r.kind): r.n for r in a.groupBy("level", "kind").agg(F.sum("n").alias("n")).collect()} == {(1, "node"): 4, (2, "node"): 4, (1, "edge"): 5, (2, "edge"): 5}


def test_coded_ids_have_the_names(spark):
    for table, ids in ((g1.nodes, ["id"]), (g1.edges, ["source", "target"])):
        coded = table(spark, SF, coded=True)
        assert all(dict(coded.dtypes)[c] == "bigint" for c in ids)
        assert coded.withColumns({c: g1.name(c) for c in ids}).exceptAll(table(spark, SF)).isEmpty()
    odd = spark.createDataFrame([(-3,), (None,), (2**59,)], "k long")
    assert [r[0] for r in odd.select(g1.name(g1.code("part", "k"))).collect()] == ["part::-3", None, f"part::{2**59}"]


def test_sides_are_counted_in_one_pass(spark):
    e = lambda *r: spark.createDataFrame(r, "source string, target string, type string")
    old, new = e(("a", "b", "t"), ("a", "b", "t"), ("c", "d", "t"), (None, "d", "t")), e(("a", "b", "t"), ("c", "d", "t"), ("x", "y", "t"), (None, "d", "t"))
    got = diff.edge_delta(old, new)
    assert rows(got) == sorted([("a", "b", "t", 1, "removed"), ("x", "y", "t", 0, "added"), (None, "d", "t", 0, "removed"), (None, "d", "t", 0, "added")], key=str)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_sequence_of_numbers_is_that_of_names(spark):
    got = []
    for coded in (False, True):
        n = g1.nodes(spark, SF, coded).where("type in ('nation', 'customer', 'order') or ord % 7 = 0")
        start = n.where("type = 'nation' and label = 'NATION_1'").select("id")
        to = {"name": g1.name, "order": ("ord", "target")} if coded else {}
        made = closure.sequence(n, g1.edges(spark, SF, coded).withColumn("label", F.lit("x")), start, {"nation": 0}, "part", **to)
        got.append([rows(made[0].select("id", "type")), rows(made[1].select("sender", "receiver", "label", "is_return"))])
    assert got[0] == got[1] and got[0][1]


def test_evidence_meets_the_unreached_once_and_takes_numbers(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    filed = lambda *x: spark.createDataFrame(list(x), "id long, file string")
    classes = spark.createDataFrame([(9, 1, [2, None], None), (8, 3, None, [4]), (9, None, None, [5])], "id long, parent long, interfaces array<long>, traits array<long>")
    unreached = filed((1, "f"), (2, "f"), (3, None), (4, "f"), (5, "f"), (5, "g"), (6, "f"), (6, "f"))
    got = rewire.evidence(unreached, bound=ids(1, 1, 2, 7), facades=ids(2, 7), inherited=rewire.inherited(classes, ids(9, 9)), configured=filed((1, "f"), (2, "g"), (2, "h"), (3, None), (4, None)), mentioned=filed((3, "f"), (4, "f"), (5, "f"), (1, "g")))
    assert rows(got) == sorted([(1, "f", ["bound", "inherited", "mentioned"]), (2, "f", ["facade", "configured", "inherited"]), (3, None, ["mentioned"]), (4, "f", ["configured"]), (5, "f", ["inherited", "mentioned"]), (5, "g", ["inherited", "mentioned"]), (6, "f", []), (6, "f", [])], key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == plan.count("strategy=shuffle_hash") == 1  # all five in one join, which sorts none of them


def test_usages_of_numbers_are_dealt_out_by_target_once(spark):
    nodes = spark.createDataFrame([(1, "T", "service", "f"), (2, "A", "action", "f"), (3, None, "job", "f"), (4, "C", None, None)], "id long, label string, type string, file string")
    edges = spark.createDataFrame([(2, 1, "y", "calls", 2), (2, 1, "x", "calls", 1), (2, 1, "x", "uses", 3), (2, 1, None, "calls", None), (3, 1, "", None, 0), (4, 1, "z", "z", 0), (-9, 1, "q", "q", 0), (1, 1, "q", "q", 0), (None, 1, "q", "q", 0), (2, 8, "q", "q", 0), (2, None, "q", "q", 0), (2, 4, "q", "q", 0)], "source long, target long, label string, type string, ord long")
    got = graph.usage_list(nodes, edges, spark.createDataFrame([(1,), (1,)], "id long"), lambda c: F.concat(F.lit("n"), F.col(c).cast("string")))
    assert rows(got) == [("n1", "#n-9", 1, "n-9", "n-9", "unknown", "q", "q"), ("n1", "#n4", 1, "n4", "C", "unknown", "z", "z"), ("n1", "f", 2, "n2", "A", "action", "x, y", "calls, uses"), ("n1", "f", 2, "n3", "n3", "job", "", "")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("strategy=shuffle_hash") == 2  # no sort for the joins
    counted = graph.usages(nodes, edges, spark.createDataFrame([(1,), (1,)], "id long"), lambda c: F.concat(F.lit("n"), F.col(c).cast("string")))
    assert [tuple(r) for r in counted.collect()] == [("n1", "f", 2), ("n1", "#n-9", 1), ("n1", "#n4", 1)]


def test_numbers_stand_for_the_names_of_the_wide_graph(spark):
    named = g1.wide_edges(spark, SF, coded=True).select(g1.name("source").alias("source"), F.when(F.col("target") >= 0, g1.name("target")).alias("target"), "type", "ord")
    only_named = F.col("type").isin("customer-to-segment", "part-to-brand", "order-to-priority")
    assert rows(named) == rows(g1.wide_edges(spark, SF).withColumn("target", F.when(~only_named, F.col("target"))))
    assert rows(g1.wide_nodes(spark, SF, coded=True).withColumn("id", g1.name("id"))) == rows(g1.wide_nodes(spark, SF))
