"""Orders that several files, blocks or levels make up, and what is found by ranges."""

import random
import time
from collections import deque

from pyspark.sql import functions as F

from cairngraph.operators import aggs, closure, diff, rewire
from cairngraph.sources import io


def test_the_newer_log_comes_first_whatever_its_size(spark, tmp_path):
    (tmp_path / "b-small.txt").write_text("@@2024-05-01␟new\na.php\n")
    (tmp_path / "a-large.txt").write_text("before any header\n@@2020-01-01␟old\na.php\n" + "".join(f"\n@@2019-01-01␟older\nf{i}.php\n" for i in range(300)))
    got = {r.file: r for r in aggs.churn(io.read_commit_log(spark, str(tmp_path))).collect()}
    assert (str(got["a.php"].last_changed), got["a.php"].last_author, got["a.php"].commits) == ("2024-05-01", "new", 2)
    assert len(got) == 301


def test_split_logs_keep_their_order(spark, tmp_path):
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for part, days in (("one", range(28, 14, -1)), ("two", range(14, 0, -1))):
        (tmp_path / f"{part}.txt").write_text("".join(f"@@2024-01-{d:02}␟{part}{d}.{k}\n{'x' * 40}.php\nshared.php\n" for d in days for k in range(9, 0, -1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = io.read_commit_log(spark, str(tmp_path)).where("file = 'shared.php'").orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.author for r in rows] == [f"{p}{d}.{k}" for p, days in (("one", range(28, 14, -1)), ("two", range(14, 0, -1))) for d in days for k in range(9, 0, -1)]
    assert [r.ord for r in rows] == list(range(len(rows)))


def test_an_unreadable_date_is_null_and_not_since(spark, tmp_path):
    (tmp_path / "log.txt").write_text("@@2024-02-30␟x\na\n\n@@soon␟y\nb\n")
    assert [(r.commit_date, r.author, r.file) for r in io.read_commit_log(spark, str(tmp_path)).orderBy("ord").collect()] == [(None, "x", "a"), (None, "y", "b")]
    assert io.read_commit_log(spark, str(tmp_path), "2020-01-01").count() == 0


def walked(edges, start):
    """The reference walk: first in, first out."""
    out = {}
    for s, t, k, o in sorted(edges, key=lambda e: (e[3], e[1], e[2])):
        out.setdefault(s, []).append((t, o))
    seen, queue, calls = [start], deque([start]), []
    while queue:
        at = queue.popleft()
        for t, _ in out.get(at, []):
            calls.append((at, t))
            if t not in seen:
                seen.append(t)
                queue.append(t)
    return seen, calls


def test_a_walk_finishes_one_caller_before_the_next(spark):
    rng = random.Random(11)
    edges = list({(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", "t", n % 60) for n in range(130)}) + [("n1", "n2", "t", 5), ("n1", "n0", "t", 5)]
    edges = list({(s, t): e for e in edges for s, t in [e[:2]]}.values())
    df = spark.createDataFrame(edges, "source string, target string, type string, ord long").withColumn("label", F.lit("call"))
    places, calls = walked(edges, "n1")
    got = closure.breadth_first(df, spark.createDataFrame([("n1",)], "id string"))
    assert [r.id for r in got.orderBy("place").collect()] == places
    assert sorted(r.place for r in got.collect()) == list(range(len(places)))
    nodes = spark.createDataFrame([(f"n{i}", "service") for i in range(40) if i != 7], "id string, type string")
    _, said = closure.sequence(nodes, df, nodes.where("id = 'n1'"))
    want = [c for c in calls if c[0] != c[1] and "n7" not in c]
    assert [(r.sender, r.receiver) for r in said.where("label = 'call'").orderBy("pos").collect()] == want


def test_callers_of_one_depth_do_not_interleave(spark):
    edges = [("r", "b", "t", 0), ("r", "a", "t", 1), ("b", "c", "t", 9), ("a", "c", "t", 2)]
    df = spark.createDataFrame(edges, "source string, target string, type string, ord long").withColumn("label", F.lit("call"))
    nodes = spark.createDataFrame([(i, "service") for i in "rabc"], "id string, type string")
    _, said = closure.sequence(nodes, df, nodes.where("id = 'r'"))
    assert [(r.sender, r.receiver) for r in said.where("label = 'call'").orderBy("pos").collect()] == [("r", "b"), ("r", "a"), ("b", "c"), ("a", "c")]


def test_places_are_counted_over_ranges(spark):
    values = [(n * 7919 % 1000 if n % 3 else None,) for n in range(1, 700)]
    got = aggs.numbered(spark.createDataFrame(values, "v long").repartition(5), [F.col("v").desc_nulls_last()], "place", 10).orderBy("place").collect()
    assert [r.v for r in got] == sorted((v for (v,) in values), key=lambda v: (v is None, -(v or 0)))
    assert [r.place for r in got] == list(range(10, 10 + len(values)))


def signed(spark, nodes, edges):
    return diff.graph_signature(spark.createDataFrame(nodes, "id string, type string, label string"), spark.createDataFrame(edges, "source string, target string, type string, label string"))


def test_different_graphs_sign_differently(spark):
    edge = ("a", "b", "t", "l")
    for one, two in (
        (([("n", "x|y", None)], [edge]), ([("n", "x", "y")], [edge])),
        (([("n", "x", "")], [edge]), ([("n", "x", None)], [edge])),
        (([("n", "x", "1:y;")], [edge]), ([("n", "x1:y;", "")], [edge])),
        (([("n", "x", "y")], [edge]), ([("n", "x", "y")], [("a", "b", "t", "m")])),
        (([("n", "x", "y")], [("a|b", "c", "t", None)]), ([("n", "x", "y")], [("a", "b|c", "t", None)])),
        (([("n", "x", "y")], [edge, edge]), ([("n", "x", "y")], [edge])),
    ):
        a, b = signed(spark, *one), signed(spark, *two)
        assert diff.signature_diff(a, b).count() > 0
        assert diff.tree_diff(diff.signature_tree(a, 2), diff.signature_tree(b, 2)).count() > 0
    nodes, edges = [("n", "x", "y"), ("m", None, None)], [edge, ("a", "b", "t", "k"), edge]
    a, b = signed(spark, nodes, edges), signed(spark, nodes[::-1], edges[::-1])
    assert diff.signature_diff(a, b).count() == 0
    assert diff.tree_diff(diff.signature_tree(a, 2), diff.signature_tree(b, 2)).count() == 0


def test_ranges_hold_all_differences(spark):
    nodes = [(f"n{i}", "t", str(i % 7)) for i in range(3000)]
    other = [(i, t, "new" if i in ("n5", "n17") else x) for i, t, x in nodes if i != "n40"] + [("extra", "t", "0")]
    a, b = signed(spark, nodes, []), signed(spark, other, [])
    ranges = diff.tree_diff(diff.signature_tree(a, 3), diff.signature_tree(b, 3))
    assert ranges.count() <= 4
    assert {r.id for r in diff.signature_diff(a, b, ranges, 3).collect()} == {r.id for r in diff.signature_diff(a, b).collect()} == {"n5", "n17", "n40", "extra"}


def test_findings_meet_the_spans_around_them(spark):
    rng = random.Random(5)
    spans = [(rng.choice("fg"), n, a, a + rng.choice([0, 1, 3, 50, 700, -1])) for n in range(200) for a in [rng.randrange(-20, 1000)]] + [("f", 900, None, 3), (None, 901, 1, 5)]
    found = [(n, rng.choice("fgh"), rng.choice([None, rng.randrange(-30, 1100)])) for n in range(150)] + [(999, None, 3)]
    got = rewire.range_findings(spark.createDataFrame(found, "n long, file string, line long"), spark.createDataFrame(spans, "file string, id long, first long, last long"))
    want = sorted((n, i) for n, f, at in found for g, i, a, b in spans if f is not None and f == g and (at is None or (a is not None and a <= at <= b)))
    assert sorted((r.n, r.id) for r in got.collect()) == want


def test_a_file_of_many_spans_is_not_paired_whole(spark):
    n = 100_000
    spans = spark.range(n).select(F.lit("f").alias("file"), "id", (F.col("id") * 10).alias("first"), (F.col("id") * 10 + 9).alias("last"))
    found = spark.range(n).select(F.lit("f").alias("file"), (F.col("id") * 10 + 3).alias("line"))
    start = time.time()
    assert rewire.range_findings(found, spans).where("line between first and last").count() == n
    assert time.time() - start < 60
